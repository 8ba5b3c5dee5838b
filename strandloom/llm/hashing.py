"""Random keys that any engine can recompute: 52 bits of an MD5 digest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys are whole numbers below this.
SPAN = 1 << 52


def random_key(seed: int | str, *parts: Column) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def random_key_sql(seed: int | str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST(('0x' || substr(md5({text}), 1, 13)) AS BIGINT)"
