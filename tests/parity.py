"""Runs a query and its SQL over the same folder and compares the rows; NaN and null differ."""

import datetime
import decimal
import math
import os
from collections import Counter
from functools import cache

import duckdb

FOLDER = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")


@cache
def database():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        path = f"{FOLDER}/{name}"
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return connection


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return "NaN" if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(table):
    names = sorted(table.column_names)
    if not table.num_rows:
        return names, Counter()
    return names, Counter(zip(*([plain(v) for v in table.column(n).to_pylist()] for n in names)))


def compare(spark, query, sql):
    mine, theirs = rows(query(spark, FOLDER).toArrow()), rows(database().sql(sql).to_arrow_table())
    assert mine[0] == theirs[0]
    assert not (mine[1] - theirs[1]) and not (theirs[1] - mine[1])
