"""Beyond the batch engine: incremental scoring and stagnation over streams (§2.12)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import encoding, model


def score_new_files(
    spark: SparkSession, source: str, schema: StructType, features: Sequence[encoding.Feature], stats: dict[str, tuple[float, float]],
    fitted: model.Fitted, keep: Sequence[str], target: str, checkpoint: str,
) -> StreamingQuery:
    """Scores the parquet files that have come since the last call, each once."""
    rows = spark.readStream.schema(schema).parquet(source)
    scored = model.score(encoding.encode(rows, features, stats), fitted, keep)
    return scored.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stagnation_stream(history: DataFrame, min_delta: float) -> DataFrame:
    """WIN-06 over a stream of (run, epoch, loss, units): the stagnant epochs so far after each."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, units, count = state.get if state.exists else (float("inf"), -1, 0)
        for part in parts:
            out = []
            for epoch, loss, active in part.sort_values("epoch")[["epoch", "loss", "units"]].itertuples(index=False):
                gain = (best - loss) / abs(best) if best not in (0.0, float("inf")) else float("inf")
                count = count + 1 if gain <= min_delta and active == units else 0
                best, units = min(best, loss), active
                out.append((key[0], epoch, count))
            yield pd.DataFrame(out, columns=["run", "epoch", "stagnant"])
        state.update((float(best), int(units), int(count)))

    return history.groupBy("run").applyInPandasWithState(step, "run bigint, epoch int, stagnant bigint", "best double, units int, count bigint", "append", GroupStateTimeout.NoTimeout)
