"""Sliding windows of rows per code on a stream.

A stream's element is a day's rows. Each code keeps its last ``rows`` values in state, missing ones
too; a new row gives the mean over those that are there and the change from the row before (missing if
either is, or if the row before is 0). Rows that come with an earlier day
than the newest one seen for their code are late and dropped. State is bounded by ``rows`` values a
code, and a code that is silent for ``idle`` is forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "code string, key date, n_rows int, mean double, change double"
STATE = "newest date, values array<double>"


def row_window(stream: DataFrame, rows: int, idle: str | None = None) -> DataFrame:
    """``stream(key, code, close)`` to ``(code, key, n_rows, mean, change)``."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest, values = state.get if state.exists else (None, [])
        values = [None if v is None or pd.isna(v) else v for v in values]
        out = []
        got = pd.concat(list(parts)).sort_values("key")
        for day, close in zip(got["key"], got["close"]):
            if newest is not None and day <= newest:
                continue
            close = None if pd.isna(close) else float(close)
            change = (close - values[-1]) / values[-1] if close is not None and values and values[-1] else None
            values = [*values, close][-rows:]
            newest = day
            there = [v for v in values if v is not None]
            out.append((key[0], day, len(values), sum(there) / len(there) if there else None, change))
        state.update((newest, values))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(out, columns=["code", "key", "n_rows", "mean", "change"])

    kind = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return stream.groupBy("code").applyInPandasWithState(run, OUT, STATE, "append", kind)


def replay(spark: SparkSession, folder: str, schema: str, build, out: str, checkpoint: str, files_at_once: int = 1) -> DataFrame:
    """Run ``build`` over a folder of files as a stream until all are read; the rows written."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    query = build(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.parquet(out)
