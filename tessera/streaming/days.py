"""Days as stream elements: inputs aligned by day, and factor modules over a sliding window of days.

``aligned`` joins streams on day and code, so a row comes out once all inputs have it; the watermark
bounds what is kept of rows that wait. ``factor_stream`` keeps the rows of its newest days in a table
and gives out, for each micro-batch, the module's columns for the days that are new in it. A day sees the
module's window of days and no more, so the batch result over the whole panel is the same.

Rows of a day that isn't newer than all days of earlier batches are late and dropped. A micro-batch that
runs again after a failure writes the same folders again. The folders must be shared by all machines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import factors
from tessera.sources.panel import densify


def aligned(streams: list[DataFrame], delay: str = "30 days") -> DataFrame:
    """Inner join of streams with ``key`` and ``code``; other columns must have names of their own."""
    marked = [s.withColumn("_at", F.col("key").cast("timestamp")).drop("key").withWatermark("_at", delay) for s in streams]
    joined = reduce(lambda a, b: a.join(b, ["_at", "code"]), marked)
    return joined.select(F.col("_at").cast("date").alias("key"), *(c for c in joined.columns if c != "_at"))


def factor_stream(spark: SparkSession, stream: DataFrame, module: str, folder: str, trim: float = 0.01) -> DataFrame:
    """Run a module over ``stream(key, code, inputs)`` until all is read; ``(key, code, factors)``."""
    m = factors.MODULES[module]
    rows_at, out_at = f"{folder}/rows", f"{folder}/out"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{rows_at}/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        # a null key or one that an earlier batch has gone past isn't new
        before = spark.read.schema(f"{_ddl(stream)}, batch bigint").parquet(rows_at).where(F.col("batch") < number).drop("batch")
        newest = before.agg(F.max("key")).first()[0]
        fresh = batch.where("key is not null" if newest is None else F.col("key") > F.lit(newest))
        fresh.write.mode("overwrite").parquet(f"{rows_at}/batch={number}")
        fresh = spark.read.schema(_ddl(stream)).parquet(f"{rows_at}/batch={number}")
        n_new = fresh.select("key").distinct().count()
        if not n_new:
            return
        every = before.unionByName(fresh)
        days = [r[0] for r in every.select("key").distinct().orderBy(F.desc("key")).limit(m.window - 1 + n_new).collect()]
        window = every.where(F.col("key") >= F.lit(days[-1]))
        found = factors.emitted(densify(window), module, trim)
        new = found.where("true" if newest is None else F.col("key") > F.lit(newest))
        new.write.mode("overwrite").parquet(f"{out_at}/batch={number}")

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.parquet(out_at).drop("batch")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
