"""Sinks: partitioned tables, a long table of metrics, snapshots and back-test artefacts."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS_SCHEMA = "run string, node string, metric string, step bigint, value double"


def write_panel(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet, a folder per year, so that a range of dates reads its years only."""
    panel.withColumn("year", F.year("key")).repartition("year").write.mode(mode).partitionBy("year").parquet(path)


def read_panel(spark: SparkSession, path: str, start=None, end=None) -> DataFrame:
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.where((F.col("year") >= F.year(F.lit(start))) & (F.col("key") >= F.lit(start)))
    if end is not None:
        rows = rows.where((F.col("year") <= F.year(F.lit(end))) & (F.col("key") <= F.lit(end)))
    return rows.drop("year")


def upsert_panel(new: DataFrame, path: str) -> None:
    """Replace the rows of ``new`` by (key, code): only the years that it touches are rewritten."""
    from tessera.sources.vendor import upsert

    spark = new.sparkSession
    years = [r[0] for r in new.select(F.year("key").alias("y")).distinct().collect()]
    old = spark.read.parquet(path).where(F.col("year").isin(years)).drop("year")
    merged = upsert(old, new).withColumn("year", F.year("key"))
    staged = f"{path.rstrip('/')}.staged"
    merged.write.mode("overwrite").parquet(staged)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        spark.read.parquet(staged).write.mode("overwrite").partitionBy("year").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def metrics_frame(spark: SparkSession, run: str, node: str, metrics: Mapping[str, float], step: int) -> DataFrame:
    return spark.createDataFrame([(run, node, k, step, float(v)) for k, v in metrics.items()], METRICS_SCHEMA)


def log_metrics(spark: SparkSession, path: str, run: str, node: str, metrics: Mapping[str, float], step: int) -> None:
    metrics_frame(spark, run, node, metrics, step).write.mode("append").partitionBy("run").parquet(path)


def long_metrics(wide: DataFrame, run: str, node: str, step: str, names: list[str]) -> DataFrame:
    """A row per metric and step from a table with a column per metric."""
    return wide.select(F.lit(run).alias("run"), F.lit(node).alias("node"), F.col(step).cast("bigint").alias("step"), *names).unpivot(["run", "node", "step"], names, "metric", "value")


def snapshot(frame: DataFrame, path: str, day_idx: str = "day_idx", interval: int = 250) -> None:
    """Every ``interval``-th day as compressed text with a header."""
    frame.where(F.col(day_idx) % interval == 0).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def export(frame: DataFrame, path: str) -> None:
    """Back-test tables by group and day, as text."""
    frame.write.mode("overwrite").partitionBy("group_id").option("header", True).csv(path)


def importance_json(importance: Mapping[str, float]) -> str:
    return json.dumps({k: round(v, 6) for k, v in importance.items()})
