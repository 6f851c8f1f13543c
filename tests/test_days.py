"""Days on a stream against the batch."""

import numpy as np
import pandas as pd

from tessera.operators import factors
from tessera.sources.panel import densify
from tessera.sources.synthetic import simulate
from tessera.streaming.days import aligned, factor_stream

COLUMNS = "key code close open high low volume turnover".split()


def market(spark, n_times=140):
    rows = simulate(n_times, 6, seed=4)[COLUMNS]
    rows = rows[~((rows["code"] == rows["code"].iloc[2]) & rows["key"].isin(sorted(rows["key"].unique())[128:131]))]  # a code that is away for three days
    return spark.createDataFrame(rows.assign(key=pd.to_datetime(rows["key"]).dt.date), "key date, code string, " + ", ".join(f"{c} double" for c in COLUMNS[2:]))


def test_factors_on_a_stream_equal_the_batch(spark, tmp_path):
    df = market(spark)
    days = sorted(r[0] for r in df.select("key").distinct().collect())
    for i, (a, b) in enumerate([(0, 124), (124, 126), (126, 127), (127, 135), (135, 140)]):
        df.where(df.key.isin(days[a:b])).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    late = df.where(df.key == days[50]).withColumn("close", df.close * 2)
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = factor_stream(spark, stream, "momentum", str(tmp_path / "run"), 0.1).toPandas().sort_values(["key", "code"]).reset_index(drop=True)
    want = factors.emitted(densify(df), "momentum", 0.1).toPandas().sort_values(["key", "code"]).reset_index(drop=True)
    assert len(got) == len(want) > 100
    pd.testing.assert_frame_equal(got[want.columns], want, rtol=1e-6, atol=1e-9)


def test_inputs_meet_by_day(spark, tmp_path):
    df = market(spark, 12)
    df.select("key", "code", "close").coalesce(1).write.parquet(str(tmp_path / "a"))
    df.where("close > 1").select("key", "code", "volume").coalesce(1).write.parquet(str(tmp_path / "b"))
    a = spark.readStream.schema("key date, code string, close double").parquet(str(tmp_path / "a"))
    b = spark.readStream.schema("key date, code string, volume double").parquet(str(tmp_path / "b"))
    query = aligned([a, b]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).toPandas().sort_values(["key", "code"])
    want = df.where("close > 1").toPandas().sort_values(["key", "code"])
    assert len(got) == len(want) > 0 and np.allclose(got["close"], want["close"]) and np.allclose(got["volume"], want["volume"])
