import random

import pytest
from helpers import SCHEMA, prose
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import entries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(300)]
    rows, labels = [], []
    passage = prose(rng, 80, words)
    for i in range(200):
        good = i % 5 > 0
        t = prose(rng, rng.randint(30, 120), words)
        t = t if good else " | ".join(t.split())
        if i in (11, 13):
            t = t + "\n" + passage
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(good), 0))
    rows += [(200, rows[1][1], "en", "s0", rows[1][4]), (201, None, None, None, None), (202, "", "en", "s1", 0), (203, "12345 !!", "en", "s1", 8)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, passage


def test_stages(spark, folder, tmp_path):
    path, rows, passage = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumnRenamed("source", "source").selectExpr("*", "1 as _kept", "'y' as _score", "2 as id", "3 as x0")
    text = {r[0]: r[1] for r in rows}
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    kept = {name: {r.doc_id for r in got} for name, got in seen.items()}
    assert kept["language_id"] == set(range(201))
    good = {i for i in range(200) if i % 5} | {200}
    assert len(kept["quality"] ^ good) <= 2
    assert kept["near_dedup"] == kept["quality"] - {200}
    after = {r.doc_id: r.text for r in seen["substring_dedup"]}
    assert passage in after[11] and passage not in after[13] and all(after[i] == text[i] for i in after if i != 13)
    assert all(r.n_chars == len(r.text) for r in seen["substring_dedup"])
    assert kept["packing"] == kept["substring_dedup"]


def test_rows_that_ids_do_not_tell_apart(spark):
    rng = random.Random(3)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (1, a), (1, b), (None, c), (None, c), (2, a), (3, None), (3, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).withColumn("_row", F.lit("x"))
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.text or "" for r in got.collect()) == sorted([a, b, c, "", "", ""])


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entries():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and set(entries.queries()) <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in entries.queries()) == list(range(1, 11))
