"""A corpus pipeline over ``documents``: language, quality, near-duplicates, repeated passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; the next stage reads it from
Parquet. All but the last return the columns of ``documents``. Columns are known by position inside
a stage, so further columns may have any names.

Defined cases: an empty table stays empty; a null text has no letters and goes in the first stage;
rows that share a doc_id, or have none, are documents of their own in the near-duplicate stage, so of
equal ones one stays; in the stage after it, rows that share a doc_id are one document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import langid, lines, minhash, packing, quality
from tessera.llm.common import cut, read_table, settle, shared_dir, small

#: Share of good documents among those of a score; lower ones are more likely bad than good.
LEAST_QUALITY = 0.5


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[str]]:
    """``docs`` with columns x0, x1, …; the new name of each; the old names."""
    settle(docs.sparkSession)
    names = docs.columns
    return docs.toDF(*(f"x{i}" for i in range(len(names)))), {n: f"x{i}" for i, n in enumerate(names)}, names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, at, names = _numbered(docs)
    found = langid.identify(rows, at["doc_id"], at["text"], at["lang"], at["source"])
    return found.where("_kept").select(*rows.columns).toDF(*names)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, at, names = _numbered(docs)
    labels = read_table(spark, sf_dir, "labels")
    model = quality.train(docs.select("doc_id", "text"), labels)
    return quality.score(rows, model, at["text"], "_score").where(F.col("_score") >= LEAST_QUALITY).select(*rows.columns).toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, at, names = _numbered(docs)
    key = at["doc_id"]
    if not rows.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        key = "_row"  # ids don't tell the rows apart; numbers do, once they are written
        rows = cut(rows.withColumn(key, F.monotonically_increasing_id()))
    found = minhash.near_duplicates(rows, key, at["text"], width=5, percent=80)
    gone = found.where("component_id != id").select(F.col("id").alias("_gone")).distinct()
    return rows.join(small(gone), F.col(key) == F.col("_gone"), "left_anti").drop("_row").toDF(*names)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, at, names = _numbered(docs)
    left = lines.deduplicate(rows, at["doc_id"], at["text"]).drop("_spans")
    if "n_chars" in at:
        left = left.withColumn(at["n_chars"], F.length(at["text"]).cast(rows.schema[at["n_chars"]].dataType))
    return left.toDF(*names)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    settle(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: Language ID, the classifier and packing aren't expressible in SQL; tests hold them against other code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
