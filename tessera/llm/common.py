"""Helpers shared by the corpus operators: tables, lineage cuts, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Estimated bytes up to which a table may be broadcast.
BROADCAST_BYTES = 16_000_000

#: The code points that the public pattern's ``\\s`` matches (Unicode White_Space).
WHITE_SPACE = "\t-\r \x85\xa0" + "{}{}-{}{}{}{}{}{}".format(*map(chr, (0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


#: Rows of a batch that a Python worker holds; texts may be long.
BATCH_ROWS = 2_000


def settle(spark: SparkSession) -> None:
    """Session settings that the operators count on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def tidy(run):
    """A function of batches that hands freed memory back to the system when its task ends.

    Workers are kept between tasks, and what one task freed would else count against the next.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return wrapped


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a new local one if unset, on one machine only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later plans start there.

    The copy is Parquet: it outlives lost executors and is smaller than a checkpoint of rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def size_of(df: DataFrame) -> int:
    """Estimated bytes of all rows, from their number and the lengths of their strings, binaries and arrays."""
    fixed, sums = 16, []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            sums.append(F.sum(F.octet_length(f"`{f.name}`")))
        elif kind in ("array", "map", "struct"):
            sums.append(F.sum(F.octet_length(F.to_json(F.struct(f"`{f.name}`")))))
        fixed += 8
    n, *more = df.agg(F.count("*"), *sums).first()
    return n * fixed + sum(x or 0 for x in more)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast if it has been measured and takes at most ``limit`` bytes."""
    return F.broadcast(df) if size_of(df) <= limit else df


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    ids = None
    for batch in batches:
        ids = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = (root(x) if parent.setdefault(x, x) != x else x for x in (a, b))
            if a != b:
                parent[max(a, b)] = min(a, b)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, ids), pa.array([root(x) for x in nodes], ids)], ["id", "component"])


#: Links up to which one task joins them (16 bytes each); beyond that it takes rounds of joins.
ONE_TASK_LINKS = 100_000


def connected_components(edges: DataFrame, one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """Smallest reachable id of every node of ``edges(a, b)``, as ``(id, component)``.

    Up to ``one_task`` counted links are joined in one task on an executor. Beyond that the larger
    and then the smaller neighbours of each node are pointed to its smallest one until nothing
    changes, so a chain of n links takes about log n rounds.
    Neighbour minima come from aggregation before the shuffle; no neighbourhood is collected.
    Nodes without links are absent. Rows with a null end or equal ends are ignored.
    """
    edges = cut(
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    if edges.count() <= one_task:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(_joined, f"id {kind}, component {kind}")
    while True:
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        big = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a != b").distinct()
        )
        # small star: a node and its smaller neighbours point to the smallest of them
        low = big.groupBy("a").agg(F.min("b").alias("low"))
        star = (
            big.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a != b")
            .distinct()
        )
        star = cut(star)
        # a fixed point is a set of stars: every node points to one root and no root points on
        if star.groupBy("a").count().where("count > 1").isEmpty() and star.alias("x").join(star.alias("y"), F.col("x.b") == F.col("y.a")).isEmpty():
            edges = star
            break
        edges = star
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
