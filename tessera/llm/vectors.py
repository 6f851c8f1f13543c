"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are drawn from a bounded sample, the vectors with the smallest hash: about
the square root of the number of vectors, at most ``MOST_PIVOTS`` or ``PIVOT_BYTES``. Every vector is
described by its ``PREFIX`` nearest pivots in order and entered in the lists of those pivots. Vectors
of one list that share at least ``SHARED`` pivots are compared by cosine in double precision, and a
pair is compared in the list of its smallest shared pivot only, so it counts once. A list longer than
``SPLIT`` is split by the second shared pivot, so that lists don't grow with the corpus as long as
pivots do. Lists longer than ``TILE`` are dealt out in pairs of tiles. A tile gives out the number of
links of each vector and a spanning set of links, never all pairs.

Equal vectors of a label are one class, known by the digest of both; the index holds a vector for each
class, and classes become rows again at the end. Only vectors of equal, non-null labels are compared.
Recall against brute force is measured in the tests (at least 0.9 is asked for).

Defined cases: null vectors, zero vectors, and vectors with null or non-finite components link with
nothing, as do vectors with a null label or id; vectors of different length link with nothing; rows
are vectors of their own, also where ids repeat over equal or different vectors, so such rows may lie
in different components; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, cut, small, tidy

PREFIX, SHARED = 8, 2
TILE, SPLIT = 512, 4_096
#: Bounds of the number of pivots, bytes of them, and sampled vectors for each.
LEAST_PIVOTS, MOST_PIVOTS, PIVOT_BYTES, SAMPLED_EACH = 16, 16_384, 32_000_000, 4


def _prepared(source: DataFrame) -> DataFrame:
    """(id, label, key, vec): key is the digest of label and vector; vec is null where it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, digests = [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2)):
                x = None
                if label is not None and v.is_valid and len(v.values) and not v.values.null_count:
                    got = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(got).all() and got.any():
                        x = packed(got + 0.0)  # + 0.0: one zero
                data.append(x)
                digests.append(xxhash.xxh3_128_digest(repr(label).encode() + b"\0" + (x or b"")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(data, pa.binary())], ["id", "label", "key", "vec"])

    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return source.mapInArrow(tidy(run), f"id {types['id']}, label {types['label']}, key binary, vec binary")


def packed(x: np.ndarray) -> bytes:
    """The width of a component and the components, as single precision if that loses nothing."""
    with np.errstate(over="ignore"):
        narrow = x.astype("<f4")
    return b"\4" + narrow.tobytes() if np.array_equal(narrow, x) else b"\x08" + x.astype("<f8").tobytes()


def dimensions(v: bytes) -> int:
    return len(v) // v[0]


def unit(vectors: list[bytes]) -> np.ndarray:
    x = np.array([np.frombuffer(v, f"<f{v[0]}", offset=1) for v in vectors], float)
    x = x / np.abs(x).max(1, keepdims=True)  # against overflow of the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def choose_pivots(sample: list[bytes], n: int) -> dict[int, np.ndarray]:
    """Up to ``n`` pivots for each vector length, spread out: of two candidates the farther one."""
    by_size: dict[int, list[bytes]] = {}
    for v in sample:
        by_size.setdefault(dimensions(v), []).append(v)
    out = {}
    for size, own in by_size.items():
        x = unit(own)
        chosen, near = [0], x @ x[0]
        rest = iter(range(1, len(x)))
        while len(chosen) < n:
            two = [i for i, _ in zip(rest, range(2))]
            if not two:
                break
            k = min(two, key=lambda i: near[i])
            chosen.append(k)
            near = np.maximum(near, x @ x[k])
        out[size] = x[chosen]
    return out


def _described(reps: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``reps`` with ``size`` and ``prefix``, the numbers of a vector's nearest pivots in order."""
    sent = reps.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOT_BYTES a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("vec").to_pylist()
            sizes = np.array([dimensions(v) for v in data], np.int64)
            prefix: list = [None] * len(data)
            for size in set(sizes.tolist()):
                at = np.flatnonzero(sizes == size)
                points = sent.value.get(size)
                if points is None:  # a length that the sample lacks: one list
                    near = np.zeros((len(at), 1), np.int32)
                else:
                    near = np.argsort(-(unit([data[i] for i in at]) @ points.T), 1, kind="stable")[:, :PREFIX].astype(np.int32)
                for i, row in zip(at.tolist(), near):
                    prefix[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(prefix, pa.list_(pa.int32()))], [*batch.schema.names, "size", "prefix"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in reps.schema.fields)
    return reps.mapInArrow(tidy(run), f"{fields}, size bigint, prefix array<int>")


def _lists(described: DataFrame) -> DataFrame:
    """The inverted lists: a row for each list of a vector; ``second`` is -1 but in split lists."""
    entries = described.select("label", "size", F.explode("prefix").alias("pivot"))
    long = entries.groupBy("label", "size", "pivot").count().where((F.col("count") > SPLIT) & (F.col("size") > 0))
    long = small(cut(long.select("label", "size", "pivot", F.lit(True).alias("long"))))
    rows = described.withColumn("pivot", F.explode("prefix")).join(long, ["label", "size", "pivot"], "left")
    others = F.filter("prefix", lambda q: q > F.col("pivot"))
    second = F.when(F.col("long") & (F.size("prefix") >= SHARED), others).otherwise(F.array(F.lit(-1)))
    return rows.withColumn("second", F.explode(second)).drop("long")


def links_of_tile(x: np.ndarray, prefix: np.ndarray, pivot: int, second_pivot: int, first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (in ``first`` x ``second``) that share enough pivots, the list's own the smallest, and link."""
    local, own = np.unique(prefix, return_inverse=True)
    marks = np.zeros((len(x), len(local)), np.float32)
    marks[np.arange(len(x))[:, None], own.reshape(prefix.shape)] = 1
    smaller = marks[:, (local < pivot) | (local > pivot) & (local < second_pivot)]
    ok = (marks[first] @ marks[second].T >= min(SHARED, prefix.shape[1])) & (smaller[first] @ smaller[second].T < 0.5)
    cosine = x[first] @ x[second].T
    return np.nonzero(ok & (cosine >= threshold))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """``(id, n_links, component_id)``, a row for each row of ``vectors``."""
    source = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    rows = cut(_prepared(source))
    usable = rows.where("vec is not null and id is not null")
    copies = cut(usable.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    members = usable.join(small(copies), "key", "left")
    classes = members.select("key", "label", "vec", F.coalesce("n", F.lit(1).cast("bigint")).alias("n"), F.coalesce("rep", "id").alias("rep"), F.col("n").isNull().alias("alone"), "id")
    # a class of several rows has its vector from the rows of its smallest id
    reps = cut(classes.where("alone").drop("id", "alone").unionByName(classes.where("not alone and id = rep").drop("id", "alone").dropDuplicates(["key"])))

    n_reps, longest = reps.agg(F.count("*"), F.max(F.length("vec"))).first()
    longest = 2 * longest if longest else 8  # as double precision
    n_pivots = max(LEAST_PIVOTS, min(MOST_PIVOTS, math.isqrt(n_reps), PIVOT_BYTES // longest))
    wanted = min(SAMPLED_EACH * n_pivots, 2 * PIVOT_BYTES // longest) or 1
    sample = [bytes(r[0]) for r in reps.orderBy(F.xxhash64("key"), "key").limit(wanted).select("vec").collect()]
    described = cut(_described(reps.select("key", "label", "n", "vec"), choose_pivots(sample, n_pivots)))

    at = ["label", "size", "pivot", "second"]
    postings = _lists(described)
    long = cut(postings.groupBy(*at).agg(F.ceil(F.count("*") / TILE).cast("int").alias("t")).where("t > 1"))
    tiled = postings.join(small(long), at, "left").withColumn("t", F.coalesce("t", F.lit(1)))
    tiled = tiled.withColumn("k", F.pmod(F.xxhash64("key"), "t").cast("int"))
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda j: F.struct(F.least("k", j).alias("i"), F.greatest("k", j).alias("j"))))
    tiled = tiled.select(*at, "prefix", "key", "n", "vec", "k", tile.alias("tile")).select("*", "tile.i", "tile.j").drop("tile")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        k, i, j, n = (table.column(c).to_numpy() for c in ("k", "i", "j", "n"))
        keys = table.column("key").combine_chunks()
        links = np.zeros(len(keys), np.int64)
        spanning: list[tuple[int, int]] = []
        first, second = np.flatnonzero(k == i[0]), np.flatnonzero(k == j[0])
        if len(first) and len(second) and len(keys) > 1:
            prefix = np.array(table.column("prefix").to_pylist(), np.int64)
            x = unit(table.column("vec").to_pylist())
            a, b = links_of_tile(x, prefix, table.column("pivot")[0].as_py(), table.column("second")[0].as_py(), first, second, threshold)
            a, b = first[a], second[b]
            once = a < b if i[0] == j[0] else np.ones(len(a), bool)
            a, b = a[once], b[once]
            np.add.at(links, a, n[b])
            np.add.at(links, b, n[a])
            parent = list(range(len(x)))

            def root(u: int) -> int:
                while parent[u] != u:
                    parent[u] = u = parent[parent[u]]
                return u

            for u, v in zip(a.tolist(), b.tolist()):
                p, q = root(u), root(v)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    spanning.append((u, v))
        u, v = (pa.array([s[c] for s in spanning], pa.int64()) for c in (0, 1))
        some = pa.array(np.flatnonzero(links))
        return pa.table({
            "key": pa.concat_arrays([keys.take(some), keys.take(u)]),
            "links": pa.array([*links[links > 0].tolist(), *[0] * len(u)], pa.int64()),
            "other": pa.concat_arrays([pa.nulls(len(some), keys.type), keys.take(v)]),
        })

    found = cut(tiled.groupBy(*at, "i", "j").applyInArrow(run, "key binary, links bigint, other binary"))
    parts = cut(connected_components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))))
    # a component is named by the smallest id of its classes
    named = parts.withColumnRenamed("id", "key").join(reps.select("key", "rep"), "key")
    named = cut(named.groupBy("component").agg(F.min("rep").alias("component_id")))
    counts = found.where("links > 0").groupBy("key").agg(F.sum("links").alias("links"))
    seen = cut(parts.withColumnRenamed("id", "key").join(small(named), "component").join(counts, "key", "left").select("key", "component_id", "links"))
    # null ids keep null keys, so that they join nothing
    can = F.col("vec").isNotNull() & F.col("id").isNotNull()
    out = rows.select("id", can.alias("can"), F.when(can, F.col("key")).alias("key")).join(small(copies), "key", "left").join(small(seen), "key", "left")
    return out.select(
        "id",
        F.when(F.col("can"), F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).otherwise(0).cast("bigint").alias("n_links"),
        F.when(F.col("can"), F.coalesce("component_id", "rep", "id")).otherwise(F.col("id")).alias("component_id"),
    )


def op7_near_vectors(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read_table

    found = near_vectors(read_table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
