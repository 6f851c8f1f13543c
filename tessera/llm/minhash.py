"""Near-duplicate groups: MinHash bands find candidates, sequential Bayesian tests prune them, and
whole shingle sets confirm the rest.

1. Each text becomes its set of hashed word shingles; of a set, a signature of ``HASHES`` minima
   and a 128-bit digest are kept. Equal sets form a class; its smallest id stands for it.
2. ``BANDS`` bands of ``ROWS`` minima are bucket keys. A pair at the threshold of 0.8 shares no
   bucket with probability (1 - 0.8**4)**32 < 1e-7.
3. A candidate pair's signatures are compared in batches of ``BATCH``. After n minima of which m
   agree, the posterior of the similarity (even prior) is Beta(m + 1, n - m + 1); the pair goes as
   soon as the posterior of at least the threshold falls below ``MISS``.
4. Survivors are confirmed on the full sets.

No bucket is expanded into its pairs. First every bucket's members are compared with its smallest id,
then with the text closest to that one, which in a family of edited copies is the text they came
from; links are joined into components, and a bucket whose members are all in one component is done.
What stays open is compared in tiles of at most ``TILE`` x ``TILE`` members and about ``TILE_BYTES``
of text, which test pairs of different components only, do steps 3 and 4 in place and give out a
spanning set of the links they find. Buckets that overlap are tiled as one family where that takes
fewer comparisons than tiling each. So a link between two texts is only left untested where both
are in one component already, however large the bucket is.

Defined cases: a text with fewer words than a shingle has its whole sequence as one shingle; null
texts and texts without words have the empty set and link with nothing; null ids link with nothing;
rows that share an id are nodes of that id; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import connected_components, cut, small, tidy

HASHES, BANDS, ROWS = 128, 32, 4
BATCH = 16
#: Posterior probability of similarity at the threshold below which a pair is dropped.
MISS = 1e-6
TILE, TILE_BYTES = 512, 8_000_000
#: Distinct words whose hash a worker keeps.
MAX_WORDS = 200_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.random.default_rng(20_240_101).integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().translate(_LOWER).split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        try:
            h = [known[w] for w in words]
        except KeyError:
            if len(known) > MAX_WORDS:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = [known[w] for w in words]
        h = np.array(h, np.uint64)
        n = max(1, len(h) - self.width + 1)
        x = np.full(n, np.uint64(min(self.width, len(h))), np.uint64)
        for i in range(min(self.width, len(h))):
            x = (x ^ h[i : i + n]) * _STEP
            x ^= x >> np.uint64(32)
        return np.unique(x)


def signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(low, (shingles[i : i + 512, None] * _ODD).min(0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


@functools.lru_cache
def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each batch the matches below which a pair is dropped."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Indices of the pairs of signature rows that no batch drops."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_matches(threshold)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (a[alive, part] == b[alive, part]).sum(1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
    return alive


def _signatures(source: DataFrame, width: int) -> DataFrame:
    """``source(id, text)`` as (id, n_shingles, h1, h2, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for t in batch.column(1):
                x = shingle(t.as_py())
                sizes.append(len(x))
                digests.append(xxhash.xxh3_128_digest(x.tobytes()))
                sigs.append(signature(x).tobytes() if len(x) else None)
            h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(sigs, pa.binary())],
                ["id", "n_shingles", "h1", "h2", "sig"],
            )

    return source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, n_shingles bigint, h1 bigint, h2 bigint, sig binary")


def _band_key(sig: bytes, band: int) -> int:
    return xxhash.xxh3_64_intdigest(sig[4 * ROWS * band : 4 * ROWS * (band + 1)], band) - (1 << 63)


def _bands(reps: DataFrame) -> DataFrame:
    """``(key, id)``: a row for each band of each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_band_key(s, k) for s in batch.column(1).to_pylist() for k in range(BANDS)]
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), ids], ["key", "id"])

    return reps.select("id", "sig").mapInArrow(tidy(run), f"key bigint, id {reps.schema['id'].dataType.simpleString()}")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(-1, HASHES)


def _confirmed(pairs: DataFrame, reps: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b, sim): the pairs that survive the batches and whose sets have the similarity."""
    kind = pairs.schema["a"].dataType.simpleString()
    sig = reps.select("id", "sig")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = survivors(_matrix(batch.column("sa")), _matrix(batch.column("sb")), percent / 100)
                yield batch.select(["a", "b"]).take(pa.array(keep))

    with_sigs = pairs.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
    left = cut(with_sigs.mapInArrow(tidy(prune), f"a {kind}, b {kind}").distinct())
    needed = cut(left.select(F.col("a").alias("id")).union(left.select("b")).distinct())
    texts = source.join(small(needed), "id")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        last_text, last = None, None
        for batch in batches:
            keep, sims = [], []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                x = x.as_py()
                if x != last_text:
                    last_text, last = x, shingle(x)
                other = shingle(y.as_py())
                both = len(np.intersect1d(last, other, assume_unique=True))
                union = len(last) + len(other) - both
                keep.append(100 * both >= percent * union)
                sims.append(both / max(1, union))
            out = batch.select(["a", "b"]).append_column("sim", pa.array(sims, pa.float64()))
            yield out.filter(pa.array(keep, pa.bool_()))

    joined = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return joined.mapInArrow(tidy(confirm), f"a {kind}, b {kind}, sim double").dropDuplicates(["a", "b"])


def _groups(rows: DataFrame) -> DataFrame:
    """Open members (key, id, a, c) as (band_key, g, id, c): by family where that is less work, else by bucket."""
    family = connected_components(rows.where("id != a").select("a", F.col("id").alias("b")))
    rows = cut(rows.join(small(cut(family.withColumnRenamed("component", "f"))), "id"))
    by_bucket = rows.groupBy("f", "key").agg(F.count("*").alias("n")).groupBy("f").agg(F.sum(F.col("n") * F.col("n")).alias("apart"))
    by_family = rows.select("f", "id").distinct().groupBy("f").agg((F.count("*") * F.count("*")).alias("together"))
    dense = cut(by_bucket.join(by_family, "f").select("f", (F.col("together") <= F.col("apart")).alias("dense")))
    rows = rows.join(small(dense), "f")
    whole = rows.where("dense").select(F.lit(None).cast("bigint").alias("band_key"), F.xxhash64("f").alias("g"), "id", "c").distinct()
    return whole.unionByName(rows.where("not dense").select(F.col("key").alias("band_key"), F.col("key").alias("g"), "id", "c"))


def _tiles(groups: DataFrame, reps: DataFrame, source: DataFrame, width: int, percent: int) -> DataFrame:
    """Spanning links (a, b) between members of a group that are in different components."""
    kind = groups.schema["id"].dataType.simpleString()
    needed = cut(groups.select("id").distinct())
    texts = source.join(small(needed), "id").select("id", "text", F.length("text").alias("size"))
    members = cut(groups.join(texts, "id").join(reps.select("id", "sig"), "id"))
    tiles = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / TILE_BYTES)).cast("int")
    sizes = cut(members.groupBy("band_key", "g").agg(tiles.alias("t")).select("g", F.coalesce("band_key", F.lit(0)).alias("b"), "t"))
    own = members.withColumn("b", F.coalesce("band_key", F.lit(0))).join(small(sizes), ["g", "b"]).withColumn("k", F.pmod(F.xxhash64("id"), "t").cast("int"))
    other = F.explode(F.transform(F.sequence(F.lit(0), F.col("t") - 1), lambda j: F.struct(F.least("k", j).alias("i"), F.greatest("k", j).alias("j"))))
    rows = own.select("g", "b", "band_key", "k", "c", "id", "sig", "text", other.alias("tile")).select("*", "tile.i", "tile.j").drop("tile")

    def run(table: pa.Table) -> pa.Table:
        band_key = table.column("band_key")[0].as_py()
        k, i, j = (table.column(x).to_numpy() for x in ("k", "i", "j"))
        first, second = np.flatnonzero(k == i[0]), np.flatnonzero(k == j[0])
        sigs = _matrix(table.column("sig").combine_chunks())
        shingle = Shingler(width)
        sets = [shingle(t.as_py()) for t in table.column("text")]
        size = np.array([len(x) for x in sets])
        parts = table.column("c").combine_chunks().dictionary_encode().indices.to_numpy().copy()
        found: list[tuple[int, int]] = []
        for x in first:
            y = second[second > x] if i[0] == j[0] else second
            y = y[(parts[y] != parts[x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
            if not len(y):
                continue
            y = y[survivors(np.broadcast_to(sigs[x], (len(y), HASHES)), sigs[y], percent / 100)]
            # of a bucket, a pair belongs to the first band in which it agrees; of a family, it must agree in one
            agree = (sigs[y] == sigs[x]).reshape(len(y), BANDS, ROWS).all(2)
            if band_key is None:
                y = y[agree.any(1)]
            else:
                y = y[[_band_key(sigs[x].tobytes(), int(b)) == band_key for b in agree.argmax(1)]]
            for z in y.tolist():
                if parts[z] != parts[x]:
                    both = np.intersect1d(sets[x], sets[z], assume_unique=True).size
                    if 100 * both >= percent * (size[x] + size[z] - both):
                        found.append((int(x), z))
                        parts[parts == parts[z]] = parts[x]
        ids = table.column("id").combine_chunks()
        a, b = (pa.array([f[n] for f in found], pa.int64()) for n in (0, 1))
        return pa.table({"a": ids.take(a), "b": ids.take(b)})

    return rows.groupBy("g", "b", "i", "j").applyInArrow(run, f"a {kind}, b {kind}").where("a != b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``(id, n_shingles, component_id)``, a row for each row of ``docs``."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = cut(_signatures(source, width))
    usable = sets.where("n_shingles > 0 and id is not null")
    copies = usable.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last"))
    copies = cut(copies.where("rep != last").select("h1", "h2", "rep"))
    members = usable.join(small(copies), ["h1", "h2"], "left").select("id", "sig", F.coalesce("rep", "id").alias("rep"))
    reps = members.where("id = rep").select("id", "sig")

    bands = _bands(reps)
    buckets = bands.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a != last").select("key", "a")
    held = cut(bands.join(small(cut(buckets)), "key"))  # (key, id, a): rows of buckets with several members
    pairs = cut(held.where("id != a").select("a", F.col("id").alias("b")).distinct())
    edges = cut(_confirmed(pairs, reps, source, width, percent))
    parts = cut(connected_components(edges))

    def opened(parts: DataFrame) -> DataFrame:
        """Members (key, id, a, c) of the buckets with several components; a bucket of two is done."""
        rows = held.join(small(parts), "id", "left").select("key", "id", "a", F.coalesce("component", "id").alias("c"))
        several = rows.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("n"))
        return rows.join(small(cut(several.where("x != y and n > 2").select("key"))), "key")

    rows = cut(opened(parts))
    if not rows.isEmpty():
        closest = cut(edges.groupBy("a").agg(F.max(F.struct("sim", "b")).alias("m")).select("a", F.col("m.b").alias("id")))
        leaders = closest.join(small(parts), "id").select("a", F.col("id").alias("l"), F.col("component").alias("lc"))
        more = rows.join(small(cut(leaders)), "a").where("c != lc").select(F.least("l", "id").alias("a"), F.greatest("l", "id").alias("b")).distinct()
        more = cut(more.join(pairs, ["a", "b"], "left_anti"))
        links = cut(edges.select("a", "b").unionByName(_confirmed(more, reps, source, width, percent).select("a", "b")))
        parts = cut(connected_components(links))
        rows = cut(opened(parts))
        if not rows.isEmpty():
            links = links.unionByName(_tiles(cut(_groups(rows)), reps, source, width, percent))
            parts = cut(connected_components(links))

    rep_of = sets.join(small(copies), ["h1", "h2"], "left").select("id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("rep", "id")).otherwise(F.col("id")).alias("rep"))
    out = rep_of.join(small(parts.withColumnRenamed("id", "rep")), "rep", "left")
    return out.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("id")).alias("component_id"))


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read_table

    found = near_duplicates(read_table(spark, sf_dir, "documents"), width=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
