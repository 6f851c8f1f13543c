"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame functions only.

A text's lower-case words (separated by ASCII white space) give shingles of ``WIDTH`` words; a text
of fewer words is one shingle, a text without words none. The fingerprint is the sorted array of the
``K`` smallest distinct 64-bit hashes. Fingerprints of parts merge into that of the whole, and two
of them estimate resemblance (Jaccard), containment and the number of distinct shingles.

Defined cases: null text is empty text; the likeness of two empty fingerprints is 1, of an empty and
another one 0; rows are ordered by id, then by hash and text where ids are equal, null ids last;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, small

WIDTH, K = 5, 128
#: Ranges of ids found by quantiles, and rows that a part of a range aims at.
RANGES, PART_ROWS = 256, 48


def hashes(text: Column, width: int = WIDTH) -> Column:
    """Sorted distinct shingle hashes of a text."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0)))
        short = F.array(F.xxhash64(F.array_join(w, " ")))
        own = F.transform(at, lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(width))))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < width, short).otherwise(own)

    # the words are bound once: a one-element array is mapped and unwrapped
    return F.array_distinct(F.array_sort(F.get(F.transform(F.array(words), of), F.lit(0))))


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    return F.slice(hashes(text, width), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The fingerprint of two parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    low = merge(a, b, k)
    both = F.size(F.array_intersect(low, F.array_intersect(a, b)))
    return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(both / F.size(low))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; 1 if ``a`` is empty."""
    union = distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * union / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """Hexadecimal, 16 digits a hash; empty for an empty fingerprint."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def with_next(docs: DataFrame, id_col: str, text_col: str, derived: dict[str, Column]) -> DataFrame:
    """``docs`` with ``derived`` columns, and ``next_`` text and derived columns of the next row.

    Next is meant in descending order of a numeric id, null ids last by hash; the last row gets the
    first's. The order is cut into ranges by quantiles and ranges into parts, so that parts hold a few
    rows whatever the ids are; null ids are a range of their own, cut by hash. Neighbours inside a part
    come from a window over the part. Parts are linked by their numbers, in a window over their range and
    one over the at most ``RANGES`` + 1 ranges; the text that heads the next part is then fetched by a join.
    """
    names = docs.columns
    if clash := {"_r", "_p", "_tie", "_n", "_last", "_head"}.intersection(names):
        raise ValueError(f"columns have names that the operator adds: {sorted(clash)}")
    known = docs.where(F.col(id_col).isNotNull())
    stats = known.agg(F.percentile_approx(id_col, [i / RANGES for i in range(1, RANGES)], 10_000), F.min(id_col), F.max(id_col), F.count("*")).first()
    n_nulls = docs.where(F.col(id_col).isNull()).count()
    bounds = sorted({*(stats[0] or []), stats[1], stats[2]} - {None}) or [0]
    n_parts, null_parts = max(1, stats[3] // (PART_ROWS * len(bounds))), max(1, n_nulls // PART_ROWS)
    table = F.array(*map(F.lit, bounds))
    docs = docs.withColumn("_r", F.when(F.col(id_col).isNull(), -1).otherwise(F.size(F.filter(table, lambda b: b <= F.col(id_col))) - 1))
    low = F.get(table, F.col("_r"))
    high = F.coalesce(F.get(table, F.col("_r") + 1), low + 1)
    inside = F.floor((F.col(id_col) - low).cast("double") / (high - low).cast("double") * n_parts)
    inside = F.coalesce(F.least(inside, F.lit(n_parts - 1)), F.lit(0))
    by_hash = F.least(F.floor((F.xxhash64(text_col).cast("double") + 2.0**63) / 2.0**64 * null_parts), F.lit(null_parts - 1))
    part = F.when(F.col(id_col).isNull(), F.lit(null_parts - 1) - by_hash).otherwise(inside)
    docs = docs.withColumns({"_p": part.cast("bigint"), "_tie": F.xxhash64(text_col)})

    carry = [text_col, *derived]
    value = F.struct(*carry)
    order = [F.col(id_col).desc_nulls_last(), F.col("_tie"), F.col(text_col)]
    rows = docs.withColumns(derived).withColumn("_n", F.lead(value).over(Window.partitionBy("_r", "_p").orderBy(*order)))
    rows = rows.withColumn("_last", F.lead(F.lit(1)).over(Window.partitionBy("_r", "_p").orderBy(*order)).isNull())

    # the first row of each part, found by its id and then fetched
    tops = cut(docs.groupBy("_r", "_p").agg(F.max(id_col).alias("_top")))
    heads = docs.join(small(tops), ["_r", "_p"]).where(F.col(id_col).eqNullSafe(F.col("_top")))
    heads = heads.groupBy("_r", "_p").agg(F.min(F.struct("_tie", text_col)).alias("_h")).select("_r", "_p", f"_h.{text_col}")
    heads = heads.withColumns(derived).select(F.col("_r").alias("_nr"), F.col("_p").alias("_np"), value.alias("_head"))
    # which part comes next, by numbers alone
    within = Window.partitionBy("_r").orderBy(F.col("_p").desc())
    linked = tops.select("_r", "_p", F.lead("_p").over(within).alias("_np"), F.row_number().over(within).alias("_at"))
    firsts = cut(linked.where("_at = 1").select("_r", "_p"))  # a row for each range
    everything = Window.orderBy(F.col("_r").desc())
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.struct("_r", "_p")
    firsts = firsts.select("_r", F.coalesce(F.lead(first).over(everything), F.first(first).over(whole)).alias("_top"))
    linked = linked.join(F.broadcast(firsts), "_r")
    same = F.col("_np").isNotNull()
    linked = linked.select("_r", "_p", F.when(same, F.col("_r")).otherwise(F.col("_top._r")).alias("_nr"), F.when(same, F.col("_np")).otherwise(F.col("_top._p")).alias("_np"), F.lit(True).alias("_last"))
    linked = linked.join(heads, ["_nr", "_np"]).drop("_nr", "_np")
    out = rows.join(linked, ["_r", "_p", "_last"], "left").withColumn("_n", F.coalesce("_n", "_head"))
    return out.select(*names, *derived, *(F.col(f"_n.{c}").alias(f"next_{c}") for c in carry))


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # sketches are made after the rows are dealt out: a sketch is a third of what its text takes on disk
    rows = with_next(docs, "doc_id", "text", {})
    n = F.length("text")
    cut_off = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut_off), F.substring(F.col("next_text"), F.lit(1), cut_off))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), sketch(F.col("text")).alias("fp"), sketch(F.col("next_text")).alias("next_fp"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", sketch(F.col("edited")).alias("efp"), "next_fp")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("fp")).alias("fingerprint"),
        as_text(F.col("efp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("efp")).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"),
        distinct_shingles(F.col("fp")).alias("n_shingles"),
    )
