"""Language identification by Bayesian fusion of four kinds of evidence.

For each language l the log posterior is

    log P(text | l) + log P(declared | l) + log P(suffix | l) + log P(l | host)

* text: byte trigrams, hashed, with add-half smoothing. Trigrams of a text depend on each other, so n
  of them count as n * E / (n + E) with E = ``EFFECTIVE``, and a long text can't outvote all else by its
  length alone. The tables are fitted on a bounded sample of each language declared anywhere, the
  ``SAMPLE_ROWS`` rows of it whose id hashes smallest;
* declared: the markup's or the table's language tag, right with probability ``DECLARED_TRUST``;
* suffix: the last label of the address, by counts over all rows;
* host: counts over all rows, grouped by host and drawn in to those of the host's suffix, which are
  drawn in to those of the whole corpus (``PRIOR_ROWS`` rows' worth at each level).

The counts are sums of posteriors of text and declaration over every row, by grouped aggregation
with partial sums before the shuffle, so a host with a third of all rows costs no more than others.

A row is rejected (``kept`` false) if it has no letters, or if a background model that knows only
single bytes explains its text better than every language does, by ``REJECT_MARGIN`` per trigram.

Defined cases: a null or empty text has no text evidence and is rejected; null or unknown tags,
hosts and addresses add no evidence; columns that the operator adds must not be there; without any declared language nothing can be fitted, language
is null and rows with letters are kept; repeated rows are judged each; null ids are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, small, tidy

#: Sampled rows of a language.
SAMPLE_ROWS = 1_000
DECLARED_TRUST = 0.8
PRIOR_ROWS = 20.0
REJECT_MARGIN = 0.5
#: Independent trigrams that a text is worth at most.
EFFECTIVE = 16.0
KINDS = frozenset({"text", "declared", "suffix", "host"})
BITS = 16
#: Languages that a task counts before it hands their counts on.
HELD_LANGUAGES = 32
_LETTER = re.compile(r"[^\W\d_]")


def trigrams(text: str) -> np.ndarray:
    b = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # trigram bucket x (languages, background)

    def evidence(self, text: str) -> np.ndarray:
        """Tempered log likelihood per language, then that of the background."""
        g = trigrams(text)
        total = np.zeros(len(self.languages) + 1)
        for at in range(0, len(g), 1 << 16):  # a long text is summed in parts
            total += self.table[g[at : at + (1 << 16)]].sum(0, dtype=np.float64)
        return total * (EFFECTIVE / (len(g) + EFFECTIVE))


def tag_language(col: Column) -> Column:
    """``en`` of ``en-US``; null if empty."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(col), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1)), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label of an address; null if there is no dot."""
    return F.nullif(F.lower(F.regexp_extract(host, r"\.([A-Za-z0-9-]+)(?::\d+)?$", 1)), F.lit(""))


def page_columns(pages: DataFrame) -> DataFrame:
    """``pages`` with ``declared`` (the language of the html element) and ``host`` (of the url)."""
    return pages.withColumns({
        "declared": F.regexp_extract("html", r"""(?i)<html[^>]*\slang\s*=\s*["']?([A-Za-z-]+)""", 1),
        "host": F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1)),
    })


def train(docs: DataFrame, id_cols: list[str], text_col: str, declared: Column, sample_rows: int = SAMPLE_ROWS) -> Model:
    source = docs.select(F.xxhash64(*(F.col(f"`{c}`") for c in id_cols)).alias("h"), tag_language(declared).alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and text is not null")
    # ranks are limited before the shuffle, so that of a language at most sample_rows a task are sent
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = cut(source.select("lang", "h").withColumn("k", rank).where(F.col("k") <= sample_rows).groupBy("lang").agg(F.max("h").alias("last")))

    kinds = pa.schema([("lang", pa.string()), ("at", pa.binary()), ("counts", pa.binary()), ("single", pa.binary())])
    ddl = "lang string, at binary, counts binary, single binary"

    def packed(found: dict[str, list]) -> pa.RecordBatch:
        rows = []
        for lang, (tri, single) in found.items():
            at = np.flatnonzero(tri)
            rows.append({"lang": lang, "at": at.astype("<i4").tobytes(), "counts": tri[at].astype("<i8").tobytes(), "single": single.astype("<i8").tobytes()})
        return pa.RecordBatch.from_pylist(rows, kinds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in found and len(found) == HELD_LANGUAGES:
                    yield packed(found)
                    found = {}
                t = t.as_py()
                entry = found.setdefault(lang, [np.zeros(1 << BITS, np.int64), np.zeros(256, np.int64)])
                entry[0] += np.bincount(trigrams(t), minlength=1 << BITS)
                entry[1] += np.bincount(np.frombuffer(t.lower().encode(), np.uint8), minlength=256)
        yield packed(found)

    def merged(table: pa.Table) -> pa.Table:
        tri, single = np.zeros(1 << BITS, np.int64), np.zeros(256, np.int64)
        for r in table.to_pylist():
            tri[np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["counts"], "<i8")
            single += np.frombuffer(r["single"], "<i8")
        return pa.Table.from_batches([packed({table.column("lang")[0].as_py(): [tri, single]})])

    sampled = source.join(small(last), "lang").where("h <= last").select("lang", "text")
    # a row per language comes to the driver
    got = sorted(sampled.mapInArrow(tidy(count), ddl).groupBy("lang").applyInArrow(merged, ddl).collect(), key=lambda r: r["lang"])
    languages = [r["lang"] for r in got]
    single = np.zeros(256)
    table = np.zeros((1 << BITS, len(languages) + 1), np.float32)
    for k, r in enumerate(got):
        c = np.full(1 << BITS, 0.5 / 16)
        c[np.frombuffer(r["at"], "<i4")] += np.frombuffer(r["counts"], "<i8")
        table[:, k] = np.log(c / c.sum())
        single += np.frombuffer(r["single"], "<i8")
    # background: bytes drawn one by one from a mixture of the sample's and even odds
    p = 0.5 * (single + 1) / (single.sum() + 256) + 0.5 / 256
    three = np.arange(256, dtype=np.uint32)
    background = np.zeros(1 << BITS)
    for a in range(256):
        h = (np.uint32(a << 16) | (three[:, None] << np.uint32(8)) | three[None, :]) * np.uint32(0x9E3779B1)
        np.add.at(background, (h >> np.uint32(32 - BITS)).ravel(), (p[a] * p[:, None] * p[None, :]).ravel())
    table[:, -1] = np.log(np.maximum(background, 1e-12)) - REJECT_MARGIN
    return Model(languages, table)


def with_evidence(docs: DataFrame, model: Model, text_col: str) -> DataFrame:
    """``docs`` with ``_ll`` (log likelihood per language, background last) and ``_letters``."""
    at, sent = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(at)]
            ll = pa.array([m.evidence(t) for t in texts], pa.list_(pa.float64()))
            letters = pa.array([_LETTER.search(t) is not None for t in texts], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, ll, letters], [*batch.schema.names, "_ll", "_letters"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(run), f"{fields}, _ll array<double>, _letters boolean")


def _log_declared(declared: Column, languages: list[str]) -> Column:
    """Log likelihood of the declared tag per language, as an array; zeros if it says nothing."""
    n = len(languages)
    wrong = math.log((1 - DECLARED_TRUST) / max(1, n - 1))
    # every declared language has a slot, so only a row without a tag says nothing
    return F.transform(F.array(*map(F.lit, languages)), lambda x: F.when(declared.isNull(), 0.0).when(declared == x, math.log(DECLARED_TRUST)).otherwise(wrong))


def _softmax(scores: Column) -> Column:
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _add(*arrays: Column) -> Column:
    out = arrays[0]
    for a in arrays[1:]:
        out = F.zip_with(out, a, lambda x, y: x + y)
    return out


def host_priors(evidence: DataFrame, languages: list[str]) -> tuple[DataFrame, DataFrame, list[float]]:
    """``(_host, _prior)``, ``(_suffix, _suffix_ll)`` and the shares over all rows.

    ``evidence`` has ``_host``, ``_suffix``, ``_ll`` and ``_declared``.
    """
    n = len(languages)
    text = F.slice(F.col("_ll"), 1, n)
    sums = [F.sum(F.col("_post")[i]).alias(f"s{i}") for i in range(n)]
    by_host = cut(
        evidence.where("_letters").withColumn("_text", text).withColumn("_sum", _add(F.col("_text"), _log_declared(F.col("_declared"), languages)))
        .withColumn("_post", _softmax(F.col("_sum"))).groupBy("_host", "_suffix").agg(*sums, F.count("*").alias("n"))
    )
    totals = by_host.agg(*(F.sum(f"s{i}") for i in range(n)), F.sum("n")).first()
    rows = totals[n] or 0
    share = [((totals[i] or 0.0) + 1.0) / (rows + n) for i in range(n)]
    drawn = lambda up: [((F.col(f"s{i}") + PRIOR_ROWS * up[i]) / (F.col("n") + PRIOR_ROWS)).alias(f"p{i}") for i in range(n)]
    suffixes = by_host.groupBy("_suffix").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(n)), F.sum("n").alias("n")).select("_suffix", *drawn([F.lit(x) for x in share]))
    suffixes = cut(suffixes)
    up = small(suffixes.select("_suffix", *(F.col(f"p{i}").alias(f"u{i}") for i in range(n))))
    hosts = by_host.join(up, "_suffix").select("_host", *drawn([F.col(f"u{i}") for i in range(n)]))
    # P(suffix | l) up to a factor that is the same for all l: P(l | suffix) / P(l)
    suffix_ll = suffixes.select("_suffix", F.when(F.col("_suffix") != "", F.array(*(F.log(F.col(f"p{i}") / share[i]) for i in range(n)))).otherwise(F.array(*[F.lit(0.0)] * n)).alias("_suffix_ll"))
    # the host's own share above its suffix's, so that the suffix counts once
    hosts = cut(hosts.groupBy("_host").agg(*(F.avg(f"p{i}").alias(f"p{i}") for i in range(n))))
    prior = hosts.select("_host", F.array(*(F.log(f"p{i}") for i in range(n))).alias("_prior"))
    return prior, suffix_ll, share


def identify(
    docs: DataFrame, id_col: str | list[str] = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str | None = "source", keep: list[str] | None = None, use: frozenset[str] = KINDS
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``_language``, ``_confidence`` and ``_kept``.

    ``use`` names the kinds of evidence that decide; the text model is fitted on declared tags in any case.
    """
    added = {"_language", "_confidence", "_kept", "_declared", "_host", "_suffix", "_ll", "_letters", "_prior", "_suffix_ll", "_total"}
    if clash := added.intersection(docs.columns):
        raise ValueError(f"columns have names that the operator adds: {sorted(clash)}")
    declared = F.col(f"`{declared_col}`")
    host = F.lower(F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit(""))) if host_col else F.lit("")
    model = train(docs, [id_col] if isinstance(id_col, str) else id_col, text_col, declared)
    names, n = model.languages, len(model.languages)
    columns = docs.columns if keep is None else keep
    rows = docs.withColumns({
        "_declared": tag_language(declared) if "declared" in use else F.lit(None).cast("string"),
        "_host": host if "host" in use else F.lit(""),
        "_suffix": F.coalesce(suffix_of(host), F.lit("")) if "suffix" in use else F.lit(""),
    })
    if not n:
        letters = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
        return rows.select(*columns, F.lit(None).cast("string").alias("_language"), F.lit(0.0).alias("_confidence"), letters.alias("_kept"))
    evidence = with_evidence(rows, model, text_col)
    if keep is None:
        priors = host_priors(with_evidence(rows.select("_declared", "_host", "_suffix", text_col), model, text_col).drop(text_col), names)
    else:
        evidence = cut(evidence.select(*columns, "_declared", "_host", "_suffix", "_ll", "_letters"))
        priors = host_priors(evidence, names)
    prior, suffix_ll, share = priors
    neutral = F.array(*(F.lit(math.log(x)) for x in share))
    scored = evidence.join(small(prior), "_host", "left").join(small(suffix_ll), "_suffix", "left")
    # the host's prior already holds its suffix's counts; the suffix speaks where the host says nothing
    prior_ll = F.when(F.col("_host") != "", F.col("_prior"))
    text = F.slice("_ll", 1, n) if "text" in use else F.array(*[F.lit(0.0)] * n)
    total = _add(text, _log_declared(F.col("_declared"), names), F.coalesce(prior_ll, _add(neutral, F.col("_suffix_ll")), neutral))
    scored = scored.withColumn("_total", total)
    best = F.array_position("_total", F.array_max("_total")).cast("int")
    post = F.lit(1.0) / F.aggregate("_total", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("_total")))
    known = F.array_max(F.slice("_ll", 1, n)) >= F.element_at("_ll", n + 1)
    return scored.select(
        *columns,
        F.element_at(F.array(*map(F.lit, names)), best).alias("_language"),
        F.round(post, 6).alias("_confidence"),
        (F.col("_letters") & known).alias("_kept"),
    )


def records(spark, sf_dir: str) -> DataFrame:
    """All that has a language: documents with their tag and source, pages with markup, address and main text."""
    from tessera.llm import html
    from tessera.llm.common import read_table

    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("bigint").alias("page_id"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    pages = page_columns(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    pages = cut(html.extract(pages.select("page_id", "html", "declared", "host")))  # three passes read it
    return docs.unionByName(pages.select(F.lit(None).cast("bigint").alias("doc_id"), "page_id", "text", "declared", "host"))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    found = identify(records(spark, sf_dir), ["doc_id", "page_id"], "text", "declared", "host", keep=["doc_id", "page_id", "declared"])
    return found.select("doc_id", "page_id", "declared", F.col("_language").alias("language"), F.col("_confidence").alias("confidence"), F.col("_kept").alias("kept"))
