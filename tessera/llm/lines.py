"""Removal of repeated passages, by digests of lines, sentences and clauses grouped over the whole corpus.

A document is cut into lines, lines into sentences, and sentences into clauses of ``LEAST_WORDS`` words
or more. A unit is normalised to its
lower-case words. Units of at least ``LEAST_WORDS`` words are known by their own words. A shorter unit is
known by two runs of ``LEAST_WORDS`` words of the document, the one that ends with it and the one that
begins with it, and is repeated if either is. So a common short line isn't taken for a repetition where
what stands around it is new, and a repeated passage of short lines is one from its first line to its
last. A line that begins with a short unit is also known as a whole. Long words count once per
``WORD_CHARS`` characters, and two characters of a script without spaces count as a word.

Per digest the smallest id keeps its (first) occurrence. All other repeated units go, with the white
space after them, where units next to each other hold ``LEAST_RUN`` words together: a line of
boilerplate alone stays, a passage goes. What is left of a passage are parts of clauses at its ends.

A document's own repetitions are found where it is read, so the shuffle holds a digest at most
once per document, and only digests of several documents come back, with a mark for each document that
repeats itself; all others aren't read again. Spans are offsets in code points
of the original text.

Defined cases: null and empty texts have no units and stay as they are; rows that share an id are
one document and keep their occurrences; rows with a null id are ranked last, each text by itself, and
their units are repeated if any other id has them; other columns stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, small, tidy

LEAST_WORDS, LEAST_RUN = 8, 16
#: First half of the digests that mark documents which repeat themselves; the second half is of the text.
OWN = b"repeated"
#: Bytes of repeated digests up to which they are broadcast.
BROADCAST_DIGESTS = 2_000_000

#: Characters of a run without spaces that count as a word.
WORD_CHARS = 16
#: Scripts written without spaces (Thai to Myanmar, Khmer, kana, Han).
_SPACELESS = "\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"

_LINE = re.compile(r"[^\n]+\n*|\n+")
_END = re.compile(r"[.!?…][\"'”»)]*\s+|[。！？][\"'”’」』）]*\s*")
_CLAUSE = re.compile(r"[,;:]\s+|[、，；：]")
_WORD = re.compile(rf"[^\W_]{{1,{WORD_CHARS}}}")
_ANY_WORD = re.compile(rf"[^\W_{_SPACELESS}]{{1,{WORD_CHARS}}}|[{_SPACELESS}]{{1,2}}")
_HAS_SPACELESS = re.compile(f"[{_SPACELESS}]")


def _words(text: str):
    return (_ANY_WORD if not text.isascii() and _HAS_SPACELESS.search(text) else _WORD).findall


def units(text: str, least: int = LEAST_WORDS) -> Iterator[tuple[int, int, str]]:
    """``(start, end, key)`` of each unit that can be removed; a line comes before its parts."""
    find = _words(text)
    words: list[str] = []  # of the document
    found = []  # (start, end, first word, word after the last, whether a line of several sentences)
    for line in _LINE.finditer(text):
        start, stop = line.span()
        at, first = start, len(words)
        parts = []
        ends = [m.end() for m in _END.finditer(text, start, stop)]
        if not ends or ends[-1] < stop:
            ends.append(stop)  # the line's last sentence ends with the line
        for end in ends:
            own = find(text[at:end].lower())
            i, j = len(words), len(words) + len(own)
            words += own
            if len(own) >= 2 * least:  # clauses, where both sides of a mark have words enough
                for m in _CLAUSE.finditer(text, at, end):
                    k = i + len(find(text[at : m.end()]))
                    if k - i >= least and j - k >= least:
                        parts.append((at, m.end(), i, k, False))
                        at, i = m.end(), k
            parts.append((at, end, i, j, False))
            at = end
        if len(parts) > 1 and parts[0][3] - first < least <= len(words) - first:
            found.append((start, stop, first, len(words), True))
        found += parts
    for start, stop, i, j, whole in found:
        if whole:
            # a line of several sentences has a key that none of its sentences can have
            yield start, stop, "\n" + " ".join(words[i:j])
        elif j - i >= least:
            yield start, stop, " ".join(words[i:j])
        elif j > i:
            if j >= least:
                yield start, stop, " ".join(words[j - least : j])
            if i + least <= len(words):
                yield start, stop, ">" + " ".join(words[i : i + least])


def _digests(text: str) -> list[tuple[int, int, bytes]]:
    digest = xxhash.xxh3_128_digest
    return [(a, b, digest(key)) for a, b, key in units(text)]


def _row_key(id_col: str, text_col: str):
    """0, but for rows with a null id a hash of the text, so that those rows don't meet in one group.

    What is repeated in a row with a null id is so in any such row, so equal hashes do no harm.
    """
    return F.when(F.col(f"`{id_col}`").isNull(), F.xxhash64(F.col(f"`{text_col}`"))).otherwise(F.lit(0).cast("bigint"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, k, digests)``: per document the digests that a smaller id has too; one of ``OWN`` if it repeats itself."""
    source = docs.select(F.col(f"`{id_col}`").alias("id"), _row_key(id_col, text_col).alias("k"), F.col(f"`{text_col}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, counts = [], []
            for t in batch.column(2):
                text = t.as_py() or ""
                every = _digests(text)
                own = {d for _, _, d in every}
                if len(own) < len(every) and removed(text, set(), every):
                    own.add(OWN + xxhash.xxh3_64_digest(text))
                found += own
                counts.append(len(own))
            h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))], ["id", "k", "h1", "h2"])

    places = source.mapInArrow(tidy(run), f"id {kind}, k bigint, h1 bigint, h2 bigint")
    firsts = places.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.col("id").isNull()).alias("nulls"))
    marks = F.col("h1") == int.from_bytes(OWN, "little", signed=True)
    firsts = cut(firsts.where(F.expr("first != last or (nulls and first is not null)") | marks).select("h1", "h2", "first"))
    again = places.join(small(firsts, BROADCAST_DIGESTS), ["h1", "h2"]).where(F.expr("id is null or id != first") | marks)
    return again.groupBy("id", "k").agg(F.collect_set(F.struct("h1", "h2")).alias("digests"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text that is left and ``_spans``, the removed parts of the original text."""
    names = docs.columns
    at = names.index(text_col)
    if clash := {"_id", "_k", "_digests", "_spans"}.intersection(names):
        raise ValueError(f"columns have names that the operator adds: {sorted(clash)}")
    gone = repeated(docs, id_col, text_col).select(F.col("id").alias("_id"), F.col("k").alias("_k"), F.col("digests").alias("_digests"))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (_row_key(id_col, text_col) == F.col("_k"))
    joined = docs.join(gone, same, "left").drop("_id", "_k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for t, digests in zip(batch.column(at), batch.column(len(names))):
                text = t.as_py()
                out: list[list[int]] = []
                if text and digests.is_valid:
                    others = {np.array([d["h1"], d["h2"]], "<i8").tobytes() for d in digests.as_py()}
                    out = removed(text, others)
                    if out:
                        ends = [0, *(b for _, b in out)]
                        text = "".join(text[a:b] for a, b in zip(ends, [*(a for a, _ in out), len(text)]))
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in out])
            columns = [*batch.columns[: len(names)], pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, [*names, "_spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(tidy(run), f"{fields}, _spans array<struct<start: bigint, end: bigint>>")


def removed(text: str, others: set[bytes], every: list[tuple[int, int, bytes]] | None = None) -> list[list[int]]:
    """Spans of the units whose digest is in ``others`` or came before in the text, joined, that are long enough."""
    seen: set[bytes] = set()
    out: list[list[int]] = []
    for a, b, d in every or _digests(text):
        if d in others or d in seen:
            if out and a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        seen.add(d)
    find = _words(text)
    return [[a, b] for a, b in out if len(find(text[a:b])) >= LEAST_RUN]


def op10_repeated_passages(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read_table

    found = deduplicate(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.size("_spans").cast("bigint").alias("n_removed"), F.col("_spans").alias("removed"))
