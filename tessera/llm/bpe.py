"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Encoding runs in three steps. Each task cuts its documents into blocks of a bounded size, splits
them into pre-tokens and numbers the distinct ones of a block. A block's distinct words are dealt
out by the hash of the word: equal words of all blocks meet in one bucket, where each is encoded
once, and their ids go back to the blocks. Each block then rebuilds its documents from the stream of
word numbers (the positions) and the ids. The words that a block has in one bucket travel as one
compressed row, and a word is in it once however often the block holds it; so a word that makes up a
third of a corpus is a vanishing share of what is shuffled.

Decoding looks each id up in the token-byte table of the vocabulary file, which is bounded by the
vocabulary and not by the corpus.

Defined cases: a null or empty text has no ids; repeated rows are encoded each; null ids are kept;
other columns are ignored. The input must be replayable in the same order (files are); a block that
meets another block's words raises an error.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WHITE_SPACE, tidy

#: Characters of text in a block. A longer document is a block of its own.
BLOCK_CHARS = 8_000_000
#: Buckets of words for each shuffle partition, bytes of input that a bucket aims at, and the most buckets.
BUCKETS_EACH, BUCKET_BYTES, MOST_BUCKETS = 4, 32_000_000, 65_536
#: From here on a planner's size only says that it doesn't know.
UNKNOWN_BYTES = 1 << 60

_SPACES = re.compile(f"[{WHITE_SPACE}]")
_CHUNK = re.compile(f" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
#: White space that the pattern keeps apart from what stands around it, put between pieces.
_BETWEEN = chr(11)


@functools.lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, as in a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


@functools.lru_cache(2)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    ranks = load_ranks(path)
    table = [b""] * (max(ranks.values()) + 1)
    for piece, i in ranks.items():
        table[i] = piece
    return table


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py() or ""
            if texts and size + len(t) > BLOCK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if texts:
        yield ids, texts


class _Block:
    """The distinct words of a block and the stream of their numbers.

    The pattern joins a word with one space before it and with no other white space beyond it, so
    texts are cut at spaces and the pattern runs once over the distinct pieces of the block. Texts
    where a space meets other white space or an end are cut in the pattern's own way.
    """

    def __init__(self, ids: list, texts: list[str], pattern: regex.Pattern, n_buckets: int, positions: bool = True):
        digest = xxhash.xxh3_64(repr(ids).encode())
        for t in texts:
            digest.update(t.encode())
        self.key = digest.intdigest() - (1 << 63)

        cuts = [t.split(" ") for t in texts]
        pieces = dict.fromkeys(chain.from_iterable(cuts))
        odd = {p for p in pieces if not p or _SPACES.match(p[0]) or _SPACES.match(p[-1]) or _BETWEEN in p}
        whole = [not odd or odd.isdisjoint(c) for c in cuts]
        safe = [p for p in pieces if p not in odd] if odd else list(pieces)
        own = [p for p in dict.fromkeys(c[0] for c in cuts) if p not in odd]  # nothing before them
        chunks = dict.fromkeys(x for t, ok in zip(texts, whole) if not ok for x in _CHUNK.findall(t))

        parts = pattern.findall(_BETWEEN.join([*(" " + p for p in safe), *own]) + _BETWEEN) if safe else []
        rest = [pattern.findall(c) for c in chunks]
        words = dict.fromkeys(parts)
        words.pop(_BETWEEN, None)
        words.update(dict.fromkeys(chain.from_iterable(rest)))
        self.words = list(words)
        self.bucket = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64) % np.uint64(n_buckets)
        if not positions:
            return

        words = dict(zip(self.words, range(len(self.words))))
        held = words.get(_BETWEEN)  # a word of its own if an odd text has it
        words[_BETWEEN] = -1
        flat = np.array([words[w] for w in parts], np.int64)
        if held is not None:
            words[_BETWEEN] = held
        ends = np.flatnonzero(flat < 0) - np.arange((flat < 0).sum())
        more = [np.array([words[w] for w in r], np.int64) for r in rest]
        first = np.concatenate([[0], ends, (ends[-1] if len(ends) else 0) + np.cumsum([len(m) for m in more], dtype=np.int64)]).astype(np.int64)
        flat = np.concatenate([flat[flat >= 0], *more]).astype(np.uint32)
        number = dict(zip(safe, range(len(safe))))
        heads = dict(zip(own, range(len(safe), len(safe) + len(own))))
        at = dict(zip(chunks, range(len(safe) + len(own), len(safe) + len(own) + len(chunks))))
        out = []
        for t, c, ok in zip(texts, cuts, whole):
            if ok:
                row = np.array([number[p] for p in c], np.int64)
                row[0] = heads[c[0]]
            else:
                row = np.array([at[x] for x in _CHUNK.findall(t)], np.int64)
            out.append(gather(first, flat, row))
        self.sizes = [len(x) for x in out]
        self.stream = np.concatenate(out) if out else np.zeros(0, np.uint32)


def gather(first: np.ndarray, parts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Concatenate ``parts[first[r]:first[r + 1]]`` for each r of ``rows``."""
    if not len(rows):
        return parts[:0]
    lens = first[rows + 1] - first[rows]
    ends = np.cumsum(lens)
    at = np.arange(ends[-1]) + np.repeat(first[rows] - (ends - lens), lens)
    return parts[at]


def _pack(numbers: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _pack_words(words: list[str]) -> bytes:
    data = [w.encode() for w in words]
    sizes = np.array([len(w) for w in data], "<u4")
    return zstandard.ZstdCompressor(level=3).compress(len(data).to_bytes(4, "little") + _wide(sizes) + b"".join(data))


def _unpack_words(blob: bytes) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:4], "little")
    sizes = _narrow(data[4 : 4 + 4 * n], n)
    ends = (np.cumsum(sizes, dtype=np.int64) + 4 + 4 * n).tolist()
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def _wide(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes()


def _narrow(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, n).T).view("<u4").ravel()


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids)``: the ids of every whole text, one row for each row of ``docs``."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = source.schema["id"].dataType.simpleString()

    planned = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # by the files' sizes
    planned = 0 if planned >= UNKNOWN_BYTES else planned
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_parts = max(n_parts, min(planned // BUCKET_BYTES, MOST_BUCKETS) // BUCKETS_EACH)
    n_buckets = BUCKETS_EACH * n_parts

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        for ids, texts in _blocks(batches):
            b = _Block(ids, texts, split, n_buckets, positions=False)
            order = np.argsort(b.bucket, kind="stable")
            used, first = np.unique(b.bucket[order], return_index=True)
            blobs = [_pack_words([b.words[i] for i in own]) for own in np.split(order, first[1:])] if len(used) else []
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(np.full(len(used), b.key)), pa.array(blobs, pa.binary())], ["bucket", "block", "words"])

    def streams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        for ids, texts in _blocks(batches):
            b = _Block(ids, texts, split, n_buckets)
            yield pa.RecordBatch.from_pylist(
                [{"block": b.key, "id": ids, "sizes": b.sizes, "buckets": _pack(b.bucket.astype(np.uint32)), "stream": _pack(b.stream)}],
                pa.schema([("block", pa.int64()), ("id", pa.list_(id_arrow)), ("sizes", pa.list_(pa.int64())), ("buckets", pa.binary()), ("stream", pa.binary())]),
            )

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(ranks_path, pattern)
        last, known = None, {}
        for batch in batches:
            out = []
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("words")):
                if bucket != last:  # rows are sorted by bucket: each distinct word is encoded once
                    last, known = bucket, {}
                own = _unpack_words(blob.as_py())
                for w in own:
                    if w not in known:
                        known[w] = np.array(enc.encode_ordinary(w.decode()), "<u4").tobytes()
                ids = [known[w] for w in own]
                sizes = np.array([len(x) // 4 for x in ids], "<u4")
                flat = np.frombuffer(b"".join(ids), "<u4")
                out.append(zstandard.ZstdCompressor(level=3).compress(len(ids).to_bytes(4, "little") + _wide(sizes) + _wide(flat)))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "ids"])

    def rebuild(key: tuple, words: pa.Table, streams: pa.Table) -> pa.Table:
        got: dict[int, bytes] = dict(zip(words.column("bucket").to_pylist(), words.column("ids").to_pylist()))  # equal blocks give equal rows
        sizes, flat = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        for bucket in sorted(got):
            data = zstandard.ZstdDecompressor().decompress(got[bucket])
            n = int.from_bytes(data[:4], "little")
            sizes.append(_narrow(data[4 : 4 + 4 * n], n))
            flat.append(_narrow(data[4 + 4 * n :], (len(data) - 4 - 4 * n) // 4))
        ends = np.cumsum(np.concatenate(sizes), dtype=np.int64)
        flat = np.concatenate(flat)
        names, lists = [], []
        for s in streams.to_pylist():
            buckets = _unpack(s["buckets"])
            if len(buckets) != len(ends) or sorted(got) != np.unique(buckets).tolist():
                raise ValueError("the documents came in another order when read again; write them to a table first")
            # words came by bucket; place[w] is where word w of the block stands among them
            place = np.empty(len(buckets), np.int64)
            place[np.argsort(buckets, kind="stable")] = np.arange(len(buckets))
            first = np.concatenate([[0], ends])
            numbers, at = place[_unpack(s["stream"])], 0
            for n in s["sizes"]:
                lists.append(gather(first, flat, numbers[at : at + n]).astype(np.int32))
                at += n
            names += s["id"]
        offsets = np.cumsum([0, *map(len, lists)]).astype(np.int64)
        values = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int32), pa.int32())
        return pa.table({"id": pa.array(names, id_arrow), "ids": pa.LargeListArray.from_arrays(offsets, values).cast(pa.list_(pa.int32()))})

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(source.schema["id"].dataType)
    words = source.mapInArrow(tidy(words_of), "bucket bigint, block bigint, words binary")
    words = words.repartition(n_parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(encode_words), "block bigint, bucket bigint, ids binary")
    streams = source.mapInArrow(tidy(streams_of), f"block bigint, id array<{id_type}>, sizes array<bigint>, buckets binary, stream binary")
    return words.groupBy("block").cogroup(streams.groupBy("block")).applyInArrow(rebuild, f"id {id_type}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Add ``bytes`` to ``(…, ids)``: the joined bytes of the ids, by the token-byte table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks_path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            out = [b"".join([table[i] for i in x.values.to_numpy()]) if x.is_valid and len(x) else b"" for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "bytes"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(tidy(run), f"{fields}, bytes binary")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.common import read_table

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return decode(encoded, path).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
