"""Packing of token ids into windows by the sum-of-squares rule.

A document longer than a window is cut into whole windows and a rest. Each rest goes to the fill
level that makes the sum of the squared numbers of windows per level smallest; the numbers stand in
an array over the levels, so a placement costs one pass over that array however many windows are
open. At the end of a task's documents the fuller ones of the windows that are still open keep what
the rule placed in them, and the emptiest ones are taken apart and cut to fill their gaps (documents
may be cut freely); the last remainder of under a window becomes windows whose lengths are powers of
two. So nothing is padded.

A task holds the rests in its open windows, two bytes an id where the vocabulary allows it; their number
is that of the task's documents at most. Tasks pack on their own: a sequence id holds the task's
partition, so ids are unique, and a task that is run again gives the same rows. Defined cases: a null or
empty text has only the end id; repeated rows are packed each; null ids are kept; other columns are
ignored. The tokenizer's own special strings in a text get their special ids, as in the library's call.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy

WINDOW = 2048
#: Distinct words, and distinct words with the marks around them, whose ids a worker keeps.
MAX_WORDS = 400_000

# Texts of these characters only (ASCII without control characters, Latin-1 and Latin Extended-A
# letters that lower to one character) are split at white space before the tokenizer sees them:
# its pre-tokens never cross white space and its normalizer works character by character there.
_PLAIN = re.compile(f"[\t\n\r -~{chr(0xA0)}-{chr(0x12F)}{chr(0x131)}-{chr(0x148)}{chr(0x14A)}-{chr(0x17E)}]*")


@functools.lru_cache(1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(1)
def _fast_pattern(path: str) -> regex.Pattern | None:
    """The file's pattern of pre-tokens, if the file has the steps that ``WordEncoder`` takes by itself."""
    with open(path, "rb") as f:
        file = json.load(f)
    steps = [x.get("type") for x in (file.get("normalizer") or {}).get("normalizers", [])]
    parts = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in parts] != ["Split", "ByteLevel"] or file.get("post_processor"):
        return None
    spaces, split, as_bytes = file["normalizer"]["normalizers"][1], parts[0], parts[1]
    pattern = split["pattern"].get("Regex")
    same = spaces["pattern"] == {"Regex": r"\s+"} and spaces["content"] == " " and (split["behavior"], split["invert"]) == ("Removed", True) and not as_bytes["add_prefix_space"] and not as_bytes["use_regex"]
    return regex.compile(pattern) if same and pattern == WORDS else None


#: Fixed value: the pattern of pre-tokens that never cross white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Ids of a text by a tokenizer that lowers case and drops white space.

    Words between white space, and the pre-tokens in them, are kept with their ids in two stores of
    bounded size, so the merges run once for each pre-token while it is in the store.
    """

    def __init__(self, path: str, end_id: int):
        self.tok, self.end = _tokenizer(path), end_id.to_bytes(4, "little")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.pattern = _fast_pattern(path)
        special = [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)), re.I) if special else None

    def __call__(self, text: str) -> np.ndarray:
        if self.pattern is None or not _PLAIN.fullmatch(text) or self.special and self.special.search(text):
            return np.frombuffer(np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + self.end, "<u4")
        words = text.lower().split()
        known = self.words
        new = set(words).difference(known)
        if new:
            if len(known) + len(new) > MAX_WORDS:
                known.clear()
                new = set(words)
            if len(self.pieces) > MAX_WORDS:
                self.pieces.clear()
            ids, model = self.pieces, self.tok.model
            for w in new:
                parts = self.pattern.findall(w)
                for p in parts:
                    if p not in ids:
                        ids[p] = b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTE_CHARS))])
                known[w] = ids[parts[0]] if len(parts) == 1 else b"".join([ids[p] for p in parts])
        return np.frombuffer(b"".join([*[known[w] for w in words], self.end]), "<u4")


def _byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: itself if it is
    printable, else the next of those from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


_BYTE_CHARS = _byte_chars()


class Packer:
    """Places pieces online; ``rows`` are (document, start, length, crc, total, sequence, offset, filled)."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0):
        self.window, self.sequence = window, first_sequence
        self.levels = np.zeros(window + 1, np.int64)  # partially filled windows by fill
        self.open: dict[int, list[list]] = {}  # fill: windows, each a list of pieces
        self.placed = self.moved = 0  # rests that the rule placed, and those of them cut up at the end

    def _close(self, pieces: list) -> Iterator[tuple]:
        at, filled = 0, sum(len(p[2]) for p in pieces)
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, at, filled
            at += len(ids)
        self.sequence += 1

    def level_for(self, size: int) -> int:
        """The fill to place ``size`` at; 0 opens a window. Ties go to the fullest."""
        n, w = self.levels, self.window
        fills = np.flatnonzero(n[: w - size + 1])
        best, where = 2 * n[size] + 1, 0
        if len(fills):
            after = fills + size
            change = np.where(after == w, 1 - 2 * n[fills], 2 * (n[after] - n[fills]) + 2)
            k = len(fills) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                where = int(fills[k])
        return where

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        total, w = len(ids), self.window
        whole = total // w * w
        for start in range(0, whole, w):
            yield from self._close([(doc, start, ids[start : start + w], total)])
        if whole == total:
            return
        rest = ids[whole:]
        rest = rest.astype("<u2") if rest.max() < 1 << 16 else rest.copy()  # held without the document's other ids
        size = total - whole
        level = self.level_for(size)
        pieces: list = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
        pieces.append((doc, whole, rest, total))
        self.placed += 1
        if level + size == w:
            yield from self._close(pieces)
        else:
            self.open.setdefault(level + size, []).append(pieces)
            self.levels[level + size] += 1

    def flush(self) -> Iterator[tuple]:
        """Fill the open windows, fullest first, with what the emptiest ones hold."""
        windows = [(fill, pieces) for fill in sorted(self.open, reverse=True) for pieces in self.open[fill]]
        self.open = {}
        self.levels[:] = 0
        loose: list = []  # pieces of windows taken apart, the next one last
        first, last = 0, len(windows)
        while first < last:
            fill, pieces = windows[first]
            first += 1
            room = self.window - fill
            while room and (loose or first < last):
                if not loose:
                    last -= 1
                    loose = windows[last][1][::-1]
                    self.moved += len(loose)
                doc, start, ids, total = loose.pop()
                pieces.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    loose.append((doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            if room:  # nothing is left to fill it
                loose = pieces[::-1]
                self.moved += len(loose)
            else:
                yield from self._close(pieces)
        yield from self._powers(loose[::-1])

    def _powers(self, pieces: list) -> Iterator[tuple]:
        """Windows whose lengths are powers of two, for under a window of ids."""
        rest = sum(len(p[2]) for p in pieces)
        room = 1 << (rest.bit_length() - 1) if rest else 0
        own: list = []
        for doc, start, ids, total in pieces:
            while len(ids):
                own.append((doc, start, ids[:room], total))
                taken = min(room, len(ids))
                start, ids, room, rest = start + taken, ids[taken:], room - taken, rest - taken
                if not room:
                    yield from self._close(own)
                    own, room = [], 1 << (rest.bit_length() - 1) if rest else 0


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_tokens."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        rows: list = []
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.extend(packer.add(i, encode(t.as_py() or "")))
            yield _rows(rows)
            rows = []
        yield _rows(list(packer.flush()))

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(source.schema["id"].dataType), *[pa.int64()] * 7]
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]

    def _rows(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names)

    out = source.mapInArrow(tidy(run), f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in names[1:]))
    power = F.col("sequence_tokens").bitwiseAND(F.col("sequence_tokens") - 1) == 0
    return out.withColumn("padded_tokens", F.when(power, F.col("sequence_tokens")).otherwise(F.lit(window)).cast("bigint"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, **kw) -> DataFrame:
    return pack(docs, lambda: WordEncoder(tokenizer_path, end_id), **kw).withColumnRenamed("id", "doc_id")


def op6_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.common import read_table

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
