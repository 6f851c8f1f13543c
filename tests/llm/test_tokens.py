"""Encoding and packing against the tokenizer libraries."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
from helpers import ODD, documents, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bpe, packing

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["a", "Z", "9", " ", "  ", "\n", "\t", "'s", "é", "ß", "日", "!", "--", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "😀", "İ", "ſ", "\x00"]


@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_blocks_split_like_the_pattern(text):
    split = regex.compile(P.PATTERN)
    b = bpe._Block([1, 2], [text, "some more text"], split, 7)
    words = [b.words[i] for i in b.stream]
    assert words[: b.sizes[0]] == split.findall(text) and words[b.sizes[0] :] == ["some", " more", " text"]
    assert bpe._Block([1, 2], [text, "some more text"], split, 7, positions=False).words == b.words


def test_encode_and_decode(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 3000)
    rng = random.Random(1)
    texts = [*ODD, *(prose(rng, n) for n in (3, 50, 400, 2000)), "<|endoftext|> is text"]
    texts += texts[-3:]
    docs = documents(spark, texts, extra=True).repartition(3).sortWithinPartitions("doc_id")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    got = {r.id: r for r in bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()}
    enc = bpe._encoding(RANKS, P.PATTERN)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert list(got[i].ids) == enc.encode_ordinary(t or "")
        assert bytes(got[i].bytes).decode() == (t or "")


def test_encode_nothing(spark):
    assert bpe.decode(bpe.encode(documents(spark, []), RANKS, P.PATTERN), RANKS).count() == 0


# --- packing ----------------------------------------------------------------------------------


def library(texts, name="word_bpe_49k.json"):
    tok = Tokenizer.from_file(P.path(name))
    return [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]


@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_word_encoder(text):
    e = packing.WordEncoder(P.path("word_bpe_49k.json"), 1)
    assert e(text).tolist() == library([text])[0].tolist()


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "a<|ENDOFTEXT|>b", "<|startoftext|>", "é <|endoftext|>", "<|endoftext", "don't I'LL 's"])
def test_special_strings(text):
    assert packing.WordEncoder(P.path("word_bpe_49k.json"), 1)(text).tolist() == library([text])[0].tolist()


def test_other_vocabulary():
    text = "Some  Words, 12 and\nmore é <|endoftext|>."
    assert packing.WordEncoder(P.path("byte_bpe_50k.json"), 1)(text).tolist() == library([text], "byte_bpe_50k.json")[0].tolist()


def check(rows, ids):
    """Every id in one piece, no gaps in a sequence, lengths and sums right."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(range(len(ids)))
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_tokens <= 2048 and own[0].padded_tokens in (2048, at)
    return sum(s[0].padded_tokens - s[0].sequence_tokens for s in by_sequence.values())


def test_pack(spark):
    rng = random.Random(2)
    texts = [*ODD, *(prose(rng, rng.choice([5, 40, 300, 3000])) for _ in range(60)), "same", "same"]
    rows = packing.pack_documents(documents(spark, texts, extra=True), P.path("word_bpe_49k.json")).collect()
    assert check(rows, library(texts)) == 0
    assert packing.pack_documents(documents(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_level_rule_is_the_sum_of_squares():
    rng = np.random.default_rng(3)
    p = packing.Packer(64)
    for _ in range(400):
        p.levels[1:64] = rng.integers(0, 4, 63)
        size = int(rng.integers(1, 64))

        def cost(level, size=size):
            n = p.levels.copy()
            if level:
                n[level] -= 1
            if level + size < 64:
                n[level + size] += 1
            return int((n[1:64] ** 2).sum())

        choices = [0, *(h for h in range(1, 65 - size) if p.levels[h])]
        assert cost(p.level_for(size)) == min(map(cost, choices))


def test_packing_leaves_little_open():
    rng = np.random.default_rng(4)
    p = packing.Packer(64)
    full = [r for i in range(20_000) for r in p.add(i, np.zeros(int(rng.integers(1, 100)), "<u4"))]
    left = sum(fill * len(w) for fill, w in p.open.items())
    assert left < 0.02 * sum(r[2] for r in full)


def test_most_rests_stay_where_the_rule_put_them():
    rng = np.random.default_rng(5)
    p = packing.Packer()
    sizes = rng.lognormal(6, 1, 8_000).astype(int) + 1
    rows = [r for i, n in enumerate(sizes) for r in p.add(i, np.zeros(n, "<u4"))] + [r for r in p.flush()]
    assert sum(r[2] for r in rows) == sizes.sum() and all(r[7] == 2048 or r[7] & (r[7] - 1) == 0 for r in rows)
    assert p.placed >= 7_900 and p.moved < 0.1 * p.placed


@given(st.lists(st.integers(1, 150), max_size=60))
@settings(max_examples=200, deadline=None)
def test_every_id_once(sizes):
    p = packing.Packer(64)
    ids = [np.arange(n, dtype="<u4") + (1 << 17 if n % 2 else 0) for n in sizes]
    rows = [r for i, x in enumerate(ids) for r in p.add(i, x)] + list(p.flush())
    by_doc, by_sequence = {}, {}
    for doc, start, length, crc, total, sequence, offset, filled in rows:
        assert total == sizes[doc] and crc == zlib.crc32(ids[doc][start : start + length].tobytes())
        by_doc.setdefault(doc, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length, filled))
    for doc, own in by_doc.items():
        own.sort()
        assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == sizes[doc]
    assert set(by_doc) == set(range(len(sizes)))
    for own in by_sequence.values():
        own.sort()
        filled = own[0][2]
        assert sum(n for _, n, _ in own) == filled and (filled == 64 or filled & (filled - 1) == 0) and [o for o, _, _ in own] == [sum(n for _, n, _ in own[:k]) for k in range(len(own))]
