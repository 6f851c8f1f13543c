"""Near-duplicates, vectors, fingerprints, repeated passages: against brute force."""

import hashlib
import os
import random
import re

import numpy as np
import pytest
from helpers import ODD, components, documents, prose
from pyspark.sql import functions as F

from tessera.llm import fingerprint, lines, minhash, vectors


def shingles(text, w):
    words = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return frozenset(tuple(words[i : i + w]) for i in range(max(1, len(words) - w + 1))) if words else frozenset()


def brute(texts, w, percent=80):
    sets = {i: shingles(t, w) for i, t in enumerate(texts)}
    edges = [(i, j) for i in sets for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return sets, components(sets, edges)


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(["edit", "other", "change"]) + str(rng.random())
    return " ".join(words)


def family(seed):
    rng = random.Random(seed)
    texts = [*ODD, "one", "ONE", "x y", "x Y"]
    for _ in range(12):
        base = prose(rng, rng.choice([8, 60, 200]))
        texts.append(base)
        texts += [edited(rng, base, rng.randint(0, max(1, len(base.split()) // 14))) for _ in range(rng.randint(0, 9))]
    chain = prose(rng, 120)
    for _ in range(10):  # each is near the one before, not the first
        texts.append(chain)
        chain = edited(rng, chain, 4)
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "width"), [(1, 2), (2, 5)])
def test_near_duplicates(spark, seed, width, monkeypatch):
    texts = family(seed)
    sets, want = brute(texts, width)
    got = minhash.near_duplicates(documents(spark, texts, extra=True), width=width).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_shingles == len(sets[r.id]) and r.component_id == want[r.id]


def test_tiles_find_what_leaders_leave(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 4)
    real = minhash._confirmed
    calls = []

    def first_only(pairs, *a):  # the leaders find nothing
        calls.append(1)
        return real(pairs.limit(0), *a)

    monkeypatch.setattr(minhash, "_confirmed", first_only)
    texts = family(3)
    _, want = brute(texts, 2)
    got = {r.id: r.component_id for r in minhash.near_duplicates(documents(spark, texts), width=2).collect()}
    assert calls
    members = {}
    for i, c in want.items():
        members.setdefault(c, []).append(i)
    # buckets of two are settled by the leader alone
    assert all(got[i] == want[i] for c, own in members.items() if len(own) > 4 for i in own)


def test_many_copies(spark):
    rng = random.Random(4)
    base = prose(rng, 80)
    texts = [base] * 300 + [edited(rng, base, 2) for _ in range(120)] + [prose(rng, 80)]
    got = {r.id: r.component_id for r in minhash.near_duplicates(documents(spark, texts), width=2).collect()}
    assert all(got[i] == 0 for i in range(300)) and got[420] == 420
    assert got == brute(texts, 2)[1]


def test_near_duplicate_edges(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    same = documents(spark, ["a b c d e f"] * 2)
    nulls = same.withColumn("doc_id", F.lit(None).cast("bigint"))
    got = minhash.near_duplicates(nulls.unionByName(same).unionByName(same), width=2).collect()
    assert sorted((r.id if r.id is not None else -1, r.component_id) for r in got if r.id is not None) == [(0, 0), (0, 0), (1, 0), (1, 0)]
    assert [r.component_id for r in got if r.id is None] == [None, None]


def test_least_matches_is_the_posterior():
    for k, m in enumerate(minhash.least_matches(0.8)):
        n = minhash.BATCH * (k + 1)
        x = np.linspace(0, 1, 200_001)
        tail = lambda m, n=n: (d := x**m * (1 - x) ** (n - m))[x >= 0.8].sum() / d.sum()
        assert tail(m) >= minhash.MISS * 0.99 and (m == 0 or tail(m - 1) < minhash.MISS * 1.01)


# --- vectors ----------------------------------------------------------------------------------


def near(rng, v, cosine):
    u = rng.normal(size=len(v))
    u -= u @ v * v
    return cosine * v + np.sqrt(1 - cosine**2) * u / np.linalg.norm(u)


def vector_rows(seed, n=260, dim=32):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i > 20 and rng.random() < 0.5:
            j = int(rng.integers(0, len(rows)))
            v = np.array(rows[j][1])
            v = near(rng, v / np.linalg.norm(v), float(rng.uniform(0.96, 1.0))) * rng.uniform(0.5, 2) if rng.random() < 0.7 else v
            label = rows[j][2]
        else:
            v, label = rng.normal(size=dim), int(rng.integers(0, 3))
        rows.append((i, [float(x) for x in v], label))
    return rows


def brute_vectors(rows, threshold=0.98):
    ok = [(i, np.array(v, float), y) for i, v, y in rows if v is not None and None not in v and len(v) and y is not None and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    edges = [(a, b) for k, (a, x, y) in enumerate(ok) for b, z, w in ok[:k] if y == w and len(x) == len(z) and x @ z / np.sqrt((x @ x) * (z @ z)) >= threshold]
    links = {r[0]: 0 for r in rows}
    for a, b in edges:
        links[a] += 1
        links[b] += 1
    return links, components(links, edges), edges


@pytest.mark.parametrize(("tile", "split"), [(512, 4096), (7, 4096), (16, 40)])
def test_near_vectors(spark, tile, split, monkeypatch):
    monkeypatch.setattr(vectors, "TILE", tile)
    monkeypatch.setattr(vectors, "SPLIT", split)
    rows = vector_rows(1)
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [float("inf")] * 32, [1.0, 2.0], [1.0, 2.0], [1e200] * 32]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)] + [(2000, rows[0][1], None)]
    links, parts, edges = brute_vectors(rows)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("pivot", F.lit(1))
    got = vectors.near_vectors(df).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got) / 2
    assert found >= 0.9 * len(edges) and found <= len(edges)
    assert {r.id: r.n_links for r in got} == links
    assert {r.id: r.component_id for r in got} == parts


def test_ids_that_repeat_over_different_vectors(spark):
    """Rows are vectors of their own; brute force over row numbers."""
    rng = np.random.default_rng(8)
    rows = [(0 if y is None else i, v, y) for i, v, y in vector_rows(3, n=200)]
    rows = [(int(rng.integers(0, 60)) if rng.random() < 0.9 else None, v, y if rng.random() < 0.95 else None) for _, v, y in rows]
    rows += rows[:30]
    numbered = [(k, v if i is not None else None, y) for k, (i, v, y) in enumerate(rows)]
    links, parts, edges = brute_vectors(numbered)
    least = {}
    for k, c in parts.items():
        if rows[k][0] is not None:
            least[c] = min(least.get(c, 10**9), rows[k][0])
    want = sorted((rows[k][0] is None, rows[k][0] or 0, links[k], least.get(parts[k]) if rows[k][0] is not None else None) for k in range(len(rows)))
    assert len(edges) > 60
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted((r.id is None, r.id or 0, r.n_links, r.component_id) for r in got) == want
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    four = [(1, a, 0), (1, b, 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.01, 1.0, 0.0], 0)]
    got = vectors.near_vectors(spark.createDataFrame(four, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_recall_on_the_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    _, _, edges = brute_vectors([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()])
    found = sum(r.n_links for r in vectors.near_vectors(df).collect()) / 2
    assert 0.9 * len(edges) <= found <= len(edges)


def test_recall_on_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in near(rng, centres[i % 40], 0.991)], 0) for i in range(1200)]
    links, _, edges = brute_vectors(rows)
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    exact = [(i, list(np.array(v, np.float32).astype(float)), y) for i, v, y in rows]
    want = len(brute_vectors(exact)[2])
    assert want > 1000 and sum(r.n_links for r in got) / 2 >= 0.9 * want


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


# --- fingerprints -----------------------------------------------------------------------------


def plain_sets(texts):
    def of(t):
        words = [x for x in re.split(r"[\x20\x09-\x0d]+", (t or "").lower()) if x]
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    return [of(t) for t in texts]


def test_fingerprint_estimates(spark):
    rng = random.Random(9)
    base = prose(rng, 800)
    texts = [base, edited(rng, base, 20), edited(rng, base, 80), prose(rng, 700), base + " " + prose(rng, 800), "", "one", "a b c d e", None]
    sets = plain_sets(texts)
    df = documents(spark, texts).withColumn("fp", fingerprint.sketch(F.coalesce("text", F.lit(""))))
    pairs = df.selectExpr("doc_id a", "fp x").join(df.selectExpr("doc_id b", "fp y"), F.col("a") <= F.col("b"))
    x, y = F.col("x"), F.col("y")
    got = pairs.select("a", "b", fingerprint.resemblance(x, y).alias("r"), fingerprint.containment(x, y).alias("c"), fingerprint.distinct_shingles(x).alias("n"), fingerprint.merge(x, y).alias("m")).collect()
    for g in got:
        a, b = sets[g.a], sets[g.b]
        assert g.r == pytest.approx(len(a & b) / len(a | b) if a | b else 1, abs=0.15)
        assert g.c == pytest.approx(len(a & b) / len(a) if a else 1, abs=0.2)
        assert g.n == pytest.approx(len(a), rel=0.35, abs=0.5)
    # the fingerprint of a whole is the merger of its parts'
    parts = spark.createDataFrame([("a b c d e f g h", "e f g h i j k l", "a b c d e f g h i j k l")], "p string, q string, w string")
    r = parts.select(fingerprint.merge(fingerprint.sketch(F.col("p")), fingerprint.sketch(F.col("q"))).alias("m"), fingerprint.sketch(F.col("w")).alias("w")).first()
    assert r.m == r.w


def test_next_rows(spark, tmp_path):
    rng = random.Random(10)
    texts = [*ODD, *(prose(rng, rng.randint(1, 200)) for _ in range(300))]
    ids = rng.sample(range(10**9), len(texts))
    rows = [(i, t, None, None, None) for i, t in zip(ids, texts)]
    from helpers import SCHEMA

    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fingerprint.op9_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        new = t[: len(t) - m] + after[:m]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        if new == t:
            assert got[i].fingerprint == got[i].edited_fingerprint and got[i].near_edited == 1


def test_fingerprints_without_python(spark, tmp_path):
    documents(spark, ["a b c d e f", "b"]).write.parquet(str(tmp_path / "documents.parquet"))
    df = fingerprint.op9_fingerprints(spark, str(tmp_path))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def test_fingerprint_edges(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    assert fingerprint.op9_fingerprints(spark, str(tmp_path / "a")).count() == 0
    rows = [(1, "same text"), (1, "same text"), (None, "x"), (2, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert fingerprint.op9_fingerprints(spark, str(tmp_path / "b")).count() == 4
    documents(spark, ["only"]).write.parquet(str(tmp_path / "c" / "documents.parquet"))
    assert fingerprint.op9_fingerprints(spark, str(tmp_path / "c")).first().edited_sha256 == hashlib.sha256(b"onlo").hexdigest()


# --- repeated passages ------------------------------------------------------------------------


def slow_units(text):
    """(start, end, keys) by plain rules: lines, in them what ends with punctuation and white space."""
    word = "[^\\W_]"
    ends = [0]
    out = []
    for line in re.findall(r"[^\n]+\n*|\n+", text):
        start, stop = ends[-1], ends[-1] + len(line)
        ends.append(stop)
        cuts = [start] + [start + m.end() for m in re.finditer(r"[.!?…][\"'”»)]*\s+", line)]
        cuts += [stop] if cuts[-1] < stop else []
        count = lambda a, b: len(re.findall(f"{word}+", text[a:b]))
        own = []
        for a, b in zip(cuts, cuts[1:]):
            for m in re.finditer(r"[,;:]\s+", text[a:b]):
                c = a + m.end()
                if min(count(own[-1][1] if own and own[-1][1] > a else a, c), count(c, b)) >= 8:
                    own.append((own[-1][1] if own and own[-1][1] > a else a, c))
            own.append((own[-1][1] if own and own[-1][1] > a else a, b))
        if len(own) > 1 and count(*own[0]) < 8 <= count(start, stop):
            out.append((start, stop, "line"))
        out += [(a, b, "part") for a, b in own]
    keyed = []
    for a, b, what in out:
        before = re.findall(f"{word}+", text[:b].lower())
        own = re.findall(f"{word}+", text[a:b].lower())
        after = re.findall(f"{word}+", text[a:].lower())
        if what == "line":
            keyed.append((a, b, [("line", *own)]))
        elif len(own) >= 8:
            keyed.append((a, b, [("own", *own)]))
        elif own:
            keyed.append((a, b, [("own", *before[-8:])] * (len(before) >= 8) + [("after", *after[:8])] * (len(after) >= 8)))
    return keyed


def slow_dedup(texts):
    first = {}
    for i, t in enumerate(texts):
        for _, _, keys in slow_units(t or ""):
            for key in keys:
                first.setdefault(key, i)
    out = []
    for i, t in enumerate(texts):
        gone, seen = [False] * len(t or ""), set()
        for a, b, keys in slow_units(t or ""):
            if any(first[k] != i or k in seen for k in keys):
                gone[a:b] = [True] * (b - a)
            seen.update(keys)
        at = 0
        while at < len(gone):
            end = next((k for k in range(at, len(gone)) if gone[k] != gone[at]), len(gone))
            if gone[at] and len(re.findall(r"[^\W_]+", t[at:end])) < 16:
                gone[at:end] = [False] * (end - at)
            at = end
        out.append("".join(c for c, g in zip(t, gone) if not g) if t else t)
    return out


def test_passages_against_plain_rules(spark):
    rng = random.Random(21)
    words = ["ab", "cd", "ef", "gh", "ij", "kl"]
    long = [" ".join(prose(rng, n, words).lower().replace(".", ",").split()) for n in (20, 40)]
    bits = long + [prose(rng, n, words) for n in (3, 9, 17, 30)] + ["one, two; three: four", "Five six. ", "a_b", "\n\n", "seven\neight\nnine\nten\n"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", "\n", ", "]) for _ in range(rng.randint(1, 9))) for _ in range(150)] + ODD[:9]
    got = [r.text for r in lines.deduplicate(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got == slow_dedup(texts)


def test_repeated_passages(spark):
    rng = random.Random(11)
    passage = prose(rng, 70).replace("\n", " ")
    clean = [prose(rng, 60) for _ in range(5)]
    texts = [*ODD, clean[0] + "\n" + passage + "\n" + clean[1], *clean[2:], prose(rng, 30) + "\n" + passage, passage, f"start {passage} end", clean[2]]
    got = {r.doc_id: r for r in lines.deduplicate(documents(spark, texts, extra=True).drop("_spans")).collect()}
    want = slow_dedup(texts)
    assert [got[i].text for i in range(len(texts))] == want
    at = len(ODD)
    assert got[at].text == texts[at] and [got[at + 1 + k].text for k in range(3)] == clean[2:]
    assert passage not in got[at + 4].text and got[at + 5].text == "" and got[at + 7].text == ""
    assert sum(len(s) for s in [got[at + 6].text]) < 0.5 * len(passage)
    for i, t in enumerate(texts):  # spans are offsets in the original
        if t:
            keep = [c for k, c in enumerate(t) if not any(s.start <= k < s.end for s in got[i]["_spans"])]
            assert "".join(keep) == got[i].text


def test_short_common_sentences_stay(spark):
    texts = ["It is so. " + " ".join(f"w{i}{j}" for j in range(20)) + ". It is so." for i in range(5)]
    assert [r.text for r in lines.deduplicate(documents(spark, texts)).orderBy("doc_id").collect()] == texts


def test_passage_of_short_lines(spark):
    rng = random.Random(12)
    fresh = iter(rng.sample([a + b + c for a in "bdfgklmnprst" for b in ("an", "el", "ir", "os", "um") for c in ("ba", "de", "fi", "go", "lu", "ry")], 360))
    words = lambda n: " ".join(next(fresh) for _ in range(n))
    verse = "\n".join(words(n) for n in (4, 3, 7, 1, 5, 6, 2, 7, 4, 3, 6, 7, 5)) + "\n"
    han = "".join(chr(0x4E00 + k) for k in range(60)) + "。"
    texts = [f"{words(12)}\n{verse}{words(12)}", f"{words(5)}\n{verse}{words(5)}", f"{words(3)}.\n{han}{words(9)}", f"{words(10)}\n{han}"]
    texts += [f"{words(9)}\nthank you\n{words(9)}" for _ in range(3)]  # a common short line in new surroundings
    texts += [words(9) + "\n" + "was eran\n" * 58 + words(9)]
    got = [r.text for r in lines.deduplicate(documents(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == texts[0] and got[1] == texts[1].replace(verse, "")
    assert got[2] == texts[2] and got[3] == texts[3].replace(han, "")
    assert got[4:7] == texts[4:7]
    assert got[7] == texts[7].replace("was eran\n" * 58, "was eran\n")


def test_boilerplate_alone_stays(spark):
    rng = random.Random(13)
    texts = [prose(rng, 30) + "\nSubscribe to our letter and never miss a story from us again.\n" + prose(rng, 30) for _ in range(6)]
    assert [r.text for r in lines.deduplicate(documents(spark, texts)).orderBy("doc_id").collect()] == texts


def test_passage_edges(spark):
    assert lines.deduplicate(documents(spark, [])).count() == 0
    with pytest.raises(ValueError):
        lines.deduplicate(documents(spark, [], extra=True))
    t = " ".join(f"word{i}" for i in range(17)) + "."
    nulls = spark.createDataFrame([(None, t), (None, t + " And new."), (None, "x"), (None, None)], "doc_id bigint, text string")
    assert sorted(r.text or "" for r in lines.deduplicate(nulls).collect()) == sorted(["", t, t + " And new.", "x"])
    rows = [(1, t), (1, t), (None, t), (0, None), (2, t + "\n" + t)]
    got = lines.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(((-1 if r.doc_id is None else r.doc_id), r.text or "") for r in got) == [(-1, ""), (0, ""), (1, t), (1, t), (2, "")]
