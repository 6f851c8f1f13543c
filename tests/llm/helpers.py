import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " ", "\n\n", "one", "One TWO", "a b c", "ünïcödé “quotes” — 日本語", "\x1c a \x85b", "x" * 5000, "tab\tand  spaces \n"]


def prose(rng: random.Random, n: int, words=None) -> str:
    """n words in sentences of five to twelve, a line each few sentences."""
    words = words or ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(200)]
    out, left = [], n
    while left > 0:
        k = min(left, rng.randint(5, 12))
        out.append(" ".join(rng.choice(words) for _ in range(k)).capitalize() + rng.choice([". ", ". ", ".\n"]))
        left -= k
    return "".join(out).strip()


def documents(spark, texts, first=0, extra=False):
    rows = [(first + i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in ("ids", "label", "component_id", "_kept", "score", "_spans", "rep", "h1")})
    return df


def components(ids, edges):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}
