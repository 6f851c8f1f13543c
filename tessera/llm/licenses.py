"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags, and a
shunting-yard parser evaluates the expressions that follow the tags.

A text is lower-cased (A-Z only) and cut into words; phrases match whole consecutive words. Where
the words of an identifier tag stand, the automaton of tags gives the offsets of all tags, and what
follows each, up to the next tag or the end of the line, is parsed: ``with`` binds tighter than
``and``, ``and`` tighter than ``or``. Its longest valid beginning counts. An operand has to be a known
identifier or a ``LicenseRef-``; punctuation of a sentence or a comment ends the expression. Parsing
takes time linear in the text.

A licence has one label, whatever phrase or identifier names it: that of the identifier without
``-only``, ``-or-later`` and ``+``, with 2 for 2.0, and without version for Creative Commons. A label
of a family (``gpl``) goes where one of its members (``gpl-2``) was found; labels of base phrases stay.

The score is the evidence that the text states a licence: 1 - product(1 - weight) over its distinct
labels, where a label's weight is that of the strongest phrase or tag that gave it.

Defined cases: a null or empty text has no words, no labels and score 0; repeated rows are scanned
each; null ids are kept; other columns are ignored. A text is scanned whole.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy

# The phrases of the contract and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Phrases of notices, with label and weight.
NOTICES = {
    "permission is hereby granted free of charge to any person": ("mit", 0.9),
    "licensed under the apache license": ("apache", 0.8),
    "gnu general public license": ("gpl", 0.8),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu general public license v2": ("gpl-2", 0.9),
    "gnu general public license v3": ("gpl-3", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd 2 clause": ("bsd-2-clause", 0.8),
    "bsd 3 clause": ("bsd-3-clause", 0.8),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc0 1 0": ("cc0", 0.8),
    "creative commons attribution": ("cc-by", 0.7),
    "dedicated to the public domain": ("public-domain", 0.8),
    "all rights reserved": ("all-rights-reserved", 0.5),
}
BASE_WEIGHT, TAG_WEIGHT = 0.8, 0.95
TAG = "spdx license identifier"
TAG_TEXT = "spdx-license-identifier"

# Identifiers of licences that ask for no more than a notice, and of others, with versions where there are several.
PERMISSIVE = (
    "mit mit-0 isc 0bsd bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause unlicense wtfpl zlib libpng x11 ncsa postgresql curl openssl ruby vim tcl w3c hpnd ftl ijg "
    "blueoak-1.0.0 bsl-1.0 cc0-1.0 ofl-1.1 pddl-1.0 upl-1.0 artistic-2.0 unicode-3.0 mulanpsl-2.0 php-3.01 cc-by"
)
PERMISSIVE_VERSIONS = {"apache": "1.0 1.1 2.0", "python": "2.0", "psf": "2.0", "afl": "2.0 2.1 3.0", "zpl": "2.0 2.1", "cc-by": "1.0 2.0 2.5 3.0 4.0"}
OTHER = "ms-pl ms-rl sleepycat sspl-1.0 busl-1.1 cc-by-sa cc-by-nc cc-by-nd cc-by-nc-sa cc-by-nc-nd"
OTHER_VERSIONS = {"gpl": "1.0 2.0 3.0", "lgpl": "2.0 2.1 3.0", "agpl": "1.0 3.0", "gfdl": "1.1 1.2 1.3", "mpl": "1.0 1.1 2.0", "epl": "1.0 2.0", "eupl": "1.0 1.1 1.2", "cddl": "1.0 1.1", "cecill": "1.0 1.1 2.0 2.1", "osl": "2.0 2.1 3.0", "cpl": "1.0"} | dict.fromkeys(
    ("cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd"), "1.0 2.0 2.5 3.0 4.0"
)
#: Labels of families, which members make needless.
FAMILIES = {"apache", "gpl", "lgpl", "agpl", "mpl", "epl", "bsd", "cc-by"}


def _label(identifier: str) -> str:
    if identifier.startswith("cc"):
        return re.sub(r"-[\d.]+$", "", identifier)
    return re.sub(r"(-\d+)\.0$", r"\1", identifier)


def _identifiers() -> dict[str, tuple[str, bool]]:
    """Label, and whether a notice is all that is asked for, of each identifier."""
    out = {}
    for free, names, versions in ((True, PERMISSIVE, PERMISSIVE_VERSIONS), (False, OTHER, OTHER_VERSIONS)):
        for name in [*names.split(), *(f"{n}-{v}" for n, vs in versions.items() for v in vs.split())]:
            for end in ("", "+", "-only", "-or-later"):
                out[name + end] = (_label(name), free)
    return out


IDENTIFIERS = _identifiers()

_COLON = re.compile(r"[ \t]*:[ \t]*")
_TOKEN = re.compile(r"[a-z0-9][a-z0-9.+:-]*|[()]|\S")
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}

# A-Z to lower case, what separates words to a space, the bytes of other characters as they are.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


@functools.lru_cache(1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


@functools.lru_cache(1)
def _tag_automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word(TAG_TEXT, len(TAG_TEXT))
    a.make_automaton()
    return a


def licence(identifier: str) -> tuple[str, bool] | None:
    """Label of a known identifier or a reference, and whether a notice is all that it asks for."""
    found = IDENTIFIERS.get(identifier)
    if found is None and ("licenseref-" in identifier and not identifier.endswith("licenseref-")):
        return identifier, False
    return found


def to_postfix(line: str) -> list[str]:
    """The longest valid beginning of ``line`` as an expression in postfix order."""
    out: list[str] = []
    stack: list[str] = []
    length, rest = 0, []  # of the longest valid beginning: how much of out, and the operators that follow
    last = "operator"  # or "licence", "exception", "group", "with"
    depth = 0
    for m in _TOKEN.finditer(line):
        tok = m[0].rstrip(".:-") if m[0][0].isalnum() else m[0]
        ended = tok != m[0]  # punctuation after a word
        if last == "operator" and tok == "(":
            stack.append(tok)
            depth += 1
            continue
        if last == "operator" and tok not in _PRECEDENCE and licence(tok):
            out.append(tok)
            last = "licence"
        elif last == "with" and "exception" in tok:
            out.append(tok)
            last = "exception"
        elif last in ("licence", "exception", "group") and tok == ")" and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
            last = "group"
        elif (last in ("licence", "exception", "group") and tok in ("and", "or") or last == "licence" and tok == "with") and not ended:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[tok]:
                out.append(stack.pop())
            stack.append(tok)
            last = "with" if tok == "with" else "operator"
            continue
        else:
            break
        if not depth:  # no bracket is open, so the stack holds three operators at most
            length, rest = len(out), stack[::-1]
        if ended:
            break
    return out[:length] + rest


def evaluate(postfix: list[str]) -> tuple[frozenset[str], bool]:
    """``(labels, permissive)``: all licences named; whether some choice asks for a notice only."""
    labels: set[str] = set()
    stack: list[tuple[str | None, bool]] = []

    def taken() -> bool:
        label, free = stack.pop()
        if label is not None:
            labels.add(label)
        return free

    for tok in postfix:
        if tok == "with":  # the exception belongs to the licence before it
            (exception, _), (label, free) = stack.pop(), stack.pop()
            stack.append((f"{label}-with-{exception}", free))
        elif tok in _PRECEDENCE:
            right, left = taken(), taken()
            stack.append((None, left and right if tok == "and" else left or right))
        else:
            stack.append(licence(tok) or (tok, False))
    free = taken() if stack else False
    return frozenset(labels), free


def scan_text(text: str) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score, permissive."""
    words = words_of(text)
    joined = f" {b' '.join(words).decode()} "
    places: list[int] = []
    base: set[str] = set()
    weights: dict[str, float] = {}
    tagged = False
    seen = at = 0
    for end, phrase in _automaton().iter(joined):
        start = end - len(phrase) - 1  # of the space before the phrase
        if phrase == TAG:
            tagged = True
        elif phrase in BASE:
            # words before a place are counted from the last place
            at += joined.count(" ", seen, start) if start >= seen else -joined.count(" ", start, seen)
            seen = start
            places.append(at)
            base.add(BASE[phrase])
            weights[BASE[phrase]] = max(weights.get(BASE[phrase], 0), BASE_WEIGHT)
        else:
            label, w = NOTICES[phrase]
            weights[label] = max(weights.get(label, 0), w)
    permissive = None
    if tagged:
        low = text.encode().translate(_LOWER).decode()
        ends = [e + 1 for e, n in _tag_automaton().iter(low) if e < n or not (low[e - n].isalnum() or low[e - n] >= "\x80")]
        for end, after in zip(ends, [*(e - len(TAG_TEXT) for e in ends[1:]), len(low)]):  # up to the next tag
            m = _COLON.match(low, end, after)
            if m is None:
                continue
            stop = min((k for k in (low.find(c, m.end(), after) for c in "\r\n") if k >= 0), default=after)
            labels, free = evaluate(to_postfix(low[m.end() : stop]))
            weights.update(dict.fromkeys(labels, TAG_WEIGHT))
            if labels:
                permissive = free if permissive is None else permissive and free
    needless = [f for f in FAMILIES.intersection(weights) if f not in base and any(x.startswith(f + "-") for x in weights)]
    for f in needless:
        del weights[f]
    for x in [x for x in weights if "-with-" in x]:  # the same licence, named without its exception
        plain = x.partition("-with-")[0]
        if plain not in base:
            weights.pop(plain, None)
    miss = 1.0
    for label in sorted(weights):
        miss *= 1 - weights[label]
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(weights)), round(1 - miss, 6), permissive)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id and the fields of ``scan_text``."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(source.schema["id"].dataType), *[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.bool_()]
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(kinds[0]), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names)

    return source.mapInArrow(
        tidy(run),
        f"id {source.schema['id'].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, permissive boolean",
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read_table

    return scan(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
