"""Main text of pages by tag-path ratios.

Every block of text has a root-to-leaf path of block elements with their class names (inline elements
do not count). The operator chooses paths in these steps:

1. Per path of a page, text outside links, punctuation and occurrences are summed. The ratios text
   per occurrence and punctuation per occurrence are fused into one value of the path.
2. What the names of a block's elements say (``NAMES``) is its weight. A name weighs, it doesn't
   decide: all blocks below a misnamed wrapper weigh the same against each other. Class names count
   for nothing on what holds the page's first ``h1`` or, but for names of a discussion, its first
   ``article`` or ``main``.
3. The content node is the deepest element that holds ``NODE_SHARE`` of the page's text, weighted by
   the square of value and weight. Below it a list or a table counts as one unit of its path, so that short items and cells
   aren't judged one by one.
4. Values are smoothed over the page's blocks in order, by weight (across the border of the content
   node by ``ACROSS`` only), averaged per path again and multiplied by the block's weight and the share
   of text outside links of its unit or path.
5. Paths stay whose fused value reaches ``THRESHOLD`` times the page's mean, weighted by text; paths
   below the content node need ``1 / INSIDE`` of that.

Hidden elements and the contents of scripts, styles and controls are not text. Time and memory are
linear in the length of the page: elements point to their parents, and a search for an end that isn't
there is made once.

Defined cases: null or empty html, and pages without text or with text in links only, give an empty
text; repeated rows give a row each; null ids and addresses are kept; broken markup is read as far as
it goes (unclosed elements end with their parents, a lone ``<`` is text, an unclosed comment reaches
to the end). A page is read whole.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import tidy

# Elements by their role.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template textarea title noscript iframe svg math object select button canvas audio video".split())
LISTS = set("ul ol dl table".split())
CLOSES = {  # elements that an opening tag ends if they are still open, up to the element named last
    "li": (("li", "p"), ("ul", "ol", "menu")),
    "dt": (("dt", "dd", "p"), ("dl",)),
    "dd": (("dt", "dd", "p"), ("dl",)),
    "tr": (("tr", "td", "th", "p"), ("table",)),
    "td": (("td", "th", "p"), ("tr", "table")),
    "th": (("td", "th", "p"), ("tr", "table")),
}
ANY_CLOSES = (("p",), ("td", "th", "li", "dd", "blockquote", "article", "section", "div", "table", "button"))
#: What an element's own name weighs.
NAMES = {"nav": 0.02, "header": 0.02, "footer": 0.02, "aside": 0.02, "form": 0.02, "menu": 0.02, "dialog": 0.02, "fieldset": 0.02}
#: Words in class, id and role that are seldom said of an article.
BOILERPLATE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "sidebar aside footer header masthead topbar comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget "
    "widgets toolbar pagination pager search form copyright disclaimer skip tags tagcloud complementary contentinfo".split()
)
#: Those of a discussion, which may hold articles of its own.
DISCUSSION = set("comment comments commentlist disqus respond reply replies".split())
#: What such words weigh as a whole class name and as a part of one; the header of an article; least of all.
WHOLE_NAME, PART_NAME, OWN_HEADER, LEAST = 0.02, 0.3, 0.5, 1e-6
#: Text and punctuation per occurrence at which a ratio is half of its most.
HALF_TEXT, HALF_MARKS = 150.0, 5.0
NODE_SHARE, ACROSS = 0.6, 0.1
#: Share of the page's mean that a path needs, and how much less one below the content node needs.
THRESHOLD, INSIDE = 0.95, 13.0

_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")
_WORD = re.compile(r"[a-z0-9]+")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_KERNEL = np.exp(-0.5 * np.arange(3) ** 2)


class Page:
    """The blocks of text of a page, and its elements by number in page order; element 0 is the page.

    ``texts`` and ``links`` (characters in links) are by block, as is ``at``, the element of a block.
    ``parent``, ``tag``, ``path`` (a number for each distinct path) and ``weight`` are by element.
    """

    def __init__(self):
        self.texts: list[str] = []
        self.links: list[int] = []
        self.at: list[int] = []
        self.parent, self.tag, self.path, self.weight = [0], [""], [0], [1.0]
        self.paths: dict[tuple, int] = {}


def _said(attributes: str) -> tuple[float, str, bool]:
    """What an element's attributes weigh (0 if it is hidden), its class names, whether they say discussion."""
    weight, classes, discussion = 1.0, "", False
    if not attributes or attributes.isspace():
        return weight, classes, discussion
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDES.search(value):
            return 0.0, classes, discussion
        if name in ("class", "id", "role"):
            own = value.split()
            if name == "class":
                classes = " ".join(sorted(own))
            words = BOILERPLATE.intersection(_WORD.findall(value))
            if words:
                weight = min(weight, WHOLE_NAME if any(words.issuperset(w) for w in map(_WORD.findall, own) if w) else PART_NAME)
                discussion |= not words.isdisjoint(DISCUSSION)
    return weight, classes, discussion


def read(page: str) -> Page:
    """The blocks and elements of a page, in one pass."""
    out = Page()
    stack = [0]
    places: dict[str, list[int]] = {}  # by tag: where it stands on the stack
    within = [0]  # by stack place: articles and mains open
    tags, said, talks = [1.0], [1.0], [False]  # by element: what its name and its attributes weigh, whether they say discussion
    landmarks: dict[str, int] = {}  # the first h1, and the first article or main
    parts: list[str] = []  # of the open block
    linked = 0  # its characters in links
    anchor = 0  # stack size at which a link was opened; 0 outside links
    absent: set[str] = set()  # what the rest of the page lacks
    at, end = 0, len(page)

    def text(s: str) -> None:
        nonlocal linked
        if not parts and s.isspace():
            return
        s = _html.unescape(s) if "&" in s else s
        parts.append(s)
        if anchor:
            linked += len(s)

    def close() -> None:
        nonlocal linked
        if parts:
            joined = " ".join("".join(parts).split())
            if joined and tags[stack[-1]]:
                out.texts.append(joined)
                out.links.append(linked)
                out.at.append(stack[-1])
            parts.clear()
        linked = 0

    def pop_to(size: int) -> None:
        nonlocal anchor
        while len(stack) > size:
            places[out.tag[stack.pop()]].pop()
            within.pop()
        if anchor > size:
            anchor = 0

    def find(what: str) -> int:
        """The next place of ``what``, or -1; a failed search isn't made again."""
        if what in absent:
            return -1
        k = page.find(what, at)
        if k < 0:
            absent.add(what)
        return k

    closers: dict[str, re.Pattern] = {}

    def skip_past(tag: str) -> bool:
        nonlocal at
        key = "</" + tag
        if key in absent:
            return False
        if tag not in closers:
            closers[tag] = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I)
        m = closers[tag].search(page, at)
        if m is None:
            absent.add(key)
            return False
        at = m.end()
        return True

    while at < end:
        k = find("<")
        if k < 0:
            text(page[at:])
            break
        if k > at:
            text(page[at:k])
            at = k
        head = page[k + 1 : k + 2]
        if head in ("!", "?"):
            if page.startswith("<!--", k):
                at = k + 4
                stop = find("-->")
                at = end if stop < 0 else stop + 3
            elif page.startswith("<![CDATA[", k):
                at = k + 9
                stop = find("]]>")
                stop = end if stop < 0 else stop
                text(page[at:stop])
                at = stop + 3
            else:
                stop = find(">")
                at = end if stop < 0 else stop + 1
            continue
        m = _TAG.match(page, k + 1) if (head.isalpha() or head == "/") and find(">") >= 0 else None
        if m is None:
            text("<")
            at = k + 1
            continue
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in RAW:
            if not closing and not attributes.rstrip().endswith("/") and not skip_past(tag) and tag in ("script", "style", "textarea", "title"):
                at = end
            continue
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                anchor = len(stack) if not closing and "href" in attributes.lower() else 0
            elif not closing and tag == "span" and attributes and _said(attributes)[0] <= WHOLE_NAME:
                skip_past("span")
            continue
        close()
        if closing:
            if places.get(tag):
                pop_to(places[tag][-1])
            continue
        if tag in VOID:
            continue
        ends, until = CLOSES.get(tag, ANY_CLOSES)
        barrier = max((places[t][-1] for t in until if places.get(t)), default=-1)
        for t in ends:
            while places.get(t) and places[t][-1] > barrier:
                pop_to(places[t][-1])
        if attributes.rstrip().endswith("/"):
            continue
        up = stack[-1]
        weight, classes, talk = _said(attributes)
        number = len(out.parent)
        out.parent.append(up)
        out.tag.append(tag)
        out.path.append(out.paths.setdefault((out.path[up], tag, classes), len(out.paths) + 1))
        hidden = not weight or not tags[up] or tag == "head"
        tags.append(0.0 if hidden else OWN_HEADER if tag == "header" and within[-1] else NAMES.get(tag, 1.0))
        said.append(weight)
        talks.append(talk)
        if not hidden and tag in ("h1", "article", "main"):
            landmarks.setdefault("h1" if tag == "h1" else "article", number)
        places.setdefault(tag, []).append(len(stack))
        stack.append(number)
        within.append(within[-1] + (tag in ("article", "main")))
    close()
    for kind, e in landmarks.items():
        while e:
            if kind == "h1" or not talks[e]:
                said[e] = 1.0
            e = out.parent[e]
    for e in range(1, len(out.parent)):
        up = out.weight[out.parent[e]]
        out.weight.append(max(LEAST, up * tags[e] * said[e]) if tags[e] else 0.0)
    return out


def ratio(text: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The value of text and punctuation per occurrence, from 0 to 2."""
    return text / (text + HALF_TEXT) * (1 + marks / (marks + HALF_MARKS))


def content_node(page: Page, mass: np.ndarray) -> int:
    """The deepest element that holds ``NODE_SHARE`` of the mass of blocks in elements below it."""
    held = [0.0] * len(page.parent)
    for e, m in zip(page.at, mass.tolist()):
        if e:
            held[page.parent[e]] += m
    best = [0] * len(page.parent)
    for e in range(len(held) - 1, 0, -1):  # children come after their parents
        up = page.parent[e]
        held[up] += held[e]
        if held[e] > held[best[up]] or not best[up]:
            best[up] = e
    node, need = 0, NODE_SHARE * float(mass.sum())
    while best[node] and held[best[node]] >= need:
        node = best[node]
    return node


def main_blocks(page: Page) -> np.ndarray:
    """Whether each block is of the article."""
    n = len(page.texts)
    if not n:
        return np.zeros(0, bool)
    size = np.array([len(t) for t in page.texts], float)
    marks = np.array([len(_PUNCTUATION.findall(t)) for t in page.texts], float)
    weight = np.array([page.weight[e] for e in page.at])
    link = np.minimum(size, page.links)
    link[[page.tag[e] == "h1" for e in page.at]] = 0  # a title often links to its own page
    own = size - link

    def by_path(paths: np.ndarray, text: np.ndarray, marks: np.ndarray, count: np.ndarray) -> np.ndarray:
        total = lambda x: np.bincount(paths, x)[paths]
        return ratio(total(text) / total(count), total(marks) / total(count))

    _, paths = np.unique([page.path[e] for e in page.at], return_inverse=True)
    value = by_path(paths, own, marks, np.ones(n))

    node = content_node(page, np.square(value * weight) * own)
    below = [e == node for e in range(len(page.parent))]
    unit = [0] * len(page.parent)  # the outermost list or table below the node
    for e in range(node + 1, len(page.parent)):
        up = page.parent[e]
        below[e] = below[up]
        unit[e] = unit[up] or (e if below[e] and page.tag[e] in LISTS else 0)
    inside = np.array([below[e] for e in page.at])
    units = np.array([unit[e] for e in page.at])
    listed = np.flatnonzero(units)
    share_path = paths.copy()
    if len(listed):
        once = np.zeros(len(listed))
        once[np.unique(units[listed], return_index=True)[1]] = 1  # a unit occurs once
        _, kinds = np.unique([page.path[u] for u in units[listed]], return_inverse=True)
        value[listed] = np.maximum(value[listed], by_path(kinds, own[listed], marks[listed], once))
        share_path[listed] = paths.max() + 1 + kinds

    total, shares = value * weight, weight.copy()
    for d in (1, 2):
        w = np.where(inside[d:] == inside[:-d], 1.0, ACROSS) * _KERNEL[d]
        total[d:] += w * (value * weight)[:-d]
        shares[d:] += w * weight[:-d]
        total[:-d] += w * (value * weight)[d:]
        shares[:-d] += w * weight[d:]
    _, groups = np.unique(share_path * 2 + inside, return_inverse=True)
    mean = lambda x: (np.bincount(groups, x) / np.bincount(groups))[groups]
    fused = mean(total / np.maximum(shares, 1e-300)) * weight
    _, groups = np.unique(np.where(units > 0, share_path.max() + units, share_path), return_inverse=True)  # each unit has a share of its own
    fused *= mean(own) / np.maximum(mean(size), 1)
    most = (fused * fused * size).sum() / max((fused * size).sum(), 1e-300)
    return (fused >= THRESHOLD * most / np.where(inside, INSIDE, 1.0)) & (fused > 0)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    read_page = read(page)
    return "\n".join(t for t, keep in zip(read_page.texts, main_blocks(read_page)) if keep)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text in place of the html."""
    at = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([main_text(x.as_py()) for x in batch.column(at)], pa.string())
            columns, names = [*batch.columns], [*batch.schema.names]
            columns[at], names[at] = out, text_col
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = ", ".join(f"`{text_col if i == at else f.name}` {f.dataType.simpleString()}" for i, f in enumerate(pages.schema.fields))
    return pages.mapInArrow(tidy(run), fields)


def op2_main_text(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import read_table

    found = extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
