"""Main text of web pages by minimum cut.

A page is read into text blocks.  A logistic regression prices each block as content and as
boilerplate, by its own text (length, share of links, punctuation, place, depth) and by weak hints
around it (elements, words in class names); no hint decides alone.  Prices become terminal
capacities; blocks that are neighbours on the page, or children of one element, are joined by
smoothness edges of the size of a doubtful block's price.  The minimum cut labels all blocks at once.

The regression learns from blocks whose surroundings leave no doubt.  Each of them is shown twice,
once without its hints, so that text weighs as much as markup where markup is silent or contradicts
itself.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
RAW = set("script style template svg iframe canvas textarea select button audio video noframes".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"},
}
BARRIER = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": set(), "body": set()}
# Elements that usually hold boilerplate, and words in class, id and role that hint at content and at boilerplate, strongly and weakly.
FURNITURE = ("nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "search")
GOOD = ("article", "main", "content", "entry", "post", "story", "prose", "articlebody")
STRONG = (
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "promoted", "sidebar", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment", "comments", "commentlist", "disqus", "replies", "cookie", "cookies", "consent", "gdpr", "popup",
    "newsletter", "subscribe", "subscription", "signup", "login", "pagination", "pager", "outbrain", "taboola", "complementary", "contentinfo",
)
WEAK = (
    "banner", "side", "topbar", "toolbar", "reply", "respond", "discussion", "notice", "notification", "alert", "modal", "overlay", "widget", "share", "sharing", "social", "related",
    "recommended", "recommendations", "tags", "tagcloud", "copyright", "legal", "disclaimer", "skip", "toc", "search", "form",
)
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_SPECIAL = re.compile("[>\"']")
_NAME = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")
_RIGHTS = re.compile(r"©|\bcopyright\b|all rights reserved", re.I)
_END_MARKS = re.compile(r"[.!?;:,…。！？]")


#: Words in front of or after others in a class name that take back what they say: no-sidebar, comments-closed.
TAKEN_BACK = {"no", "not", "has", "with", "without"}, {"closed", "open", "enabled", "disabled"}


@dataclass
class Element:
    """What an element and those above it hint at."""

    name: str
    parent: "Element | None" = None
    content: bool = False  # inside an article
    furniture: bool = False
    strong: bool = False
    weak: bool = False
    good: bool = False
    hidden: bool = False
    depth: int = 0
    scope: "Element | None" = None  # the box around a paragraph, heading or item
    own: tuple[bool, bool] = (False, False)  # strong and weak words of its own
    chars: int = 0  # of text in it
    titled: bool = False  # it holds the page's first heading


@dataclass
class Block:
    text: str
    link_chars: int
    tag: str
    element: Element
    scope: Element
    features: list[float] = field(default_factory=list)


_ITEMS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre"}


def _element(name: str, attributes: str, parent: Element | None) -> Element:
    if parent is None:
        return Element(name)
    e = Element(name, parent, parent.content, parent.furniture, parent.strong, parent.weak, parent.good, parent.hidden, parent.depth + 1)
    e.scope = (parent.scope or parent) if name in _ITEMS else e
    e.content |= name in ("article", "main")
    # An article has a header of its own.
    e.furniture |= name in FURNITURE or name == "header" and not parent.content
    e.hidden |= name == "head"
    strong = weak = False
    for m in _NAME.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            e.hidden = True
        elif key in ("class", "id", "role") and name not in ("html", "body"):
            for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).split():
                words = _WORD.findall(token.lower())
                e.good |= any(w in GOOD for w in words)
                e.content |= key == "role" and "main" in words
                if words and words[0] not in TAKEN_BACK[0] and words[-1] not in TAKEN_BACK[1]:
                    strong |= any(w in STRONG for w in words)
                    weak |= any(w in WEAK for w in words)
    e.own, e.strong, e.weak = (strong, weak), e.strong or strong, e.weak or weak
    return e


def _weigh(elements: list[Element], blocks: list[Block]) -> None:
    """Take class words back from boxes around the page: an element that holds the first heading and
    more than half of the text is no sidebar, whatever its class says.  What it said to the elements
    inside goes as well."""
    for b in blocks:
        b.element.chars += len(b.text)
    title = next((b.element for b in blocks if b.tag == "h1"), None)
    while title is not None and not title.titled:
        title.titled, title = True, title.parent
    for e in reversed(elements):
        if e.parent is not None:
            e.parent.chars += e.chars
    whole = sum(len(b.text) for b in blocks)
    for e in elements:  # parents come first
        if e.parent is not None:
            around = e.titled and 2 * e.chars > whole
            e.strong, e.weak = (above or mine and not around for above, mine in zip((e.parent.strong, e.parent.weak), e.own))


def _tags(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Start, end, name, whether it closes, and attributes of each tag; comments and declarations have
    no name, and a CDATA section the name ``[`` and its text as attributes.

    A tag ends at the first > outside of quotes, or at the first one at all if quotes don't close.
    Where quoted parts lead is kept by place, so that no stretch is searched from many starts."""
    special = [m.start() for m in _SPECIAL.finditer(source)]
    marks = {c: [k for k in special if source[k] == c] for c in ">\"'"}
    ends: dict[int, int] = {}
    last_section = source.rfind("]]>")

    def following(c: str, at: int) -> int:
        k = bisect_left(marks[c], at)
        return marks[c][k] if k < len(marks[c]) else -1

    def unquoted(at: int) -> int:
        path = []
        end = -1
        while True:
            k = bisect_left(special, at)
            if k == len(special):
                break
            at = special[k]
            if at in ends:
                end = ends[at]
                break
            path.append(at)
            if source[at] == ">":
                end = at
                break
            at = following(source[at], at + 1) + 1
            if not at:
                break
        for k in path:
            ends[k] = end
        return end

    at = source.find("<")
    while at >= 0:
        stop, name, closing, attributes = -1, "", False, ""
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            stop = end + 3 if end >= 0 else len(source)
        elif at < last_section and source.startswith("<![CDATA[", at) and (end := source.find("]]>", at + 9)) >= 0:
            stop, name, attributes = end + 3, "[", source[at + 9 : end]
        elif source.startswith(("<!", "<?"), at):
            stop = following(">", at) + 1 or -1
        elif (first := following(">", at)) >= 0 and (m := _OPEN.match(source, at, first + 1)):
            end = unquoted(m.end())
            end = end if end >= 0 else following(">", m.end())
            if end >= 0:
                stop, name, closing, attributes = end + 1, m[2].lower(), bool(m[1]), source[m.end() : end]
        if stop >= 0:
            yield at, stop, name, closing, attributes
            at = source.find("<", stop)
        else:
            at = source.find("<", at + 1)


def read_blocks(source: str) -> list[Block]:
    """Blocks of text in page order, with what stands around them."""
    root = _element("", "", None)
    open_: list[Element] = [root]
    elements = [root]
    names: Counter[str] = Counter()  # of open elements
    blocks: list[Block] = []
    parts: list[str] = []
    links = 0  # depth of open <a>
    link_chars = 0
    inline: list[Element] = []  # open inline elements that say something about their text
    raw_ends: dict[str, list[tuple[int, int]]] = {}

    def end_block() -> None:
        nonlocal parts, link_chars
        if parts:
            text = _BLANK.sub(" ", html.unescape("".join(parts))).strip()
            around = inline[-1] if inline else open_[-1]
            if text and not around.hidden:
                blocks.append(Block(text, link_chars, open_[-1].name, around, open_[-1].scope or open_[-1]))
            parts = []
        link_chars = 0

    def cut(k: int) -> None:
        names.subtract(e.name for e in open_[k:])
        del open_[k:]

    def raw_end(name: str, at: int) -> int | None:
        if name not in raw_ends:
            raw_ends[name] = [m.span() for m in re.finditer(rf"</{re.escape(name)}\s*>", source, re.I)]
        k = bisect_left(raw_ends[name], (at,))
        return raw_ends[name][k][1] if k < len(raw_ends[name]) else None

    at = 0
    for start, stop, name, closing, attributes in _tags(source):
        if start < at:
            continue
        if start > at:
            text = source[at:start]
            parts.append(text)
            if links:
                link_chars += len(text.strip())
        at = stop
        if not name:
            continue
        if name == "[":
            parts.append(html.escape(attributes))
            continue
        if name in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                end = raw_end(name, at)
                at = end if end is not None else (len(source) if name in ("script", "style", "textarea") else at)
            if name in ("svg", "math", "button", "select"):
                parts.append(" ")
            continue
        if name == "br" or name == "wbr" or name == "img":
            if name != "wbr":
                parts.append(" ")
            continue
        if name not in BLOCK:
            if name == "a":
                links = max(0, links + (-1 if closing else 1))
            elif attributes and not closing:
                around = inline[-1] if inline else open_[-1]
                e = _element(name, attributes, around)
                if (e.strong, e.hidden) != (around.strong, around.hidden):
                    # Likely boilerplate inside running text stands as a block of its own.
                    end_block()
                    inline.append(e)
                    elements.append(e)
            elif closing and inline and inline[-1].name == name:
                end_block()
                inline.pop()
            continue
        end_block()
        inline.clear()
        links = 0
        if closing:
            if names[name] > 0:
                k = len(open_) - 1
                while open_[k].name != name:
                    k -= 1
                cut(k)
            continue
        # What a start tag closes by itself.
        if open_[-1].name == "p":
            cut(len(open_) - 1)
        if name in CLOSES and any(names[n] > 0 for n in CLOSES[name]):
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].name in BARRIER[name]:
                    break
                if open_[k].name in CLOSES[name]:
                    cut(k)
                    if name not in ("tr", "tbody", "tfoot"):
                        break
        if name not in VOID:
            open_.append(_element(name, attributes, open_[-1]))
            elements.append(open_[-1])
            names[name] += 1
    if at < len(source):
        parts.append(source[at:])
    end_block()
    _weigh(elements, blocks)
    return blocks


N_TEXT, N_HINTS = 13, 6
RIDGE = 0.01
N_FEATURES = N_TEXT + N_HINTS
#: Log odds that the regression starts from and is drawn to: of a block's text (constant, log words, links, punctuation, ends in a mark, paragraph, heading, list or cell, text around,
#: depth, distance from the page's middle, repeated on the page, claims rights), and of hints (article, furniture, strong and weak words, good words, outside of the page's article).
PRIOR = np.array([-2.0, 0.7, -3.0, 1.0, 0.5, 0.5, 0.3, -0.5, 0.1, 0.0, -0.5, -1.0, -1.5, 3.0, -4.0, -4.0, -1.5, 1.0, -3.0])


def _describe(blocks: list[Block]) -> None:
    seen = Counter(b.text for b in blocks)
    has_main = any(b.element.content for b in blocks)
    for k, b in enumerate(blocks):
        n = len(b.text)
        words = b.text.count(" ") + 1
        marks = len(_END_MARKS.findall(b.text))
        around = sum(len(blocks[j].text) for j in (k - 1, k + 1) if 0 <= j < len(blocks))
        e = b.element
        b.features = [
            1.0, min(8.0, math.log1p(words)), min(1.0, b.link_chars / max(1, n)), min(1.0, 8 * marks / max(1, n / 8)), float(b.text[-1] in ".!?…\"'"),
            float(b.tag == "p"), float(b.tag in ("h1", "h2", "h3", "h4", "h5", "h6")), float(b.tag in ("li", "td", "option")), min(10.0, math.log1p(around)),
            min(20, e.depth) / 10, abs(2 * (k + 0.5) / len(blocks) - 1), float(seen[b.text] > 1), float(n < 200 and _RIGHTS.search(b.text) is not None),
            float(e.content), float(e.furniture), float(e.strong), float(e.weak), float(e.good), float(has_main and not e.content),
        ]


class Classifier:
    """Logistic regression with the prior's weights as its mean; without training the prior alone."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.weights = PRIOR.copy()
        if len(y) and 0 < y.sum() < len(y):
            bare = x.copy()
            bare[:, N_TEXT:] = 0
            x, y = np.vstack([x, bare]), np.r_[y, y]
            share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
            for _ in range(30):
                p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
                grad = x.T @ (share * (p - y)) + RIDGE * (self.weights - PRIOR)
                hess = (x * (share * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(N_FEATURES)
                self.weights -= np.linalg.solve(hess, grad)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs: list[list[float]] = []
        ys: list[int] = []
        for source in batch.column(0):
            blocks = read_blocks(source.as_py() or "")
            _describe(blocks)
            sure = [(b, good) for b in blocks if (good := b.element.content) != (b.element.furniture or b.element.strong) and not b.element.weak]
            step = max(1, len(sure) // 32)  # at most 63 blocks of a page
            for b, good in sure[::step]:
                xs.append(b.features)
                ys.append(int(good))
        if xs:
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.int32())], names=["x", "y"])


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = 512) -> Classifier:
    """Fit on blocks inside articles or inside boilerplate elements of at most ``sample`` pages: the
    page of least hash in each of as many slots of the id.  The driver gets at most 63 short
    vectors of each."""
    hashed = F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit(3))
    rows = pages.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{html_col}`").alias("h"), hashed.alias("k")).filter("i is not null and h is not null")
    picks = rows.groupBy(F.pmod("k", F.lit(sample)).alias("slot")).agg(F.min(F.struct("k", "i")).alias("pick"))
    picked = rows.join(F.broadcast(picks.select(F.col("pick.i").alias("i"))), "i", "left_semi").groupBy("i").agg(F.min("h").alias("h"))
    got = picked.select("h").mapInArrow(_training, "x array<double>, y int").collect()
    got.sort(key=lambda r: (r["y"], r["x"]))
    x = np.array([r["x"] for r in got], dtype=float).reshape(-1, N_FEATURES)
    return Classifier(x, np.array([r["y"] for r in got], dtype=float))


def min_cut(prices: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) of least cost: a node on the sink side pays its price if that is
    positive, one on the source side the negated price if negative, and each edge between sides its
    weight.

    A node whose own price outweighs all its edges keeps its sign in any minimum, so such nodes are
    fixed first and their edges become prices of the others; augmenting paths settle the rest.
    """
    n = len(prices)
    price = list(prices)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            around[a][b] = around[a].get(b, 0.0) + w
            around[b][a] = around[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if label[k] is None and abs(price[k]) >= sum(around[k].values()):
            label[k] = price[k] > 0
            for j, w in around[k].items():
                price[j] += w if label[k] else -w
                del around[j][k]
                queue.append(j)
            around[k] = {}
    for part in _parts(label, around):
        for k, side in _cut(part, price, around).items():
            label[k] = side
    return [bool(x) for x in label]


def _parts(label: list[bool | None], around: list[dict[int, float]]) -> Iterator[list[int]]:
    """Connected sets of the nodes without a label."""
    seen = [x is not None for x in label]
    for k in range(len(label)):
        if not seen[k]:
            seen[k] = True
            part = [k]
            for a in part:
                for b in around[a]:
                    if not seen[b]:
                        seen[b] = True
                        part.append(b)
            yield part


def _cut(part: list[int], price: list[float], around: list[dict[int, float]]) -> dict[int, bool]:
    """Maximum flow by shortest augmenting paths, level by level.  -1 is the source, -2 the sink."""
    residual: dict[int, dict[int, float]] = {k: dict(around[k]) for k in part}
    residual[-1], residual[-2] = {}, {}
    for k in part:
        a, b = (-1, k) if price[k] > 0 else (k, -2)
        residual[a][b] = abs(price[k])
        residual[b].setdefault(a, 0.0)
    while True:
        level = {-1: 0}
        queue = deque([-1])
        while queue:
            a = queue.popleft()
            for b, c in residual[a].items():
                if c > 1e-9 and b not in level:
                    level[b] = level[a] + 1
                    queue.append(b)
        if -2 not in level:
            return {k: k in level for k in part}
        left = {a: list(residual[a]) for a in level}
        path = [-1]
        while path:
            a = path[-1]
            if a == -2:
                flow = min(residual[x][y] for x, y in zip(path, path[1:]))
                cut = 0
                for k, (x, y) in enumerate(zip(path, path[1:])):
                    residual[x][y] -= flow
                    residual[y][x] = residual[y].get(x, 0.0) + flow
                    if residual[x][y] <= 1e-9 and not cut:
                        cut = k + 1
                del path[cut:]
                continue
            while left[a] and not (residual[a].get(left[a][-1], 0.0) > 1e-9 and level.get(left[a][-1]) == level[a] + 1):
                left[a].pop()
            if left[a]:
                path.append(left[a][-1])
            else:
                path.pop()
                if path:
                    left[path[-1]].pop()


NEAR, SIBLING = 1.0, 1.5


def _edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges = []
    last: dict[int, int] = {}
    for k, b in enumerate(blocks):
        if k:
            steps = abs(b.scope.depth - blocks[k - 1].scope.depth) + 2 * (b.scope is not blocks[k - 1].scope)
            edges.append((k - 1, k, NEAR / (1 + steps)))
        j = last.get(id(b.scope))
        if j is not None:
            edges.append((j, k, SIBLING))
        last[id(b.scope)] = k
    return edges


def label_blocks(blocks: list[Block], classifier: Classifier) -> tuple[list[float], list[bool]]:
    """Each block's price (log odds of content) and its side of the cut (True: content)."""
    if not blocks:
        return [], []
    _describe(blocks)
    prices = classifier.odds(np.array([b.features for b in blocks])).tolist()
    return prices, min_cut(prices, _edges(blocks))


def main_text(source: str, classifier: Classifier) -> str:
    """Blocks on the content side of the cut, one to a line."""
    blocks = read_blocks(source)
    return "\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, classifier)[1]) if keep)


def extract(pages: DataFrame, classifier: Classifier, html_col: str = "html") -> DataFrame:
    """All columns of ``pages`` but ``html_col``, with text and n_chars (code points).

    Character references are decoded; white space inside a block becomes one space.  Defined cases:
    null, empty and text-free pages give an empty text; broken markup is read as browsers recover
    from it, as far as blocks go; repeated rows get equal texts; an empty table stays empty;
    columns named text or n_chars are replaced.
    """
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    shared = spark.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [main_text(h.as_py() or "", shared.value) for h in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string, n_chars long"])
    return pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{html_col}`").cast("string").alias("_html")).mapInArrow(run, schema)
