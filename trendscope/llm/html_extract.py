"""Main text of HTML pages by a tree-structured graphical model over the DOM.

Each element has a hidden label, content or not. Its node potential comes from a few
features (link share, text length, sentence marks, kind of tag); each parent-child pair has a
potential that depends on the kind of edge: into a main element (article, main), into a
boilerplate element (navigation, footer, advert, comments, ... by tag, or by class and id
words), or plain. Sum-product messages go up and down the tree and give every element's
marginal; the text of elements that are more likely content than not is the main text.

Training: pages whose own markup labels them (they have an ``article`` or ``main``; inside
it is content, unless inside a boilerplate element) are counted, at most about
``TRAIN_PAGES`` of them; potentials are smoothed log shares, bounded by ``WEAK``. ``PRIOR`` holds fixed
counts beside those of training: it is what judges pages where no page is labelled, and it outweighs some
thousand pages, so that a label changes along an edge for evidence only.

Blocks are the texts between block-level tags, with character references decoded and white
space as single spaces, in page order. A null or empty page has the empty text. A page
without labelled markup is judged by the same model. Repeated rows each give a row. Time follows the
page's length, however deep its elements are.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_PAGES = 5000   # about so many labelled pages are counted, chosen by a hash of their text
WEAK = 1.5           # bound of a single feature's log odds
SMOOTHING = 1.0
# counts added to those of training: (edge, parent, child)
PRIOR = {("main", 0, 1): 50.0, ("main", 1, 1): 50.0, ("boiler", 1, 0): 20_000.0, ("boiler", 0, 0): 20_000.0,
         ("plain", 1, 1): 200_000.0}

# HTML's void, raw-text, hidden and block elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset(("head script style title textarea noscript template iframe svg math canvas object audio video "
                    "select option button input form label datalist dialog").split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
                   "optgroup option p pre search section select summary table tbody td tfoot th thead title tr "
                   "ul").split())
MAIN_TAG = frozenset(("article", "main"))
BOILER_TAG = frozenset(("nav", "aside", "footer", "header", "menu"))
PARAGRAPH = frozenset(("p", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "dd", "dt"))
LIST = frozenset(("ul", "ol", "li", "a", "dl"))
# Words of class, id and role values
BOILER_WORD = frozenset(("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav "
                         "navigation navbar menu breadcrumb breadcrumbs sidebar side aside rail widget footer foot "
                         "header masthead topbar toolbar cookie cookies consent notice notices gdpr popup modal overlay "
                         "newsletter subscribe subscription signup login share sharing social related recommended "
                         "recommendations comment comments commentlist reply replies respond disqus discussion form "
                         "search pagination pager tags copyright legal disclaimer alert complementary "
                         "contentinfo").split())
MAIN_WORD = frozenset("article main content maincontent post entry story articlebody postcontent".split())

TAG = re.compile(r"""<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))""")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
WORD = re.compile(r"[a-z]+")
MARKS = re.compile(r"[.!?;,:]")
CLOSES_P = BLOCK - {"body", "html", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt", "option", "legend"}
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
        "option": ({"option"}, {"select"})}


class Page:
    """Elements in page order: ``tag``, ``parent`` and ``edge`` by element; ``runs``: (element,
    text or None at a block boundary) in page order."""

    def __init__(self, source: str):
        self.tag, self.parent, self.edge = ["#root"], [-1], ["plain"]
        self.runs: list[tuple[int, str | None]] = []
        self.open: dict[str, list[int]] = {}  # places in the stack of the open elements, by tag
        stack, at, size = [0], 0, len(source)
        while at < size:
            m = TAG.search(source, at)
            if m is None:
                self.text(stack[-1], source[at:])
                break
            if m.start() > at:
                self.text(stack[-1], source[at:m.start()])
            name = m[2]
            if name is None:
                close = "-->" if m[0] == "<!--" else ">"
                to = source.find(close, m.end())
                at = size if to < 0 else to + len(close)
                continue
            rest = REST.match(source, m.end())
            if rest:
                at = rest.end()
            else:  # an unclosed quote or tag
                to = source.find(">", m.end())
                at = size if to < 0 else to + 1
            name = name.lower()
            if m[1]:
                self.end(stack, name)
                continue
            self.start(stack, name, source[m.end():at])
            if name in RAW:
                to = re.compile(f"</{name}", re.IGNORECASE).search(source, at)
                to = to.start() if to else size
                if name in ("title", "textarea"):
                    self.text(stack[-1], source[at:to])
                at = to

    def text(self, element: int, text: str) -> None:
        self.runs.append((element, text))

    def boundary(self, element: int, name: str) -> None:
        if name in BLOCK:
            self.runs.append((element, None))

    def pop_to(self, stack: list[int], place: int) -> None:
        while len(stack) > place:
            tag = self.tag[stack[-1]]
            self.open[tag].pop()
            self.boundary(stack.pop(), tag)

    def open_place(self, names: set | frozenset, stop: set | frozenset) -> int | None:
        """Place in the stack of the innermost open element of these names, unless one to stop at is inside it."""
        place = max((self.open[n][-1] for n in names if self.open.get(n)), default=None)
        if place is None or any(self.open[n][-1] > place for n in stop if self.open.get(n)):
            return None
        return place

    def start(self, stack: list[int], name: str, rest: str) -> None:
        if name in CLOSES_P and (place := self.open_place({"p"}, {"table", "button"})) is not None:
            self.pop_to(stack, place)
        if name in SAME and (place := self.open_place(*SAME[name])) is not None:
            self.pop_to(stack, place)
        element = len(self.tag)
        self.tag.append(name)
        self.parent.append(stack[-1])
        words = set()
        for value in NAMES.findall(rest):
            words.update(WORD.findall(value.lower()))
        boiler = name in BOILER_TAG or name in HIDDEN or words & BOILER_WORD
        main = name in MAIN_TAG or words & MAIN_WORD
        # a main tag outweighs its class words; else words like "post-comments" are boilerplate
        self.edge.append("main" if name in MAIN_TAG and name not in BOILER_TAG and not words & BOILER_WORD - {"header"}
                         else "boiler" if boiler else "main" if main else "plain")
        self.boundary(element, name)
        if name not in VOID:
            if not rest.rstrip(">").rstrip().endswith("/") or name not in ("svg", "math"):
                self.open.setdefault(name, []).append(len(stack))
                stack.append(element)
        elif name == "br":
            self.text(stack[-1], " ")

    def end(self, stack: list[int], name: str) -> None:
        place = self.open_place({name}, set() if name in BLOCK else {"td", "th", "table"})
        if place is not None:
            self.pop_to(stack, place)

    def features(self) -> list[tuple[str, ...]]:
        """Weak features, over its subtree, of each element that has text of its own; other
        elements have none, so that wrappers don't count the same text again."""
        n = len(self.tag)
        own = {element for element, text in self.runs if text and not text.isspace()}
        size, linked, marks = [0] * n, [0] * n, [0] * n
        for element, text in self.runs:
            if text:
                size[element] += len(text)
                marks[element] += len(MARKS.findall(text))
        for e in range(n - 1, 0, -1):
            if self.tag[e] == "a":
                linked[e] = size[e]
            p = self.parent[e]
            size[p] += size[e]
            linked[p] += linked[e]
            marks[p] += marks[e]
        out = []
        for e in range(n):
            if e not in own:
                out.append(())
                continue
            length = size[e]
            share = linked[e] / length if length else 0
            tag = self.tag[e]
            out.append((
                "links0" if share == 0 else "links1" if share < 0.3 else "links2",
                "size0" if length < 25 else "size1" if length < 120 else "size2" if length < 500 else "size3",
                "marks0" if marks[e] * 200 < length or not length else "marks1",
                "paragraph" if tag in PARAGRAPH else "list" if tag in LIST else "other"))
        return out

    def labels(self) -> list[int] | None:
        """By the page's own markup, or None where it has no article or main."""
        if not MAIN_TAG.intersection(self.tag):
            return None
        out = [0]
        for e in range(1, len(self.tag)):
            edge = self.edge[e]
            out.append(1 if edge == "main" and self.tag[e] in MAIN_TAG else 0 if edge == "boiler" else out[self.parent[e]])
        return out


class Model:
    """Log potentials. ``node[feature]``: log odds of content; ``edges[kind][parent][child]``."""

    def __init__(self, counts: dict[tuple[str, ...], int]):
        total, seen = [0, 0], {}
        pairs: dict[tuple, float] = dict(PRIOR)
        for (what, *key), n in counts.items():
            if what == "node":
                feature, label = key[0], int(key[1])
                seen.setdefault(feature, [SMOOTHING, SMOOTHING])[label] += n
                if feature.startswith("size"):
                    total[label] += n
            else:
                pair = (key[0], int(key[1]), int(key[2]))
                pairs[pair] = pairs.get(pair, 0) + n
        self.node = {f: max(-WEAK, min(WEAK, log(a[1] / (total[1] + 4)) - log(a[0] / (total[0] + 4))))
                     for f, a in seen.items()}
        self.edges = {}
        for kind in ("main", "boiler", "plain"):
            rows = []
            for parent in (0, 1):
                a = [pairs.get((kind, parent, c), 0) + SMOOTHING for c in (0, 1)]
                a[1] = max(a[1], a[0] * 1e-4)  # enough evidence can always make content
                rows.append([log(max(x / sum(a), 1e-6)) for x in a])
            self.edges[kind] = rows

    def marginals(self, page: Page) -> list[float]:
        """Log odds that each element is content: messages up to the root, then down."""
        n = len(page.tag)
        node = [sum(self.node.get(f, 0.0) for f in fs) for fs in page.features()]
        up = [[0.0, w] for w in node]        # log potential of the subtree by label
        message = [(0.0, 0.0)] * n           # from the element to its parent
        for e in range(n - 1, 0, -1):
            edge, own, p = self.edges[page.edge[e]], up[e], up[page.parent[e]]
            message[e] = to = tuple(_either(own[0] + edge[y][0], own[1] + edge[y][1]) for y in (0, 1))
            p[0] += to[0]
            p[1] += to[1]
        belief = [up[0]] + [[0.0, 0.0]] * (n - 1)
        belief[0] = [up[0][0] + log(0.99), up[0][1] + log(0.01)]  # the page as a whole isn't content
        for e in range(1, n):
            edge, above, to = self.edges[page.edge[e]], belief[page.parent[e]], message[e]
            outside = (above[0] - to[0], above[1] - to[1])
            down = [_either(outside[0] + edge[0][y], outside[1] + edge[1][y]) for y in (0, 1)]
            belief[e] = [up[e][0] + down[0], up[e][1] + down[1]]
            level = max(belief[e])           # beliefs matter up to a constant; keep them small
            belief[e][0] -= level
            belief[e][1] -= level
        return [b[1] - b[0] for b in belief]


def _either(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a >= b else b + log1p(exp(a - b))


def main_text(source: str, model: Model) -> str:
    page = Page(source)
    odds = model.marginals(page)
    blocks, parts = [], []

    def flush() -> None:
        if text := " ".join(html_module.unescape("".join(parts)).split()):
            blocks.append(text)
        parts.clear()

    for element, text in page.runs:
        if text is None:
            flush()
        elif odds[element] > 0:
            parts.append(text)
        else:
            parts.append(" ")
    flush()
    return "\n".join(blocks)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, int] = {}
    for batch in batches:
        for source in batch.column(0):
            page = Page(source.as_py())
            labels = page.labels()
            if labels is None:
                continue
            for e, features in enumerate(page.features()):
                keys = [f"node {f} {labels[e]}" for f in features]
                if e:
                    keys.append(f"edge {page.edge[e]} {labels[page.parent[e]]} {labels[e]}")
                for key in keys:
                    counts[key] = counts.get(key, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                     ["key", "n"])


def hash_bound(rows: int, wanted: int) -> int:
    """The largest signed 64-bit hash below which about ``wanted`` of ``rows`` rows fall (all, if fewer)."""
    share = 1 << 64 if rows <= wanted else (wanted << 64) // rows
    return share - (1 << 63) - 1


def train(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES) -> Model:
    """Count labelled pages: all of them, or about ``train_pages`` by a hash of their text.
    A few dozen sums reach the driver."""
    rows = pages.filter(F.col(html_col).isNotNull())
    picked = rows.filter(F.xxhash64(html_col) <= hash_bound(rows.count(), train_pages))
    counts = (picked.select(F.col(html_col).alias("html")).mapInArrow(_train, "key string, n long")
              .groupBy("key").agg(F.sum("n").alias("n")).collect())
    return Model({tuple(r["key"].split(" ")): r["n"] for r in counts})


def _extract(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py() or "", model) for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], batch.schema.names)


def extract(pages: DataFrame, model: Model, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars``, one row per page. No shuffle."""
    rows = pages.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(html_col).cast("string").alias("text"))
    out = rows.mapInArrow(lambda b: _extract(b, model), rows.schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "text",
                      F.length("text").cast("long").alias("n_chars"))


def extract_pages(pages: DataFrame) -> DataFrame:
    return extract(pages, train(pages))
