"""Page boilerplate mixed with the main content.

A page is a tree of nodes, each content or boilerplate. The tree of an HTML page is its DOM, with
the lines of text as leaves; the tree of a Markdown text has its blocks and their lines. A graphical
model gives every node a potential from its features and every edge one from its two labels;
sum-product messages passed upward and then downward yield the marginal of each node.

The potentials are learned from labelled pages: elements that a page itself names (nav, footer,
a class like "cookie" or "pager") are boilerplate; paragraphs, lists, headings and code outside of
them that hold sentences are content. The Markdown model is trained on lines that pages
have labelled. A line of Markdown has the marginal of the Markdown tree; if the page it was
extracted from is at hand and holds the line, the odds of both trees multiply.

Every page and every extract with a page trains the model. Pages are parsed into trees once; each
round of training counts the features of all trees in the tasks and sends sums to the driver, which
holds what the model itself holds: a weight a feature.
Nulls: a NULL text has no lines; extracts without a page, or with a garbled one, use the Markdown
tree alone. Lines of code belong to the content. Repeated rows count once.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.html.dom import Node, parse
from quire.llm.charlm import CharModel
from quire.llm.encoding import labeller
from quire.llm.spampages import words
from quire.session import slices, small, written

#: Features a task counts before it hands them on and begins anew.
FEATURES = 300_000
#: Addresses that may be broadcast to choose the pages by; more are joined by a shuffle.
WANTED = 200_000

# What pages call their boilerplate, in tags and class or id names.
NAMED_TAGS = {"nav", "footer", "aside", "header", "form", "button"}
NAMED = re.compile(
    r"(?:^|[\s_-])(nav|navbar|menu|breadcrumbs?|footer|header|aside|sidebar|widget|cookies?|consent|gdpr|banner|promo|advert|ads|sponsor|share|sharing|social|"
    r"related|recommend\w*|popular|newsletter|letter|subscribe|signup|comments?|pager|pagination|tags|tagcloud|search|login)(?:$|[\s_-])",
    re.I,
)
SKIP = {"script", "style", "template", "noscript", "svg", "head", "title", "#root", "html"}
LINE_TAGS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "section", "article", "main", "td", "th", "tr", "table", "ul", "ol", "dl", "dt", "dd", "figure", "figcaption", "nav", "aside", "header", "footer", "body", "form"}
CONTENT_TAGS = {"p", "li", "h1", "h2", "h3", "h4", "pre", "blockquote", "td", "dd", "dt", "figcaption"}

_MARK = re.compile(r"^\s*(?:#{1,6}\s+|>\s*|[-*+]\s+|\d+[.)]\s+)+")
_LETTERS = re.compile(r"[^\W\d_]+")
_NORM = re.compile(r"[\W_]+")
_MDLINK = re.compile(r"!?\[([^\]\n]*)\]\(([^)\s]*)\)")
_END = re.compile(r"[.!?。！？…][\"'”’»)）」』*_\]]*$")
_SEP = re.compile(r"\s[|/•·–—\-»>→]\s|[|•·>]|\s{2,}")
_DIGIT = re.compile(r"\d")
_FENCE = re.compile(r"^\s*(```|~~~)")
_SIGN = re.compile(r"©|\(c\) ?\d{4}|@|☰|🔍|▶|←|→|↑|▲")


def key_of(line: str) -> int:
    """A line's identity across page and Markdown: its letters and digits."""
    return xxhash.xxh64_intdigest(_NORM.sub("", line).lower()) - (1 << 63)


def features(line: str, place: int, tag: str = "", names: tuple[str, ...] = ()) -> list[str]:
    """What is seen of a node: shape, place, tag, the parts of its class and id, and words."""
    s = line.strip()
    n = len(s)
    body = _MARK.sub("", s)
    links = _MDLINK.findall(body)
    linked = sum(len(a) for a, _ in links)
    shown = _MDLINK.sub(r"\1", body) if links else body
    wide = 1 if s.isascii() else 2
    size = len(shown) * wide
    ws = words(shown)
    out = [
        f"size{min(6, int(math.log2(size + 1)) - 1)}", "end" if _END.search(shown) else "open", f"link{0 if not links else 1 if linked < 0.5 * len(shown) else 2 if linked < 0.9 * len(shown) else 3}",
        f"sep{min(3, len(_SEP.findall(shown)))}", f"place{place}", f"words{min(4, len(ws) // 4)}",
    ]
    out.append(out[1] + out[0])  # a short line that ends a sentence is another thing than a short label
    if size > 120 and _END.search(shown):
        out.append("sentences")
    if s.startswith("#"):
        out.append("heading")
    elif s.startswith(("- ", "* ", "+ ")):
        out.append("bullet-end" if _END.search(shown) else "bullet")
    if _SIGN.search(s):
        out.append("sign")
    if _DIGIT.search(shown):
        out.append("digit")
    if shown.isupper():
        out.append("caps")
    if tag:
        out.append(f"<{tag}>")
    out.extend("." + n for n in names)
    out.extend("w:" + w for w in set(ws))
    return out


def place_of(i: int, n: int) -> int:
    """Begin, middle or end of the page."""
    return 0 if i * 8 < n else 2 if (n - 1 - i) * 8 < n else 1


CODE = ["code"]
#: Words of a line that count one by one.
CLEAREST = 6
#: Marginals between these label nothing in training.
LOW, HIGH = 0.1, 0.9


class Tree:
    """Nodes in an order in which parents come first: parent index, features, line key or None."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.seen: list[list[str]] = []
        self.line: list = []

    def add(self, parent: int, seen: list[str], line=None) -> int:
        self.parent.append(parent)
        self.seen.append(seen)
        self.line.append(line)
        return len(self.parent) - 1


def _called(n: Node) -> str:
    return f"{n.get('class')} {n.get('id')} {n.get('role')}"


def _names(n: Node) -> tuple[str, ...]:
    """The words in what a page calls an element, whatever they are."""
    return tuple(sorted(set(_LETTERS.findall(_called(n).lower()))))


def page_tree(html: str) -> tuple[Tree, list[bool | None]]:
    """The DOM of a page as a tree, and the labels that its own names give (None: unknown)."""
    t, labels = Tree(), []
    root = parse(html)
    jobs: list = []
    # first the lines, to know their places
    leaves: list[tuple[Node, str]] = []

    def lines_of(n: Node) -> list[str]:
        parts: list[str] = []
        for c in n.children:
            if isinstance(c, str):
                parts.append(c if n.tag == "pre" or any(p == "pre" for p in _up(n)) else c.replace("\n", " "))
            elif c.tag == "br":
                parts.append("\n")
            elif c.tag in LINE_TAGS or c.tag in SKIP:
                parts.append("\n")
            else:
                parts.append("\n".join(lines_of(c)) if c.tag == "pre" else " ".join(lines_of(c)))
        return [x.strip() for x in "".join(parts).split("\n") if x.strip()]

    top = t.add(-1, ["page"])
    labels.append(None)
    jobs.append((root, top, False))
    while jobs:
        n, at, named = jobs.pop()
        if n.tag in SKIP and n.tag not in ("#root", "html"):
            continue
        own = n.tag in NAMED_TAGS or bool(NAMED.search(_called(n)))
        if n.tag in LINE_TAGS and n.tag not in ("body",):
            at = t.add(at, [f"<{n.tag}>", *("." + x for x in _names(n))])
            labels.append(False if own or named else None)
        named = named or own
        if n.tag in LINE_TAGS or n.tag in ("#root", "html"):
            for x in lines_of(n):
                leaves.append((n, x))
                i = t.add(at, [], x)
                known: bool | None = False if named else None
                if not named and n.tag in CONTENT_TAGS and (n.tag in ("pre", "h2", "h3") or len(x) > 40 or _END.search(x)):
                    known = True
                labels.append(known)
                t.seen[i] = [n.tag, _names(n)]
        jobs.extend((c, at, named) for c in reversed(n.elements()))
    total = len(leaves)
    k = 0
    for i, x in enumerate(t.line):
        if x is not None:
            tag, names = t.seen[i]
            t.seen[i] = features(x, place_of(k, total), tag, names)
            k += 1
    return t, labels


def _up(n: Node) -> Iterator[str]:
    while n.parent is not None:
        n = n.parent
        yield n.tag


def markdown_tree(text: str) -> tuple[Tree, list[int]]:
    """Page, blocks, lines of a Markdown text, and the line number of each node (0: none)."""
    t, nos = Tree(), [0]
    top = t.add(-1, ["page"])
    rows = text.split("\n")
    total = len(rows)
    block, fence = -1, False
    for no, line in enumerate(rows, 1):
        if _FENCE.match(line):
            fence = not fence
            if fence and block < 0:
                block = t.add(top, CODE)
                nos.append(0)
            t.add(block, CODE, line)
            nos.append(no)
            continue
        if not line.strip():
            if not fence:
                block = -1
            continue
        if block < 0:
            block = t.add(top, CODE if fence else ["block"])
            nos.append(0)
        t.add(block, CODE if fence else features(line, place_of(no - 1, total)), line)
        nos.append(no)
    return t, nos


class Tally:
    """Counts over labelled trees, by label: features, nodes, and edges by both labels."""

    def __init__(self) -> None:
        self.by: tuple[Counter, Counter] = (Counter(), Counter())
        self.n = [0, 0]
        self.edge = [[0, 0], [0, 0]]

    def add(self, t: Tree, labels: list[bool | None]) -> None:
        for i, y in enumerate(labels):
            if y is None:
                continue
            self.n[y] += 1
            self.by[y].update(t.seen[i])
            p = t.parent[i]
            if p >= 0 and labels[p] is not None:
                self.edge[labels[p]][y] += 1

    def add_clear(self, potentials: Potentials, seen: list[list[str]], labels: list[bool | None]) -> None:
        for x, y in zip(seen, labels):
            if y is not None:
                self.by[y][potentials.clear(x)] += 1

    def add_clear_rows(self, low: set[str], high: set[str], seen: str, labels: str) -> None:
        """The same of a tree as a row, with the words that are clear either way."""
        for x, y in zip(seen.split("\n"), labels):
            if y != "?":
                ws = x.split(" w:")[1:]
                k = f"clear{min(4, sum(map(low.__contains__, ws)))}{min(4, sum(map(high.__contains__, ws)))}" if ws else "clear00"
                self.by[y == "1"][k] += 1

    def rows(self) -> list[tuple[str, int, int]]:
        """(feature, count with either label); "#" begins the names of the other counts."""
        by, (e0, e1) = self.by, self.edge
        return [("#n", *self.n), ("#0", *e0), ("#1", *e1), *((f, by[0][f], by[1][f]) for f in by[0].keys() | by[1].keys())]

    @staticmethod
    def of(rows: DataFrame) -> Tally:
        """The sum of the rows (f, n0, n1) of all tasks, without features that occur once."""
        t = Tally()
        got = rows.groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n0 + n1 > 1 OR f LIKE '#%' OR f LIKE 'clear%'").toArrow()
        for f, n0, n1 in zip(*(got[c].to_pylist() for c in ("f", "n0", "n1"))):
            if f == "#n":
                t.n = [n0, n1]
            elif f[0] == "#":
                t.edge[int(f[1])] = [n0, n1]
            else:
                for y, n in ((0, n0), (1, n1)):
                    if n:
                        t.by[y][f] = n
        return t


class Potentials:
    """Log-odds of content for features, and log-potentials of edges; sum-product on trees."""

    CLIP, SCALE, CLEAR, WORDS = 4.0, 0.9, 2.0, 0.6

    def __init__(self, trees: list[tuple[Tree, list[bool | None]]], shape: float = 0.65, blind: bool = False):
        """blind: without tags and names, which the labels come from."""
        tally, clear = Tally(), Tally()
        for t, labels in trees:
            tally.add(t, labels)
        self.learn(tally, shape, blind)
        # how many words speak clearly for either side, counted once the words' weights are known
        for t, labels in trees:
            clear.add_clear(self, t.seen, labels)
        self.learn_clear(clear)

    def learn(self, tally: Tally, shape: float = 0.65, blind: bool = False) -> None:
        """Weights and edges from the counts of all trees."""
        self.shape = shape
        self.n = [1.0 + x for x in tally.n]
        self.weight: dict[str, float] = {}
        by = tally.by
        for f in set(by[0]) | set(by[1]):
            if by[0][f] + by[1][f] > 1 and not (blind and f[0] in "<."):
                self.weigh(f, by[0][f], by[1][f])
        edge = [[1.0 + x for x in e] for e in tally.edge]
        # a floor keeps a block from fixing its lines
        self.same = (max(0.02, min(0.98, (edge[0][0]) / sum(edge[0]))), max(0.02, min(0.98, edge[1][1] / sum(edge[1]))))

    def learn_clear(self, tally: Tally) -> None:
        """Weights of what `clear` says, from its counts."""
        for f in set(tally.by[0]) | set(tally.by[1]):
            self.weigh(f, tally.by[0][f], tally.by[1][f])

    def weigh(self, f: str, n0: int, n1: int) -> None:
        self.weight[f] = max(-self.CLIP, min(self.CLIP, math.log((n1 + 0.3) / (self.n[1] + 0.6)) - math.log((n0 + 0.3) / (self.n[0] + 0.6))))

    def clear(self, seen: list[str]) -> str:
        """How many of a node's words are clearly boilerplate, and how many content, as one feature."""
        get = self.weight.get
        return self._clear([get(f, 0.0) for f in seen if f[:2] == "w:"])

    def _clear(self, ws: list[float]) -> str:
        low, high = 0, 0
        for w in ws:
            if w < -self.CLEAR:
                low += 1
            elif w > self.CLEAR:
                high += 1
        return f"clear{min(4, low)}{min(4, high)}"

    def odds(self, seen: list[str]) -> float:
        """Log-odds of content from a node's features alone."""
        get = self.weight.get
        shape, ws = 0.0, []
        for f in seen:
            if f[:2] == "w:":
                ws.append(get(f, 0.0))
            else:
                shape += get(f, 0.0)
        w = 0.0
        if ws:
            # the words that speak most clearly; the others depend on them. All words over the root of their number
            # were tried instead: on sf0.1 that changed 69 of 25,138 lines, most for the worse
            w = self.WORDS * sum(sorted(ws, key=abs, reverse=True)[:CLEAREST]) + get(self._clear(ws), 0.0)
        return self.shape * shape + self.SCALE * w if seen != CODE else 6.0

    def marginals(self, t: Tree) -> list[float]:
        """P(content) of every node: messages up from the leaves, then down from the root."""
        n = len(t.parent)
        own = [self.odds(s) for s in t.seen]
        s0, s1 = self.same
        up = own[:]  # log-odds of each node with everything below it
        msg = [0.0] * n

        def pass_up(x: float) -> float:
            e = math.exp(max(-30.0, min(30.0, x)))
            return math.log((s1 * e + (1 - s1)) / ((1 - s0) * e + s0))

        for i in range(n - 1, 0, -1):
            msg[i] = pass_up(up[i])
            up[t.parent[i]] += msg[i]
        full = up[:]
        for i in range(1, n):
            p = t.parent[i]
            e = math.exp(max(-30.0, min(30.0, full[p] - msg[i])))
            full[i] = up[i] + math.log((s1 * e + (1 - s0)) / ((1 - s1) * e + s0))
        return [1 / (1 + math.exp(-max(-30.0, min(30.0, x)))) for x in full]


MARKDOWN_SHAPE = 0.45


def sure(p: float) -> bool | None:
    """The label that a marginal gives in training."""
    return None if LOW < p < HIGH else p >= HIGH


def labelled_markdown(text: str, known: dict[int, bool | None]) -> tuple[Tree, list[bool | None]]:
    """The tree of a Markdown text with the labels `known` of its lines' keys."""
    t, _ = markdown_tree(text)
    labels = [None if x is None else known.get(key_of(x)) for x in t.line]
    # a block has the label its lines share
    kids = defaultdict(set)
    for i, p in enumerate(t.parent):
        if p > 0 and labels[i] is not None:
            kids[p].add(labels[i])
    for i, ys in kids.items():
        if len(ys) == 1:
            labels[i] = next(iter(ys))
    return t, labels


class Model:
    """The page model and the Markdown model."""

    def __init__(self, pages: dict[str, str], extracts: list[tuple[str | None, str]], chars: CharModel):
        self.chars = chars
        lab = labeller(chars)
        good = {u: h for u, h in pages.items() if not lab.garbled(h)}
        named = [page_tree(h) for h in good.values()]
        # names label the pages; a model that doesn't see them then labels it again, and from its labels it is
        # learned what tags and names of any kind are worth, so no list of names is part of the model
        first = Potentials(named, blind=True)
        self.page = Potentials([(t, [sure(p) for p in first.marginals(t)]) for t, _ in named])
        trees = []
        for url, text in extracts:
            if url not in good:
                continue
            known = self.page_lines(good[url])
            trees.append(labelled_markdown(text, {k: sure(p) for k, p in known.items()}))
        # the shape features of a line depend on each other more where no element's name is among them
        self.markdown = Potentials(trees, MARKDOWN_SHAPE)

    def page_lines(self, html: str) -> dict[int, float]:
        """P(content) by line key; a line that stands in several places gets the lowest."""
        t, _ = page_tree(html)
        out: dict[int, float] = {}
        for x, p in zip(t.line, self.page.marginals(t)):
            if x is not None:
                k = key_of(x)
                out[k] = min(p, out.get(k, 1.0))
        return out

    def markdown_lines(self, text: str) -> list[tuple[int, int, float]]:
        """(line number, key, P(content)) of every non-blank line."""
        t, nos = markdown_tree(text)
        return [(no, key_of(x), p) for no, x, p in zip(nos, t.line, self.markdown.marginals(t)) if no]


#: A tree as a row (features of a node between blanks, nodes between line breaks; labels "0", "1", "?"; nodes of lines and their keys), or a feature with its counts.
TREES = "url string, parent array<int>, seen string, labels string, lines array<int>, keys array<long>, f string, n0 long, n1 long"
COLUMNS = ["url", "parent", "seen", "labels", "lines", "keys"]


def _row(url: str, t: Tree, labels: list[bool | None]) -> tuple:
    lines = [i for i, x in enumerate(t.line) if x is not None]
    return url, t.parent, "\n".join(map(" ".join, t.seen)), _written(labels), lines, [key_of(t.line[i]) for i in lines]


def _written(labels: list[bool | None]) -> str:
    return "".join("?" if y is None else "1" if y else "0" for y in labels)


def _read(labels: str) -> list[bool | None]:
    return [None if y == "?" else y == "1" for y in labels]


def _tree(parent, seen: str) -> Tree:
    t = Tree()
    t.parent, t.seen = parent.tolist(), _seen(seen)
    return t


def _seen(seen: str) -> list[list[str]]:
    return [x.split(" ") for x in seen.split("\n")]


def _grown(df: DataFrame, start: Callable[[], Callable[[pd.DataFrame, Tally], list[tuple]]], name: str) -> tuple[DataFrame, Tally]:
    """The trees made of rows of `df`, written, and their tally; `start` gives each task the function that makes and counts them."""

    def handed(tally: Tally) -> Iterator[pd.DataFrame]:
        rows = tally.rows()
        for at in range(0, len(rows), 50_000):
            f, n0, n1 = zip(*rows[at : at + 50_000])
            yield pd.DataFrame({c: pd.Series([None] * len(f), dtype=object) for c in COLUMNS} | {"f": f, "n0": n0, "n1": n1})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally, make = Tally(), start()
        for pdf in slices(batches):
            yield pd.DataFrame(make(pdf, tally), columns=COLUMNS, dtype=object).assign(f=None, n0=0, n1=0)
            if len(tally.by[0]) + len(tally.by[1]) >= FEATURES:
                yield from handed(tally)
                tally = Tally()
        yield from handed(tally)

    got = written(df.mapInPandas(run, TREES), name)
    return got.where("f IS NULL").select(*COLUMNS), Tally.of(got.where("f IS NOT NULL").select("f", "n0", "n1"))


def _learned(trees: DataFrame, tally: Tally, shape: float = 0.65, blind: bool = False) -> Potentials:
    """The potentials of the labelled `trees`, whose counts are `tally`."""
    p = Potentials([])
    p.learn(tally, shape, blind)
    words = {f[2:]: w for f, w in p.weight.items() if f[:2] == "w:"}
    b = trees.sparkSession.sparkContext.broadcast(({x for x, w in words.items() if w < -p.CLEAR}, {x for x, w in words.items() if w > p.CLEAR}))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clear, (low, high) = Tally(), b.value
        for pdf in slices(batches):
            for seen, labels in zip(pdf["seen"], pdf["labels"]):
                clear.add_clear_rows(low, high, seen, labels)
        yield pd.DataFrame(clear.rows(), columns=["f", "n0", "n1"])

    p.learn_clear(Tally.of(trees.select("seen", "labels").mapInPandas(run, "f string, n0 long, n1 long")))
    return p


def fit(pages: DataFrame, extracts: DataFrame, chars: CharModel) -> Model:
    """Train on all pages (url, html) and all extracts (url, text) that have one."""
    return train(pages.withColumn("at", F.lit(None).cast("timestamp")), extracts, chars)[0]


def train(pages: DataFrame, extracts: DataFrame, chars: CharModel) -> tuple[Model, DataFrame]:
    """The model trained on all pages (url, html, at) and all extracts (url, text) that have one, and (url, keys, probs) of the pages.

    Of several pages for one address the latest sound one counts.
    """
    spark = pages.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    b = spark.sparkContext.broadcast(chars)

    def parsing() -> Callable[[pd.DataFrame, Tally], list[tuple]]:
        lab, last = labeller(b.value), None

        def parsed(pdf: pd.DataFrame, tally: Tally) -> list[tuple]:
            nonlocal last
            out = []
            for url, html in zip(pdf["url"], pdf["html"]):
                if url != last and not lab.garbled(html):
                    last = url
                    t, labels = page_tree(html)
                    # an empty page has no line and trains nothing
                    labels = labels if html else []
                    tally.add(t, labels)
                    out.append(_row(url, t, labels))
            return out

        return parsed

    at_hand = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", "html", "at").repartition(parts, "url").sortWithinPartitions("url", F.desc("at"), F.desc("html"))
    trees, tally = _grown(at_hand.select("url", "html"), parsing, "page-trees")
    first = spark.sparkContext.broadcast(_learned(trees, tally, blind=True))

    def again(pdf: pd.DataFrame, tally: Tally) -> list[tuple]:
        out = []
        for url, parent, seen, named, lines, keys in pdf[COLUMNS].itertuples(index=False):
            t = _tree(parent, seen)
            labels = [sure(p) for p in first.value.marginals(t)] if named else []
            tally.add(t, labels)
            out.append((url, parent, seen, _written(labels), lines, keys))
        return out

    model = Model({}, [], chars)
    trees, tally = _grown(trees, lambda: again, "page-labels")
    model.page = _learned(trees, tally)
    page = spark.sparkContext.broadcast(model.page)

    def lines_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            out = []
            for url, parent, seen, lines, keys in pdf.itertuples(index=False):
                ps, got = page.value.marginals(_tree(parent, seen)), {}
                for i, k in zip(lines.tolist(), keys.tolist()):
                    got[k] = min(ps[i], got.get(k, 1.0))
                out.append((url, list(got), list(got.values())))
            yield pd.DataFrame(out, columns=["url", "keys", "probs"], dtype=object)

    def labelled(pdf: pd.DataFrame, tally: Tally) -> list[tuple]:
        out = []
        for text, keys, probs in zip(pdf["text"], pdf["keys"], pdf["probs"]):
            t, labels = labelled_markdown(text, {k: sure(p) for k, p in zip(keys.tolist(), probs.tolist())})
            tally.add(t, labels)
            out.append((None, None, "\n".join(map(" ".join, t.seen)), _written(labels), None, None))
        return out

    lines = written(trees.select("url", "parent", "seen", "lines", "keys").mapInPandas(lines_of, "url string, keys array<long>, probs array<double>"), "page-lines")
    mine = extracts.where("url IS NOT NULL AND text IS NOT NULL").select("url", "text").repartition(parts, "url").join(lines.repartition(parts, "url"), "url").select("text", "keys", "probs")
    model.markdown = _learned(*_grown(mine, lambda: labelled, "line-trees"), MARKDOWN_SHAPE)
    return model, lines


def label_pages(pages: DataFrame, model: Model) -> DataFrame:
    """(url, keys, probs, sound): the line keys of every page of `pages` (url, html) with their marginals."""
    b = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = b.value
        lab = labeller(m.chars)
        for pdf in slices(batches):
            keys, probs, sound = [], [], []
            for h in pdf["html"]:
                # lines of a garbled page couldn't be told from its Markdown's
                ok = not lab.garbled(h)
                got = m.page_lines(h) if ok else {}
                keys.append(list(got))
                probs.append(list(got.values()))
                sound.append(ok)
            yield pd.DataFrame({"url": pdf["url"], "at": pdf["at"], "keys": keys, "probs": probs, "sound": sound})

    return pages.mapInPandas(run, "url string, at timestamp, keys array<long>, probs array<double>, sound boolean")


def label_lines(extracts: DataFrame, pages: DataFrame, model: Model) -> DataFrame:
    """(key, line_no, content) of every non-blank line of `extracts` (key, url, text), with its marginal.

    `pages` (url, html, at) are the pages at hand; of several for one address the latest sound one counts.
    Only pages that an extract comes from are parsed.
    """
    wanted = small(extracts.where("text IS NOT NULL AND key IS NOT NULL AND url IS NOT NULL").select("url").distinct(), WANTED)
    best = (
        label_pages(pages.where("html IS NOT NULL").join(wanted, "url", "left_semi"), model)
        .groupBy("url").agg(F.max_by(F.struct("keys", "probs"), F.struct("sound", "at")).alias("page"))
    )
    return label_lines_on(extracts, best.select("url", "page.keys", "page.probs"), model)


def label_lines_on(extracts: DataFrame, page_lines: DataFrame, model: Model) -> DataFrame:
    """The same with the lines of pages that are labelled already (url, keys, probs), one row an address."""
    b = extracts.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = b.value
        for pdf in slices(batches):
            got = [m.markdown_lines(x) for x in pdf["text"]]
            yield pd.DataFrame({
                "key": pdf["key"], "url": pdf["url"], "nos": [[a for a, _, _ in g] for g in got],
                "keys": [[k for _, k, _ in g] for g in got], "probs": [[p for _, _, p in g] for g in got],
            })

    lines = extracts.where("text IS NOT NULL AND key IS NOT NULL").mapInPandas(run, "key long, url string, nos array<int>, keys array<long>, probs array<double>")
    best = page_lines.select("url", F.struct("keys", "probs").alias("page"))
    one = lines.join(best, "url", "left").select("key", "page", F.explode(F.arrays_zip("nos", "keys", "probs")).alias("x"))
    at = F.coalesce(F.array_position("page.keys", F.col("x.keys")), F.lit(0)).cast("int")
    q, r = F.col("x.probs"), F.expr("try_element_at(page.probs, int(coalesce(array_position(page.keys, x.keys), 0)))")
    # the two trees see different things of a line: their odds multiply
    p = F.when(at > 0, F.greatest(q * r, F.lit(1e-30)) / (F.greatest(q * r, F.lit(1e-30)) + F.greatest((1 - q) * (1 - r), F.lit(1e-30)))).otherwise(q)
    return one.select("key", F.col("x.nos").alias("line_no"), p.alias("content"), (at > 0).alias("on_page"))
