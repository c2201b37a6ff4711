"""Keyword-stuffed and link-list pages.

A page is cut into lines, long lines into sentences. A hidden Markov model with the states prose,
link list, tag list and menu labels them in order; a page is spam if more than half of its
characters lie in lines of the other three states. Emissions are naive Bayes over the unit's words,
with weights of their own for each state, and over a few shape features. They are fitted on a bounded
sample of pages by Viterbi training: units whose shape speaks for a state begin it, later rounds
label all units by the model, with those shapes as a prior of limited weight. How much many words of
one unit count is fitted on units held out.

Nothing in the model names a language or a word: words, or pairs of characters in scripts without
blanks, get their weights from the sample.

Nulls and empty or blank texts are not spam (share 0). Texts of any length are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain, repeat
from operator import add

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.charlm import sample_texts

#: The bound of the sample the model is fitted on, in pages.
SAMPLE_PAGES = 2500
ROUNDS = 3
PROSE, LINKS, TAGS, MENU = range(4)
STATES = ("prose", "link list", "tag list", "menu")

_LINK = re.compile(r"!?\[[^\]\n]*\]\([^)\s]*\)|<a\b[^>]*>.*?</a>|https?://\S+|www\.\S+", re.I)
_HASH = re.compile(r"(?<![^\s])#[^\W\d_][\w]*|(?<![^\s])#\d+[^\W\d_]\w*")
_WORD = re.compile(r"[^\W\d_]+")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿豈-﫿]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=\S)|(?<=[。！？])")
# Ends of sentences, what may follow them, and separators of lists.
ENDS, CLOSERS = frozenset(".!?。！？…:："), "\"'”’»)）」』*_]"
SEPARATORS = re.compile("[,;|·•/、，；>]")
_FENCE = re.compile(r"^\s*(```|~~~)")
_BREAK = re.compile(r"<br\s*/?>", re.I)
#: Openings: clock time or date, number with a word of up to three letters, bullet, term of a glossary, quotation, heading.
_LEAD = re.compile(r"(\[?\d{1,4}[:.\-/]\d{2}\b)|([-*+]?\s*\d+(?:[.,/]\d+)?\s*[^\W\d_]{1,3}(?![^\W\d_]))|([-*+] )|(\*\*[^*]+\*\*\s*[:：–—-])|(> )|(#{1,6} )")
_PRICE = re.compile(r"\d+[.,]\d{2}\b")
LONG = 160


LEADS = frozenset("0123456789[-*+># ")


def units(text: str) -> list[tuple[str, bool]]:
    """(unit, whether it is code) in order: lines, those over LONG characters cut into sentences."""
    out, fence = [], False
    for line in _BREAK.sub("\n", text).split("\n") if "<" in text else text.split("\n"):
        if _FENCE.match(line):
            fence = not fence
            out.append((line, True))
            continue
        s = line.strip()
        if not s:
            continue
        if fence or len(s) <= LONG:
            out.append((s, fence))
        else:
            out.extend((p, False) for p in _SENTENCE.split(s) if p and not p.isspace())
    return out


def words(s: str) -> list[str]:
    """Lower-case words; in scripts without blanks, pairs of neighbouring characters."""
    found = _WORD.findall(s.lower())
    if s.isascii() or not _WIDE.search(s):
        return found
    out = []
    for w in found:
        if _WIDE.search(w):
            last = 0
            for m in _WIDE.finditer(w):
                if m.start() > last:
                    out.append(w[last : m.start()])
                r = m.group()
                out.extend(map(add, r, r[1:])) if len(r) > 1 else out.append(r)
                last = m.end()
            if last < len(w):
                out.append(w[last:])
        else:
            out.append(w)
    return out


def shape(s: str, ws: list[str], often: set) -> tuple[int, ...] | None:
    """Shape features of a unit, each a small number; None without words or links. `often` has the page's pairs of words seen more than twice."""
    n, k = len(s), len(ws)
    link = sum(len(m) for m in _LINK.findall(s)) / n if ("](" in s or "://" in s or "<a" in s or "www." in s) else 0.0
    if not k and not link:
        return None
    tag = sum(map(len, _HASH.findall(s))) / n if "#" in s else 0.0
    sep = len(SEPARATORS.findall(s)) + s.count(" - ") + s.count(" – ")
    part = (n if s.isascii() else n + 2 * sum(map(len, _WIDE.findall(s)))) / (sep + 1)
    rep = sum(map(often.__contains__, zip(ws, ws[1:]))) / (k - 1) if k > 1 and often else 0.0
    own = len(set(ws)) / k if k > 8 else 1.0
    lead = _LEAD.match(s) if s[0] in LEADS else None
    return (
        0 if link == 0 else 1 if link < 0.5 else 2 if link < 0.85 else 3,
        0 if tag == 0 else 1 if tag < 0.6 else 2,
        1 if s.rstrip(CLOSERS)[-1:] in ENDS else 0,
        0 if sep == 0 else 1 if part >= 40 else 2 if part >= 18 else 3,
        min(4, int(rep * 5)),
        0 if k <= 3 else 1 if k <= 8 else 2,
        1 if ("." in s or "," in s) and _PRICE.search(s) else 0,
        0 if own < 0.5 else 1 if own < 0.65 else 2 if own < 0.8 else 3,
        lead.lastindex if lead else 0,
    )


WIDTHS = (4, 3, 2, 4, 5, 3, 2, 4, 7)


def features(text: str) -> list[tuple[int, list[str], tuple[int, ...] | None]]:
    """(characters, words outside links, shape) of every unit; shape None for code."""
    us = units(text)
    ws = [[] if code else words(_LINK.sub(" ", s) if "](" in s or "://" in s or "<a" in s else s) for s, code in us]
    counts: Counter = Counter()
    for w in ws:
        counts.update(zip(w, w[1:]))
    often = {p for p, c in counts.items() if c > 2}
    return [(len(s), w, None if code else shape(s, w, often)) for (s, code), w in zip(us, ws)]


def hinted(w: list[str], f: tuple[int, ...]) -> int | None:
    """The state that a unit's shape alone speaks for, or None."""
    link, tag, end, sep, rep, size, price, own, lead = f
    if link == 3 and len(w) <= 2:
        return LINKS
    if tag == 2 or price and sep >= 1 and not end and link == 0:
        return TAGS
    if link == 0 and size == 2 and (own == 0 or own == 1 and rep >= 3 or not end and rep >= 3):
        return TAGS
    if lead in (1, 6) and link == 0 and not price:
        return PROSE
    if link == 0 and not end and sep == 3 and size <= 1 and rep == 0 and not lead:
        return MENU
    if link <= 1 and end and sep <= 2 and size == 2 and (own == 3 or own == 2 and rep <= 2):
        return PROSE
    return None


class Sample:
    """The units of pages as numbers: page, shape and code of each unit, and (unit, word) of each different word in it."""

    def __init__(self, pages: list[list]):
        units = [(w, f) for page in pages for _, w, f in page]
        self.page = np.repeat(np.arange(len(pages)), [len(page) for page in pages])
        self.code = np.array([f is None for _, f in units], bool)
        self.shape = np.array([f or (0,) * len(WIDTHS) for _, f in units], np.int64).reshape(-1, len(WIDTHS))
        ids: dict[str, int] = {}
        each = [[ids.setdefault(x, len(ids)) for x in set(w)] for w, _ in units]
        self.unit = np.repeat(np.arange(len(units)), [len(x) for x in each])
        self.word = np.fromiter(chain.from_iterable(each), np.int64, len(self.unit))
        self.words = list(ids)


class Model:
    """Emissions and transitions, in logarithms."""

    CLIP, CODE = 3.0, (0.0, -30.0, -30.0, -30.0)
    #: How much a hint counts while training, and the powers of a unit's number of words that are tried as its words' weight.
    HINT, POWERS = 3.0, (0.0, 0.25, 0.5, 0.75, 1.0)

    def __init__(self, pages: list[list]):
        self.power = 0.5
        self.fit(pages)

    def fit(self, pages: list[list]) -> None:
        hints = [[PROSE if f is None else hinted(w, f) for _, w, f in page] for page in pages]
        sample = Sample(pages)
        told = np.array([-1 if h is None else h for hs in hints for h in hs], np.int64)
        self.power = self.best_power(sample, told, pages)
        self.estimate(sample, told)
        for _ in range(ROUNDS):
            self.estimate(sample, np.array([s for page, own in zip(pages, hints) for s in self.label(page, own)], np.int64))

    def best_power(self, sample: Sample, told: np.ndarray, pages: list[list]) -> float:
        """The power under which words alone best tell the hinted units of every other page, learned on the rest."""
        odd = sample.page % 2 == 1
        self.estimate(sample, np.where(odd, -1, told))
        sizes = np.array([len(w) for page in pages for _, w, _ in page], np.int64)
        held = np.flatnonzero(odd & (told >= 0) & ~sample.code & (sizes > 0))
        if not len(held):
            return self.power
        units = [w for page in pages for _, w, _ in page]
        e, h = self.evidence([units[i] for i in held]), told[held]

        def likelihood(power: float) -> float:
            x = e * (sizes[held] ** power)[:, None]
            return float((x[np.arange(len(h)), h] - np.logaddexp.reduce(x, axis=1)).sum())

        return max(self.POWERS, key=likelihood)

    def estimate(self, sample: Sample, labels: np.ndarray) -> None:
        """From units with labels; -1 is none."""
        k, plain = len(STATES), (labels >= 0) & ~sample.code
        shapes = [1.0 + np.bincount(labels[plain] * n + sample.shape[plain, i], minlength=k * n).reshape(k, n) for i, n in enumerate(WIDTHS)]
        both = (labels[:-1] >= 0) & (labels[1:] >= 0) & (sample.page[:-1] == sample.page[1:])
        trans = 1.0 + np.bincount(labels[:-1][both] * k + labels[1:][both], minlength=k * k).reshape(k, k)
        self.known: dict[tuple[int, ...], tuple[float, ...]] = {}
        self.trans = np.log(trans / trans.sum(1, keepdims=True))
        self.shapes = [np.log(x / x.sum(1, keepdims=True)) for x in shapes]
        on, n = plain[sample.unit], len(sample.words)
        counts = np.bincount(labels[sample.unit[on]] * n + sample.word[on], minlength=k * n).reshape(k, n).T
        seen = counts.sum(1)
        sums = counts.sum(0) + 0.5 * (np.count_nonzero(seen) + 1.0)
        # word numbers, and a row of weights for each; row 0 is that of unknown words
        often = np.flatnonzero(seen > 1)
        self.ids = {sample.words[w]: i for i, w in enumerate(often, 1)}
        x = np.log((counts[often] + 0.5) / sums)
        self.weight = np.vstack([np.zeros(k), np.clip(x - x.mean(1, keepdims=True), -self.CLIP, self.CLIP)])

    def evidence(self, units: list[list[str]]) -> np.ndarray:
        """The mean weight of each unit's words in each state; units without words have none."""
        out = np.zeros((len(units), len(STATES)))
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        some = np.flatnonzero(sizes)
        if len(some):
            words = np.fromiter(map(self.ids.get, chain.from_iterable(units), repeat(0)), np.int64, int(sizes.sum()))
            starts = (np.cumsum(sizes) - sizes)[some]
            out[some] = np.add.reduceat(self.weight[words], starts) / sizes[some, None]
        return out

    def emissions(self, page: list) -> list[list[float]]:
        """The log-probability of every unit in each state."""
        units = [w if f is not None else [] for _, w, f in page]
        out = []
        for _, _, f in page:
            e = self.CODE if f is None else self.known.get(f)
            if e is None:
                e = self.known[f] = tuple(float(sum(t[s, v] for t, v in zip(self.shapes, f))) for s in range(len(STATES)))
            out.append(e)
        # words of one unit depend on each other, so many count less than as often as they are
        n = np.fromiter(map(len, units), np.int64, len(units)) ** self.power
        return (np.array(out) + self.evidence(units) * n[:, None]).tolist()

    def label(self, page: list, hints: list | None = None) -> list[int]:
        """Viterbi; hints, in training, raise the states they name."""
        if not page:
            return []
        t, back = self.trans.T.tolist(), []
        seen = self.emissions(page)
        if hints:
            seen = [tuple(x + self.HINT * (k == h) for k, x in enumerate(e)) for e, h in zip(seen, hints)]
        a, b, c, d = seen[0]
        for e in seen[1:]:
            now, ptr = [], []
            for s in range(len(STATES)):
                p, q, r, u = t[s]
                best, k = a + p, 0
                if b + q > best:
                    best, k = b + q, 1
                if c + r > best:
                    best, k = c + r, 2
                if d + u > best:
                    best, k = d + u, 3
                now.append(best + e[s])
                ptr.append(k)
            a, b, c, d = now
            back.append(ptr)
        last = (a, b, c, d)
        s = last.index(max(last))
        out = [s]
        for ptr in reversed(back):
            s = ptr[s]
            out.append(s)
        return out[::-1]

    def shares(self, text: str) -> list[float]:
        """The share of the page's characters in each state."""
        page = features(text)
        total = sum(n for n, _, _ in page)
        out = [0.0] * len(STATES)
        if total:
            for (n, _, _), s in zip(page, self.label(page)):
                out[s] += n / total
        return out


def fit(df: DataFrame, key: str = "doc_id", text: str = "text", pages: int = SAMPLE_PAGES) -> Model:
    """The model of at most `pages` pages of `df`."""
    return Model([features(t) for t in sample_texts(df, key, text, pages)])


def page_shares(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`df` with the columns prose, links, tags, menu (shares of characters) and spam (more than half not prose)."""
    b: Broadcast = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("prose double, links double, tags double, menu double")
    def measure(s: pd.Series) -> pd.DataFrame:
        m = b.value
        return pd.DataFrame([m.shares(t) if t else [0.0] * 4 for t in s], columns=["prose", "links", "tags", "menu"])

    names = ("prose", "links", "tags", "menu")
    rest = [c for c in df.columns if c not in (*names, "spam")]
    out = df.select(*rest, measure(F.col(text)).alias("_s")).select(*rest, *[F.col(f"_s.{c}").alias(c) for c in names])
    return out.withColumn("spam", F.col("links") + F.col("tags") + F.col("menu") > 0.5)
