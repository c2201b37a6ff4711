"""Character n-gram statistics of text, counted over all rows, and bounded samples of texts."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bound of a sample: rows, chosen by a hash of their key.
SAMPLE_ROWS = 1500
#: What all text counted by `count_texts` weighs at most beside the seed and the prior, in characters.
WEIGHT = 2_000_000
#: Characters counted together.
TOGETHER = 1_000_000

# Sentences that keep a model usable when the sample is empty or lacks a language.
SEED = """The quick reader opens the old letter, and the café keeps its façade. It’s “quite” ‘the’ ‘a’ ‘tidy’ naïve – a résumé for 5 €.
Die Wörter hören über den großen Fluß auf; schöne Grüße aus Köln, Mädchen und Bücher für alle. Straße, Größe, Übung, Ärger, Öl.
Les élèves préfèrent l'été à la forêt où le cœur garde l'œuvre française : « très âgé », déjà, naïve, hôtel, île, ça, dû, août, Noël. À bientôt, Été, Ève.
Los niños y las niñas también leen aquí: ¿dónde está el corazón? ¡Mañana será otro día! último, árbol, ésta, Índice, Ábaco, Úrsula, pingüino.
A educação e a atenção não são só lições; também há avós, pão, três mães, corações, à mão, você. PROMOÇÃO, INFORMAÇÕES.
Старый дом стоит у реки, и читатель открывает письмо. Всё же объявление ещё не готово; поэтому эта глава молчит. Школа, юг, Яна, цена № 5.
安静的读者打开了旧信。我们在图书馆里写下第一个故事，然后关上门！你好，世界？“是的”，他说：这里有《书》、纸和墨水。
古い手紙を読みました。図書館の人は「はい」と言い、静かな町を歩いています。カタカナの言葉、メール、ページ、データもあります。
"""
BLANKS, DIGITS = " \t\n\r", "0123456789"
_SPACE = re.compile(r"[ \t\r\n]+")
_DIGIT = re.compile(r"[0-9]")


def _cjk(c: str) -> bool:
    return "\u3040" <= c <= "\u30ff" or "\u4e00" <= c <= "\u9fff"


class CharModel:
    """P(c | previous c), backing off to P(c), in natural logarithms."""

    K = 6.0
    FLOOR, HAN = 2e-8, 1e-6

    def __init__(self, texts: list[str], seed: str = SEED):
        self.uni: Counter = Counter()
        self.bi: Counter = Counter()
        for t in [seed, *texts]:
            self.add(t)
        self.total = sum(self.uni.values())
        self._memo: dict[str, float] = {}
        self.mark = uuid.uuid4().hex  # names the model to the caches of workers, which outlive broadcasts

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_memo": {}}

    def add(self, text: str) -> None:
        t = _DIGIT.sub("0", _SPACE.sub(" ", text))
        self.uni.update(t)
        self.bi.update(map("".join, zip(t, t[1:])))

    def add_all(self, texts: list[str]) -> None:
        """What `add` does to each of `texts`, counted in arrays."""
        a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(a):
            return
        first = np.zeros(len(a) + 1, bool)
        first[np.cumsum([0, *map(len, texts)])] = True
        first = first[:-1]
        blank = (a == 32) | (a == 9) | (a == 10) | (a == 13)
        keep = first | ~blank
        keep[1:] |= ~blank[:-1]
        a = np.where(blank, 32, np.where((a >= 48) & (a <= 57), 48, a))[keep]
        first = first[keep]
        n = np.bincount(a)
        for c in np.flatnonzero(n).tolist():
            self.uni[chr(c)] += int(n[c])
        pairs, n = np.unique((a[:-1].astype(np.uint64) << np.uint64(21) | a[1:])[~first[1:]], return_counts=True)
        for c, k in zip(pairs.tolist(), n.tolist()):
            self.bi[chr(c >> 21) + chr(c & 0x1FFFFF)] += k

    def prior(self, c: str) -> float:
        n = self.uni.get(c, 0)
        if n >= 1:
            return n / self.total
        # weighed counts may be below one: what was seen is no less likely than what wasn't
        return max(n / self.total, self._unseen(c)) if n else self._unseen(c)

    def _unseen(self, c: str) -> float:
        if "\x80" <= c <= "\x9f" or c == "\ufffd" or "\ue000" <= c <= "\uf8ff":
            return self.FLOOR * 1e-3
        if "\u4e00" <= c <= "\u9fff":
            return self.HAN
        if "\uff01" <= c <= "\uff9f":
            return self.HAN
        low = c.lower()
        if low != c and self.uni.get(low):
            return max(self.FLOOR, 0.02 * self.uni[low] / self.total)
        return self.FLOOR

    def logp(self, prev: str, c: str) -> float:
        """log P(c | prev); digits and blanks count as one class each."""
        key = prev + c
        v = self._memo.get(key)
        if v is None:
            p = "0" if prev in DIGITS else " " if prev in BLANKS else prev
            d = "0" if c in DIGITS else " " if c in BLANKS else c
            n = self.bi.get(p + d, 0)
            if n < 1 and p.isupper() and d.isupper():
                n = max(n, 0.1 * self.bi.get(p.lower() + d.lower(), 0))
            k = self.K
            if n < 1 and (_cjk(p) and d.isascii() and d.isalpha() or _cjk(d) and p.isascii() and p.isalpha()):
                k = self.K * 0.02
            if len(self._memo) > 500_000:
                self._memo.clear()
            v = self._memo[key] = math.log((n + k * self.prior(d)) / (self.uni.get(p, 0) + self.K))
        return v

    def score(self, text: str, prev: str = " ") -> float:
        s = 0.0
        for c in text:
            s += self.logp(prev, c)
            prev = c
        return s


def count_texts(df: DataFrame, text: str, prepare: Callable[[str], str] | None = None, weight: float | None = None) -> CharModel:
    """The model of all texts of `df`, each as `prepare` gives it.

    With `weight`, counts of more characters than that are multiplied by one factor, so that they weigh as many together:
    all rates are those of all texts, but seed and prior, which stand for text of other kinds, keep their say at any size.
    Every task counts its rows first, so what is shuffled and sent to the driver is bounded by the
    distinct pairs of characters, not by the rows.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = CharModel([], seed="")
        some, chars = [], 0
        for b in batches:
            for t in b["t"]:
                some.append(prepare(t) if prepare else t)
                chars += len(some[-1])
                if chars >= TOGETHER:
                    m.add_all(some)
                    some, chars = [], 0
        m.add_all(some)
        for grams in (m.uni, m.bi):
            yield pd.DataFrame({"gram": list(grams.keys()), "n": list(grams.values())}).astype({"gram": object, "n": "int64"})

    texts = df.select(F.col(text).alias("t")).where(F.length("t") > 0)
    got = texts.mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    model = CharModel([])
    grams, counts = got["gram"].to_pylist(), got["n"].to_pylist()
    seen = sum(n for g, n in zip(grams, counts) if len(g) == 1)
    share = 1 if weight is None or seen <= weight else weight / seen
    for g, n in zip(grams, counts):
        (model.uni if len(g) == 1 else model.bi)[g] += n * share
    model.total = sum(model.uni.values())
    return model


def sample_texts(df: DataFrame, key: str, text: str, rows: int = SAMPLE_ROWS) -> list[str]:
    """At most `rows` non-empty texts, those with the smallest hashes of their key.

    A threshold on the hash, from a count of the rows, leaves about twice as many to be ordered,
    so the driver receives a bounded number at any size.
    """
    n = df.select(key).count()
    h = F.xxhash64(key)
    share = min(1.0, 2.0 * rows / max(n, 1))
    limit = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    s = df.where(h <= F.lit(limit)).select(h.alias("h"), F.col(text).alias("t")).where(F.length("t") > 0)
    return [r.t for r in s.orderBy("h", "t").limit(rows).collect()]
