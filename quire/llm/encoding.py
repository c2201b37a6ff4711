"""Text garbled by a wrong character encoding: find it, and restore the original.

A hidden Markov model labels the characters of every stretch of a text that isn't plain ASCII. Its states:

* clean text;
* a pair (encoding the bytes were written in, encoding they were read in), which emits a character
  through the pair's inverse transform, so the probability of a garbled stretch is that of the text
  the transform restores, under one character model counted on all clean text. A "?" may stand for one
  byte that an earlier reader had no character for;
* a double pair: text of a pair, written as UTF-8 and read wrongly again;
* loss, which emits U+FFFD and has no inverse.

Viterbi finds the best labelling of a whole stretch, however long, and each labelled span gets its
state's inverse transform. States more than BEAM behind the best are dropped; what all remaining
paths share is put out as the search goes on, so memory follows the open part of a stretch.

Character references to characters outside ASCII count as those characters: `&#195;&#169;` is garbled,
`&eacute;` is not. ASCII characters read the same in all pairs, so stretches without others need no search.
A restored text is labelled again until nothing is found; every restoration raises its score.
"""

from __future__ import annotations

import codecs
import html
import re
from collections import Counter, OrderedDict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.charlm import WEIGHT, CharModel, count_texts

# Pairs of (written in, read in); the rare ones need more evidence.
PAIRS = [
    ("utf-8", "cp1252"), ("utf-8", "iso-8859-1"), ("utf-8", "iso-8859-15"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("utf-8", "cp1254"),
    ("utf-8", "koi8-r"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp850"), ("utf-8", "cp866"), ("utf-8", "gb18030"),
    ("gb18030", "cp1252"), ("gb18030", "iso-8859-1"), ("gb18030", "iso-8859-15"), ("gb18030", "cp1251"),
    ("euc_jp", "cp1252"), ("euc_jp", "iso-8859-1"), ("euc_jp", "cp1251"), ("shift_jis", "cp1252"), ("shift_jis", "iso-8859-1"), ("shift_jis", "cp1251"),
    ("cp1251", "cp1252"), ("cp1251", "iso-8859-1"), ("cp1251", "koi8-r"), ("koi8-r", "cp1252"), ("koi8-r", "iso-8859-1"), ("koi8-r", "cp1251"),
    ("cp1252", "iso-8859-1"), ("cp1252", "cp1251"), ("cp1252", "gb18030"),
]
RARE_PAIRS = [
    ("utf-8", "shift_jis"), ("utf-8", "euc_jp"), ("utf-8", "big5"), ("utf-8", "cp949"), ("gb18030", "koi8-r"), ("gb18030", "big5"), ("gb18030", "shift_jis"), ("gb18030", "euc_jp"),
    ("euc_jp", "iso-8859-15"), ("euc_jp", "gb18030"), ("euc_jp", "shift_jis"), ("shift_jis", "iso-8859-15"), ("shift_jis", "gb18030"), ("shift_jis", "euc_jp"),
    ("cp1251", "iso-8859-15"), ("cp1251", "gb18030"), ("cp1251", "cp866"), ("cp1251", "mac_cyrillic"), ("koi8-r", "iso-8859-15"), ("koi8-r", "gb18030"),
    ("cp866", "cp1251"), ("iso-8859-5", "cp1251"), ("mac_cyrillic", "cp1251"), ("cp1252", "iso-8859-15"), ("iso-8859-15", "cp1252"), ("cp1252", "cp1250"), ("cp1250", "cp1252"),
    ("cp1252", "koi8-r"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"),
]
#: Log-probabilities of entering a pair's state (of a rare pair, of two-byte writings read as single bytes, of a double pair), and of leaving.
ENTER, RARE, WIDE, DOUBLE, LEAVE = -9.0, -18.0, -14.0, -18.0, -3.0
#: Log-probabilities of a lost byte, and of "?" standing for one.
LOSS, HOLE = -12.0, -3.0
#: What it costs to take a byte for lost that the reader has a character for.
HELD = -4.0
#: What a change of state costs between two letters outside ASCII, as encodings seldom change inside a word,
#: and what a restored Cyrillic letter costs beside a Latin one.
JOIN = -6.0
#: The price of entering for a pair that has garbled a text in at least SEVERAL places already, or that its bytes speak for.
AGAIN, SEVERAL = -2.0, 3
#: What entering a pair costs where another was left with nothing in between.
SWITCH = -20.0
#: States this far behind the best, in natural logarithms, are dropped; LAG counts once a state has said what it makes of a
#: character that clean text has said its own of.
BEAM, LAG = 30.0, 22.0
#: Characters after which the part all paths share is put out.
SETTLE = 4096
#: The longest stretch whose labelling is kept for its next occurrence.
REMEMBER = 40
#: Encodings tried on bytes that their label doesn't explain.
READINGS = ["utf-8", "gb18030", "cp1251", "koi8-r", "euc_jp", "shift_jis", "cp1252"]
_RUN = re.compile(r"[^\x00-\x7f]+(?:[\x21-\x7e]{1,2}[^\x00-\x7f]+)*\??")
_REFERENCE = re.compile(r"&(?:#[0-9]{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z][A-Za-z0-9]{1,31});")
#: Texts that needn't be searched at all: ASCII without references.
SEARCHED = r"[^\x00-\x7f]|&#?[A-Za-z0-9]+;"


def unreferenced(text: str) -> tuple[str, list[int] | None]:
    """The text with references to characters outside ASCII as those characters, and where each character begins in `text` (None: at its own place)."""
    if "&" not in text:
        return text, None
    out, at, last = [], [], 0
    for m in _REFERENCE.finditer(text):
        c = html.unescape(m.group())
        if len(c) != 1 or c < "\x80":
            continue
        a = m.start()
        out.append(text[last:a])
        at.extend(range(last, a))
        out.append(c)
        at.append(a)
        last = m.end()
    if not last:
        return text, None
    out.append(text[last:])
    at.extend(range(last, len(text) + 1))
    return "".join(out), at


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([^\s\"';,]+)", re.I)


def evidence(text: str, content: bytes | None, content_type: str | None) -> frozenset[str]:
    """The pairs that the bytes speak for: they are UTF-8 beyond ASCII, but the text isn't what they say.

    The reader is the one that the type names; without a known one the pairs of all readers count.
    """
    if content is None or text.isascii():
        return frozenset()
    try:
        meant = content.decode("utf-8")
    except UnicodeDecodeError:
        return frozenset()
    if meant == text or meant.isascii():
        return frozenset()
    m = _CHARSET.search(content_type or "")
    names = {r for w, r in PAIRS + RARE_PAIRS if w == "utf-8"}
    try:
        told = codecs.lookup(m.group(1)).name if m else ""
    except LookupError:
        told = ""
    alike = {r for r in names if codecs.lookup(r).name == told or told == "iso8859-1" and r in ("cp1252", "iso-8859-1")}
    return frozenset(f"utf-8>{r}" for r in alike or names)


class Codec:
    """Characters to the bytes a reading came from, and bytes to the characters of a writing."""

    def __init__(self, name: str):
        self.name = name
        self.single = self._table()
        self.back = {c: bytes([b]) for b, c in enumerate(self.single)} if self.single else None
        self.memo: dict = {}
        # no author's text has controls, or frames and hard blanks inside words
        self.firsts = [None if "\x7f" <= c <= "\xa0" or "\u2500" <= c <= "\u25a0" else (c, 1) for c in self.single] if self.single else None

    def _table(self) -> list[str] | None:
        if self.name in ("utf-8", "gb18030", "shift_jis", "euc_jp", "big5", "cp949"):
            return None
        out = []
        for b in range(256):
            try:
                out.append(bytes([b]).decode(self.name))
            except UnicodeDecodeError:
                out.append(chr(b))  # readers pass undefined bytes through
        return out

    def to_bytes(self, c: str) -> bytes | None:
        if self.back is not None:
            return self.back.get(c)
        b = self.memo.get(c, 0)
        if b == 0:
            try:
                b = c.encode(self.name)
            except UnicodeEncodeError:
                b = None
            if len(self.memo) < 100_000:
                self.memo[c] = b
        return b

    def first(self, b: bytes, at: int) -> tuple[str, int] | None:
        """The character that begins at b[at:], with its length in bytes."""
        if self.firsts:
            return self.firsts[b[at]]
        lead = b[at]
        if lead < 0x80:
            return chr(lead), 1
        if self.name == "utf-8":
            n = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            sizes = (n,) if n else ()
        else:
            sizes = (2, 1) if self.name == "shift_jis" else (2, 3) if self.name == "euc_jp" else (2,)
        for n in sizes:
            piece = b[at : at + n]
            if len(piece) < n:
                continue
            key = piece
            c = self.memo.get(key, 0)
            if c == 0:
                try:
                    c = piece.decode(self.name)
                    c = c if len(c) == 1 else None
                except UnicodeDecodeError:
                    c = None
                if len(self.memo) < 100_000:
                    self.memo[key] = c
            if c is not None:
                return c, n
        return None


class Twice:
    """UTF-8 bytes of a text that was itself written in `writer` and read as `reader`."""

    single = firsts = None

    def __init__(self, utf8: Codec, writer: Codec, reader: Codec):
        self.utf8, self.writer, self.reader = utf8, writer, reader

    def first(self, b: bytes, at: int) -> tuple[str, int] | None:
        raw, end = b"", at
        while end < len(b) and len(raw) < 4:
            got = self.utf8.first(b, end)
            back = None if got is None else self.reader.to_bytes(got[0])
            if back is None:
                return None
            raw, end = raw + back, end + got[1]
            inner = self.writer.first(raw, 0)
            if inner is not None and inner[1] == len(raw):
                return inner[0], end - at
            if self.writer.single is not None:
                return None
        return None


class Node:
    """A step of a path: score, last character of the text it restores, the step before, what it does and with what."""

    __slots__ = ("score", "last", "before", "kind", "what")

    def __init__(self, score: float, last: str, before: Node | None, kind: int, what: object):
        self.score, self.last, self.before, self.kind, self.what = score, last, before, kind, what


CLEAN, LOST, IN, STEP, OUT = range(5)


class Written:
    """The text and the pairs of a settled path, put out piece by piece."""

    def __init__(self, run: str):
        self.run = run
        self.out: list[str] = []
        self.used: list[str] = []
        self.span: list[str] = []
        self.start = 0

    def take(self, node: Node) -> None:
        """Everything up to `node`, which becomes the begin of the path."""
        path = []
        at: Node | None = node
        while at is not None and at.kind is not None:
            path.append(at)
            at = at.before
        for p in reversed(path):
            if p.kind == CLEAN:
                self.out.append(p.what)
            elif p.kind == LOST:
                self.out.append("\ufffd")
                self.used.append("loss")
            elif p.kind == IN:
                self.span, self.start = [], p.what
            elif p.kind == STEP:
                self.span.append(p.what)
            else:
                names, end = p.what
                text = "".join(self.span)
                self.out.append(text)
                if text != self.run[self.start : end]:
                    self.used.extend(names)
        node.before = None
        node.kind = None


class Labeller:
    """The hidden Markov model over one character model; keeps what it found for repeated stretches."""

    CACHE = 200_000

    def __init__(self, model: CharModel):
        self.model = model
        codecs_ = {n: Codec(n) for p in PAIRS + RARE_PAIRS for n in p}
        self.utf8 = codecs_["utf-8"]
        # states by reader: [(writer, names of the pairs to undo, price)], those that begin with UTF-8 apart
        self.readers: dict[str, tuple[Codec, list, list]] = {}
        for pairs, cost in ((PAIRS, ENTER), (RARE_PAIRS, RARE)):
            for w, r in pairs:
                price = WIDE if cost == ENTER and w in ("gb18030", "euc_jp", "shift_jis") else cost
                self.readers.setdefault(r, (codecs_[r], [], []))[1 if w == "utf-8" else 2].append((codecs_[w], (f"{w}>{r}",), price))
        for outer in [r for w, r in PAIRS if w == "utf-8"]:
            for w, r in PAIRS:
                price = DOUBLE + (WIDE - ENTER if w in ("gb18030", "euc_jp", "shift_jis") else 0.0)
                self.readers[outer][1].append((Twice(self.utf8, codecs_[w], codecs_[r]), (f"utf-8>{outer}", f"{w}>{r}"), price))
        self.cache: OrderedDict = OrderedDict()
        #: What the text at hand's stretches were found to be.
        self.told: dict = {}
        han = "".join(re.escape(c) for c in sorted({c for c, n in model.uni.items() if n >= 2 and ("\u3000" <= c <= "\u9fff" or "\uff01" <= c <= "\uff60")})) or "\x00"
        self.plain_cjk = re.compile(f"[{han}]{{2,}}")
        #: Known ideographs and kana in a row are clean; the rest of a stretch is searched apart from them.
        self.sure = re.compile(f"([{han}]{{8,}})")

    def stretch(self, prev: str, run: str, nxt: str, favoured: frozenset[str] = frozenset()) -> tuple[str, tuple[str, ...]] | None:
        """(restored, pairs used) of one stretch, or None where it is clean."""
        # what favoured pairs explain already, they explain as well at a lower price
        told = self.told.get((prev, run, nxt))
        if told and favoured.issuperset(told[1]):
            return told
        if len(run) > REMEMBER:
            out = self.told[prev, run, nxt] = self._viterbi(prev, run, nxt, favoured)
            return out
        key = (prev, run, nxt, favoured)
        if key in self.cache:
            out = self.told[prev, run, nxt] = self.cache[key]
            return out
        out = self.told[prev, run, nxt] = self._viterbi(prev, run, nxt, favoured)
        if len(self.cache) >= self.CACHE:
            self.cache.popitem(last=False)
        self.cache[key] = out
        return out

    def _filled(self, reader: Codec, b: bytes, at: int, prev: str) -> tuple[str, int] | None:
        """A UTF-8 character at b[at:] one of whose later bytes a "?" stands for: the likeliest behind `prev`, bytes that `reader` has no character for before others."""
        lead = b[at]
        n = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 0
        piece = b[at : at + n]
        if not n or len(piece) < n or piece[1:].count(b"?") != 1:
            return None
        hole = piece.index(b"?")
        best = None
        for x in range(0x80, 0xC0):
            try:
                u = (piece[:hole] + bytes([x]) + piece[hole + 1 :]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            v = self.model.logp(prev, u) + (0.0 if reader.single[x] == chr(x) else HELD)
            if best is None or v > best[0]:
                best = (v, u)
        return best and (best[1], n)

    def _viterbi(self, prev: str, run: str, nxt: str, favoured: frozenset[str]) -> tuple[str, tuple[str, ...]] | None:
        logp, n, utf8 = self.model.logp, len(run), self.utf8
        letter = [c > "\x7f" and c.isalpha() for c in run]
        groups = []
        for r, eights, others in self.readers.values():
            parts = [r.to_bytes(c) for c in run]
            gaps = {i for i, p in enumerate(parts) if p is None}
            if len(gaps) == n:
                continue
            offs, o = [0], 0
            for p in parts:
                o += len(p) if p is not None else 1
                offs.append(o)
            whole = b"".join(p if p is not None else b"\x00" for p in parts)
            groups.append((whole, offs, gaps, {x: i for i, x in enumerate(offs)}, eights, others, r if r.single is not None and b"?" in whole else None, {}))
        written = Written(run)
        clean = {0: Node(0.0, prev, None, None, None)}
        for i in range(n):
            here, c = clean.pop(i), run[i]
            best = here.score
            for g in groups:
                start = g[1][i]
                for f in g[7].values():
                    node = f.get(start)
                    if node is not None and node.score > best:
                        best = node.score
            least = best - BEAM
            s = here.score + logp(here.last, c)
            node = Node(here.score + LOSS, " ", here, LOST, None) if c == "\ufffd" and here.score + LOSS > s else Node(s, c, here, CLEAN, c)
            old = clean.get(i + 1)
            if old is None or node.score > old.score:
                clean[i + 1] = node
            after_this = clean[i + 1].score - LAG
            base = here.score + (JOIN if i and letter[i - 1] and letter[i] else 0.0) + (SWITCH if here.kind == OUT else 0.0)
            opens = base + (AGAIN if favoured else ENTER) >= least
            for whole, offs, gaps, at, eights, others, holed, live in groups:
                if i in gaps:
                    live.clear()
                    continue
                start, stop = offs[i], offs[i + 1]
                if opens:
                    some = utf8.first(whole, start) if eights else None
                    for state in (*eights, *others) if some else (*eights[:1], *others) if holed and eights else others:
                        enter = base + (AGAIN if favoured and favoured.issuperset(state[1]) else state[2])
                        if enter < least:
                            continue
                        # most writings have nothing to say from here on, or nothing likely
                        got = state[0].first(whole, start)
                        if got is None:
                            if not (holed and state[0] is utf8):
                                continue
                        elif start + got[1] == stop and len(got[0]) == 1 and (got[0] == c or enter + logp(here.last, got[0]) < after_this):
                            continue  # what reads the same can as well be clean
                        f = live.get(state)
                        if f is None:
                            live[state] = {start: Node(enter, here.last, here, IN, i)}
                        else:
                            old = f.get(start)
                            if old is None or enter > old.score:
                                f[start] = Node(enter, here.last, here, IN, i)
                if not live:
                    continue
                for state in list(live):
                    w, names, _ = state
                    f = live[state]
                    for o in range(start, stop):
                        cur = f.pop(o, None)
                        if cur is None or cur.score < least:
                            continue
                        got, t = w.first(whole, o), cur.score
                        if got is None:
                            got = self._filled(holed, whole, o, cur.last) if holed and w is utf8 else None
                            if got is None:
                                continue
                            t += HOLE
                        u, m = got
                        t += logp(cur.last, u) if len(u) == 1 else self.model.score(u, cur.last)
                        mixed = w.single is not None and "\u0400" <= u <= "\u04ff"
                        if mixed and cur.last.isascii() and cur.last.isalpha():
                            t += JOIN
                        e = o + m
                        # a lower score than that can't come within the beam where this character ends
                        if e == stop and t < after_this:
                            continue
                        if gaps and any(j in gaps for j in range(i, min(n, i + m)) if offs[j] < e):
                            continue
                        node = Node(t, u[-1], cur, STEP, u)
                        old = f.get(e)
                        if old is None or t > old.score:
                            f[e] = node
                        j = at.get(e)
                        if j is not None:
                            v = t + LEAVE + (JOIN if j < n and letter[j] and letter[j - 1] else 0.0)
                            after = run[j] if j < n else nxt
                            if mixed and after.isascii() and after.isalpha():
                                v += JOIN
                            old = clean.get(j)
                            if old is None or v > old.score:
                                clean[j] = Node(v, u[-1], node, OUT, (names, j))
                    if not f:
                        del live[state]
            if i % SETTLE == SETTLE - 1:
                self._settle(written, [*clean.values(), *(x for g in groups for f in g[7].values() for x in f.values())])
        written.take(clean[n])
        if not written.used:
            return None
        return "".join(written.out), tuple(written.used)

    @staticmethod
    def _settle(written: Written, live: list[Node]) -> None:
        """Put out the part that the paths to all `live` nodes share."""
        order: dict[int, int] = {}
        trunk = []
        at: Node | None = live[0]
        while at is not None:
            order[id(at)] = len(trunk)
            trunk.append(at)
            at = at.before
        deepest = 0
        for node in live[1:]:
            at = node
            while id(at) not in order:
                at = at.before
            deepest = max(deepest, order[id(at)])
        if trunk[deepest].kind is not None:
            written.take(trunk[deepest])

    def garbled(self, text: str, favoured: frozenset[str] = frozenset()) -> bool:
        """Whether any character belongs to another state than clean."""
        self.told = {}
        return bool(self.once(text, favoured, first=True)[1])

    def once(self, text: str, favoured: frozenset[str] = frozenset(), first: bool = False) -> tuple[str, list[str]]:
        """One labelling: (restored text, pairs used). first: stop at the first garbled stretch."""
        shown, at = unreferenced(text)
        out, used, last = [], [], 0
        for m in _RUN.finditer(shown):
            run, a = m.group(), m.start()
            prev = shown[a - 1] if a else " "
            z = m.end()
            nxt = shown[z] if z < len(shown) else " "
            if self.plain_cjk.fullmatch(run) and not (prev.isalpha() and prev.isascii()):
                continue
            parts = self.sure.split(run)
            for k, p in enumerate(parts):
                if not p:
                    continue
                got = None if k % 2 else self.stretch(prev, p, nxt if k == len(parts) - 1 else parts[k + 1][0], favoured)
                if got:
                    if first:
                        return text, list(got[1])
                    begin, end = (a, a + len(p)) if at is None else (at[a], at[a + len(p)])
                    out.append(text[last:begin])
                    out.append(got[0])
                    used.extend(got[1])
                    last = end
                prev, a = p[-1], a + len(p)
        if not used:
            return text, used
        out.append(text[last:])
        return "".join(out), used

    def repair(self, text: str, favoured: frozenset[str] = frozenset()) -> tuple[str, list[str]]:
        """(restored text, pairs used), labelled until no pair is found; each time the score rises, so this ends."""
        used: list[str] = []
        while True:
            self.told = {}
            fixed, u = self.once(text, favoured)
            often = frozenset(p for p, n in Counter(u).items() if n >= SEVERAL and p != "loss") - favoured
            if often:
                fixed, u = self.once(text, favoured | often)
            used += u
            if not set(u) - {"loss"} or fixed == text:
                return fixed, used
            # what spoke for a pair in the garbled text says nothing of the restored one
            text, favoured = fixed, frozenset()

    def read(self, content: bytes, text: str, used: list[str]) -> str:
        """The best reading of the bytes, where they hold more than `text`; every character outside ASCII of the whole page has a say."""
        if not used or content is None:
            return text
        best, score = text, None
        for name in READINGS:
            try:
                t = content.decode(name)
            except UnicodeDecodeError:
                continue
            if name == "utf-8":
                return t
            body = Counter((m.group(), t[m.start() - 1] if m.start() else " ") for m in re.finditer(r"[^\x00-\x7f]+", t))
            n = sum(len(x) * k for (x, _), k in body.items())
            if not n:
                continue  # nothing to judge by
            s = sum(self.model.score(x, p) * k for (x, p), k in body.items()) / n
            if score is None or s > score:
                best, score = t, s
        return best


_worker: dict[str, Labeller] = {}


def labeller(model: CharModel) -> Labeller:
    """The labeller of a model, kept by the worker."""
    if model.mark not in _worker:
        _worker.clear()
        _worker[model.mark] = Labeller(model)
    return _worker[model.mark]


def fit(clean: DataFrame, key: str, text: str) -> CharModel:
    """The character model of all rows (key, text) of clean text."""
    return count_texts(clean.select(key, text), text, weight=WEIGHT)


def _or_null(df: DataFrame, name: str | None, kind: str) -> F.Column:
    return F.col(name).cast(kind) if name else F.lit(None).cast(kind)


def find_garbled(df: DataFrame, model: CharModel, text: str = "text", content: str | None = None, content_type: str | None = None) -> DataFrame:
    """The rows of `df` whose text the model labels as garbled, with the same columns.

    NULL and empty texts aren't garbled. `content` and `content_type`, where they are named, are evidence.
    """
    b = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def garbled(s: pd.Series, raw: pd.Series, kind: pd.Series) -> pd.Series:
        lab = labeller(b.value)
        return pd.Series([bool(t) and lab.garbled(t, evidence(t, r, k)) for t, r, k in zip(s, raw, kind)], dtype=bool)

    # other texts are clean in every pair and needn't leave the JVM
    return df.where(F.col(text).rlike(SEARCHED)).where(garbled(F.col(text), _or_null(df, content, "binary"), _or_null(df, content_type, "string")))


def repair(df: DataFrame, model: CharModel, text: str = "text", content: str | None = "content", content_type: str | None = None, out: str = "restored", pairs: str = "pairs") -> DataFrame:
    """`df` with the restored text and the distinct pairs whose transforms were undone.

    Clean texts come back as they are with no pairs; NULL stays NULL. Where the bytes hold more
    than the text (lost bytes, or a wrong label), they are read again before the labelling.
    `content` may be None if there are no bytes. Existing columns named `out` or `pairs` are replaced.
    """
    b = df.sparkSession.sparkContext.broadcast(model)
    searched = re.compile(SEARCHED)

    def one(lab: Labeller, t: str | None, raw: bytes | None, kind: str | None) -> tuple[str | None, list[str]]:
        if not t or not searched.search(t):
            return t, []
        raw = None if raw is None else bytes(raw)
        fixed, used = lab.repair(t, evidence(t, raw, kind))
        if used and raw is not None:
            again = lab.read(raw, fixed, used)
            if again not in (fixed, t):
                fixed, more = lab.repair(again)
                used = used + more
        return fixed, sorted(set(used))

    @F.pandas_udf("restored string, pairs array<string>")
    def fix(s: pd.Series, raw: pd.Series, kind: pd.Series) -> pd.DataFrame:
        lab = labeller(b.value)
        return pd.DataFrame([one(lab, *row) for row in zip(s, raw, kind)], columns=["restored", "pairs"])

    got = fix(F.col(text), _or_null(df, content, "binary"), _or_null(df, content_type, "string"))
    rest = [c for c in df.columns if c not in (out, pairs)]
    return df.select(*rest, got.alias("_fix")).select(*rest, F.col("_fix.restored").alias(out), F.col("_fix.pairs").alias(pairs))
