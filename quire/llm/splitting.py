"""Splitting oversized texts at natural boundaries.

Every position of a text gets a boundary strength, from a paragraph's end down to a place inside a
word; places inside a protected token or a written character get none. A sparse table over the
strengths answers range-maximum queries, rightmost first: each piece ends at the strongest boundary
of its permissible window of lengths, and the next piece starts at the strongest boundary about
`overlap` characters before that end. Pieces are substrings, so the text can be put together again
from their offsets. Lengths are code points.

The table covers one stretch of a text at a time, so memory is bounded by the limits, not the text.

Nulls: a NULL text gives one piece with NULL text and 0 characters; an empty text one empty piece.
A row whose profile has no limits (NULL max_chars) stays whole. Rows with a NULL key are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import slices, small

# Strengths of boundaries.
NONE, INSIDE, CHARACTER, BLANK, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(8)
#: Boundaries of this strength and above count as natural.
NATURAL = BLANK

_W = r"぀-ヿ㐀-鿿豈-﫿가-힯＀-｠"
_SENTENCE = re.compile(rf"[.!?…]+[\"'”’»)\]*_]*\s+|[。！？]+[”’」』）》]*\s*|[.!?…]+[\"'”’»)\]*_]*(?=[{_W}])")
_CLAUSE = re.compile(rf"[,;:)\]—–]+[\"”’»]*\s+|[，；：、）」』》]+\s*|[,;:](?=[{_W}])")
_BLANK = re.compile(r"\s+")
_NEWLINE = re.compile(r"[^\S\n]*\n")
_EMPTY = re.compile(r"\n(?:[^\S\n]*\n)+")
_HEADING = re.compile(r"^#{1,6} ", re.M)
_FENCE = re.compile(r"^[ \t]*(```|~~~).*$", re.M)
_TOKEN = re.compile(r"⟦[^⟧\n]{0,20}⟧")
_JOINED = re.compile("[̀-ͯ҃-҉֑-ֽً-ٟऀ-ःऺ-ॏัิ-ฺ็-๎᪰-᫿᷀-᷿⃐-⃿‍︀-️゙゚︠-︯\U0001f3fb-\U0001f3ff\U000e0100-\U000e01ef]")
_FLAGS = re.compile("[\U0001f1e6-\U0001f1ff]{2}")


def strengths(text: str) -> np.ndarray:
    """The strength of a cut before each character, and at the end."""
    n = len(text)
    s = np.full(n + 1, INSIDE, dtype=np.int8)
    if not text.isascii():
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        wide = ((cp >= 0x3040) & (cp <= 0x30FF)) | ((cp >= 0x3400) & (cp <= 0x9FFF)) | ((cp >= 0xF900) & (cp <= 0xFAFF)) | ((cp >= 0xAC00) & (cp <= 0xD7AF)) | ((cp >= 0xFF00) & (cp <= 0xFF60)) | ((cp >= 0x20000) & (cp <= 0x3FFFF))
        s[1:n][wide[:-1] | wide[1:]] = CHARACTER

    def mark(pattern: re.Pattern, value: int) -> None:
        at = [m.end() for m in pattern.finditer(text)]
        s[at] = np.maximum(s[at], value)

    mark(_BLANK, BLANK)
    mark(_CLAUSE, CLAUSE)
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    # a lower-case letter after a full stop continues the sentence
    ends = [e for e in ends if e >= n or not text[e].islower()]
    s[ends] = np.maximum(s[ends], SENTENCE)
    mark(_NEWLINE, LINE)
    mark(_EMPTY, PARAGRAPH)
    heads = [m.start() for m in _HEADING.finditer(text)]
    s[heads] = PARAGRAPH
    fences = [m.span() for m in _FENCE.finditer(text)]
    for (a, _), (_, b) in zip(fences[::2], fences[1::2]):
        inner = s[a + 1 : b]
        s[a + 1 : b] = np.where(inner >= LINE, SENTENCE, np.minimum(inner, CHARACTER))
    for m in _TOKEN.finditer(text):
        s[m.start() + 1 : m.end()] = NONE
    if not text.isascii():
        joined = [m.start() for m in _JOINED.finditer(text)]
        s[joined] = NONE
        after = [i + 1 for i in joined if text[i] == "‍"]
        s[after] = NONE
        for m in _FLAGS.finditer(text):
            s[m.start() + 1] = NONE
    for m in re.finditer("\r\n", text):
        s[m.start() + 1] = NONE
    s[0] = s[n] = PARAGRAPH
    return s


class RangeMax:
    """Sparse table: the rightmost position of the greatest value of a range, for ranges up to `width`."""

    def __init__(self, values: np.ndarray, width: int):
        n = len(values)
        row = values.astype(np.int64) * (n + 1) + np.arange(n)
        self.n, self.rows, k = n, [row], 1
        while 2 * k <= min(width, n):
            row = np.maximum(row[: len(row) - k], row[k:])
            self.rows.append(row)
            k *= 2

    def __call__(self, a: int, b: int) -> int:
        """The position within a..b (both included)."""
        k = (b - a + 1).bit_length() - 1
        row = self.rows[k]
        return int(max(row[a], row[b - (1 << k) + 1]) % (self.n + 1))


def split(text: str, target: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """The (start, end) of the pieces of `text`, in order, none longer than `limit`."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit // 2))
    target = max(overlap + 1, min(target, limit))
    stretch = max(1 << 16, 8 * limit)
    value = strengths(text)
    out: list[tuple[int, int]] = []
    start, done, base, table = 0, 0, -1, None
    while True:
        if n - start <= limit:
            out.append((start, n))
            return out
        if table is None or start + limit > base + table.n - 1:
            base = max(0, start)
            table = RangeMax(value[base : base + stretch + 1], limit + 1)

        def best(a: int, b: int) -> int:
            return base + table(a - base, b - base)

        end = best(max(start + target, done + 1), start + limit)
        if value[end] < NATURAL:
            low = max(start + overlap + 1, done + 1)
            wider = best(low, start + limit)
            end = wider if value[wider] > value[end] else end
        if value[end] == NONE:
            end = start + limit
        out.append((start, end))
        done = end
        if overlap:
            a, b = max(start + 1, end - overlap * 5 // 4), max(start + 1, end - overlap * 3 // 4)
            start = best(a, b)
            if value[start] == NONE:
                start = max(a, end - overlap)
        else:
            start = end


def split_texts(df: DataFrame, key: str, text: str, target: str, limit: str, overlap: str) -> DataFrame:
    """One row a piece: (key, piece_no from 1, n_pieces, start, text, chars)."""
    src = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(target).cast("int").alias("target"), F.col(limit).cast("int").alias("limit"), F.col(overlap).cast("int").alias("overlap"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            rows = []
            for k, t, tg, lim, ov in pdf.itertuples(index=False):
                if t is None:
                    rows.append((k, 1, 1, 0, None, 0))
                    continue
                if pd.isna(lim):
                    rows.append((k, 1, 1, 0, t, len(t)))
                    continue
                cuts = split(t, int(tg) if not pd.isna(tg) else int(lim), int(lim), int(ov) if not pd.isna(ov) else 0)
                rows.extend((k, i, len(cuts), a, t[a:b], b - a) for i, (a, b) in enumerate(cuts, 1))
            yield pd.DataFrame(rows, columns=["key", "piece_no", "n_pieces", "start", "text", "chars"])

    kind = src.schema["key"].dataType.simpleString()
    return src.where("key IS NOT NULL").mapInPandas(run, f"key {kind}, piece_no int, n_pieces int, start int, text string, chars int").withColumnRenamed("key", key)


def split_chunks(chunks: DataFrame, profiles: DataFrame) -> DataFrame:
    """The pieces of `chunks` (id, profile, text) under the limits of their `profiles`; repeated rows count once."""
    rows = chunks.select("id", "profile", "text").distinct()
    return split_texts(rows.join(small(profiles), "profile", "left"), "id", "text", "target_chars", "max_chars", "overlap_chars")
