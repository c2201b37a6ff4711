"""Covers: style, palette and line breaking of a title, written as SVG."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import or_empty, shorten

# Hints of style, palettes, characters that may not begin or end a line, sizes by style.
STYLE_HINTS = [
    ("editorial", r"essay|文章|随笔|选集|collection|选读"), ("band", r"handbook|guide|手册|指南|教程|notes"), ("minimal", r"poem|诗|meditation|禅|静"),
]
PALETTES = [
    ("#0d1b2a", "#c9a227", "#f6f2e8"), ("#1a1512", "#d97757", "#f3ece4"), ("#12211c", "#9dbf9e", "#eef2ec"), ("#1c1a26", "#b8a1d9", "#f2eef8"),
    ("#241a1a", "#e0b0a0", "#f7f0ec"), ("#f3efe6", "#8c3b2e", "#221f1b"), ("#e8edf2", "#2f5d8a", "#182430"), ("#0f0f10", "#7fd1c1", "#f0f0f0"),
]
NOT_FIRST = set("，。、；：？！）】》」』’”…—·%‰℃,.;:?!)]}>\"'")
NOT_LAST = set("（【《「『‘“([{<")
SIZES = {"editorial": (132, 5, 54, 46), "classic": (112, 4, 48, 42), "minimal": (88, 4, 40, 36), "band": (118, 4, 46, 40)}
MANY_WORDS, MANY_ARTICLES, WIDTH, HEIGHT = 120_000, 4, 1600, 2400


def recommend_style(title: Column, subtitle: Column, description: Column, articles: Column, words: Column) -> Column:
    """By words of the title, then by size."""
    t = F.lower(F.concat_ws(" ", or_empty(title), or_empty(subtitle), or_empty(description)))
    out = F.when(words > MANY_WORDS, "classic").when(articles > MANY_ARTICLES, "editorial").otherwise("classic")
    for style, hint in reversed(STYLE_HINTS):
        out = F.when(t.rlike(hint), style).otherwise(out)
    return out


def title_role(title: Column, style: Column) -> Column:
    """The kind of type for a title: serif, but sans for minimal and band; CJK or Latin."""
    cjk = or_empty(title).rlike("[一-鿿]")
    return (
        F.when(style == "minimal", F.when(cjk, "sans_zh").otherwise("sans_en")).when(style == "band", F.when(cjk, "sans_zh").otherwise("bold_en"))
        .otherwise(F.when(cjk, "serif_zh").otherwise("serif_en"))
    )


def palette_seed(title: Column) -> Column:
    """The sum of code points, each times its place plus seven."""
    chars = F.split(or_empty(title), "")
    points = F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: _code_point(c) * (i + 7))
    return F.aggregate(points, F.lit(0).cast("long"), lambda a, x: a + x)


def _code_point(c: Column) -> Column:
    return F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")


def palette(title: str) -> dict[str, str]:
    """The palette of a title, always the same."""
    bg, accent, text = random.Random(sum(ord(c) * (i + 7) for i, c in enumerate(title))).choice(PALETTES)
    return {"bg": bg, "accent": accent, "text": text}


def rgb(color: str) -> tuple[int, int, int]:
    """The parts of a colour written as #rgb or #rrggbb."""
    h = color.removeprefix("#")
    h = "".join(x + x for x in h) if len(h) == 3 else h
    return tuple(bytes.fromhex(h))


def luma(color: str) -> float:
    """Relative brightness of a colour from 0 to 1, by the usual weights of linear light."""
    linear = [x / 12.92 if x <= 0.03928 else ((x + 0.055) / 1.055) ** 2.4 for x in (c / 255 for c in rgb(color))]
    return sum(w * x for w, x in zip((0.2126, 0.7152, 0.0722), linear))


def width_of(s: str, size: float) -> float:
    """An estimate of a line's width: wide characters an em, others a little over half."""
    return size * sum(1.0 if ord(c) > 0x2E7F else 0.55 for c in s)


_PIECE = re.compile(r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*(?: [A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*)*|\s+|.", re.S)
_WORDS = re.compile(r"[A-Za-z0-9]+(?:['’\-][A-Za-z0-9]+)*|\s+|.", re.S)


def wrap(text: str, room: float, measure: Callable[[str], float]) -> list[str]:
    """Lines no wider than `room` where a piece allows it; no line begins or ends with a mark that may not."""
    out: list[str] = []
    for row in text.split("\n"):
        line = ""
        for piece in _WORDS.findall(row):
            if not line or measure(line + piece) <= room:
                line += piece
                continue
            keep, last = line.rstrip(), ""
            if keep and (keep[-1] in NOT_LAST or piece[:1] in NOT_FIRST) and len(keep) > 1:
                keep, last = keep[:-1].rstrip(), keep[-1]
            out.append(keep)
            line = (last + piece).lstrip()
        out.append(line.rstrip())
    return out


def balance(text: str, n: int, room: float, measure: Callable[[str], float]) -> list[str] | None:
    """The text in `n` lines of widths as even as can be, words of a Latin phrase together; None if it can't be done."""
    pieces = _PIECE.findall(text)
    if n < 2 or len(pieces) < n:
        return None
    # the narrowest widest line, by dynamic programming over break places
    m = len(pieces)
    best = [[float("inf")] * (m + 1) for _ in range(n + 1)]
    cut = [[0] * (m + 1) for _ in range(n + 1)]
    best[0][0] = 0.0
    for k in range(1, n + 1):
        for j in range(1, m + 1):
            for i in range(j - 1, -1, -1):
                line = "".join(pieces[i:j]).strip()
                w = measure(line)
                if w > room:
                    break
                bad = not line or k > 1 and line[0] in NOT_FIRST
                if not bad and max(best[k - 1][i], w) < best[k][j]:
                    best[k][j], cut[k][j] = max(best[k - 1][i], w), i
    if best[n][m] == float("inf"):
        return None
    out, j = [], m
    for k in range(n, 0, -1):
        out.append("".join(pieces[cut[k][j] : j]).strip())
        j = cut[k][j]
    return out[::-1]


def fit(text: str, room: float, lines: int, size: int, least: int = 24) -> tuple[int, list[str]]:
    """(size, lines): the greatest size at which the text needs no more lines than allowed."""
    while True:
        got = wrap(text, room, lambda s: width_of(s, size))
        if size <= least or len(got) <= lines and all(width_of(x, size) <= room for x in got):
            even = balance(text, len(got), room, lambda s: width_of(s, size)) if len(got) > 1 else None
            return size, even or got
        size = max(least, int(size * 0.94))


def svg(title: str, author: str = "", subtitle: str = "", style: str = "editorial") -> str:
    """A cover of 2:3."""
    p, (big, most, sub, small) = palette(title), SIZES[style]
    size, rows = fit(title, WIDTH * 0.8, most, big)
    step, total = size * 1.25, size * 1.25 * len(rows)
    top = {"editorial": HEIGHT * 0.9 - total - sub - small - 80, "classic": HEIGHT * 0.46 - total / 2, "minimal": HEIGHT * 0.5 - total / 2, "band": HEIGHT * 0.56 + size}[style]
    middle = style in ("classic", "minimal")
    x, anchor = (WIDTH / 2, "middle") if middle else (WIDTH * 0.1, "start")
    band = f'<rect x="0" y="{HEIGHT * 0.56:.0f}" width="{WIDTH}" height="{total + size + sub + small + 60:.0f}" fill="{p["accent"]}" opacity="0.25"/>' if style == "band" else ""

    def line(s: str, y: float, z: float, color: str) -> str:
        return f'<text x="{x:.0f}" y="{y:.0f}" font-size="{z:.0f}" fill="{color}" text-anchor="{anchor}" font-family="serif">{html.escape(s)}</text>'

    body = [line(s, top + step * (i + 1), size, p["text"]) for i, s in enumerate(rows)]
    y = top + total + sub + 30
    if subtitle:
        body.append(line(subtitle, y, sub, p["accent"]))
        y += sub + 20
    if author:
        body.append(line(author, y + small, small, p["text"]))
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {HEIGHT}" width="100%"><rect width="{WIDTH}" height="{HEIGHT}" fill="{p["bg"]}"/>{band}{"".join(body)}</svg>'


def prompt(title: Column, style: Column, bg: Column, accent: Column) -> Column:
    """A request for a cover's background, without any text on it."""
    mood = F.when(style == "editorial", "modern editorial publishing, bold and confident").when(style == "classic", "timeless classic literature, refined").when(style == "minimal", "ultra minimal, much empty space, quiet").otherwise("contemporary trade paperback, graphic and clean")
    return F.format_string('An abstract cover in the spirit of "%s". %s. Dominant color %s, accent %s. Vertical, 2:3, room for a title above and below. No text, letters, numbers, logos or watermarks.', shorten(title, 60), mood, bg, accent)


# Colours of text on dark and on light ground, and the brightness between them.
ON_DARK, ON_LIGHT, BRIGHT = (250, 248, 244), (20, 22, 26), 138.0


def region_luma(pixels: np.ndarray, box: tuple[int, int, int, int]) -> float:
    """The mean brightness, 0 to 255, of the part of an image (rows, columns, RGB or grey) inside a box; 128 of nothing."""
    x0, y0, x1, y1 = (max(0, int(v)) for v in box)
    part = pixels[y0:y1, x0:x1].astype(float)
    if not part.size:
        return 128.0
    return float((part @ np.array([0.299, 0.587, 0.114]) if part.ndim == 3 else part).mean())


def text_color(pixels: np.ndarray, box: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """The colour of text that can be read in a box of an image."""
    return ON_LIGHT if region_luma(pixels, box) > BRIGHT else ON_DARK
