"""Markdown to XHTML pages of a book."""

from __future__ import annotations

import html
import os
import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.markdown import thin_spaces

CSS = {
    "classic": "body{font-family:serif;line-height:1.7;margin:1em}h1{text-align:center}blockquote{margin:1em 2em;color:#555}",
    "modern": "body{font-family:sans-serif;line-height:1.6;margin:1em}h1{font-weight:600}blockquote{border-left:3px solid #999;padding-left:1em}",
    "minimal": "body{font-family:serif;line-height:1.8;margin:2em}h1{font-weight:400}",
    "literary": "body{font-family:serif;line-height:1.9;margin:1.5em}p{text-indent:2em;margin:0}",
}


def css(theme: str, folders: list[str] = (), variable: str = "QUIRE_THEMES") -> str:
    """A theme's style sheet: a file <theme>.css of the folders, or of the variable's, before the built-in ones."""
    for d in [*folders, *filter(None, os.environ.get(variable, "").split(os.pathsep))]:
        p = Path(d) / f"{theme}.css"
        if p.is_file():
            return p.read_text("utf-8")
    return CSS.get(theme, CSS["classic"])


def esc(s: object) -> str:
    return html.escape(str(s or ""), quote=False)


_INLINE = re.compile(
    r"(?P<code>(`+)(?!`)(?P<c>.+?)(?<!`)\2(?!`))|!\[(?P<alt>[^\]]*)\]\((?P<src>[^)\s]+)[^)]*\)|\[(?P<note>\^[^\]]+)\]|\[(?P<text>[^\]]+)\]\((?P<href>[^)\s]+)[^)]*\)|<(?P<auto>https?://[^>\s]+)>"
    r"|\*\*(?P<b>.+?)\*\*|(?<!\*)\*(?P<i>[^*]+)\*(?!\*)|~~(?P<d>.+?)~~|(?P<br>  \n)"
)


def inline(s: str) -> str:
    out, last = [], 0
    for m in _INLINE.finditer(s):
        out.append(esc(s[last : m.start()]))
        g = m.groupdict()
        if g["code"]:
            out.append(f"<code>{esc(g['c'].strip())}</code>")
        elif g["src"] is not None:
            src = g["src"]
            src = "../Images/" + src[7:] if src.startswith("assets/") else src
            out.append(f'<img src="{html.escape(src)}" alt="{html.escape(g["alt"])}"/>')
        elif g["note"]:
            n = esc(g["note"][1:])
            out.append(f'<sup><a href="#fn-{n}">{n}</a></sup>')
        elif g["href"] is not None:
            out.append(f'<a href="{html.escape(g["href"])}">{inline(g["text"])}</a>')
        elif g["auto"]:
            out.append(f'<a href="{html.escape(g["auto"])}">{esc(g["auto"])}</a>')
        elif g["br"]:
            out.append("<br/>")
        else:
            tag = next(t for t in ("b", "i", "d") if g[t])
            name = {"b": "strong", "i": "em", "d": "del"}[tag]
            out.append(f"<{name}>{inline(g[tag])}</{name}>")
        last = m.end()
    return "".join(out) + esc(s[last:])


_ITEM = re.compile(r"^(\s*)([-*+]|\d{1,3}[.)])\s+(.*)$")


def to_xhtml(md: str | None) -> str:
    """Well-formed XHTML of headings, paragraphs, lists, quotations, code, tables, rules, footnotes."""
    lines, out, i = (md or "").split("\n"), [], 0

    def many(p: str) -> list[str]:
        nonlocal i
        got = []
        while i < len(lines) and re.match(p, lines[i]):
            got.append(lines[i])
            i += 1
        return got

    while i < len(lines):
        x = lines[i]
        fence = re.match(r"^\s*(`{3,}|~{3,})\s*(\S*)", x)
        if fence:
            i += 1
            code = []
            while i < len(lines) and not re.match(rf"^\s*{fence.group(1)[0]}{{{len(fence.group(1))},}}\s*$", lines[i]):
                code.append(lines[i])
                i += 1
            i += 1
            cls = f' class="language-{html.escape(fence.group(2))}"' if fence.group(2) else ""
            out.append(f"<pre><code{cls}>{esc(chr(10).join(code))}</code></pre>")
        elif not x.strip():
            i += 1
        elif m := re.match(r"^(#{1,6})\s+(.*)$", x):
            out.append(f"<h{len(m[1])}>{inline(m[2])}</h{len(m[1])}>")
            i += 1
        elif re.match(r"^\s*(?:-{3,}|\*{3,}|_{3,})\s*$", x):
            out.append("<hr/>")
            i += 1
        elif x.lstrip().startswith(">"):
            inner = [re.sub(r"^\s*> ?", "", y) for y in many(r"^\s*>")]
            out.append(f"<blockquote>{to_xhtml(chr(10).join(inner))}</blockquote>")
        elif m := re.match(r"^\[\^([^\]]+)\]:\s*(.*)$", x):
            i += 1
            more = [y.strip() for y in many(r"^ {4}\S")]
            out.append(f'<p class="footnote" id="fn-{esc(m[1])}">{inline(" ".join([m[2], *more]))}</p>')
        elif _ITEM.match(x):
            out.append(_list(many(r"^\s*(?:[-*+]|\d{1,3}[.)])\s+")))
        elif x.lstrip().startswith("|") and i + 1 < len(lines) and re.match(r"^\s*\|[\s:|-]+\|?\s*$", lines[i + 1]):
            rows = [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", y.strip().strip("|"))] for y in many(r"^\s*\|")]
            cells = lambda r, t: "<tr>" + "".join(f"<{t}>{inline(c)}</{t}>" for c in r) + "</tr>"
            out.append(f"<table><thead>{cells(rows[0], 'th')}</thead><tbody>{''.join(cells(r, 'td') for r in rows[2:])}</tbody></table>")
        else:
            para = [x]
            i += 1
            while i < len(lines) and lines[i].strip() and not re.match(r"^(?:#{1,6} |\s*>|\s*(?:```|~~~)|\s*(?:[-*+]|\d{1,3}[.)])\s+)", lines[i]):
                para.append(lines[i])
                i += 1
            out.append(f"<p>{inline(chr(10).join(para))}</p>")
    return "\n".join(out)


def _list(rows: list[str]) -> str:
    """Nested lists by indent."""
    items = [(len(m[1]), m[2], m[3]) for m in map(_ITEM.match, rows)]

    def level(k: int) -> tuple[str, int]:
        pad, ordered = items[k][0], items[k][1][0].isdigit()
        tag, out = ("ol", []) if ordered else ("ul", [])
        while k < len(items) and items[k][0] >= pad:
            if items[k][0] > pad:
                inner, k = level(k)
                out[-1] = out[-1][:-5] + inner + "</li>"
                continue
            out.append(f"<li>{inline(items[k][2])}</li>")
            k += 1
        return f"<{tag}>{''.join(out)}</{tag}>", k

    out, k = "", 0
    while k < len(items):
        part, k = level(k)
        out += part
    return out


def page(title: str, body: str, lang: str = "zh-CN") -> str:
    """A complete XHTML page."""
    return (
        '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" '
        f'xml:lang="{lang}" lang="{lang}">\n<head><title>{esc(title)}</title><link rel="stylesheet" type="text/css" href="../Style/main.css"/></head>\n<body>\n{body}\n</body>\n</html>\n'
    )


def chapter(title: str, md: str, number: str = "", thin: bool = False, lang: str = "zh-CN") -> str:
    body = to_xhtml(md)
    head = f'<p class="chap-no">{esc(number)}</p>' if number else ""
    return page(title, f'<section class="chapter"><h1>{esc(title)}</h1>{head}{thin_spaces(body) if thin else body}</section>', lang)


def chapters(title: Column, md: Column, thin: bool = False, lang: str = "zh-CN") -> Column:
    """The XHTML page of every chapter."""

    @F.pandas_udf("string")
    def run(t: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([chapter(a or "", b or "", "", thin, lang) for a, b in zip(t, m)], dtype="object")

    return run(title, md)


def counts(n_sections: int = 0, n_articles: int = 0, words: int = 0) -> str:
    """What a part or section page says about its size."""
    parts = [f"{n_sections} 个分类" if n_sections > 1 else "", f"{n_articles} 篇" if n_articles else "", f"约 {words:,} 字" if words else ""]
    return " · ".join(p for p in parts if p)
