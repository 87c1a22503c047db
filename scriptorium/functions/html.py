"""Functions on markup that regular expressions can't express. They take and give Arrow batches."""

from __future__ import annotations

import re
from html import escape, unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = re.compile(r"\s+")
SILENT = {"script", "style"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Text(HTMLParser):
    """Text outside scripts, styles, and elements of a class that is dropped."""

    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.depth, self.out = dropped, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        classes = set((dict(attrs).get("class") or "").split())
        if self.depth or tag in SILENT or classes & self.dropped:
            self.depth += 1

    def handle_endtag(self, tag):
        if self.depth and tag not in VOID:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.out.append(data)


def text_of(html: str | None, dropped: frozenset[str] = frozenset()) -> str:
    """STR-08 for one page."""
    if not html:
        return ""
    p = _Text(dropped)
    p.feed(html)
    p.close()
    return SPACE.sub(" ", " ".join(p.out)).strip()


def parsed_text(html: Column, dropped: tuple[str, ...] = ("licensebox",)) -> Column:
    """STR-08, UDF-02 for pages of any form, unclosed tags and all."""
    classes = frozenset(dropped)

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: text_of(h, classes))

    return run(html)


LINK = re.compile(r"\[\[([^|\]]+)(?:\|([^\]]*))?\]\]")
INNER = re.compile(r"\{\{([^{}]*)\}\}")


def inline(text: str | None, targets: dict[str, str] | None = None) -> str | None:
    """STR-10 for one text: links, tooltips, and the last argument of other templates, innermost first."""
    if text is None:
        return None

    def template(m: re.Match) -> str:
        name, *args = [x.strip() for x in m[1].split("|")]
        plain = [a for a in args if "=" not in a]
        if name.lower() in ("tooltip", "tt", "tip") and plain:
            return f'<span title="{escape(plain[1] if len(plain) > 1 else plain[0])}">{escape(plain[0])}</span>'
        return plain[-1] if plain else name

    for _ in range(20):
        new = INNER.sub(template, text)
        if new == text:
            break
        text = new
    return LINK.sub(lambda m: f'<a href="{escape((targets or {}).get(m[1], m[1]))}">{m[2] or m[1]}</a>', text)


def rendered_inline(text: Column) -> Column:
    """STR-10, STR-11"""
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(inline)

    return run(text)


def summary(html: Column, most: int = 220) -> Column:
    """STR-22: the first paragraphs' text, up to `most` characters."""
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]+>", " "), r"\s+", " ")))
    return F.substring(F.array_join(F.filter(paragraphs, lambda p: p != ""), " "), 1, most)


def data_record(html: Column) -> Column:
    """STR-12: the map of a data page's table; of a field that repeats, the last value."""
    keys = F.transform(F.regexp_extract_all(html, F.lit(r'(?is)<th[^>]*>(.*?)</th>\s*<td class="mw-jsonconfig-value"[^>]*>(.*?)</td>'), F.lit(1)), _cell)
    values = F.transform(F.regexp_extract_all(html, F.lit(r'(?is)<th[^>]*>(.*?)</th>\s*<td class="mw-jsonconfig-value"[^>]*>(.*?)</td>'), F.lit(2)), _cell)
    last = F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.element_at(values, i + 1).alias("v"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.size(keys)), e["k"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def _cell(c: Column) -> Column:
    return F.trim(F.replace(F.regexp_replace(c, "<[^>]+>", ""), F.lit("&quot;"), F.lit("")))


@F.udtf(returnType="tag string, attribute string, value string")
class Attributes:
    """UDF-04: every attribute of every tag of a page."""

    def eval(self, html: str):
        for tag, attrs in re.findall(r"<([A-Za-z][A-Za-z0-9]*)\b([^>]*)>", html or ""):
            for name, value in re.findall(r'([A-Za-z-]+)\s*=\s*"([^"]*)"', attrs):
                yield tag.lower(), name.lower(), unescape(value)
