"""HTML and markdown fragments."""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import escaped_html, stripped


def one_row_table(body: Column) -> Column:
    """Words of a text as the cells of a table of one row."""
    words = F.filter(F.split(body, r"(?U)\s+"), lambda w: w != "")
    cells = F.array_join(F.transform(words, lambda w: F.concat(F.lit("<td>"), escaped_html(w), F.lit("</td>"))), "")
    table = F.concat(F.lit("<table><tbody><tr>"), cells, F.lit("</tr></tbody></table>"))
    return F.when(F.size(words) > 0, table).otherwise("<table></table>")


def html_tables(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<table.*?>.*?</table>"), F.lit(0))


def markdown_to_html(markdown: Column) -> Column:
    """Pipe tables as HTML tables, other lines that aren't blank as paragraphs, in order."""
    lines = F.split(markdown, r"\r\n|\n|\r")
    tag = lambda name, s: F.concat(F.lit(f"<{name}>"), s, F.lit(f"</{name}>"))
    cells = lambda s: F.transform(F.split(F.regexp_replace(stripped(s), r"^\|+|\|+$", ""), r"\|"), stripped)
    row = lambda s, name: tag("tr", F.array_join(F.transform(cells(s), lambda c: tag(name, escaped_html(c))), ""))

    def step(state: Column, line: Column) -> Column:
        piped = F.startswith(stripped(line), F.lit("|"))
        n = F.when(piped, state.n + 1).otherwise(0)
        rule = (n == 2) & F.forall(cells(line), lambda c: c.rlike("^[-: ]*$"))
        opened = F.when(n == 1, F.concat(F.when(state.out == "", "").otherwise("\n"), F.lit("<table>"))).otherwise("")
        inside = F.concat(state.out, opened, F.when(rule, "").otherwise(F.when(n == 1, row(line, "th")).otherwise(row(line, "td"))))
        closed = F.concat(state.out, F.when(state.n > 0, "</table>").otherwise(""))
        body = stripped(line)
        text = F.concat(closed, F.when((body != "") & (closed != ""), "\n").otherwise(""), F.when(body != "", tag("p", escaped_html(body))).otherwise(""))
        return F.struct(F.when(piped, inside).otherwise(text).alias("out"), n.cast("int").alias("n"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    return F.aggregate(lines, start, step, lambda s: F.concat(s.out, F.when(s.n > 0, "</table>").otherwise("")))


# What isn't text in HTML, and the elements whose content isn't markup.
MARKS = r"""(?s)<!--.*?(?:-->|$)|<[!?][^>]*>|</?[A-Za-z](?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
RAW = "script|style"


#: A character reference that ends in a semicolon.
_CLOSED = re.compile(r"&#?[A-Za-z0-9]+;")


def _named_signs(text: Column, closed: bool) -> Column:
    """Character references as the characters they name; only texts with an ampersand leave the JVM."""

    def one(t: str) -> str:
        if not closed:
            return unescape(t)
        return _CLOSED.sub(lambda m: unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], t)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return F.when(F.contains(text, F.lit("&")), run(text)).otherwise(text)


def html_text(html: Column, skip: tuple[str, ...] = (), closed: bool = False) -> Column:
    """The text of an HTML fragment: what stands between marks, parted and collapsed to single spaces.

    ``skip`` names elements that are left out with their content, such as script and style. Marks
    inside other raw elements (RAW) are text. A fragment without text gives what stands outside of angle
    brackets, which may be a left-out element's content; null gives null. A reference without its semicolon, such as
    ``&amp`` before a mark, names its character as in browsers, unless ``closed``.
    """
    whole_html = html
    if skip:
        names = "|".join(skip)
        html = F.regexp_replace(html, rf"(?is)<({names})\b[^>]*>.*?(?:</\1\s*>|$)", " ")
    raw = rf"(?is)(<(?:{RAW})\b[^>]*>)(.*?)(</(?:{RAW})\s*>|$)"
    inside = F.transform(F.regexp_extract_all(html, F.lit(raw), F.lit(2)), lambda x: F.translate(x, "<>", "\u0001\u0002"))
    outside = F.split(F.regexp_replace(html, raw, "\u0003"), "\u0003")
    padded = F.concat(inside, F.array(F.lit("")))
    whole = F.array_join(F.zip_with(outside, padded, lambda o, i: F.concat(F.regexp_replace(o, MARKS, " "), F.lit(" "), F.coalesce(i, F.lit("")), F.lit(" "))), "")
    text = _named_signs(F.translate(whole, "\u0001\u0002", "<>"), closed)
    text = stripped(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(text != "", text).otherwise(stripped(F.regexp_replace(whole_html, "<[^>]+>", " ")))
