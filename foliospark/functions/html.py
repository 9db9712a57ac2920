"""HTML to plain text: a chain of built-in replacements, and a parser for markup the chain can't follow."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Patterns and what they become, in this order; the ampersand is decoded last.
REPLACEMENTS = [
    ("(?is)<script[^>]*>.*?</script>", " "),
    ("(?is)<style[^>]*>.*?</style>", " "),
    ("(?s)<!--.*?-->", " "),
    ("(?s)<[^>]*>", " "),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("\\s+", " "),
]


def html_to_text(c: Column) -> Column:
    """Built-in functions only, inside code generation. For markup without > in attribute values."""
    for pattern, to in REPLACEMENTS:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(c)


def listed_references(c: Column) -> Column:
    """Markup in which only the chain's references are references, for the parser, which decodes all of HTML's and those
    without their semicolon (`&amp`) as well: any other ampersand is text."""
    closed = "|".join(pattern for pattern, _ in REPLACEMENTS if pattern.startswith("&"))
    return F.regexp_replace(F.regexp_replace(c, "&nbsp;", " "), f"&(?!{closed.replace('&', '')})", "&amp;")


class _Strings(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "template")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "template") and self.hidden:
            self.hidden -= 1

    def handle_data(self, data):
        if not self.hidden and (s := data.strip()):
            self.out.append(s)


def parse_text(html: str | None) -> str | None:
    """Stripped strings of a document, joined by spaces; null stays null."""
    if html is None:
        return None
    p = _Strings()
    p.feed(html)
    p.close()
    return " ".join(p.out)


@F.pandas_udf(T.StringType())
def html_parser_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(parse_text, na_action="ignore").astype(object).where(s.notna(), None)
