"""Visible text of HTML by a parser, for markup that replacement patterns can't follow."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HIDDEN = {"script", "style"}


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _HIDDEN

    def handle_endtag(self, tag):
        self.hidden -= tag in _HIDDEN and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def visible(html: str | None) -> str:
    """Text nodes joined by spaces, white space squeezed; texts without ``<`` only have it squeezed; null becomes empty."""
    if not html:
        return ""
    if "<" in html:
        parser = _Text()
        parser.feed(html)
        parser.close()
        html = " ".join(parser.parts)
    return " ".join(html.replace("\xa0", " ").split())


@F.pandas_udf(T.StringType())
def strip_html(values: pd.Series) -> pd.Series:
    return values.map(visible)
