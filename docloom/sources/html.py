"""HTML as visible lines, through the standard library's parser in an Arrow UDF."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tags that end a line, and tags whose content is not visible.
BLOCK_TAGS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
HIDDEN_TAGS = frozenset(("head", "script", "style"))


class _Lines(HTMLParser):
    """Words are kept in one list, with None where a line ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.words: list[str | None] = []
        self.hidden = 0

    def _edge(self, tag: str, step: int) -> None:
        if tag in HIDDEN_TAGS:
            self.hidden = max(0, self.hidden + step)
        elif not self.hidden and tag in BLOCK_TAGS:
            self.words.append(None)

    def handle_starttag(self, tag, attrs) -> None:
        self._edge(tag, 1)

    def handle_endtag(self, tag) -> None:
        self._edge(tag, -1)

    def handle_data(self, data) -> None:
        if not self.hidden:
            self.words.extend(data.split())


def visible_lines(html: str) -> list[str]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    out: list[list[str]] = [[]]
    for word in parser.words:
        if word is None:
            out.append([])
        else:
            out[-1].append(word)
    return [" ".join(line) for line in out if line]


@F.pandas_udf(T.ArrayType(T.StringType()))
def html_lines(html: pd.Series) -> pd.Series:
    """array<string> of the visible lines; null for null."""
    return html.map(lambda h: None if h is None else visible_lines(h))


def section_between(lines: Column, start: Column, end: Column) -> Column:
    """Lines from the first with the start marker up to the first later one with the end marker; either missing is an error."""
    at = F.array_position(F.transform(lines, lambda x: x.contains(start)), True)
    rest = F.slice(lines, (at + 1).cast("int"), F.size(lines))
    to = F.array_position(F.transform(rest, lambda x: x.contains(end)), True)
    fail = lambda what: F.raise_error(F.lit(f"{what} marker was not found")).cast("array<string>")
    return F.when(at == 0, fail("start")).when(to == 0, fail("end")).otherwise(F.slice(lines, at.cast("int"), to.cast("int")))
