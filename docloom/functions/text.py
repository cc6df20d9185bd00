"""Text expressions. All but NFKC and casefold are native; those two are Arrow UDFs, as Spark has no such function."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import CHARS_PER_TOKEN, REFUSAL

#: Line ends as Python's splitlines() has them, and white space as its strip() has it.
LINE_END = r"(?:\r\n|[\n\r\x0B\f\x1C-\x1E\u0085  ])"
SPACE = r"[\s\x1C-\x1F\u0085   -     　]"
WORD = r"[\p{L}\p{N}_][\p{L}\p{N}_-]*"
#: Characters whose upper case is longer than one character, and the one character that some of them have instead.
LONG_UPPER = "".join(c for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if len(c.upper()) > 1)
ONE_UPPER = {c: "\u1e9e" if c == "\u00df" else c.title() for c in LONG_UPPER if c == "\u00df" or len(c.title()) == 1}


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else t.casefold())


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def upper_by_character(text: Column) -> Column:
    """Upper case character by character, so no text gets longer: \u00df becomes \u1e9e, and \ufb01 stays."""
    one = F.translate(text, "".join(ONE_UPPER), "".join(ONE_UPPER.values()))
    parts = F.split(one, f"(?<=[{LONG_UPPER}])|(?=[{LONG_UPPER}])", -1)
    each = F.transform(parts, lambda p: F.when(p.rlike(f"^[{LONG_UPPER}]$"), p).otherwise(F.upper(p)))
    return F.when(text.rlike(f"[{LONG_UPPER}]"), F.array_join(each, "")).otherwise(F.upper(text))


def collapse_space(text: Column) -> Column:
    """White-space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def normalize_page(text: Column, compatibility: bool = True) -> Column:
    """Stable text: NFKC, no soft hyphens, single spaces, none before a line end, at most one blank line."""
    text = nfkc(text) if compatibility else text
    text = F.regexp_replace(text, "­", "")
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" +\n", "\n")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def line_signature(line: Column) -> Column:
    """A running line's key: white space collapsed, digit runs as #."""
    return F.regexp_replace(collapse_space(line), r"\p{Nd}+", "#")


def lines(text: Column) -> Column:
    """Lines without their ends; no empty last line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def lines_keeping_ends(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[^\n\r\x0B\f\x1C-\x1E\u0085  ]*{LINE_END}|[^\n\r\x0B\f\x1C-\x1E\u0085  ]+"), F.lit(0))


def render_table(rows: Column) -> Column:
    """array<array<string>> as lines of ' | '; ragged rows are padded, empty columns and rows go, under two rows nothing is left."""
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    cell = lambda r, i: F.coalesce(F.trim(F.get(r, i)), F.lit(""))
    indices = F.filter(F.sequence(F.lit(0), width), lambda i: i < width)
    kept = F.filter(indices, lambda i: F.exists(rows, lambda r: cell(r, i) != ""))
    full = F.filter(F.transform(rows, lambda r: F.transform(kept, lambda i: cell(r, i))), lambda r: F.exists(r, lambda c: c != ""))
    return F.when(F.size(full) < 2, F.lit("")).otherwise(F.array_join(F.transform(full, lambda r: F.array_join(r, " | ")), "\n"))


def split_after(text: Column, separator: str) -> Column:
    """Pieces that keep the separator at their end; the last may be empty."""
    parts = F.split(text, rf"\Q{separator}\E", -1)
    return F.transform(parts, lambda p, i: F.when(i < F.size(parts) - 1, F.concat(p, F.lit(separator))).otherwise(p))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def join_broken_words(text: Column) -> Column:
    """Collapsed white space, and 'word- word' joined to 'word-word'."""
    return F.regexp_replace(collapse_space(text), r"(?U)(?<=\w)- (?=\w)", "-")


def question_key(question: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(question), "[^a-z0-9]+", " "))


def lexical_tokens(text: Column) -> Column:
    """[a-z0-9]+ of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Words with inner hyphens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def field_name(token: Column) -> Column:
    return F.regexp_replace(F.lower(token), "[^a-z0-9_]", "")


def is_refusal(text: Column, sentence: str = REFUSAL) -> Column:
    clean = lambda t: strip(F.regexp_replace(strip(t), r"\.+$", ""))
    return F.lower(clean(text)) == F.lower(clean(F.lit(sentence)))


def title_of(question: Column, most: int = 60) -> Column:
    flat = collapse_space(question)
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("..."))).otherwise(flat)


def display_width(score: Column, low: float = 0.4, high: float = 0.95) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - low) / (high - low)))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int"))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def canonical_model(name: Column) -> Column:
    return F.when(F.element_at(F.split(name, "/"), -1).contains(":"), name).otherwise(F.concat(name, F.lit(":latest")))


def format_number(value: Column) -> Column:
    """Three decimals; a dash for null."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.format_string("%.3f", value.cast("double")))


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\|", r"\\|"), r"\r?\n", " ")
