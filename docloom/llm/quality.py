"""Quality rules: counts over words and lines, and n-gram perplexity.

Two modified Kneser-Ney models are counted by Spark over all documents and kept in sorted hash arrays:

* words: bigrams of words per language, dealt over buckets (``word_model``); they grow with the corpus. Every document is
  scored by what the other documents know, in bits per word: far above the usual are odd words and words in odd order.
* spelling: 4-grams of byte classes per language (letters in one case, digits, marks), of which there are at most
  CLASSES ** ORDER a language (16.8 million; a few ten thousand in practice), so they can be broadcast. They score each distinct word of a
  chunk once, in bits per character: far above is noise, far below is repetition of a few short words.

Each language has a lower and an upper band for either score: its median, less or plus so many times the distance from the
median to the upper quartile, over the documents that pass the base rules (the lower quartile is the copies', which know each other).
Documents outside of a band are rejected. The widths (BANDS) are chosen on labelled
documents (the README has the shares that they reject).

Scale: three passes over the texts (spelling counts, ask, score), no shuffle of texts; what is shuffled are distinct pairs of words and
two bytes or so a word. Scores are written once to the shared folder, as bands need all of them.

Defined results: a null text has no words, counts 0 and base_failed true; so has an empty one. Documents of
a null language form a language of their own. Texts count whole. Repeated rows give repeated rows, and know each
other's words; only
the columns asked for are returned, so extra columns cannot clash. Word and line equality inside one
document is decided on 64-bit hashes of their bytes, between documents on 32-bit hashes of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import give_back, read, small_batches
from docloom.llm.ngrams import BackoffTable, HashArrays, Level, count_ngrams, merged
from docloom.llm.textblocks import BASE, INVERSE, M1, U, blocks, mix, powers, prefix_hash, span_hash, sums, word_bounds
from docloom.llm.word_model import CHUNK, discounts, scored

ORDER, CLASSES, SPACE_CLASS = 4, 64, 26
WINDOW = 8
#: Widths of the bands below and above the median, in distances from the median to the upper quartile, and the
#: least such distance as a share of the median (few documents of a language can lie close together).
BANDS = {"log_ppl": (17.0, 3.0, 0.05), "log_spelling": (6.0, 6.0, 0.01)}
COUNTS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean"}
ADDED = [*COUNTS, *BANDS]


def byte_classes() -> np.ndarray:
    """64 classes: letters in one case 0-25, space 26, line end 27, digits 28, marks 29-47, lead bytes 48-51, following bytes 52-63."""
    out = np.zeros(256, np.uint8)
    for b in range(256):
        ch = chr(b)
        if b >= 0xC0:
            out[b] = 48 + b % 4
        elif b >= 0x80:
            out[b] = 52 + b % 12
        elif ch.isalpha():
            out[b] = ord(ch.lower()) - 97
        elif ch == "\n":
            out[b] = 27
        elif ch.isspace() or b < 32:
            out[b] = 26
        elif ch.isdigit():
            out[b] = 28
        else:
            out[b] = 29 + b % 19
    return out


CLASS = byte_classes()
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
IS_FIRST = np.array([(b & 0xC0) != 0x80 for b in range(256)])  # of a character


def repeats_in_windows(hashes: np.ndarray, bounds: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each text in width-word windows that stand in it twice or more."""
    n = len(hashes)
    out = np.zeros(len(bounds) - 1, np.int64)
    if n < width:
        return out
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    value = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        value = value * BASE + hashes[k : k + len(value)] + M1
    whole = np.flatnonzero(text[: len(value)] == text[width - 1 :])
    key = mix(value[whole] + mix(text[whole].astype(np.uint64) + M1))  # equal windows of other texts differ
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    found = whole[order[same[1:] | same[:-1]]]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, found, 1)
    np.add.at(cover, found + width, -1)
    return sums((np.cumsum(cover)[:-1] > 0).astype(np.int64), bounds)


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    n = len(offsets) - 1
    starts, ends = word_bounds(data, offsets)
    prefix, inverse = prefix_hash(data), powers(INVERSE, len(data) + 1)
    words = np.searchsorted(starts, offsets)
    first = np.concatenate([[0], np.cumsum(IS_FIRST[data], dtype=np.int64)])
    # Lines: between line ends and text ends; those with a word count.
    cut = np.union1d(np.flatnonzero(data == 10), offsets[1:] - 1) if len(data) else np.zeros(0, np.int64)
    line_end = np.where(data[cut] == 10, cut, cut + 1) if len(data) else cut
    line_start = np.concatenate([[0], cut[:-1] + 1]).astype(np.int64) if len(cut) else cut
    with_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[with_word], line_end[with_word]
    of = np.searchsorted(offsets, line_start, side="right") - 1
    key = mix(span_hash(prefix, line_start, line_end, inverse) + mix(of.astype(np.uint64) + M1))
    lines = np.bincount(of, minlength=n)
    distinct = np.bincount(of[np.unique(key, return_index=True)[1]], minlength=n)
    counts = {
        "n_words": np.diff(words),
        "word_chars": sums(first[ends] - first[starts], words),
        "n_symbols": sums(IS_SYMBOL[data].astype(np.int64), offsets),
        "n_dup_lines": lines - distinct,
        "n_repeat_words": repeats_in_windows(span_hash(prefix, starts, ends, inverse), words),
    }
    counts["base_failed"] = (counts["n_words"] < 20) | (100 * counts["n_repeat_words"] > 30 * counts["n_words"])
    return counts


def kneser_ney(codes: np.ndarray, counts: np.ndarray, order: int, classes: int = CLASSES) -> list[tuple[np.ndarray, ...]]:
    """Per order from 1: grams, log2 probabilities, contexts and their log2 back-off weights (interpolated form)."""
    adjusted = [(codes, counts)]
    for k in range(order, 1, -1):  # below the top: numbers of distinct symbols that come before
        grams = adjusted[-1][0] & U((1 << (8 * (k - 1))) - 1)
        adjusted.append(merged(grams, np.ones(len(grams), np.int64)))
    out: list[tuple[np.ndarray, ...]] = []
    for k, (grams, n) in enumerate(reversed(adjusted), 1):
        d = discounts([int((n == k).sum()) for k in range(1, 5)])[np.minimum(n, 3)]
        contexts, total = merged(grams >> U(8), n)
        at = np.searchsorted(contexts, grams >> U(8))
        weight = np.bincount(at, d, len(contexts)) / total
        below = np.full(len(grams), 1 / classes) if k == 1 else np.exp2(out[-1][1][np.searchsorted(out[-1][0], grams & U((1 << (8 * (k - 1))) - 1))])
        out.append((grams, np.log2((n - d) / total[at] + weight[at] * below), contexts, np.log2(weight)))
    return out


def build_table(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> tuple[list[str], BackoffTable]:
    """Groups, sorted, and one table whose codes begin with the group's number."""
    names = sorted(counts)
    models = [kneser_ney(*merged(*counts[g]), order) for g in names]
    levels = []
    for k in range(1, order + 1):
        grams = np.concatenate([m[k - 1][0] | U(i) << U(8 * k) for i, m in enumerate(models)])
        contexts = np.concatenate([m[k - 1][2] | U(i) << U(8 * (k - 1)) for i, m in enumerate(models)])
        logp, weight = (np.concatenate([m[k - 1][j] for m in models]).astype(np.float32)[None, :] for j in (1, 3))
        levels.append(Level(HashArrays(grams), logp, HashArrays(contexts), weight))
    return names, BackoffTable(levels, -np.log2(CLASSES), 1)


def train_spelling(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER) -> tuple[list[str], BackoffTable] | None:
    """The models of all documents' languages; None without any text of ORDER bytes."""
    table = count_ngrams(docs, lang, text, order, CLASS).toArrow()
    groups = np.array(table.column("group").to_pylist(), object)
    codes, n = table.column("code").to_numpy().astype(np.uint64), table.column("n").to_numpy()
    counts = {g: (codes[groups == g], n[groups == g]) for g in sorted(set(groups.tolist()))}
    del table, groups, codes, n
    model = build_table(counts, order) if counts else None
    give_back()
    return model


class Speller:
    """Bits of words' spellings, between spaces, under their language's model."""

    def __init__(self, shared) -> None:
        self.shared = shared

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: list[str]) -> np.ndarray:
        names, table = self.shared.value or ([], None)
        size = ends - starts
        if table is None:
            return np.log2(CLASSES) * (size + 1.0)
        bounds = np.concatenate([[0], np.cumsum(size + 2)])
        symbols = np.full(bounds[-1], SPACE_CLASS, np.uint8)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        symbols[np.repeat(bounds[:-1] + 1, size) + inside] = CLASS[data[np.repeat(starts, size) + inside]]
        number = {g: i for i, g in enumerate(names)}
        group = np.array([number.get(g, len(names)) for g in langs], np.int64)
        space = table.score(symbols[:1], np.array([0, 1]), group[:1])[0][0] if len(group) else 0.0
        return space - table.score(symbols, bounds, group)[0]


def _counted(rows: pa.RecordBatch) -> dict[str, np.ndarray]:
    parts = [base_counts(data, offsets) for _, data, offsets in blocks(rows.column(0))]
    return {c: np.concatenate([p[c] for p in parts]) for c in COUNTS}


def score(docs: DataFrame, lang: str = "lang", text: str = "text", carry: list[str] | None = None, chunk: int = CHUNK, spelled: bool = True) -> DataFrame:
    """The columns carry (default: all), with the counts, base_failed, log_ppl (bits per word) and log_spelling (bits per character; both null without words)."""
    small_batches(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ADDED]
    speller = Speller(docs.sparkSession.sparkContext.broadcast(train_spelling(docs, lang, text))) if spelled else None
    found = scored(docs, text, lang, carry, COUNTS, _counted, chunk, speller)
    return found.select(*carry, *COUNTS, "log_ppl", (F.col("spelling") * F.col("n_words") / (F.col("word_chars") + F.col("n_words"))).alias("log_spelling"))


def bands(found: DataFrame, lang: str = "lang", widths: dict[str, tuple[float, float, float]] = BANDS) -> DataFrame:
    """__band (lang) and, for each score, its lower and upper: the values a language's documents may have."""
    quartiles = [F.percentile_approx(c, F.array(F.lit(0.5), F.lit(0.75)), 10_000).alias(f"__{c}") for c in widths]
    limits = found.where("not base_failed").groupBy(lang).agg(*quartiles)
    ends = []
    for c, (below, above, least) in widths.items():
        middle, upper = F.get(f"__{c}", F.lit(0)), F.get(f"__{c}", F.lit(1))
        spread = F.greatest(upper - middle, least * middle)
        ends += [(middle - spread * below).alias(f"{c}_lower"), (middle + spread * above).alias(f"{c}_upper")]
    return limits.select(F.col(lang).alias("__band"), *ends)


def quality_rules(docs: DataFrame, lang: str = "lang", text: str = "text", carry: list[str] | None = None, widths: dict[str, tuple[float, float, float]] = BANDS, chunk: int = CHUNK) -> DataFrame:
    """The columns carry, with counts, base_failed, the scores, their language's bands (lower and upper of each), and kept."""
    ends = [f"{c}_{end}" for c in widths for end in ("lower", "upper")]
    wanted = [c for c in (docs.columns if carry is None else carry) if c not in (*ADDED, *ends, "kept")]
    found = score(docs, lang, text, list(dict.fromkeys([*wanted, lang])), chunk)
    joined = found.join(bands(found, lang, widths), F.col(lang).eqNullSafe(F.col("__band")), "left")
    inside = F.lit(True)
    for c in widths:
        inside = inside & F.coalesce(F.col(c).between(F.col(f"{c}_lower"), F.col(f"{c}_upper")), F.lit(True))
    return joined.select(*wanted, *ADDED, *ends, (~F.col("base_failed") & inside).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality_rules(docs, carry=["doc_id"])
