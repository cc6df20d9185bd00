"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: for every context of up to ORDER - 1 bytes the counts of the
bytes that followed, and an escape probability (method C: distinct / (total + distinct)) for bytes that
never did. A text's exact code length under a language's frozen tree is the sum of -log2 p over its bytes;
the language with the shortest code wins, and the score is its share of the likelihoods.

Spark counts the n-grams of the training rows: all rows with a language if there are few, else a sample
of about ``per_language`` documents of each, picked by a hash of key and text (a documented bound for fitting a
classifier). The trees of all languages are merged into one table with one column a language, whose size
is bounded by that sample, and broadcast. Prediction is one pass over the texts without a shuffle.

The share says which language fits best, not that any fits: of a text in a language that was never learned, or
of noise, one is still the likeliest. ``usual_bits`` gives the bits per byte that labelled rows of each language
need; a text that needs several times as many is in none of them.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if there
is no training row. Equal code lengths: the alphabetically first language. Texts count whole. Repeated
rows give repeated rows; only the columns asked for are returned, so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import drop_table, give_back, materialize, read, small_batches, tidy
from docloom.llm.ngrams import BackoffTable, HashArrays, Level, count_ngrams, lower_order, merged
from docloom.llm.textblocks import U, blocks, sums
from docloom.operators.selection import exact_quantile

ORDER = 5
PER_LANGUAGE = 4000
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _tree(codes: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, ...]]:
    """For order 1 .. order: grams, their counts, contexts, totals and numbers of distinct successors."""
    out = []
    for k in range(order, 0, -1):
        contexts, totals = merged(codes >> U(8), counts)
        distinct = merged(codes >> U(8), np.ones(len(codes), np.int64))[1]
        out.append((codes, counts, contexts, totals, distinct))
        codes, counts = lower_order(codes, counts, k)
    return out[::-1]


def build_table(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> tuple[list[str], BackoffTable]:
    """Languages, sorted, and their trees as one table."""
    names = sorted(counts)
    trees = [_tree(*merged(*counts[g]), order) for g in names]
    floor = -8.0  # one of 256 bytes
    levels: list[Level] = []
    for k in range(1, order + 1):
        grams = np.unique(np.concatenate([t[k - 1][0] for t in trees]))
        contexts = np.unique(np.concatenate([t[k - 1][2] for t in trees]))
        lower = np.zeros((len(names), len(contexts)))
        logp = np.zeros((len(names), len(grams)))
        tail = grams & U((1 << (8 * (k - 1))) - 1)
        for c, t in enumerate(trees):
            own, n, ctx, total, distinct = t[k - 1]
            at = np.searchsorted(contexts, ctx)
            lower[c, at] = np.log2(distinct / (total + distinct))
            # Unknown to this language: escape, then what the shorter gram has (it is in the table below).
            below = np.full(len(grams), floor) if k == 1 else levels[-1].logp[c, np.searchsorted(levels[-1].grams.codes, tail)]
            logp[c] = lower[c, np.searchsorted(contexts, grams >> U(8))] + below
            parent = np.searchsorted(ctx, own >> U(8))
            logp[c, np.searchsorted(grams, own)] = np.log2(n / (total[parent] + distinct[parent]))
        levels.append(Level(HashArrays(grams), logp.astype(np.float32), HashArrays(contexts), lower.astype(np.float32)))
    return names, BackoffTable(levels, floor, len(names))


def _sample(docs: DataFrame, lang: str, text: str, key: str, per_language: int, seed: str) -> DataFrame | None:
    """About per_language labelled rows (__l, __x) of each language; None if there are none."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("__l"), F.col(text).alias("__x"), F.col(key).alias("__k"))
    sizes = {r["__l"]: r["count"] for r in rows.groupBy("__l").count().collect()}
    if not sizes:
        return None
    pick = F.pmod(F.xxhash64(F.col("__k").cast("string"), "__x", F.lit(seed)), F.lit(1_000_000))
    share: Column = F.lit(False)
    for g, n in sorted(sizes.items()):
        share = share | ((F.col("__l") == g) & (pick < F.lit(int(min(1.0, per_language / n) * 1_000_000))))
    return rows.where(share).select("__l", "__x")


def train(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", per_language: int = PER_LANGUAGE, order: int = ORDER) -> tuple[list[str], BackoffTable] | None:
    """The model of docs' labelled rows; None if there are none."""
    rows = _sample(docs, lang, text, key, per_language, "language")
    if rows is None:
        return None
    table = count_ngrams(rows, "__l", "__x", order).toArrow()
    groups = np.array(table.column("group").to_pylist())
    codes, n = table.column("code").to_numpy().astype(np.uint64), table.column("n").to_numpy()
    counts = {g: (codes[groups == g], n[groups == g]) for g in sorted(set(groups.tolist()))}
    del table, groups, codes, n
    model = build_table(counts, order) if counts else None
    give_back()
    return model


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = sums(IS_LETTER[data].astype(np.int64), offsets) > 0
    for i in np.flatnonzero(~found):  # rare: look at the other scripts' characters
        found[i] = any(ch.isalpha() for ch in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def predict_block(model, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and bits per byte of each text of a block."""
    n = len(offsets) - 1
    letters = has_letter(data, offsets)
    if model is None:
        return np.full(n, "und", object), np.zeros(n), np.zeros(n)
    names, table = model
    logp = table.score(data, offsets)
    best = logp.argmax(axis=0)
    top = logp.max(axis=0)
    score = 1 / np.exp2(np.maximum(logp - top, -1000)).sum(axis=0)
    lang = np.array(names, object)[best]
    lang[~letters] = "und"
    return lang, np.where(letters, score, 0.0), -top / np.maximum(np.diff(offsets), 1)


def median_bits(found: DataFrame, lang: str = "lang", predicted: str = "lang_pred", bits: str = "bits_per_byte") -> dict[str, float]:
    """The exact median bits per byte of each language, of all labelled rows that the model puts there; found is read several times."""
    own = found.where(F.col(lang) == F.col(predicted)).select(F.col(predicted).alias("l"), F.col(bits).alias("b"))
    return {r["l"]: r["m"] for r in exact_quantile(own, ["l"], "b", 0.5, "m").collect()}  # languages of the model, which the driver holds


def usual_bits(docs: DataFrame, model, lang: str = "lang", text: str = "text") -> dict[str, float]:
    """The median bits per byte of each language, of all labelled rows that the model puts there."""
    if model is None:
        return {}
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("__l"), F.col(text).alias("__x"))
    found = materialize(identify(rows, model, "__x", ["__l"]), "bits")
    bits = median_bits(found, "__l")
    drop_table(found)
    return bits


def identify(docs: DataFrame, model, text: str = "text", carry: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "lang_score", "bits_per_byte")) -> DataFrame:
    """The columns carry (default: all) with lang_pred, lang_score and bits_per_byte (or ``names``); they replace columns of these names."""
    spark = docs.sparkSession
    small_batches(spark)
    added = list(names)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in added]
    shared = spark.sparkContext.broadcast(model)
    # A carried text crosses to Python once.
    once = text in carry and isinstance(docs.schema[text].dataType, T.StringType)
    columns = carry if once else [*carry, "__text"]
    at = columns.index(text if once else "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [predict_block(shared.value, data, offsets) for _, data, offsets in blocks(batch.column(at))]
            if parts:
                lang, score, bits = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(lang, pa.string()), pa.array(score), pa.array(bits)], names=[*carry, *added])

    inner = docs.select(*carry) if once else docs.select(*carry, F.col(text).cast("string").alias("__text"))
    fields = [T.StructField(c, docs.schema[c].dataType) for c in carry] + [T.StructField(c, T.StringType() if c == names[0] else T.DoubleType()) for c in added]
    return inner.mapInArrow(tidy(run), T.StructType(fields))


def fold(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 4


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = train(docs.where(fold(F.col("doc_id")) != 2))
    found = identify(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "bits_per_byte")
