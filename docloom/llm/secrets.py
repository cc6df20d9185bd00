"""Secret scans: fixed patterns plus a character Markov model.

Two first-order character models, one of random strings and one of ordinary tokens, are trained from labelled
samples. A long token is a secret if its log-likelihood ratio under the two, per pair of characters, is above a
threshold that is fitted on samples held out of the training: halfway between what LEAST_PRECISE of the
ordinary samples stay under and what LEAST_FOUND of the random ones exceed (the former, if that is higher). Ordinary samples are whole tokens: those of the texts outside the fixed patterns' matches,
words in the usual joins, and made-up dates, numbers, ids, paths, UUIDs and rulers. The models are
two tables over ASCII pairs, so their size is fixed (128 x 128); the ratio
table is a literal in the plan. Everything runs as native expressions in one pass over the texts without
a shuffle, so skew of any key does not matter, and each row needs memory for its own text only.

Positions of pattern matches come from splitting the text at the same pattern: the pieces between the
matches and the matches themselves alternate, so their lengths add up to the offsets (code points).

Defined results: a null text is an empty one and has no spans; repeated rows give repeated rows. Spans of
the method (kind ``markov``) are tokens of ``[A-Za-z0-9+/_=-]`` of at least ``min_length`` characters that
overlap no span of the fixed patterns. Extra columns stay; result columns replace columns of the
same name. With an empty or one-sided sample the method adds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import partitions, read

KINDS = ["assign", "access", "hex", "markov"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}+"
MIN_LENGTH, SMOOTHING, LEAST_PRECISE, LEAST_FOUND = 20, 50.0, 0.9995, 0.99
#: Bounds of the training sample: strings made at random, and documents whose words are identifiers.
N_RANDOM, N_DOCUMENTS = 20_000, 400
SPANS = "array<struct<start:int,kind:int,end:int>>"


def token_pattern(min_length: int) -> str:
    return rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{min_length},}}+"


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratios of ASCII pairs, the threshold of their mean, and the shares of held-out samples judged rightly."""

    ratio: list[float]
    threshold: float
    ordinary_kept: float = 0.0
    random_found: float = 0.0


def random_strings(spark: SparkSession, n: int = N_RANDOM) -> DataFrame:
    """Labelled samples: n reproducible random strings of 20 to 43 characters, in forms of base 64 and of letters and digits."""
    digest = F.sha2(F.concat(F.lit("random string "), "id"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    alnum = F.regexp_replace(base64, "[+/]", "")
    form = F.pmod("id", F.lit(5))
    text = F.when(form == 0, base64).when(form == 1, F.translate(base64, "+/", "-_")).when(form == 2, alnum).when(form == 3, F.lower(alnum)).otherwise(F.upper(alnum))
    size = F.pmod(F.xxhash64("id", F.lit("size")), F.lit(24)).cast("int") + MIN_LENGTH
    return spark.range(n).select(F.substr(text, F.lit(1), size).alias("text"), F.lit(1).alias("random"))


def _digits(n: int, *seed) -> Column:
    """n reproducible digits."""
    return F.lpad(F.pmod(F.xxhash64(*seed), F.lit(10**n)).cast("string"), n, "0")


def _date(mark: str, *seed) -> Column:
    day = F.date_add(F.lit("1990-01-01").cast("date"), F.pmod(F.xxhash64(*seed), F.lit(18_000)).cast("int"))
    return F.date_format(day, f"yyyy{mark}MM{mark}dd" if mark else "yyyyMMdd")


def made_strings(spark: SparkSession, n: int = N_RANDOM) -> DataFrame:
    """Labelled samples: n reproducible dates, numbers, UUIDs and rulers."""
    i, s = F.col("id"), F.lit
    h = F.md5(F.concat(s("uuid "), i))
    part = lambda a, b: F.substring(h, a, b)
    mark = F.get(F.array(*map(s, "=-_+/")), F.pmod(F.xxhash64(i), s(5)).cast("int"))
    forms = [
        F.concat_ws("-", _date("-", i), _date("-", i, s(1)), _digits(4, i)),
        F.concat_ws("/", _date("/", i), _digits(8, i, s(2))),
        F.concat(_date("", i), s("T"), _digits(6, i), s("Z-"), _digits(6, i, s(1))),
        F.concat_ws("-", _date("-", i), F.concat(s("T"), _digits(2, i)), _digits(2, i, s(3)), _digits(2, i, s(4))),
        F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)),
        F.concat_ws("-", *[_digits(4, i, s(k)) for k in range(5)]),
        F.concat(_digits(12, i), _digits(12, i, s(5))),
        F.concat(s("+"), _digits(2, i), s("-"), _digits(3, i), s("-"), _digits(7, i), s("-"), _digits(6, i, s(6))),
        F.repeat(mark, (F.pmod(i, s(60)) + MIN_LENGTH).cast("int")),
        F.repeat(F.concat(mark, F.get(F.array(*map(s, "=-_+/")), F.pmod(F.xxhash64(i, s(1)), s(5)).cast("int"))), (F.pmod(i, s(40)) + 10).cast("int")),
        F.repeat(F.substring(F.lower(h), 1, 1), (F.pmod(i, s(40)) + MIN_LENGTH).cast("int")),
    ]
    pick = F.get(F.array(*forms), F.pmod(i, s(len(forms))).cast("int"))
    return spark.range(n).select(pick.alias("text"), s(0).alias("random"))


def ordinary_strings(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N_DOCUMENTS) -> DataFrame:
    """Labelled samples of about n documents, picked by a hash of key and text: their long tokens outside the fixed
    patterns' matches, and their words alone and in the usual joins, with numbers and dates between them."""
    total = docs.count()
    share = 1.0 if total <= n else n / total
    body = F.coalesce(F.col(text), F.lit(""))
    picked = docs.where(F.pmod(F.xxhash64(F.col(key).cast("string"), body), F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)).select(body.alias("__x"))
    own = picked.repartition(partitions(docs.sparkSession))
    clear = F.regexp_replace(F.regexp_replace(F.regexp_replace("__x", ASSIGN, " "), ACCESS, " "), HEX, " ")
    tokens = own.select(F.explode(F.array_distinct(F.regexp_extract_all(clear, F.lit(token_pattern(8)), F.lit(0)))).alias("text"))
    word = own.select(F.regexp_extract_all("__x", F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w")).where("size(w) > 0")
    at = word.select(F.posexplode(F.transform("w", lambda x, i: F.struct(x.alias("a"), F.coalesce(F.get("w", i + 1), x).alias("b"), F.coalesce(F.get("w", i + 2), x).alias("c")))).alias("i", "t")).select("i", "t.*")
    a, b, c, i = (F.col(x) for x in ("a", "b", "c", "i"))
    low = [F.lower(x) for x in (a, b, c)]
    forms = [
        a, F.upper(a), low[0], F.concat(low[0], F.initcap(b), F.initcap(c)), F.concat(F.initcap(a), F.initcap(b), F.initcap(c)), F.concat_ws("_", *low), F.concat_ws("-", *low), F.concat_ws("/", *low), F.concat_ws("=", low[0], low[1]),
        F.concat_ws("_", F.upper(a), _digits(10, a, i), F.substring(_date("-", b, i), 1, 4), F.upper(b), F.concat(F.lit("Q"), F.pmod(i, F.lit(4)) + 1)), F.concat_ws("_", *[F.upper(x) for x in (a, b, c)]),
        F.concat_ws("/", low[0], _date("/", a, i), F.concat_ws("-", low[1], _date("-", b, i))), F.concat_ws("-", low[0], _digits(4, a, i), low[1], _digits(2, b, i)), F.concat_ws("/", low[0], low[1], F.concat(low[2], _digits(3, c, i))), F.concat(low[0], _digits(4, a, i), F.lit("_"), _digits(6, b, i)),
        F.concat_ws("-", F.upper(F.substring(a, 1, 3)), _digits(4, a, i), _digits(6, b, i), F.upper(F.substring(b, 1, 2))),
    ]
    joined = at.select(F.explode(F.array(*forms)).alias("text"))
    return joined.unionByName(tokens).select("text", F.lit(0).alias("random"))


def pair_ratios(samples: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """Log-likelihood ratios (random over ordinary) of ASCII pairs, at 128 * first + second.

    Spark counts the pairs, map-side first; at most 2 x 128 x 128 counts reach the driver.
    """
    codes = F.transform(F.split("text", ""), lambda c: F.least(F.ascii(c), F.lit(127)))
    pairs = samples.select("random", codes.alias("c")).select(
        "random", F.explode(F.zip_with(F.slice("c", F.lit(1), F.size("c") - 1), F.slice("c", F.lit(2), F.size("c") - 1), lambda a, b: a * 128 + b)).alias("pair")
    )
    counts: list[dict[int, int]] = [{}, {}]
    for label, pair, n in pairs.groupBy("random", "pair").count().collect():
        counts[label][pair] = n
    if not counts[0] or not counts[1]:
        return [0.0] * (128 * 128)
    symbols = sorted({s for c in counts for p in c for s in divmod(p, 128)})
    models = []
    for c in counts:  # each row is smoothed towards the frequencies of its second characters, and these to equal ones
        after, before = ({x: sum(n for p, n in c.items() if divmod(p, 128)[k] == x) for x in symbols} for k in (1, 0))
        total = sum(after.values())
        share = {x: (after[x] + smoothing) / (total + smoothing * len(symbols)) for x in symbols}
        models.append({128 * x + y: (c.get(128 * x + y, 0) + smoothing * share[y]) / (before[x] + smoothing) for x in symbols for y in symbols})
    ratio = [0.0] * (128 * 128)
    for p, q in models[1].items():
        ratio[p] = round(math.log(q / models[0][p]), 6)
    return ratio


def log_ratio(token: Column, ratio: list[float]) -> Column:
    """Native expression: the log-likelihood ratio of a token's pairs."""
    table = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")  # folded to one literal
    codes = lambda t: F.transform(F.split(t, ""), lambda c: F.least(F.ascii(c), F.lit(127)))
    pairs = F.zip_with(F.slice(codes(token), F.lit(1), F.greatest(F.length(token) - 1, F.lit(0))), F.slice(codes(token), F.lit(2), F.greatest(F.length(token) - 1, F.lit(0))), lambda a, b: F.get(table, a * 128 + b))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def mean_ratio(token: Column, ratio: list[float]) -> Column:
    return log_ratio(token, ratio) / F.greatest(F.length(token) - 1, F.lit(1))


def train(samples: DataFrame, smoothing: float = SMOOTHING, precise: float = LEAST_PRECISE, found: float = LEAST_FOUND) -> Model:
    """The model of samples (text, random): four of five, picked by a hash, for the tables, and the long ones of the rest for the threshold."""
    part = F.pmod(F.xxhash64("text", F.lit("part")), F.lit(5))
    ratio = pair_ratios(samples.where(part > 0), smoothing)
    held = samples.where((part == 0) & (F.length("text") >= MIN_LENGTH)).select("random", mean_ratio(F.col("text"), ratio).alias("m"))
    at = lambda label, share: F.percentile_approx(F.when(F.col("random") == label, F.col("m")), F.lit(share), F.lit(100_000))
    ends = held.agg(at(0, precise).alias("ordinary"), at(1, 1 - found).alias("random")).first()
    if ends["ordinary"] is None or ends["random"] is None:
        return Model(ratio, math.inf)
    limit = max(ends["ordinary"], (ends["ordinary"] + ends["random"]) / 2, 0.0)
    shares = held.agg(F.avg(F.when(F.col("random") == 0, (F.col("m") <= limit).cast("int"))).alias("kept"), F.avg(F.when(F.col("random") == 1, (F.col("m") > limit).cast("int"))).alias("found")).first()
    return Model(ratio, limit, shares["kept"] or 0.0, shares["found"] or 0.0)


def _matches(text: Column, pattern: str, kind: int, keep_group: int = 0, least: int = 0) -> Column:
    """Spans of the pattern's matches; those whose group is shorter than least are dropped."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    checked = F.regexp_extract_all(text, F.lit(pattern), F.lit(keep_group))
    rows = F.zip_with(F.zip_with(found, checked, lambda m, g: F.struct(F.length(m).alias("m"), F.length(g).alias("g"))), F.slice(pieces, F.lit(1), F.size(found)), lambda m, p: F.struct(m["m"].alias("m"), m["g"].alias("g"), F.length(p).alias("p")))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("s"))
    span = lambda a, x: F.struct((a["at"] + x["p"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + x["p"] + x["m"]).alias("end"))
    step = lambda a, x: F.struct((a["at"] + x["p"] + x["m"]).alias("at"), F.when(x["g"] >= least, F.array_append(a["s"], span(a, x))).otherwise(a["s"]).alias("s"))
    return F.when(text.rlike(pattern), F.aggregate(rows, zero, step, lambda a: a["s"])).otherwise(F.array().cast(SPANS))


def find_secrets(docs: DataFrame, model: Model, text: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """docs with secret_spans: an array of (start, kind, end), sorted; kind counts as in KINDS."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(_matches(body, ASSIGN, 0, 2, 12), _matches(body, ACCESS, 1, 0, 18), _matches(body, HEX, 2))
    tokens = _matches(body, token_pattern(min_length), 3)
    keep = [c for c in docs.columns if c != "secret_spans"]
    first = docs.select(*keep, body.alias("__b"), F.array_sort(base).alias("__base"), tokens.alias("__tokens"))
    clear = F.filter("__tokens", lambda t: ~F.exists("__base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    random = F.filter(clear, lambda t: mean_ratio(F.substring(F.col("__b"), t["start"] + 1, t["end"] - t["start"]), model.ratio) > model.threshold)
    method = F.when(F.size("__tokens") > 0, random).otherwise(F.array().cast(SPANS))
    return first.select(*keep, F.array_sort(F.concat("__base", method)).alias("secret_spans"))


def redact(docs: DataFrame, model: Model, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with every secret span of the text replaced by mark; overlapping spans become one."""
    found = find_secrets(docs, model, text, **options)
    zero = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))
    gap = lambda a, s: F.substring(F.col(text), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
    step = lambda a, s: F.struct(F.when(s["start"] < a["at"], a["t"]).otherwise(F.concat(a["t"], gap(a, s), F.lit(mark))).alias("t"), F.greatest(a["at"], s["end"]).alias("at"))
    clean = F.aggregate("secret_spans", zero, step, lambda a: F.concat(a["t"], F.substring(F.col(text), a["at"] + 1, F.length(text))))
    return found.select(*[F.when(F.size("secret_spans") > 0, clean).otherwise(F.col(text)).alias(c) if c == text else c for c in docs.columns])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def default_model(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """The model of the random, the made-up and the documents' ordinary strings."""
    spark = docs.sparkSession
    return train(random_strings(spark).unionByName(made_strings(spark)).unionByName(ordinary_strings(docs, key, text)))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, default_model(docs)).select("doc_id", "secret_spans")
    count = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans")
    )
