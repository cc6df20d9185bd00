"""Alert severity analytics: strict replies, anchored ranks, agreement, confusion, judge bands, evidence statistics.

Ranking rows have model, alert_id, priority, rank (null unless parsed); judge rows have model, alert_id, score,
reasoning. Every report is one aggregation, or an equi-join and one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import field_name, lines, strip

# A priority's place on the five-step scale, and the fields that a reply may name.
ANCHOR = {1: 1, 2: 3, 3: 5}
RANKS = (1, 2, 3, 4, 5)
KNOWN_FIELDS = (
    "alert_id", "alert", "timestamp", "alert_message", "classification", "priority", "protocol", "service",
    "source_ip", "source_port", "destination_ip", "destination_port", "direction", "packet_length",
)
HIDDEN_FIELDS = ("rule_id", "gid", "sid", "rev")
REQUIRED, OPTIONAL = ("model_rank", "justification", "metrics_used"), ("mismatch_explanation", "matched_sid", "sid_evidence_document")
REPLY = "struct<model_rank:bigint,justification:string,mismatch_explanation:string,metrics_used:array<string>,matched_sid:bigint,sid_evidence_document:string>"


def anchored_rank(priority: Column) -> Column:
    """1 -> 1, 2 -> 3, 3 -> 5; anything else is an error."""
    out = F.when(priority == 1, ANCHOR[1])
    for p in (2, 3):
        out = out.when(priority == p, ANCHOR[p])
    return out.otherwise(F.raise_error(F.concat(F.lit("priority must be 1, 2 or 3, got "), F.coalesce(priority.cast("string"), F.lit("null")))).cast("int"))


def is_mismatch(rank: Column, priority: Column) -> Column:
    return F.abs(rank - anchored_rank(priority)) > 1


def parse_reply(content: Column) -> Column:
    """A reply of exactly one line of JSON with the required and no unknown keys, each of its exact type; else null."""
    text = strip(content)
    v = F.try_parse_json(text)
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    get = lambda name, to: F.try_variant_get(v, f"$.{name}", to)
    keys = F.json_object_keys(text)
    named = F.array(*map(F.lit, REQUIRED + OPTIONAL))
    metrics = get("metrics_used", "array<string>")
    absent = lambda name: kind(name).isNull() | (kind(name) == "VOID")
    fits = (
        (F.size(lines(text)) == 1)
        & F.schema_of_variant(v).startswith("OBJECT")
        & (F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), keys)) == 0)
        & (F.size(F.array_except(keys, named)) == 0)
        & (kind("model_rank") == "BIGINT")
        & get("model_rank", "bigint").between(1, 5)
        & (kind("justification") == "STRING")
        & (strip(get("justification", "string")) != "")
        & (kind("metrics_used") == "ARRAY<STRING>")
        & F.size(metrics).between(1, 60)
        & F.forall(metrics, lambda m: strip(m) != "")
        & (absent("mismatch_explanation") | (kind("mismatch_explanation") == "STRING"))
        & (absent("matched_sid") | (kind("matched_sid") == "BIGINT"))
        & (absent("sid_evidence_document") | (kind("sid_evidence_document") == "STRING"))
    )
    value = F.struct(
        get("model_rank", "bigint").alias("model_rank"), get("justification", "string").alias("justification"), get("mismatch_explanation", "string").alias("mismatch_explanation"),
        metrics.alias("metrics_used"), get("matched_sid", "bigint").alias("matched_sid"), get("sid_evidence_document", "string").alias("sid_evidence_document"),
    )
    return F.when(F.coalesce(fits, F.lit(False)), value.cast(REPLY))


def parse_verdict(content: Column) -> Column:
    """struct(score, reasoning) of a JSON object with these two keys alone, score in 0..1 (numbers in strings count), reasoning not empty; else null."""
    v = F.try_parse_json(content)
    score, reasoning = F.try_variant_get(v, "$.score", "double"), F.try_variant_get(v, "$.reasoning", "string")
    keys = F.json_object_keys(content)
    fits = (F.size(keys) == 2) & score.between(0, 1) & (F.schema_of_variant(F.try_variant_get(v, "$.reasoning", "variant")) == "STRING") & (reasoning != "")
    return F.when(F.coalesce(fits, F.lit(False)), F.struct(score.alias("score"), reasoning.alias("reasoning")))


def alert_query(alert: Column) -> Column:
    parts = F.array(*[F.nullif(alert[c], F.lit("")) for c in ("alert_message", "classification", "protocol", "service")])
    return F.array_join(F.array_compact(parts), " ")


def redacted(alert: Column) -> Column:
    """The alert as indented JSON without the fields that give the rule away."""
    return F.to_json(alert.dropFields(*HIDDEN_FIELDS), {"pretty": "true"})


def evidence_blocks(chunks: Column) -> Column:
    """[S1|document] ... [/S1] of array<struct(document, text)>."""
    n = lambda i: (i + 1).cast("string")
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("[S"), n(i), F.lit("|"), c["document"], F.lit("]\n"), c["text"], F.lit("\n[/S"), n(i), F.lit("]"))), "\n\n")


def agreement(rows: DataFrame) -> DataFrame:
    """Per model: rows, parsed, exact, two_off, mismatches and their rate over parsed, distinct ranks, collapsed."""
    anchor = anchored_rank(F.col("priority"))
    parsed = F.col("rank").isNotNull()
    wrong = parsed & (F.abs(F.col("rank") - anchor) > 1)
    return rows.groupBy("model").agg(
        F.count("*").alias("alerts"), F.count_if(parsed).alias("parsed"), F.count_if(F.col("rank") == anchor).alias("exact"), F.count_if(F.abs(F.col("rank") - anchor) == 2).alias("two_off"),
        F.count_if(wrong).alias("mismatches"), (F.count_if(wrong) / F.nullif(F.count_if(parsed), F.lit(0))).alias("mismatch_rate"),
        F.countDistinct("rank").alias("ranks_used"), (F.countDistinct("rank") == 1).alias("collapsed"),
    )


def confusion(rows: DataFrame) -> DataFrame:
    """Per model and priority: counts of ranks 1 to 5, and their total."""
    counts = rows.where("rank is not null").groupBy("model", "priority").agg(*[F.count_if(F.col("rank") == r).alias(f"rank_{r}") for r in RANKS])
    return counts.withColumn("total", sum((F.col(f"rank_{r}") for r in RANKS[1:]), F.col("rank_1")))


def mismatch_by_priority(rows: DataFrame) -> DataFrame:
    """Per model and priority, with a row of totals per model (priority null)."""
    parsed = rows.where("rank is not null").withColumn("__wrong", is_mismatch(F.col("rank"), F.col("priority")))
    each = parsed.groupBy("model", "priority").agg(F.count_if("__wrong").alias("mismatches"), F.count("*").alias("parsed"))
    total = each.groupBy("model").agg(F.lit(None).cast("int").alias("priority"), F.sum("mismatches").alias("mismatches"), F.sum("parsed").alias("parsed"))
    return each.select("model", F.col("priority").cast("int").alias("priority"), "mismatches", "parsed").unionByName(total)


def judge_summary(judged: DataFrame, rows: DataFrame) -> DataFrame:
    """Per model: n, mean, median, exact (1.0), close (0.5 and over), means over mismatches and over the others."""
    both = judged.join(rows.select("model", "alert_id", "rank", "priority"), ["model", "alert_id"], "left")
    wrong = F.coalesce(F.when(F.col("rank").isNotNull(), is_mismatch(F.col("rank"), F.col("priority"))), F.lit(False))
    return both.withColumn("__wrong", wrong).groupBy("model").agg(
        F.count("score").alias("n"), F.avg("score").alias("mean"), F.median("score").alias("median"), F.count_if(F.col("score") == 1.0).alias("exact"), F.count_if(F.col("score") >= 0.5).alias("close"),
        F.avg(F.when(F.col("__wrong"), F.col("score"))).alias("mismatch_mean"), F.avg(F.when(~F.col("__wrong"), F.col("score"))).alias("other_mean"),
    )


def judge_bands(judged: DataFrame) -> DataFrame:
    """Per model: counts of scores in [0, .2), [.2, .4), [.4, .6), [.6, .8) and [.8, 1]."""
    s = F.col("score")
    band = F.when(s < 0.2, 0).when(s < 0.4, 1).when(s < 0.6, 2).when(s < 0.8, 3).otherwise(4)
    return judged.where("score is not null").withColumn("__b", band).groupBy("model").agg(*[F.count_if(F.col("__b") == i).alias(f"band_{i}") for i in range(5)])


def lowest_scored(judged: DataFrame, k: int = 3) -> DataFrame:
    order = Window.partitionBy("model").orderBy("score", "reasoning", "alert_id")
    return judged.where("score is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def pair_agreement(rows: DataFrame) -> DataFrame:
    """Pairs of models (a < b): common parsed alerts and how many have equal ranks."""
    a = rows.where("rank is not null").select(F.col("model").alias("model_a"), "alert_id", F.col("rank").alias("__ra"))
    b = rows.where("rank is not null").select(F.col("model").alias("model_b"), "alert_id", F.col("rank").alias("__rb"))
    return a.join(b, "alert_id").where("model_a < model_b").groupBy("model_a", "model_b").agg(F.count("*").alias("common"), F.count_if(F.col("__ra") == F.col("__rb")).alias("agree"))


def run_comparison(now: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per model: common, changed, ranks used before and now; and the moved alerts (model, alert_id, before, after)."""
    n = now.where("rank is not null").select("model", "alert_id", F.col("rank").alias("after"))
    p = before.where("rank is not null").select("model", "alert_id", F.col("rank").alias("before"))
    both = n.join(p, ["model", "alert_id"])
    changed = both.groupBy("model").agg(F.count("*").alias("common"), F.count_if(F.col("after") != F.col("before")).alias("changed"))
    used = lambda df, c, name: df.groupBy("model").agg(F.countDistinct(c).alias(name))
    summary = changed.join(used(p, "before", "used_before"), "model").join(used(n, "after", "used_now"), "model")
    return summary, both.where("after <> before").orderBy("model", "alert_id", "before", "after")


def done_reasons(rows: DataFrame) -> DataFrame:
    return rows.select("model", F.explode("done_reasons").alias("reason")).groupBy("model", "reason").agg(F.count("*").alias("n"))


def failed_and_retried(rows: DataFrame) -> DataFrame:
    """Per model: how many failed, how many took two attempts."""
    return rows.groupBy("model").agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.size("attempts") == 2).alias("retried"))


def unknown_metrics(rows: DataFrame) -> DataFrame:
    """model, alert_id, token of reply fields that no record has."""
    tokens = rows.where("parsed is not null").select("model", "alert_id", F.explode("parsed.metrics_used").alias("token"))
    return tokens.where(~field_name(F.col("token")).isin(*KNOWN_FIELDS))


def sid_match(matched: Column, actual: Column) -> Column:
    """Null without a matched sid."""
    return F.when(matched.isNotNull(), matched == actual)


def documents_per_alert(chunks: DataFrame) -> DataFrame:
    """Per model: how many alerts drew on how many distinct documents. chunks: model, alert_id, document."""
    own = chunks.groupBy("model", "alert_id").agg(F.countDistinct("document").alias("documents"))
    return own.groupBy("model", "documents").agg(F.count("*").alias("alerts"))


def document_by_priority(chunks: DataFrame) -> DataFrame:
    """Per document: chunks of alerts of priority 1, 2, 3, and in all."""
    return chunks.groupBy("document").agg(*[F.count_if(F.col("priority") == p).alias(f"priority_{p}") for p in ANCHOR], F.count("*").alias("total"))


def evidence_scores(chunks: DataFrame) -> DataFrame:
    """One row: mean and maximum dense score (null counts 0), chunks of ISO documents, chunks with a control."""
    s = F.coalesce("score", F.lit(0.0))
    return chunks.agg(F.avg(s).alias("mean"), F.max(s).alias("max"), F.count_if(F.col("document").startswith("ISO")).alias("iso"), F.count("control_id").alias("controls"))


def short_evidence(rows: DataFrame) -> DataFrame:
    """Rows with fewer chunks than the most that any row has."""
    most = rows.agg(F.max(F.size("chunks")).alias("__most"))
    return rows.crossJoin(F.broadcast(most)).where(F.size("chunks") < F.col("__most")).drop("__most")  # one row


def top_labels(rows: DataFrame, label: str, order: str, k: int = 12) -> DataFrame:
    """The k most frequent labels; equal counts by first appearance."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    return counts.orderBy(F.desc("n"), "__first").limit(k).drop("__first")


def single_value(rows: DataFrame, column: str) -> str:
    """The one value of a column; more or none are an error."""
    found = [r[0] for r in rows.select(column).distinct().limit(2).collect()]
    if len(found) != 1:
        raise ValueError(f"{column} must have exactly one value")
    return found[0]


def duplicate_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def spot_check(rows: DataFrame, text: str, literal: str, expected: int = 1) -> DataFrame:
    """model, alert_id, rank and ok of the alerts whose text has the literal: whether each parsed rank is the expected one."""
    return rows.where(F.coalesce(F.col(text).contains(literal), F.lit(False))).select("model", "alert_id", "rank", (F.col("rank") == expected).alias("ok"))
