"""Chat formatting with cumulative-snapshot collapse.

Chat services often log a conversation again after every turn, so the log holds many conversations that
are only the beginning of a longer one. Each conversation gets the rolling hashes of its turn prefixes
(two running sums of 64-bit hashes of place, role and text). A conversation whose full hash is a
proper-prefix hash of another one is a snapshot; an anti-join removes it. Of conversations with equal
turns the smallest conv_id stays. What remains is rendered with a chat template.

Scale: a turn is a row of two 16-byte hashes until the anti-join, and a running window makes the prefix hashes, so the
work is linear in the turns and a long conversation is sorted on disk, not held. Full hashes and prefix hashes are
aggregated (map-side first) before they meet, so a first turn or a conversation that is logged very often
costs one row per task. The texts are shuffled once, for conversations that stay; a rendered
conversation is one string.

Defined results: turns are ordered by turn (nulls last), then role, then the MD5 of the text; a null role is
``unknown`` and a null text is empty; rows that repeat (conv_id, turn, role, text) count once; rows
with a null conv_id are one conversation. Template marks inside of a role or text get a backslash after their first
character (one more if they have some already), and line ends in a role become spaces, so no text can begin a turn, and
what was written can be read back. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import read

START, END = "<|im_start|>", "<|im_end|>"
MARK = r"<(\\*)\|(im_start|im_end)\|>"


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").alias("__c"),
        F.coalesce(F.col("turn").cast("long"), F.lit(2**63 - 1)).alias("__n"),
        F.coalesce("role", F.lit("unknown")).alias("__r"),
        F.coalesce("text", F.lit("")).alias("__x"),
    )


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(F.to_binary(text, F.lit("utf-8"))))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (so far), h1 and h2 (the prefix's hash) and whole (nothing follows), for each turn prefix."""
    rows = _turns(conversations).select("__c", "__n", "__r", _digest(F.col("__x")).alias("__t")).distinct()  # repeated log lines count once
    order = Window.partitionBy("__c").orderBy("__n", "__r", "__t")
    placed = rows.withColumn("__k", F.row_number().over(order)).withColumn("__next", F.lead("__k").over(order))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    term = lambda seed: F.sum(F.xxhash64(F.lit(seed), "__k", "__r", "__t").cast("decimal(20,0)")).over(running)
    return placed.select(F.col("__c").alias("conv_id"), F.col("__k").alias("turns"), term("one").alias("h1"), term("two").alias("h2"), F.col("__next").isNull().alias("whole"))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that no longer one begins with."""
    chains = prefix_hashes(conversations)
    whole = chains.where("whole").groupBy("h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.min("turns").alias("n_turns"), F.count("*").alias("n_copies"))
    shorter = chains.where("not whole").select("h1", "h2").distinct()
    return whole.join(shorter, ["h1", "h2"], "left_anti").drop("h1", "h2")


def escaped(text: Column) -> Column:
    """A text without template marks: each gets one more backslash after its first character."""
    return F.regexp_replace(text, MARK, r"<\\$1|$2|>")


def render(conversations: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per conversation of chosen (conv_id, ...): its columns and the rendered text."""
    rows = _turns(conversations).join(chosen.select(F.col("conv_id").alias("__k")), F.col("__c").eqNullSafe(F.col("__k")), "left_semi")
    groups = rows.groupBy("__c").agg(F.array_sort(F.collect_set(F.struct("__n", "__r", _digest(F.col("__x")).alias("__t"), "__x"))).alias("__s"))
    line = lambda t: F.concat(F.lit(START), escaped(F.regexp_replace(t["__r"], r"[\r\n]+", " ")), F.lit("\n"), escaped(t["__x"]), F.lit(f"{END}\n"))
    texts = groups.select("__c", F.array_join(F.transform("__s", line), "").alias("rendered"))
    return chosen.join(texts, F.col("conv_id").eqNullSafe(F.col("__c"))).drop("__c")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and rendered for every maximal conversation."""
    return render(conversations, maximal_conversations(conversations))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read(spark, sf_dir, "conversations")).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "rendered")


_SAFE = r"regexp_replace({0}, '<(\\*)\|(im_start|im_end)\|>', '<\\\1|\2|>', 'g')"
_ROLE = r"regexp_replace(r, '[\r\n]+', ' ', 'g')"
OP8_SQL = f"""
with t as (select distinct conv_id, coalesce(turn, 9223372036854775807) as n, coalesce(role, 'unknown') as r, coalesce(text, '') as x from conversations),
c as (select conv_id, list(struct_pack(r := r, x := x) order by n, r, md5(x)) as turns,
  string_agg('{START}' || {_SAFE.format(_ROLE)} || chr(10) || {_SAFE.format("x")} || '{END}' || chr(10), '' order by n, r, md5(x)) as rendered from t group by conv_id),
whole as (select turns, min(conv_id) as conv_id, count(*) as n_copies, min_by(rendered, conv_id) as rendered from c group by turns),
shorter as (select distinct list_slice(turns, 1, k) as turns from (select turns, unnest(range(1, len(turns))) as k from whole))
select conv_id, len(turns)::bigint as n_turns, n_copies, rendered from whole where turns not in (select turns from shorter)"""
