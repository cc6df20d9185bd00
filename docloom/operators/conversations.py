"""Conversation history: completed turns, recency, titles, upsert and deletion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import title_of

MOST = 20


def completed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: a user's message followed by the assistant's."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select("*", F.lead("role").over(order).alias("__next"), F.lead("text").over(order).alias("answer"))
    return rows.where("role = 'user' and __next = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def last_turns(conversations: DataFrame, n: int = 2) -> DataFrame:
    """The last n completed turns of each conversation; place 1 is the latest."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return completed_turns(conversations).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def titles(conversations: DataFrame) -> DataFrame:
    first = conversations.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("__q"))
    return first.select("conv_id", title_of(F.col("__q")).alias("title"))


def load_history(stored: DataFrame, most: int | None = MOST) -> DataFrame:
    """Valid conversations (id, title, created_at, updated_at, messages), the first of a repeated id, the latest ones (all if most is None)."""
    valid = (F.length("id") > 0) & (F.length("title") <= 60) & F.col("created_at").isNotNull() & F.col("updated_at").isNotNull() & F.forall("messages", lambda m: m["role"].isin("user", "assistant") & m["id"].isNotNull() & m["text"].isNotNull())
    first = Window.partitionBy("id").orderBy("place")
    own = stored.where(F.coalesce(valid, F.lit(False))).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return own if most is None else own.orderBy(F.desc("updated_at"), "place").limit(most)


def save_history(conversations: DataFrame, most: int | None = MOST) -> DataFrame:
    """What is kept: conversations with messages, the latest first (all, in no order, if most is None)."""
    own = conversations.where(F.size("messages") > 0)
    return own if most is None else own.orderBy(F.desc("updated_at"), "id").limit(most)


def upsert_front(history: DataFrame, new: DataFrame, most: int | None = MOST) -> DataFrame:
    return save_history(history.join(new.select("id"), "id", "left_anti").unionByName(new), most)


def delete(history: DataFrame, ids: DataFrame) -> DataFrame:
    return history.join(ids.select("id"), "id", "left_anti")


def recent(conversations: DataFrame, most: int = MOST) -> DataFrame:
    """conv_id, messages and last turn of the conversations with the most turns; a report of the top ones."""
    own = conversations.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))
    return own.orderBy(F.desc("last_turn"), F.desc("conv_id")).limit(most)
