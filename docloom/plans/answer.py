"""Answering: query rewriting, retrieval, prompts, generation, refusal - over a table of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import QUERY_PREFIX, Settings
from docloom.functions.providers import Embedder, Generator, embed, generate
from docloom.functions.text import is_refusal, strip
from docloom.operators.fusion import retrieve
from docloom.operators.lexical import LexicalIndex

GROUNDING = "Answer the question from the context alone and cite the blocks you use. If the context does not answer it, reply: "
REWRITE = "Rewrite the question as one search query that stands on its own. Resolve what it refers to from the conversation. Reply with the query alone."
REPLY_CHARS, HISTORY_TURNS = 300, 2


def prompt_of(question: Column, blocks: Column, settings: Settings = Settings()) -> Column:
    return F.concat(F.lit("CONTEXT\n"), blocks, F.lit("\n\nQUESTION\n"), question, F.lit(f"\n\nINSTRUCTION\n{GROUNDING}{settings.refusal_message}"))


def blocks_of(texts: Column) -> Column:
    """[S1]...[/S1] of array<string>."""
    n = lambda i: (i + 1).cast("string")
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("[S"), n(i), F.lit("]\n"), t, F.lit("\n[/S"), n(i), F.lit("]"))), "\n\n")


def rewrite_prompt(question: Column, history: Column) -> Column:
    """history: array<struct(question, answer)>, oldest first."""
    last = F.slice(history, F.greatest(F.size(history) - HISTORY_TURNS + 1, F.lit(1)), F.lit(HISTORY_TURNS))
    context = F.array_join(F.transform(last, lambda h: F.concat(F.lit("QUESTION\n"), h["question"], F.lit("\n\nANSWER\n"), h["answer"])), "\n\n")
    return F.concat(F.lit("CONTEXT\n"), context, F.lit("\n\nQUESTION\n"), question, F.lit(f"\n\nINSTRUCTION\n{REWRITE}"))


def rewritten(question: Column, reply: Column) -> Column:
    """The reply's first line without matching quotes; the question for an error, a long or an empty reply."""
    first = F.coalesce(F.get(F.filter(F.transform(F.split(reply, r"\r?\n"), strip), lambda x: x != ""), F.lit(0)), F.lit(""))
    bare = F.when(first.rlike(r"""^(["']).*\1$""") & (F.length(first) >= 2), strip(F.substring(first, F.lit(2), F.length(first) - 2))).otherwise(first)
    return F.when(reply.isNull() | (F.length(reply) > REPLY_CHARS) | (bare == ""), question).otherwise(bare)


def ask(questions: DataFrame, chunks: DataFrame, index: LexicalIndex | None, embedder: Embedder, generator: Generator, limit: int = 5, settings: Settings = Settings(), reranker: Callable | None = None, model: str | None = None, key: str = "id") -> DataFrame:
    """question_id, question, answer, refused, model, rewritten_question and sources of each question.

    questions: question_id, question, and history (array<struct(question, answer)>) if there is any. The
    rewritten question retrieves, the asked one is answered. Without sources the answer is the refusal and
    no model is called.
    """
    name = F.lit(model or settings.default_model)
    own = questions if "history" in questions.columns else questions.withColumn("history", F.array().cast("array<struct<question:string,answer:string>>"))
    needs = F.size("history") > 0
    # Only questions with a history go to the model.
    asked = own.where(needs).withColumn("__reply", generate(rewrite_prompt(F.col("question"), F.col("history")), name, generator)).unionByName(own.where(~needs).withColumn("__reply", F.lit(None).cast("string")))
    search = asked.withColumn("__search", F.when(needs, rewritten(F.col("question"), F.col("__reply"))).otherwise(F.col("question")))
    queries = search.select(F.col("question_id").alias("query_id"), F.col("__search").alias("query_text"), embed(F.col("__search"), embedder, QUERY_PREFIX).alias("query_vector"))
    found = retrieve(chunks, queries, limit, key, "embedding", index=index, reranker=reranker, settings=settings)
    columns = [c for c in ("doc_name", "section", "page", "control_id") if c in chunks.columns]
    rows = found.join(chunks.select(key, "text", *columns), key)
    source = F.struct("rank", F.col(key).alias("id"), "text", "score", *columns)
    sources = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    ready = search.join(sources, F.col("question_id") == F.col("query_id"), "left").drop("query_id")
    prompt = prompt_of(F.col("question"), blocks_of(F.transform("sources", lambda s: s["text"])), settings)
    reply = generate(F.when(F.size("sources") > 0, prompt), name, generator)
    out = ready.withColumn("__answer", reply).withColumn("answer", F.coalesce("__answer", F.lit(settings.refusal_message)))
    changed = F.when(F.col("__search") != F.col("question"), F.col("__search"))
    return out.select("question_id", "question", "answer", is_refusal(F.col("answer"), settings.refusal_message).alias("refused"), name.alias("model"), changed.alias("rewritten_question"), F.coalesce("sources", F.array().cast(out.schema["sources"].dataType)).alias("sources"))


def stream_answer(prompt: str, model: str, tokens: Callable[[str, str], Iterator[str]]) -> Iterator[dict]:
    """Events of one answer on the driver: a token event for each piece, then the final text."""
    parts: list[str] = []
    for piece in tokens(prompt, model):
        parts.append(piece)
        yield {"event": "token", "text": piece}
    yield {"event": "final", "text": "".join(parts)}
