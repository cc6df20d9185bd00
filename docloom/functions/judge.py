"""Judging answers: lax parsing of judgments, cache keys, and a judge over a table with a cache."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.providers import Attempts
from docloom.schemas import JUDGMENT

CRITERIA = {"correctness": (), "completeness": ("missing_claim_ids",), "faithfulness": ("unsupported_claims", "contradicted_claims"), "relevance": ()}
VERDICTS = ("pass", "partial", "fail")
REPAIR_CHARS = 8000


def canonical_json(value: object) -> str:
    """Sorted compact ASCII JSON; what JSON has no form for is an error."""
    try:
        return json.dumps(value, sort_keys=True, separators=(",", ":"))
    except (TypeError, ValueError) as e:
        raise ValueError("inputs must have a JSON form") from e


def cache_key(inputs: dict) -> str:
    for name in ("question_id", "candidate_answer"):
        if not str(inputs.get(name, "")).strip():
            raise ValueError(f"{name} must not be empty")
    return hashlib.sha256(canonical_json(inputs).encode()).hexdigest()


#: What a verdict depends on besides the answer and its references: the rubric's and the request's settings.
REQUEST = {
    "provider": "local", "judge_model": "rule", "prompt_version": "1", "prompt_hash": "", "temperature": 0.0, "reasoning_effort": "low", "include_reasoning": False, "max_completion_tokens": 2048,
    "sdk_max_retries": 0, "max_request_attempts": 5, "max_retry_delay_seconds": 60.0, "response_schema": {name: ["score", "justification", *lists] for name, lists in CRITERIA.items()} | {"verdict": list(VERDICTS)},
}
JUDGED = ("question_id", "question", "candidate_answer", "reference_answer", "reference_answers", "gold_claims", "gold_evidence", "retrieved_context")


def judge_keys(results: DataFrame, request: dict | None = None) -> DataFrame:
    """question_id, candidate_model and cache_key of results with an answer: a hash over the eight judged inputs and the twelve settings.

    Of the retrieved chunks those used for the answer count. Another setting, schema or prompt gives other keys.
    """
    settings = REQUEST | (request or {})
    used = F.filter("retrieved_chunks", lambda c: F.coalesce(c["used_for_generation"], F.lit(False)))
    own = results.where("trim(question_id) <> '' and trim(generated_answer) <> ''").select("question_id", "candidate_model", "question", F.col("generated_answer").alias("candidate_answer"), "reference_answer", "reference_answers", "gold_claims", "gold_evidence", used.alias("retrieved_context"))

    @F.pandas_udf(T.StringType())
    def key(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: cache_key(json.loads(r) | settings))

    payload = F.to_json(F.struct(*JUDGED), {"ignoreNullFields": "false"})
    return own.select("question_id", "candidate_model", key(payload).alias("cache_key"))


def _whole(value: object, low: int, high: int) -> int | None:
    """An integer in range: also true and false, whole floats, and digits in a string."""
    try:
        n = int(value) if isinstance(value, (bool, int)) else int(value) if isinstance(value, float) and value.is_integer() else int(value.strip()) if isinstance(value, str) else None
    except ValueError:
        return None
    return n if n is not None and low <= n <= high else None


def parse_judgment(reply: str | None) -> dict | None:
    """The judgment of a reply; unknown or missing keys, wrong types and ranges give None."""
    try:
        raw = json.loads(reply or "")
    except ValueError:
        return None
    if not isinstance(raw, dict) or set(raw) != {*CRITERIA, "verdict"} or raw["verdict"] not in VERDICTS:
        return None
    out: dict = {"verdict": raw["verdict"]}
    for name, lists in CRITERIA.items():
        part = raw[name]
        if not isinstance(part, dict) or set(part) != {"score", "justification", *lists}:
            return None
        score = _whole(part["score"], 0, 4)
        ok = score is not None and isinstance(part["justification"], str) and part["justification"] and all(isinstance(part[x], list) and all(isinstance(y, str) for y in part[x]) for x in lists)
        if not ok:
            return None
        out[name] = part | {"score": score}
    return out


@F.pandas_udf(T.StringType())
def judgment_json(replies: pd.Series) -> pd.Series:
    """Canonical JSON of each reply's judgment, null if it has none."""
    return replies.map(lambda r: None if (j := parse_judgment(r)) is None else canonical_json(j))


def judge_rows(rows: DataFrame, cache: DataFrame, request: Callable[[str], str], payload: str = "payload", attempts: int = 5) -> DataFrame:
    """rows with cache_key, judgment, raw_response, cache_hit and error. Only payloads that the cache lacks are sent, each once.

    A reply without a judgment is sent back once, cut to its first characters, for repair.
    """
    keyed = rows.withColumn("cache_key", F.sha2(payload, 256))
    known = keyed.join(cache.select("cache_key", F.col("raw_response").alias("__raw")), "cache_key", "left")
    ask = known.where("__raw is null").select("cache_key", payload).dropDuplicates(["cache_key"])

    def send(parts):
        for part in parts:
            out = []
            for key, text in zip(part["cache_key"], part[payload]):
                budget = Attempts(attempts)
                try:
                    reply = budget.call(lambda t=text: request(t))
                    if parse_judgment(reply) is None:
                        reply = budget.call(lambda r=reply, t=text: request(f"{t}\n\nREPAIR\n{r[:REPAIR_CHARS]}"))
                    out.append((key, reply, None if parse_judgment(reply) else "no judgment"))
                except Exception as e:
                    out.append((key, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["cache_key", "__new", "__error"])

    answered = ask.mapInPandas(send, "cache_key string, __new string, __error string")
    both = known.join(answered, "cache_key", "left").withColumn("raw_response", F.coalesce("__raw", "__new"))
    judgment = F.from_json(judgment_json("raw_response"), T._parse_datatype_string(f"j {JUDGMENT}").fields[0].dataType)
    return both.withColumn("judgment", judgment).withColumn("cache_hit", F.col("__raw").isNotNull()).withColumn("error", F.col("__error")).drop("__raw", "__new", "__error")


def new_cache_rows(judged: DataFrame) -> DataFrame:
    """What to append to the cache: successful judgments that it lacks."""
    return judged.where("judgment is not null and not cache_hit").select("cache_key", "raw_response").dropDuplicates(["cache_key"])
