"""Interfaces of models, and deterministic local ones. Nothing here uses a network."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import lexical_tokens


class Embedder(Protocol):
    dim: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


@lru_cache(maxsize=1 << 17)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:8], "big")


@dataclass
class HashEmbedder:
    """Signed hashes of words, summed and normalised."""

    dim: int = 64

    def __call__(self, texts: list[str]) -> list[list[float]]:
        own = [[_word_hash(word) for word in re.findall(r"[a-z0-9]+", text.lower())] for text in texts]
        h = np.array([x for words in own for x in words], np.uint64)
        v = np.zeros((len(own), self.dim))
        at = np.repeat(np.arange(len(own)), np.array([len(words) for words in own], np.int64))
        np.add.at(v, (at, (h % np.uint64(self.dim)).astype(np.int64)), np.where(h >> np.uint64(63), 1.0, -1.0))
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, n, out=np.zeros_like(v), where=n > 0).tolist()


def embed(text: Column, embedder: Embedder, prefix: str = "", batch: int = 32) -> Column:
    """array<float> of each text, in batches and in order; a wrong number or width of vectors is an error."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts, vectors = [prefix + (t or "") for t in part], []
            for at in range(0, len(texts), batch):
                got = embedder(texts[at : at + batch])
                if len(got) != len(texts[at : at + batch]) or any(len(v) != embedder.dim for v in got):
                    raise ValueError("the embedder returned a wrong number or width of vectors")
                vectors.extend(got)
            yield pd.Series(vectors)

    return run(text)


def lexical_scorer(query: Column, text: Column) -> Column:
    """A native reranking score: the share of the query's distinct tokens that the text has."""
    q = F.array_distinct(lexical_tokens(query))
    return F.size(F.array_intersect(q, lexical_tokens(text))) / F.greatest(F.size(q), F.lit(1))


class Generator(Protocol):
    def __call__(self, prompt: str, model: str) -> str: ...


def extractive_generator(prompt: str, model: str = "") -> str:
    """The first evidence block's first sentence, cited; what a test needs of a model."""
    m = re.search(r"\[S1[^\]]*\]\n(.*?)\n\[/S1\]", prompt, re.S)
    first = re.split(r"(?<=[.!?])\s", m[1].strip(), maxsplit=1)[0] if m else ""
    return f"{first} [S1]" if first else ""


def generate(prompt: Column, model: Column, generator: Generator) -> Column:
    """Answers of a generator; errors become null."""

    @F.pandas_udf(T.StringType())
    def run(prompts: pd.Series, models: pd.Series) -> pd.Series:
        def one(p, m):
            try:
                return generator(p, m)
            except Exception:
                return None

        return pd.Series([None if p is None else one(p, m) for p, m in zip(prompts, models)], dtype=object)

    return run(prompt, model)


# What a provider says when the tokens of a day are used up, and its names of connection errors.
DAILY_QUOTA = r"tokens per day|tokens_per_day|daily token|daily_tokens|\btpd\b"
CONNECTION_ERRORS = ("APIConnectionError", "APITimeoutError")
BUSY, LONGEST_WAIT = 429, 60.0


def failure_class(status: Column, told: Column, connection: Column) -> Column:
    """'quota' (stop for today), 'transient' (try again) or 'final' of logged failures."""
    busy = F.coalesce(status == BUSY, F.lit(False))
    again = busy | F.coalesce(status >= 500, F.lit(False)) | F.coalesce(connection, F.lit(False))
    return F.when(busy & F.lower(F.coalesce(told, F.lit(""))).rlike(DAILY_QUOTA), "quota").when(again, "transient").otherwise("final")


@dataclass(frozen=True)
class Failure:
    """An exception of a provider's client as a row: status, what it told, whether the connection broke, and when to come back."""

    status: int | None
    told: str
    connection: bool
    retry_after: str | None

    @classmethod
    def of(cls, error: Exception) -> Failure:
        reply = getattr(error, "response", None)
        said = [error, getattr(error, "body", None), getattr(reply, "text", None)]
        headers = getattr(reply, "headers", None) or getattr(error, "headers", None) or {}
        broken = isinstance(error, OSError) or any(c.__name__ in CONNECTION_ERRORS for c in type(error).__mro__)
        status = getattr(error, "status_code", None)
        return cls(status if isinstance(status, int) else None, "\n".join(str(x) for x in said if x), broken, headers.get("Retry-After"))

    @property
    def kind(self) -> str:
        """As failure_class."""
        if self.status == BUSY:
            return "quota" if re.search(DAILY_QUOTA, self.told.lower()) else "transient"
        return "transient" if self.connection or (self.status or 0) >= 500 else "final"


def _asked_wait(value: str, now: datetime) -> float | None:
    """Seconds that a Retry-After value asks for: a number, or what is left until an HTTP date; None for anything else."""
    if re.fullmatch(r"\s*[+-]?\d+(\.\d*)?\s*", value):
        return float(value)
    try:
        until = parsedate_to_datetime(value)
    except ValueError:
        return None
    return until.replace(tzinfo=until.tzinfo or UTC).timestamp() - now.timestamp()


def retry_delay(retry_after: str | None, attempt: int, most: float = LONGEST_WAIT, now: datetime | None = None) -> float:
    """Seconds before the next attempt: what the provider asks for, else two to the attempt; never negative, at most ``most``."""
    asked = None if retry_after is None else _asked_wait(retry_after, now or datetime.now(UTC))
    return float(np.clip(2.0**attempt if asked is None else asked, 0.0, most))


@dataclass
class Attempts:
    """A budget of attempts that a first and a repair request share."""

    most: int = 5
    sleep: Callable[[float], None] = time.sleep
    used: int = field(default=0)

    def call(self, request: Callable[[], str]) -> str:
        """The reply; transient errors are retried until the budget ends, others and daily quotas are raised."""
        while True:
            self.used += 1
            try:
                return request()
            except Exception as e:
                failure = Failure.of(e)
                if failure.kind != "transient" or self.used >= self.most:
                    raise
                self.sleep(retry_delay(failure.retry_after, self.used - 1))
