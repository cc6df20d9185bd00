"""Settings: typed values with defaults, overridden by DOCLOOM_* environment variables or docloom.* session settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

# Defaults, prompts' prefixes and limits that results depend on.
CHARS_PER_TOKEN = 4
DOCUMENT_PREFIX, QUERY_PREFIX, CLUSTERING_PREFIX = "search_document: ", "search_query: ", "clustering: "
SUPPORTED_MODELS = ("llama3.2", "qwen2.5:1.5b", "gemma2:2b", "phi4-mini", "gemma4:e2b")
REFUSAL = "I could not find sufficient information in the loaded documents to answer that."


@dataclass(frozen=True)
class Settings:
    embed_dim: int = 768
    embed_batch_size: int = 32
    default_model: str = "llama3.2"
    temperature: float = 0.1
    num_ctx: int = 8192
    chunk_size: int = 400
    chunk_overlap: int = 60
    retrieval_mode: str = "hybrid"
    top_k_dense: int = 20
    top_k_bm25: int = 20
    rrf_k: int = 60
    rerank_enabled: bool = False
    rerank_candidates: int = 40
    rerank_top_n: int = 5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    refusal_message: str = REFUSAL
    pdf_parser: str = "layout"

    def __post_init__(self) -> None:
        if self.retrieval_mode not in ("dense", "hybrid"):
            raise ValueError(f"unknown retrieval mode {self.retrieval_mode!r}")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError(f"passages of {self.chunk_size} tokens cannot share {self.chunk_overlap}")


def load(spark: SparkSession | None = None, **overrides) -> Settings:
    """Defaults, then the environment, then the session, then overrides."""
    found = {}
    kinds = {"int": int, "float": float, "str": str, "bool": lambda x: str(x).lower() in ("1", "true", "yes")}
    for f in fields(Settings):
        value = os.environ.get(f"DOCLOOM_{f.name.upper()}")
        if spark is not None:
            value = spark.conf.get(f"docloom.{f.name}", value)
        if value is not None:
            found[f.name] = kinds[f.type](value)
    return replace(Settings(), **(found | overrides))
