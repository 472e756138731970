"""Deterministic stand-ins for the embedding model and the relevance judge, so every query runs offline."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelake.functions.text import STOPWORDS, terms
from passagelake.operators.model_stages import attach_embeddings, embed_missing

MODEL = "hash-64"
SIZE = 64
_stop = frozenset(STOPWORDS)


@lru_cache(maxsize=1 << 17)
def _slot(token: str) -> int:
    if not token or token in _stop or (len(token) < 2 and not token.isdigit()):
        return -1
    return int(hashlib.md5(token.encode()).hexdigest()[:2], 16) % SIZE


def hashed_counts(texts: list[str], mode: str | None) -> np.ndarray:
    """One count per hash slot of the text's terms."""
    out = np.zeros((len(texts), SIZE), dtype=np.float32)
    for row, text in enumerate(texts):
        pieces = re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", text).lower())
        slots = np.array([s for s in map(_slot, pieces) if s >= 0], dtype=np.int64)
        out[row] = np.bincount(slots, minlength=SIZE)
    return out


def embed(rows: DataFrame, mode: str = "", text: str = "text") -> DataFrame:
    """Attach ``embedding`` to rows through the de-duplicating batch embedder."""
    vectors = embed_missing(rows.select(F.col(text).alias("text")), None, hashed_counts, MODEL, mode)
    return attach_embeddings(rows, vectors, MODEL, mode, text)


def overlap_judge(prompts: DataFrame, pool: DataFrame) -> DataFrame:
    """Listwise responses: 0..10 by the share of the question's terms found in the passage, wrapped in chatter."""
    asked = F.array_distinct(terms(F.col("standalone"), stem=False))
    shared = F.size(F.array_intersect(asked, terms(F.col("text"), stem=False)))
    score = F.when(F.size(asked) == 0, F.lit(0)).otherwise(F.floor(F.lit(10) * shared / F.size(asked))).cast("int")
    item = F.format_string('{"id": %d, "score": %d}', F.col("rank"), score)
    listed = pool.groupBy("qid").agg(F.array_join(F.sort_array(F.collect_list(item)), ", ").alias("items"))
    return listed.join(prompts.select("qid"), "qid").select(
        "qid", F.concat(F.lit('Scores follow.\n```json\n{"scores": ['), "items", F.lit("]}\n```")).alias("text")
    )
