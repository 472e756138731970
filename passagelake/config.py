"""Named retrieval presets. Each preset is its parent with one idea changed."""

from __future__ import annotations

from copy import deepcopy

# Defaults and tuned thresholds.
BASIC = {
    "name": "basic",
    "indexing": {"chunker": "basic", "header": False, "task_types": False, "llm_context": False},
    "query": {"rewrite": False, "multi_query": False, "hyde": False},
    "retrieval": {
        "mode": "dense", "top_k": 5, "candidate_k": 20, "rrf_k": 60, "dense_weight": 1.0, "bm25_weight": 1.0,
        "multi_query_weight": 0.7, "hyde_weight": 0.7, "hyde_gate": 0.0,
    },
    "rerank": {"enabled": False, "candidates": 20, "passage_chars": 700},
    "mmr": {"enabled": False, "lambda": 0.75},
    "expand": {"neighbors": 0, "max_chars": 6000},
    "abstain": {"signal": "dense", "threshold": 0.15, "drop_below": None, "fallback": {"threshold": 0.15}},
}
DENSE_THRESHOLD = 0.682
RERANK_THRESHOLD = 5.0
HYDE_GATE = 0.7

LADDER = {
    "basic": (None, {}),
    "chunk-structured": ("basic", {"indexing": {"chunker": "structured"}}),
    "chunk-header": ("chunk-structured", {"indexing": {"header": True}}),
    "chunk-tasktype": ("chunk-header", {"indexing": {"task_types": True}}),
    "hybrid": ("chunk-tasktype", {"retrieval": {"mode": "hybrid"}}),
    "hybrid-w50": ("chunk-tasktype", {"retrieval": {"mode": "hybrid", "bm25_weight": 0.5}}),
    "hybrid-w25": ("chunk-tasktype", {"retrieval": {"mode": "hybrid", "bm25_weight": 0.25}}),
    "bm25-only": ("chunk-tasktype", {"retrieval": {"mode": "hybrid", "dense_weight": 0.0}}),
    "rewrite": ("hybrid", {"query": {"rewrite": True}}),
    "multiquery": ("rewrite", {"query": {"multi_query": True}}),
    "hyde": ("multiquery", {"query": {"hyde": True}, "retrieval": {"hyde_gate": HYDE_GATE}}),
    "rerank": (
        "rewrite",
        {
            "rerank": {"enabled": True},
            "mmr": {"enabled": True},
            "abstain": {
                "signal": "rerank", "threshold": RERANK_THRESHOLD, "drop_below": RERANK_THRESHOLD,
                "fallback": {"threshold": DENSE_THRESHOLD},
            },
        },
    ),
    "rerank-dense": ("rerank", {"retrieval": {"mode": "dense"}}),
    "contextual": ("rerank", {"indexing": {"llm_context": True}}),
    "advanced": ("rerank", {"expand": {"neighbors": 1}}),
}


def overlay(base: dict, patch: dict | None) -> dict:
    """``base`` with ``patch`` laid over it, nested dicts merged; neither argument changes."""
    merged = deepcopy(base)
    stack = [(merged, patch or {})]
    while stack:
        into, changes = stack.pop()
        for key, value in changes.items():
            if isinstance(value, dict) and isinstance(into.get(key), dict):
                stack.append((into[key], value))
            else:
                into[key] = deepcopy(value)
    return merged


def preset(name: str, overrides: dict | None = None) -> dict:
    if name not in LADDER:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(LADDER)}")
    parent, patch = LADDER[name]
    base = BASIC if parent is None else preset(parent)
    return overlay(overlay(base, patch) | {"name": name}, overrides)


def index_signature(indexing: dict) -> str:
    flags = (("h", "header"), ("t", "task_types"), ("c", "llm_context"))
    return ".".join([indexing["chunker"], *[f"{mark}{int(bool(indexing[key]))}" for mark, key in flags]])


def index_version(config: dict, embedding_model: str) -> str:
    return f"{index_signature(config['indexing'])}|{embedding_model}"
