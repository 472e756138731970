import os
import random
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for the Python workers
sys.path.insert(0, ROOT)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, cls string, gid int, _d string, _covered int, features int, score string"


@pytest.fixture(scope="session")
def make(spark):
    """``make(rows)``: a table of documents with columns whose names clash with those that operators use."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, "c", 2, "d", 3, 4, "x") for i, t in rows], SCHEMA)

    return build


@pytest.fixture(scope="session")
def prose():
    """``prose(n, seed)``: n invented words."""

    def text(n, seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))

    return text


@pytest.fixture(scope="session")
def odd(prose):
    """Null ids and texts, empty and blank texts, repeated rows, a very long text, characters beyond the basic plane."""
    long = prose(60_000, 1)
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (5, long), (6, long), (None, "no id at all here"), (None, None), (7, "é😀 " * 40), (8, "a b c d e f g h i j k l")]
