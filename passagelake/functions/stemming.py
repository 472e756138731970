"""Porter2 (Snowball English) stemming of lower-case ASCII tokens.

The published algorithm, expressed as suffix tables. The stemmer is applied to token arrays through an Arrow UDF that
encodes a batch's tokens as a dictionary: Python sees each distinct token of a batch once, and no token is shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the Porter2 definition.
WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
    "andes": "andes",
}
KEEP_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
REGION_PREFIX = re.compile(r"^(gener|commun|arsen)")
REGION = re.compile(r"[aeiouy][^aeiouy]")
SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
DERIVED = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
REDUCED = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
RESIDUAL = {
    s: ""
    for s in "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()
}


def _ending(word: str, table) -> str | None:
    for size in range(min(len(word), 7), 0, -1):
        if word[-size:] in table:
            return word[-size:]
    return None


def _regions(word: str) -> tuple[int, int]:
    prefix = REGION_PREFIX.match(word)
    first = prefix if prefix else REGION.search(word)
    r1 = first.end() if first else len(word)
    second = REGION.search(word, r1)
    return r1, second.end() if second else len(word)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and re.search(r"[aeiouy].", word[:-1]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    hit = _ending(word, {"eed", "eedly", "ed", "edly", "ing", "ingly"})
    if hit is None:
        return word
    base = word[: -len(hit)]
    if hit.startswith("eed"):
        return base + "ee" if len(base) >= r1 else word
    if not re.search(r"[aeiouy]", base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return base[:-1]
    if len(base) <= r1 and SHORT_END.search(base):
        return base + "e"
    return base


def _swap(word: str, table: dict, r1: int, allowed) -> str:
    hit = _ending(word, table)
    if hit is None:
        return word
    base = word[: -len(hit)]
    return base + table[hit] if len(base) >= r1 and allowed(hit, base) else word


@lru_cache(maxsize=1 << 17)
def porter2(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in WHOLE_WORDS:
        return WHOLE_WORDS[word]
    word = re.sub(r"(^|(?<=[aeiouy]))y", "Y", word)
    r1, r2 = _regions(word)
    word = _plural(word)
    if word in KEEP_AFTER_PLURAL:
        return word
    word = _past(word, r1)
    word = re.sub(r"(?<=[^aeiouy])(?<!^.)[yY]$", "i", word) if len(word) > 2 else word
    word = _swap(
        word, DERIVED, r1,
        lambda hit, base: base.endswith("l") if hit == "ogi" else hit != "li" or base[-1:] in set("cdeghkmnrt"),
    )
    word = _swap(word, REDUCED, r1, lambda hit, base: hit != "ative" or len(base) >= r2)
    word = _swap(word, RESIDUAL, r2, lambda hit, base: hit != "ion" or base.endswith(("s", "t")))
    if word.endswith("e"):
        base = word[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not SHORT_END.search(base)):
            word = base
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")


def stem_token(token: str) -> str:
    """Numbers and tokens of up to three characters are kept as they are."""
    return token if len(token) <= 3 or token.isdigit() else porter2(token)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_terms(tokens: pa.Array) -> pa.Array:
    """Stems of arrays of tokens: the distinct tokens of a batch are stemmed once each, rows are only their positions."""
    words = tokens.flatten().dictionary_encode()  # a null row has no tokens
    stems = pa.array([None if w is None else stem_token(w) for w in words.dictionary.to_pylist()], pa.string())
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, stems.take(words.indices), mask=tokens.is_null())
