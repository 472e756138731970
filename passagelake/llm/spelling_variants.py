"""Operator 11: grouping of spelling variants by a dictionary of trie-node pairs.

1. Words are counted in the scan and added up; the vocabulary is numbered in order of falling count, then code point, so that of
   two words the better form has the smaller number.
2. Every prefix of a word is a node of the forward trie, every suffix one of the reversed trie. Nodes that are at most
   ``DIRECT`` bytes deep are numbered by their own bytes, deeper ones by a stored dictionary of the distinct nodes.
3. A word of length L gives L skipping pairs (prefix node before i, suffix node after i) and L + 1 inserting pairs (prefix node
   before i, suffix node from i). Words that share a skipping pair differ by one replaced code point; a word whose skipping pair
   is another word's inserting pair is that word with one code point more. Of a run of equal code points only the first one's
   skipping pair counts as a deletion, so every pair of near words meets exactly once.
4. A pair of nodes spells all but one code point, so it holds one inserting word and at most one skipping word for each code
   point of the alphabet: groups are small, and hold no two equal words. Of each group a word learns how many near words it has
   there and the best of them; nothing is compared pair by pair.
5. A word's form has at least twice its count, so chains of forms are at most as long as a count has bits: roots follow by
   pointer doubling in a few rounds.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from passagelake.sources.stores import materialise

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Words are sent on once a task holds so many different ones.
HELD = 300_000
#: Nodes of at most so many bytes are their own number, below 2 ** 56.
DIRECT = 7
_NUMBERED = 1 << 60

SKIP, DELETE, INSERT = 0, 1, 2  # DELETE: a skipping pair that also counts as a deletion


def _damaged(run: str, h: int) -> str:
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, divisor: int = 97) -> DataFrame:
    """``word, n``: occurrences of all words of the texts, one code point deleted where ``divisor`` divides the run's checksum.

    The checksum is the crc32 of ``<doc_id>:<run>``; a null doc_id stands as nothing before the colon.
    """

    def run(batches):
        held: Counter = Counter()

        def sent():
            yield pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                lowered = (text.as_py() or "").encode().lower().decode()  # bytes: lower() changes A-Z only
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(_RUN.findall(lowered)).items():
                    h = zlib.crc32(word.encode(), start)
                    held[word if h % divisor else _damaged(word, h)] += n
                if len(held) > HELD:
                    yield from sent()
        yield from sent()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``id, word, n`` of the words that are long and frequent enough; ids rise with falling count and then with the word."""
    words = materialise(counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count)).select("word", "n"), "words")
    order = [F.col("n").desc(), F.col("word")]
    ranged = words.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ranged.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "vocabulary")


def _letters(word: str, reverse: bool) -> list[bytes]:
    return [c.encode() for c in (reversed(word) if reverse else word)]


def _shallow(letters: list[bytes]) -> list[int]:
    """Numbers of the nodes of at most ``DIRECT`` bytes on a path, the root (0) first."""
    found, number, size = [0], 0, 0
    for c in letters:
        size += len(c)
        if size > DIRECT:
            break
        number = number << 8 * len(c) | int.from_bytes(c, "big")
        found.append(number)
    return found


def _deep(letters: list[bytes]) -> list[bytes]:
    """Keys of the nodes of more than ``DIRECT`` bytes: the path's bytes up to 15, beyond a 128-bit digest taken along the path."""
    path, digest, size, keys = b"", None, 0, []
    for c in letters:
        size += len(c)
        if size < 16:
            path += c
        elif digest is None:
            digest = blake2b(path + c, digest_size=16)
        else:
            digest.update(c)
        if size > DIRECT:
            keys.append(path if digest is None else digest.copy().digest())
    return keys


def deep_nodes(words: DataFrame) -> DataFrame:
    """``id, nodes``: numbers of the deep nodes on a word's two paths, ordered by trie (forward first) and depth.

    The stored dictionary numbers the distinct nodes of each trie. Words of few bytes have no row.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 5_000):
                ids, reverse, depth, keys = [], [], [], []
                for i, word in zip(b.column("id")[at : at + 5_000].to_pylist(), b.column("word")[at : at + 5_000].to_pylist()):
                    for back in (False, True):
                        found = _deep(_letters(word, back))
                        ids += [i] * len(found)
                        reverse += [back] * len(found)
                        depth += range(len(found))
                        keys += found
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(reverse, pa.bool_()), pa.array(depth, pa.int32()), pa.array(keys, pa.binary())], ["id", "reverse", "depth", "key"])

    paths = materialise(words.select("id", "word").mapInArrow(run, "id long, reverse boolean, depth int, key binary"), "paths")
    numbers = materialise(paths.select("reverse", "key").distinct().withColumn("node", F.monotonically_increasing_id() + F.lit(_NUMBERED)), "nodes")
    step = F.struct("reverse", "depth", "node")
    steps = paths.join(numbers, ["reverse", "key"]).groupBy("id").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # bounded by the word's length
    return steps.select("id", F.col("steps.node").alias("nodes"))


def node_pairs(words: DataFrame) -> DataFrame:
    """``prefix, suffix, kind, id``: the skipping and inserting pairs of every word."""

    def of_word(word: str, deep: list[int]):
        prefix, suffix = _shallow(_letters(word, False)), _shallow(_letters(word, True))
        ahead = len(word) + 1 - len(prefix)
        prefix, suffix = prefix + deep[:ahead], (suffix + deep[ahead:])[::-1]  # suffix[i]: the node of word[i:]
        head = [DELETE if i == 0 or word[i] != word[i - 1] else SKIP for i in range(len(word))]
        return prefix[:-1] + prefix, suffix[1:] + suffix, head + [INSERT] * len(prefix)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 5_000):
                part = b.slice(at, 5_000)
                prefix, suffix, kind, ids = [], [], [], []
                for i, word, deep in zip(part.column("id").to_pylist(), part.column("word").to_pylist(), part.column("nodes").to_pylist()):
                    x, y, k = of_word(word, deep or [])
                    prefix += x
                    suffix += y
                    kind += k
                    ids += [i] * len(k)
                yield pa.record_batch([pa.array(prefix, pa.int64()), pa.array(suffix, pa.int64()), pa.array(kind, pa.int8()), pa.array(ids, pa.int64())], ["prefix", "suffix", "kind", "id"])

    held = words.join(deep_nodes(words), "id", "left").select("id", "word", "nodes")
    return held.mapInArrow(run, "prefix long, suffix long, kind byte, id long")


def near_words(words: DataFrame) -> DataFrame:
    """``id, n_near, best``: for words with near words, their number and the smallest id among them and the word itself.

    The smallest id is the most frequent word, so where it is the word's own no near word has a larger count.
    """
    group = Window.partitionBy("prefix", "suffix")  # one inserting word, and one skipping word per code point at most
    skips, deletes, inserts = F.col("kind") != INSERT, F.col("kind") == DELETE, F.col("kind") == INSERT
    met = node_pairs(words).select(
        "kind",
        "id",
        F.count(F.when(skips, 1)).over(group).alias("n_skip"),
        F.min(F.when(skips, F.col("id"))).over(group).alias("skip"),
        F.count(F.when(deletes, 1)).over(group).alias("n_delete"),
        F.min(F.when(deletes, F.col("id"))).over(group).alias("delete"),
        F.min(F.when(inserts, F.col("id"))).over(group).alias("insert"),
    )
    shorter = F.when(deletes & F.col("insert").isNotNull(), F.col("insert"))
    near = F.when(inserts, F.col("n_delete")).otherwise(F.col("n_skip") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0))
    best = F.when(inserts, F.least("id", "delete")).otherwise(F.least("id", "skip", shorter))
    return met.select("id", near.alias("near"), best.alias("best")).where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """``id, root`` from ``id, form``: the last form of each word's chain. A round doubles the reach; counts of 64 bits need six at most."""
    links = materialise(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        further = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        joined = materialise(links.join(further, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = joined.select("id", "root")
        if joined.where("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, divisor: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (``doc_id``, ``text``) that is long and frequent enough.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case. Two words are near if one inserted, deleted or replaced
    code point turns one into the other. ``form`` is the near word with the largest count (of equal ones the first in code point
    order), if that count is at least twice the word's; ``root`` is where the chain of forms ends. Null, empty and wordless texts
    give no words, repeated rows count each, a table without words gives no rows. Other columns are not read.
    """
    words = vocabulary(word_counts(docs, divisor), least_length, least_count)
    near = materialise(near_words(words), "near")
    target = words.select(F.col("id").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    counted = materialise(words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best"), "counted")
    formed = materialise(counted.join(target, "best").where("form_n >= 2 * n").select("id", F.col("best").alias("form_id"), "form", "form_n"), "forms")
    last = _roots(formed.select("id", F.col("form_id").alias("form"))).join(words.select(F.col("id").alias("root"), F.col("word").alias("last")), "root").select("id", "last")
    full = counted.join(formed, "id", "left").join(last, "id", "left")
    return full.select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
