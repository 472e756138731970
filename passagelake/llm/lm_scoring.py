"""Operator 6: a hidden Markov language model.

A token is a word or the text's end. Frequent tokens are symbols of their own, the others share a symbol with words of the same
ending; the chain emits symbols and a symbol emits its tokens, so a text's probability is the chain's probability of the symbols
times that of each token in its symbol. Token counts are exact over all training rows.

Nothing that grows with the corpus reaches the driver or is broadcast. Texts are dealt into groups of bounded size; each group
sends its distinct tokens with their counts, packed by ranges of the token's hash; each range adds up the counts of all groups and
sends them back; a group then knows the counts of its tokens. A frequent word is thus one entry per group, never a hot key.
Baum-Welch runs over all training rows: each task sums expected counts, blocks of them are added up across tasks. A first pass
learns after each of some growing shares of the rows, which moves the model further than one step after all of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelake.llm.hmm import Chains, Counts, Model, slices
from passagelake.llm.token_arrays import NOT_BLANK, mix, word_slices
from passagelake.sources.stores import materialise

ENDING_BITS = 10
ENDINGS = 1 << ENDING_BITS
#: A token with at least this share of all training tokens is a symbol of its own, so there are at most OWN of them.
OWN = 1 << 14
STATES = 6
ROUNDS = 1
#: The first pass goes through shares of the training rows, each a fixed part of them, and the model learns after each.
SHARES = 16
PASS = ((0, 1), (1, 2), (2, 3), (3, 4), (4, 6), (6, 8), (8, 12), (12, 16))
PRIOR = 50.0
GROUP_CHARS = 8_000_000
RANGE_CHARS = 80_000_000
_SLICE = 300_000
_MASK = np.uint64(ENDINGS - 1)
_END = (mix(np.array([1234567], np.uint64)) & ~_MASK)[0]


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts and the bounds of each text's share; the low bits of an id are its ending."""
    ids, sizes = [], []
    for _, words in word_slices(column, NOT_BLANK):
        last = words.data[words.end - 1].astype(np.uint64)
        prior = words.data[np.maximum(words.end - 2, words.start)].astype(np.uint64)
        ending = mix((last << np.uint64(8)) | prior) & _MASK
        own = (words.hash & ~_MASK) | ending
        # a text's end follows its last word
        ids.append(np.insert(own, words.first[1:], _END))
        sizes.append(words.counts + 1)
    if not ids:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def _group_counts(docs: DataFrame, bits: int) -> DataFrame:
    """``gid, part, keys, counts, n``: distinct tokens of each group by range of the hash, with their training counts."""

    def run(table: pa.Table) -> pa.Table:
        ids, bounds = _tokens(table.column("text"))
        train = np.repeat(~table.column("held_out").to_numpy(), np.diff(bounds))
        keys, inverse = np.unique(ids, return_inverse=True)
        counts = np.bincount(inverse[train], minlength=len(keys)).astype(np.int32)
        cuts = _cuts(keys, bits)
        parts = [i for i in range(len(cuts) - 1) if cuts[i] < cuts[i + 1]]
        pick = lambda x: pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in parts], pa.binary())
        gid = table.column("gid")[0].as_py()
        return pa.table({
            "gid": pa.array([gid] * len(parts), pa.int64()), "part": pa.array(parts, pa.int32()), "keys": pick(keys), "counts": pick(counts),
            "n": pa.array([int(counts[cuts[i] : cuts[i + 1]].sum()) for i in parts], pa.int64()),
        })

    return docs.groupBy("gid").applyInArrow(run, "gid long, part int, keys binary, counts binary, n long")


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([np.searchsorted(keys, edges), [len(keys)]])


def _global_counts(local: DataFrame, total: int) -> DataFrame:
    """Kind 0: ``gid, part, counts`` of the corpus for the group's keys; 1: an ending's tokens (a), count (b), kinds (c); 2: a frequent token (a) and its count (b)."""

    def run(table: pa.Table) -> pa.Table:
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
        held = [np.frombuffer(x.as_buffer(), np.int32) for x in table.column("counts")]
        keys, inverse = np.unique(np.concatenate(raw), return_inverse=True)
        sums = np.bincount(inverse, weights=np.concatenate(held), minlength=len(keys)).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        own = sums[inverse]
        frequent = (sums * OWN >= total) & (sums > 0)
        rare, ending = ~frequent & (sums > 0), (keys & _MASK).astype(np.int64)
        tokens = np.bincount(ending[rare], weights=sums[rare], minlength=ENDINGS).astype(np.int64)
        kinds = np.bincount(ending[rare], minlength=ENDINGS)
        some = np.flatnonzero(kinds)
        n, e, f = len(raw), len(some), int(frequent.sum())
        none = lambda k, t: pa.nulls(k, t)
        return pa.table({
            "kind": pa.array([0] * n + [1] * e + [2] * f, pa.int32()),
            "gid": pa.chunked_array([table.column("gid").combine_chunks(), none(e + f, pa.int64())]) if e + f else table.column("gid"),
            "part": pa.chunked_array([table.column("part").combine_chunks(), none(e + f, pa.int32())]) if e + f else table.column("part"),
            "a": pa.array([None] * n + some.tolist() + keys[frequent].view(np.int64).tolist(), pa.int64()),
            "b": pa.array([None] * n + tokens[some].tolist() + sums[frequent].tolist(), pa.int64()),
            "c": pa.array([None] * n + kinds[some].tolist() + [None] * f, pa.int64()),
            "counts": pa.array([own[cuts[i] : cuts[i + 1]].tobytes() for i in range(n)] + [None] * (e + f), pa.binary()),
        })

    return local.groupBy("part").applyInArrow(run, "kind int, gid long, part int, a long, b long, c long, counts binary")


class Lexicon:
    """Totals, frequent tokens and endings: fixed-size statistics of the training tokens."""

    def __init__(self, total: int, counted: DataFrame):
        self.total = total
        frequent = {r["a"]: r["b"] for r in counted.where("kind = 2").select("a", "b").collect()}  # at most OWN rows
        endings = counted.where("kind = 1").groupBy("a").agg(F.sum("b").alias("b"), F.sum("c").alias("c")).collect()  # at most ENDINGS rows
        self.keys = np.sort(np.array(list(frequent), np.int64).view(np.uint64))
        self.tokens, self.kinds = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
        for r in endings:
            self.tokens[r["a"]], self.kinds[r["a"]] = r["b"], r["c"]
        self.distinct = len(frequent) + int(self.kinds.sum())
        own = np.array([frequent[int(k)] for k in self.keys.view(np.int64)], np.float64)
        # an ending without training tokens still has its one unknown kind
        weight = np.concatenate([own, self.tokens + 1.0])
        self.frequencies = weight / weight.sum()

    @property
    def symbols(self) -> int:
        return len(self.keys) + ENDINGS

    def symbols_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbol of each key, and whether it is the key's own."""
        ending = (keys & _MASK).astype(np.int64) + len(self.keys)
        if not len(self.keys):
            return ending, np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        own = self.keys[at] == keys
        return np.where(own, at, ending), own


ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inner double, symbols binary"


def _encoded(docs: DataFrame, counted: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Base score, number of known tokens, probability of tokens within symbols and the symbols of each row."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, bounds = _tokens(left.column("text"))
        keys, inverse = np.unique(ids, return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        if right.num_rows:
            order = np.argsort(right.column("part").to_numpy())
            raw = right.column("counts")
            counts = np.concatenate([np.frombuffer(raw[int(i)].as_buffer(), np.int64) for i in order])
        base = np.log10((counts + 1) / (lexicon.total + lexicon.distinct + 1))
        symbols, own = lexicon.symbols_of(keys)
        ending = (keys & _MASK).astype(np.int64)
        inner = np.where(own, 0.0, np.log10((counts + 1) / (lexicon.tokens + lexicon.kinds + 1)[ending]))
        add = lambda x: np.add.reduceat(x[inverse], bounds[:-1])  # noqa: E731  every text has a token
        sequence = symbols.astype(np.uint16)[inverse]
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(np.diff(bounds)),
            "n_known": pa.array(add((counts > 0).astype(np.int64))), "base_score": pa.array(add(base)), "inner": pa.array(add(inner)),
            "symbols": pa.array([sequence[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
        })

    own = counted.where("kind = 0").select("gid", "part", "counts")
    return docs.groupBy("gid").cogroup(own.groupBy("gid")).applyInArrow(run, ENCODED)


def _chains(column: pa.Array):
    """``(first row, Chains)`` of slices of a column of packed symbols."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = [np.frombuffer(x.as_buffer(), np.uint16) for x in column]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    for a, b in slices(bounds, _SLICE):
        yield a, Chains(np.concatenate(raw[a:b]).astype(np.int64), bounds[a : b + 1] - bounds[a])


_CELLS = 512


def baum_welch_round(encoded: DataFrame, model: Model, frequencies: np.ndarray, prior: float = PRIOR) -> tuple[Model, float]:
    """The model after one pass over all given rows, and their log likelihood before it."""
    states = len(model.start)

    def local(batches):
        counts = Counts.zero(model)
        for b in batches:
            for _, chains in _chains(b.column("symbols")):
                chains.expect(model, counts)
        flat = np.concatenate([counts.start, counts.move.ravel(), [counts.log_likelihood], counts.emit.ravel()])
        full = [i for i in range(0, len(flat), _CELLS) if flat[i : i + _CELLS].any()]
        yield pa.record_batch([pa.array([i // _CELLS for i in full], pa.int32()), pa.array([flat[i : i + _CELLS].tobytes() for i in full], pa.binary())], ["block", "sums"])

    def merged(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column("block").to_pylist(), b.column("sums").to_pylist()):
                held[i] = held.get(i, 0.0) + np.frombuffer(raw, np.float64)
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["block", "sums"])

    parts = encoded.select("symbols").mapInArrow(local, "block int, sums binary").repartition("block").mapInArrow(merged, "block int, sums binary")
    flat = np.zeros(states + states * states + 1 + model.emit.size)
    for row in parts.collect():  # the model's own size, whatever the corpus
        got = np.frombuffer(row["sums"], np.float64)
        flat[row["block"] * _CELLS : row["block"] * _CELLS + len(got)] = got
    a, b = states, states + states * states
    counts = Counts(flat[:a], flat[a:b].reshape(states, states), flat[b + 1 :].reshape(model.emit.shape), float(flat[b]))
    # without a row there is nothing to learn
    return (counts.estimate(frequencies, prior) if counts.start.any() else model), counts.log_likelihood


def fit(encoded: DataFrame, lexicon: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training rows: one pass in growing shares, then ``rounds`` whole passes.

    A share is a fixed part of the training rows by a hash, so it grows with the corpus; every row is in one share. Each step adds
    up expected counts across partitions, and only these sums, of the model's own size, reach the driver.
    """
    train = encoded.where("not held_out")
    model = Model.initial(states, lexicon.frequencies)
    for a, b in PASS:
        model, _ = baum_welch_round(train.where(F.col("share").between(a, b - 1)), model, lexicon.frequencies, PRIOR * (b - a) / SHARES)
    for _ in range(rounds):
        model, _ = baum_welch_round(train, model, lexicon.frequencies)
    return model


def lm_scores(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Words lie between ASCII blanks, A-Z in lower case. A null or empty text is its end alone: one token. Rows without doc_id
    are training rows; repeated rows are scored, and learned from, each time. Other columns are not read. Without training rows
    all counts are 0. Scores are base-10 logarithms of probabilities.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = own.agg(F.sum(F.length("text")).alias("chars")).first()["chars"] or 0
    groups, bits = max(1, math.ceil(size / GROUP_CHARS)), max(3, math.ceil(math.log2(max(1, size / RANGE_CHARS))))
    # dealt by place in the input, so that repeated rows spread; stored, so that a row's group stays the same
    gid = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    dealt = materialise(own.select(gid.alias("gid"), "doc_id", _held_out(F.col("doc_id")).alias("held_out"), "text"), "dealt")
    local = materialise(_group_counts(dealt, bits), "token-counts")
    total = local.agg(F.sum("n").alias("n")).first()["n"] or 0
    counted = materialise(_global_counts(local, total), "corpus-counts")
    lexicon = Lexicon(total, counted)
    encoded = materialise(_encoded(dealt, counted, lexicon).withColumn("share", F.pmod(F.xxhash64("doc_id", "base_score"), F.lit(SHARES))), "encoded")
    model = fit(encoded, lexicon, states, rounds)

    def run(batches):
        for b in batches:
            for at, chains in _chains(b.column("symbols")):
                part = b.slice(at, len(chains.per))
                score = chains.log_likelihood(model) / np.log(10) + part.column("inner").to_numpy()
                keep = [part.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")]
                yield pa.record_batch([*keep, pa.array([total] * part.num_rows, pa.int64()), part.column("base_score"), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
