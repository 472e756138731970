"""Hidden Markov chains over symbol sequences, many at a time with numpy.

Sequences are cut into segments of ``SEGMENT`` symbols. The product of a segment's step matrices is formed for all segments at
once; the segments of a sequence are then joined in order. That is the scaled forward recursion, exact to rounding, with work
spread over segments instead of one Python step per symbol.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEGMENT = 32
_FLOOR = 1e-9


@dataclass
class Model:
    """``start`` (K), ``move`` (K, K) and ``emit`` (symbols, K): probabilities of state, of next state, of symbol in a state."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def initial(cls, states: int, frequencies: np.ndarray, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        emit = (frequencies[:, None] + _FLOOR) * np.exp(rng.normal(0, 1, (len(frequencies), states)))
        move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * 0.9
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))


@dataclass
class Counts:
    """Expected counts of one pass: what Baum-Welch adds up over all sequences."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log_likelihood: float = 0.0

    @classmethod
    def zero(cls, model: Model) -> Counts:
        return cls(np.zeros_like(model.start), np.zeros_like(model.move), np.zeros_like(model.emit))

    def estimate(self, frequencies: np.ndarray, prior: float = 50.0) -> Model:
        """The next model; each state's symbols are smoothed with ``prior`` symbols of the corpus frequencies."""
        emit = self.emit + prior * (frequencies[:, None] + _FLOOR)
        move, start = self.move + 0.5, self.start + 0.5
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Chains:
    """A run of sequences laid out in segments."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        self.symbols, self.bounds = symbols, np.asarray(bounds, np.int64)
        sizes = np.diff(self.bounds)
        self.per = -(-sizes // SEGMENT)
        total = int(self.per.sum())
        self.first = np.concatenate([[0], np.cumsum(self.per)])
        owner = np.repeat(np.arange(len(sizes)), self.per)
        self.rank = np.arange(total) - self.first[owner]
        self.begin = self.bounds[owner] + self.rank * SEGMENT
        self.size = np.minimum(self.bounds[owner + 1] - self.begin, SEGMENT)
        at = self.begin[:, None] + np.arange(SEGMENT)
        self.here = np.arange(SEGMENT) < self.size[:, None]
        self.at = np.where(self.here, at, self.begin[:, None])

    def _emissions(self, model: Model) -> np.ndarray:
        out = np.maximum(model.emit[self.symbols[self.at]], 1e-12)
        out[~self.here] = 1.0
        return out

    def _products(self, model: Model, emissions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled product of each segment's steps, and the logarithm of the scale."""
        k = len(model.start)
        leads = self.rank == 0
        out = np.empty((len(self.rank), k, k))
        out[:] = model.move
        out[leads] = model.start
        out *= emissions[:, 0, None, :]
        log = np.zeros(len(out))
        for i in range(1, SEGMENT):
            live = self.here[:, i]
            if live.all():
                out = (out.reshape(-1, k) @ model.move).reshape(-1, k, k)
                out *= emissions[:, i, None, :]
            elif live.any():
                out[live] = (out[live].reshape(-1, k) @ model.move).reshape(-1, k, k) * emissions[live, i, None, :]
            else:
                break
            if i % 8 == 7:
                scale = out.max(axis=(1, 2))
                out /= scale[:, None, None]
                log += np.log(scale)
        scale = out.max(axis=(1, 2))
        return out / scale[:, None, None], log + np.log(scale)

    def _rounds(self):
        """Segments of equal rank, rank by rank."""
        order = np.argsort(self.rank, kind="stable")
        cuts = np.searchsorted(self.rank[order], np.arange(int(self.per.max(initial=0)) + 1))
        return [order[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def log_likelihood(self, model: Model) -> np.ndarray:
        """Natural logarithm of each sequence's probability; 0 for an empty one."""
        return self._forward(model, self._emissions(model))[0]

    def _forward(self, model: Model, emissions: np.ndarray):
        products, logs = self._products(model, emissions)
        docs, k = len(self.per), len(model.start)
        owner = np.repeat(np.arange(docs), self.per)
        state, total = np.full((docs, k), 1 / k), np.zeros(docs)
        before = np.empty((len(owner), k))
        for own in self._rounds():
            d = owner[own]
            before[own] = state[d]
            step = np.einsum("sk,skj->sj", state[d], products[own])
            size = step.sum(1)
            state[d] = step / size[:, None]
            total[d] += np.log(size) + logs[own]
        return total, products, before

    def expect(self, model: Model, counts: Counts) -> None:
        """Add the expected counts of these sequences."""
        if not len(self.rank):
            return
        emissions = self._emissions(model)
        total, products, before = self._forward(model, emissions)
        counts.log_likelihood += float(total.sum())
        docs, k = len(self.per), len(model.start)
        owner = np.repeat(np.arange(docs), self.per)
        after, ahead = np.empty((len(owner), k)), np.ones((docs, k))
        for own in reversed(self._rounds()):
            d = owner[own]
            after[own] = ahead[d]
            step = np.einsum("skj,sj->sk", products[own], ahead[d])
            ahead[d] = step / step.sum(1, keepdims=True)
        leads = self.rank == 0
        alpha = np.empty((SEGMENT, len(owner), k))
        state = before
        for i in range(SEGMENT):
            step = (state @ model.move if i else np.where(leads[:, None], model.start, state @ model.move)) * emissions[:, i]
            step /= step.sum(1, keepdims=True)
            state = np.where(self.here[:, i, None], step, state)
            alpha[i] = state
        beta = after
        symbols = self.symbols[self.at]
        for i in range(SEGMENT - 1, -1, -1):
            live = self.here[:, i]
            if not live.any():
                continue
            seen = alpha[i] * beta
            seen /= seen.sum(1, keepdims=True)
            seen[~live] = 0
            for s in range(k):
                counts.emit[:, s] += np.bincount(symbols[:, i], weights=seen[:, s], minlength=len(counts.emit))
            back = emissions[:, i] * beta
            prior = alpha[i - 1] if i else before
            if not i:
                counts.start += seen[leads].sum(0)
                live = live & ~leads
            weight = np.einsum("sk,kj,sj->s", prior, model.move, back)
            ratio = np.where(live, 1 / weight, 0.0)
            counts.move += (prior.T @ (back * ratio[:, None])) * model.move
            step = back @ model.move.T
            beta = np.where(self.here[:, i, None], step / step.sum(1, keepdims=True), beta)


def slices(bounds: np.ndarray, most: int):
    """``(from, to)`` of runs of sequences of at most ``most`` symbols, at least one sequence each."""
    at, last = 0, len(bounds) - 1
    while at < last:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, to
        at = to
