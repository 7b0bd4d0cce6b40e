"""A linear-chain conditional random field over clauses, in NumPy: forward-backward, L-BFGS and Viterbi.

A clause is a set of feature numbers. Sequences are handled together, step by step, so the cost of Python is per step of
the longest sequence and not per clause. The likelihood and its gradient are sums over blocks of sequences, so a field can be
fitted on as many blocks as there are, wherever they lie.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Weights: per feature and tag, between tags, and for the first tag."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def scores(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A score per clause and tag; clause k has features ids[offsets[k]:offsets[k + 1]], at least one."""
        return np.add.reduceat(self.emit[ids], offsets[:-1], axis=0) if len(offsets) > 1 else np.zeros((0, self.emit.shape[1]), np.float32)

    def tags(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best tag of every clause, by Viterbi; lengths are those of the sequences, each at least 1."""
        order = np.argsort(-lengths, kind="stable")
        first = (np.cumsum(lengths) - lengths)[order]
        size = lengths[order]
        best = scores[first] + self.start
        back: list[np.ndarray] = []
        ends = [best]
        for t in range(1, int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -t, side="left"))  # sequences longer than t
            to = best[:n, :, None] + self.move[None]
            back.append(to.argmax(axis=1).astype(np.int8))
            best = to.max(axis=1) + scores[first[:n] + t]
            ends.append(best)
        out = np.zeros(len(scores), np.int8)
        tag = np.zeros(len(size), np.int64)
        for t in range(len(ends) - 1, -1, -1):
            n = len(ends[t])
            m = len(ends[t + 1]) if t + 1 < len(ends) else 0  # these go on from a later tag
            tag[m:n] = ends[t][m:n].argmax(axis=1)
            if m:
                tag[:m] = back[t][np.arange(m), tag[:m]]
            out[first[:n] + t] = tag[:n]
        return out


@dataclass
class Lists:
    """Lists of feature numbers, whose sums are taken again and again. Numbers that stand side by side are taken together, and such
    pairs in turn: a pair that recurs is added up once. `pairs` are tables from numbers or pairs of the table before. What the
    last table holds lies in `ids` by place, the first ones of all lists first, the longest lists ahead."""

    pairs: list[tuple[np.ndarray, np.ndarray]]
    ids: np.ndarray
    going: np.ndarray  # how many lists have a number at each place
    lie: np.ndarray  # where each list lies

    @staticmethod
    def of(ids: np.ndarray, offsets: np.ndarray, most: int = 2) -> Lists:
        """List k is ids[offsets[k]:offsets[k + 1]], which may be empty."""
        pairs, n = [], np.diff(offsets)
        while len(pairs) < most and len(ids):
            at = np.cumsum(n) - n
            place = np.arange(len(ids)) - np.repeat(at, n)
            nothing = int(ids.max()) + 1
            after = np.append(ids[1:], nothing)
            after[at[n > 0] + n[n > 0] - 1] = nothing
            left = place % 2 == 0
            code, which = np.unique(ids[left].astype(np.int64) * (nothing + 1) + after[left], return_inverse=True)
            if 2 * len(code) > len(which):
                break
            a, b = np.divmod(code, nothing + 1)
            pairs.append((least(a), least(np.where(b == nothing, -1, b) + 1)))
            ids, n = which, (n + 1) // 2
        order = np.argsort(-n, kind="stable")
        lie = np.empty(len(n), np.int64)
        lie[order] = np.arange(len(n))
        by_place, going = placed((np.cumsum(n) - n)[order], n[order])
        return Lists(pairs, least(ids[by_place]), going, least(lie))

    def sums(self, emit: np.ndarray) -> np.ndarray:
        """The sum of each list by tag; `emit` has a row per tag and a column per feature."""
        for a, b in self.pairs:
            emit = emit.take(a, axis=1) + np.concatenate([np.zeros((len(emit), 1), emit.dtype), emit], axis=1).take(b, axis=1)
        out, at = np.zeros((len(emit), len(self.lie)), emit.dtype), 0
        for n in self.going.tolist():
            out[:, :n] += emit.take(self.ids[at : at + n], axis=1)
            at += n
        return out.take(self.lie, axis=1)

    def back(self, g: np.ndarray, n_features: int) -> np.ndarray:
        """From a number for each tag and list, the sums by feature."""
        sizes = [n_features, *(len(a) for a, _ in self.pairs)]
        lying = np.empty_like(g)
        lying[:, self.lie] = g
        ids = self.ids.astype(np.intp)
        g = np.stack([np.bincount(ids, np.concatenate([x[:n] for n in self.going] or [x[:0]]), sizes[-1]) for x in lying])
        for (a, b), size in zip(reversed(self.pairs), reversed(sizes[:-1])):
            a, b = a.astype(np.intp), b.astype(np.intp)
            g = np.stack([np.bincount(a, x, size) + np.bincount(b, x, size + 1)[1:] for x in g])
        return g


def placed(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where what lies list by list goes if it is to lie by place, and how many lists have something at each place; the longest
    lists come first."""
    going = np.array([np.searchsorted(-size, -t, side="left") for t in range(int(size[0]) if len(size) else 0)], np.int32)
    return (np.concatenate([first[:n] + t for t, n in enumerate(going)]) if len(going) else np.zeros(0, np.int64)), going


def least(x: np.ndarray) -> np.ndarray:
    """In as few bytes as the numbers need."""
    return x.astype(np.uint16 if not len(x) or x.max() < 1 << 16 else np.int32)


@dataclass
class Block:
    """Sequences with their tags and weights. A clause has the features of two things, each kept once: `kinds`, of which there are
    few, and `keys`; clauses that have the same are scored once. Clauses lie by place, the first ones of all sequences first, the
    longest sequences ahead; numbers lie by tag."""

    kinds: Lists
    keys: Lists
    kind: np.ndarray  # of each different clause
    key: np.ndarray
    which: np.ndarray  # of these each clause is
    tags: np.ndarray
    going: np.ndarray  # how many sequences have a clause at each place
    weight: np.ndarray  # of each sequence
    moves: np.ndarray  # by tag and next tag, the weight with which they are the clauses' tags

    @staticmethod
    def of(kinds: list[list[int]], keys: list[list[int]] | tuple[np.ndarray, np.ndarray], kind: np.ndarray, key: np.ndarray, lengths: np.ndarray, tags: np.ndarray, weight: np.ndarray) -> Block:
        """From clauses that lie sequence by sequence; `lengths` are those of the sequences, each at least 1."""
        order = np.argsort(-lengths, kind="stable")
        first, size = (np.cumsum(lengths) - lengths)[order], lengths[order]
        lie, going = placed(first, size)
        lists = [Lists.of(*(x if isinstance(x, tuple) else flat(x))) for x in (kinds, keys)]
        code, which = np.unique(kind[lie].astype(np.int64) + key[lie] * len(lists[0].lie), return_inverse=True)
        key, kind = np.divmod(code, len(lists[0].lie))
        follows = np.ones(len(tags), bool)
        follows[first] = False
        after = np.flatnonzero(follows)
        most = int(tags.max(initial=0)) + 1
        moves = np.bincount(tags[after - 1].astype(np.int64) * most + tags[after], np.repeat(weight, lengths)[after], most * most).reshape(most, most)
        return Block(*lists, least(kind), least(key), least(which), tags[lie].astype(np.int8), going, weight[order].astype(np.float32), moves)

    def gradient(self, w: Chain) -> tuple[float, Chain]:
        """Log-likelihood of the tags, and its gradient, each sequence by its weight."""
        n_features, n_tags = w.emit.shape
        emit = np.ascontiguousarray(w.emit.T, np.float32)
        s = self.kinds.sums(emit).take(self.kind, axis=1)
        s += self.keys.sums(emit).take(self.key, axis=1)
        at = np.concatenate([[0], np.cumsum(self.going)])
        place = [slice(at[t], at[t + 1]) for t in range(len(self.going))]
        which = self.which.astype(np.intp)
        own = self.tags * np.intp(len(which)) + np.arange(len(which))  # of each clause the place of its tag
        s -= s.max(axis=0, initial=-np.inf)
        gold = s.ravel().take(self.tags * np.intp(s.shape[1]) + which)  # less the top, as are all
        e = np.exp(s, out=s).take(which, axis=1)
        between, begin = np.exp(w.move).astype(np.float32), np.exp(w.start).astype(np.float32)
        alpha, scale = np.empty_like(e), np.empty(len(which), np.float32)
        for t, here in enumerate(place):
            x = e[:, here] * (begin[:, None] if t == 0 else between.T @ alpha[:, place[t - 1]][:, : self.going[t]])
            scale[here] = c = x.sum(axis=0)
            np.divide(x, c, out=alpha[:, here])
        beta = np.ones_like(e)
        move = np.zeros((n_tags, n_tags))
        weight = np.concatenate([self.weight[:n] for n in self.going]) if len(self.going) else self.weight
        value = float(np.sum((gold - np.log(scale)) * weight, dtype=np.float64))
        for t in range(len(place) - 1, 0, -1):
            here, n = place[t], self.going[t]
            ahead = e[:, here] * beta[:, here]
            ahead /= scale[here]
            before = slice(at[t - 1], at[t - 1] + n)
            np.matmul(between, ahead, out=beta[:, before])
            move -= between * (alpha[:, before] @ (ahead * self.weight[:n]).T)
        most = len(self.moves)
        move[:most, :most] += self.moves
        value += float((w.move[:most, :most] * self.moves).sum())
        alpha *= beta
        alpha *= -weight
        miss = alpha
        miss.reshape(-1)[own] += weight
        began = miss[:, place[0]].sum(axis=1, dtype=np.float64) if place else np.zeros(n_tags)
        value += float((w.start[self.tags[place[0]]] * self.weight).sum()) if place else 0.0
        out, miss = np.zeros((n_tags, n_features)), [np.bincount(which, x, len(self.kind)) for x in miss]
        for lists, n in ((self.kinds, self.kind), (self.keys, self.key)):
            out += lists.back(np.stack([np.bincount(n, x, len(lists.lie)) for x in miss]), n_features)
        return value, Chain(np.ascontiguousarray(out.T), move, began)


def flat(features: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(f) for f in features])]).astype(np.int64)
    return np.fromiter((i for f in features for i in f), np.int64, int(offsets[-1])), offsets


def sums(emit: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of the columns ids[offsets[k]:offsets[k + 1]], which may be none, for each k."""
    out = np.zeros((len(emit), len(offsets) - 1), np.float32)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        ids, starts = ids.astype(np.int64), offsets[some]
        for x, row in zip(emit, out):
            row[some] = np.add.reduceat(x.take(ids), starts)
    return out


def climb(gradient: Callable[[Chain], tuple[float, Chain]], weight: float, n_features: int, n_tags: int, decay: float | np.ndarray = 1e-4, steps: int = 30, memory: int = 8, enough: float = 1e-4) -> Chain:
    """Maximise the penalised mean likelihood by L-BFGS with at most `steps` sums over all blocks, until a step gains less than
    `enough` of the value; `decay` may be given per feature."""
    cut = [n_features * n_tags, (n_features + n_tags) * n_tags]
    penalty = np.concatenate([np.repeat(np.broadcast_to(np.asarray(decay, float), n_features), n_tags), np.full(n_tags * n_tags + n_tags, 1e-4)])

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        emit, move, start = np.split(x, cut)
        value, g = gradient(Chain(emit.reshape(n_features, n_tags), move.reshape(n_tags, n_tags), start))
        flat = np.concatenate([g.emit.ravel(), g.move.ravel(), g.start])
        return float(penalty @ (x * x)) / 2 - value / weight, penalty * x - flat / weight

    x = np.zeros(len(penalty))
    f, g = loss(x)
    past: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
    used, still = 1, 0
    while used < steps and still < 2:
        d, took = -g, []
        for s, y, r in reversed(past):
            took.append(r * (s @ d))
            d = d - took[-1] * y
        if past:
            s, y, r = past[-1]
            d = d / (r * (y @ y))
        else:
            d = d / max(1e-12, float(np.abs(g).max()))
        for (s, y, r), a in zip(past, reversed(took)):
            d = d + (a - r * (y @ d)) * s
        slope, size = float(g @ d), 1.0
        if slope >= 0:
            break
        while True:
            new_f, new_g = loss(x + size * d)
            used += 1
            if new_f <= f + 1e-4 * size * slope or used >= steps:
                break
            size *= 0.4
        if new_f >= f:
            break
        s, y = size * d, new_g - g
        if s @ y > 1e-12:
            past.append((s, y, 1.0 / float(s @ y)))
        still = still + 1 if f - new_f < enough * abs(f) else 0
        x, f, g = x + s, new_f, new_g
    emit, move, start = (v.astype(np.float32) for v in np.split(x, cut))
    return Chain(emit.reshape(n_features, n_tags), move.reshape(n_tags, n_tags), start)


def fit(ids: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, tags: np.ndarray, n_features: int, n_tags: int, decay: float | np.ndarray = 1e-4) -> Chain:
    """The field of sequences at hand: clause k has features ids[offsets[k]:offsets[k + 1]]."""
    own = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    block = Block.of([[]], own, np.zeros(len(own), np.int64), np.arange(len(own)), lengths, tags, np.ones(len(lengths)))
    return climb(block.gradient, len(lengths), n_features, n_tags, decay)
