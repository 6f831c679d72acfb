"""Approximate nearest neighbours by multi-index hashing.

Directions are turned by ``ROTATIONS`` rotations, learned on a bounded sample (``SAMPLE``
vectors, those with the smallest hash of their id) so that the signs of the turned
components lose as little as they can (iterative quantization).  The signs of all rotations
are a vector's code.  Cells of the whole table (``vectors``) that can have nothing as near as the
k-th best found are left out.  A code is split into substrings, and each block
of vectors has an index of each substring.  They have as many bits as number the block's vectors, and at most
``BITS``: an index has about a bucket for each vector, so that probing meets few empty ones.  A query probes in every index the
buckets within a small radius of its own substring.  By the pigeonhole principle,
m indexes probed at radius r give every vector whose code differs in less than m * (r + 1) bits,
and many beyond.  What is found is reranked by the inner product of the vectors.

The radius starts at 0 and grows until a vector as near as the k-th best found so
far would have been found with a probability of ``SURE``: a direction that differs by an
angle t has each sign changed with probability t / pi.  Every vector is indexed; at the
widest radius all are found, so a query gets k results where there are k candidates.

Inner products are made angles by one more component that gives all vectors the
length of the longest.  Vectors that are null, zero or empty or hold null or
non-finite components take no part, nor do rows without vec_id.  Of several rows with one
vec_id one counts; see ``vectors.usable``.  Ties go to the smaller vec_id, equal vectors have
equal scores.  An empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from math import comb

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, written
from .vectors import search, top, usable

K = 20
SAMPLE = 4096
ROTATIONS = 6
BITS = 16
SURE = 0.97
ROUNDS = 15


def directions(v: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """Unit vectors whose angles order as the inner products."""
    size = np.sqrt((v * v).sum(axis=1))
    if query:
        return np.concatenate([v / size[:, None], np.zeros((len(v), 1))], axis=1)
    more = np.sqrt(np.maximum(0, 1 - (size / longest) ** 2))
    return np.concatenate([v / longest, more[:, None]], axis=1)


def learned_rotations(sample: np.ndarray, count: int = ROTATIONS) -> np.ndarray:
    """[rotation, component, component]; rotations that differ by where they start."""
    d = sample.shape[1]
    out = []
    for k in range(count):
        turn = np.linalg.qr(np.random.default_rng(k).normal(size=(d, d)))[0]
        for _ in range(ROUNDS if len(sample) else 0):
            signs = np.where(sample @ turn > 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(sample.T @ signs)
            turn = left @ right
        out.append(turn)
    return np.stack(out)


def width(n: int, d: int) -> int:
    """Bits of the substrings for ``n`` vectors of ``d`` components."""
    return max(1, min(BITS, d, n.bit_length() - 1))


def codes(v: np.ndarray, turns: np.ndarray, bits: int = BITS) -> np.ndarray:
    """[substring, vector] numbers of so many bits, or of all bits where there are fewer."""
    d = turns.shape[1]
    bits = min(bits, d)
    per = d // bits
    weights = (1 << np.arange(bits)).astype(np.int64)
    return np.concatenate(
        [((v @ t > 0)[:, : per * bits].reshape(len(v), per, bits) @ weights).T for t in turns]
    )


def masks(bits: int, r: int) -> np.ndarray:
    """All numbers of ``bits`` bits of which r are set."""
    every = np.arange(1 << bits, dtype=np.int64)
    return every[np.bitwise_count(every) == r]


def chance(bits: int, tables: int, r: int, angle: float) -> float:
    """Of finding a direction at this angle with some table probed at radius r."""
    p = angle / np.pi
    one = sum(comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(r + 1))
    return 1 - (1 - one) ** tables


class Block:
    """The vectors of a block and the indexes of their substrings."""

    def __init__(
        self, ids: np.ndarray, v: np.ndarray, sub: np.ndarray, turns: np.ndarray, longest: float, bits: int = BITS
    ) -> None:
        self.ids, self.v, self.turns, self.longest = ids, v, turns, longest
        self.bits = min(bits, turns.shape[1])
        self.near = v.astype(np.float32)
        m, n = sub.shape
        self.order = np.concatenate([np.argsort(s, kind="stable") for s in sub])
        counts = np.concatenate([np.bincount(s, minlength=1 << self.bits) for s in sub])
        self.filled = counts > 0
        self.first = np.concatenate([[0], np.cumsum(counts)])  # of each bucket, and of the one behind it
        self.rings = [masks(self.bits, r) for r in range(self.bits + 1)]
        grid = np.linspace(0, np.pi, 181)
        self.chances = np.array([[chance(self.bits, m, r, a) for a in grid] for r in range(self.bits + 1)])

    def probe(self, code: np.ndarray, r: int) -> np.ndarray:
        """Places of the vectors whose substrings differ from the query's in exactly r bits."""
        base = np.arange(len(code)) << self.bits
        at = ((base | code)[:, None] ^ self.rings[r]).ravel()
        at = at[self.filled[at]]
        first = self.first[at]
        size = self.first[at + 1] - first
        ahead = np.cumsum(size) - size
        return self.order[np.repeat(first - ahead, size) + np.arange(size.sum())]

    def search(self, ids: np.ndarray, v: np.ndarray, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        sub = codes(directions(v, self.longest, True), self.turns, self.bits)
        length = np.sqrt((v * v).sum(axis=1))
        slack = 1e-5 * self.longest
        for i in range(len(ids)):
            seen = np.zeros(len(self.ids), bool)
            own = np.searchsorted(self.ids, ids[i])
            query = v[i].astype(np.float32)
            rough = np.full(len(self.ids), -np.inf, np.float32)
            for r in range(self.bits + 1):
                got = self.probe(sub[:, i], r)
                fresh = np.zeros(len(seen), bool)
                fresh[got] = True
                fresh &= ~seen
                if own < len(self.ids) and self.ids[own] == ids[i]:
                    fresh[own] = False
                seen |= fresh
                new = np.flatnonzero(fresh)
                rough[new] = self.near.take(new, axis=0) @ query
                found = np.flatnonzero(seen)
                least = floor[i]  # the k-th best of what the query has met before
                if len(found) >= K:
                    best = rough[found]
                    least = max(least, np.partition(best, len(best) - K)[len(best) - K])
                if least == -np.inf:
                    continue
                angle = np.arccos(np.clip(least / (length[i] * self.longest), -1, 1))
                if self.chances[r][int(round(angle * 180 / np.pi))] >= SURE:
                    break
            found = np.flatnonzero(seen)
            if len(found) > K:
                best = rough[found]
                least = np.partition(best, len(best) - K)[len(best) - K]
                found = found[best >= least - slack * length[i]]
            # The same order of additions for every row: equal vectors, equal scores.
            exact = (self.v[found] * v[i]).sum(axis=1)
            yield int(ids[i]), *top(self.ids[found], exact, K)


def fitted(vectors: DataFrame) -> tuple[np.ndarray, float]:
    """Rotations learned on the sample, and the length of the longest vector of all."""
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    longest = vectors.agg(F.max(length)).first()[0]
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return np.zeros((ROTATIONS, 1, 1)), 1.0
    longest = float(longest) * (1 + 1e-12)
    return learned_rotations(directions(np.array([r.v for r in sample]), longest)), longest


def index_of(ids: np.ndarray, v: np.ndarray, turns: np.ndarray, longest: float) -> bytes:
    bits = width(len(ids), turns.shape[1])
    out = io.BytesIO()
    np.savez(out, ids=ids, v=v, sub=codes(directions(v, longest), turns, bits), bits=bits)
    return out.getvalue()


def opened(index: bytes, turns: np.ndarray, longest: float) -> Block:
    got = np.load(io.BytesIO(index))
    return Block(got["ids"], got["v"], got["sub"], turns, longest, int(got["bits"]))


def nearest(vectors: DataFrame, is_query: str) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``K`` nearest found for each row that is a query."""
    rows = written(usable(vectors, zero=False), "vectors")
    turns, longest = fitted(rows)

    def prepare(ids: np.ndarray, v: np.ndarray) -> bytes:
        return index_of(ids, v, turns, longest)

    def searcher(index: bytes):
        return opened(index, turns, longest).search

    return search(rows, is_query, K, longest**2, prepare, searcher, "double")


def query(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"), "vec_id % 20 = 0")
