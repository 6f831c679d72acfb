"""Searches of stated queries against all vectors, by cells of the whole table and blocks within them.

One more component gives all vectors the length of the longest, and makes the highest inner products the nearest
points of a metric.  Centres (at most ``CELLS``, placed on a bounded sample of ``SAMPLE`` vectors) split the table into cells; every vector belongs to
its nearest centre, and a cell is known by its centre and the distance of its farthest vector.  A cell of more than
``BLOCK`` vectors is dealt by id into blocks, so a third of all being alike makes no block larger.

A query meets the blocks of the cell that may have the highest score first.  Its k-th best there tells which other cells
can have anything as good, and it meets only their blocks.  Queries go to a block in packs of about ``PACK``.
Where vectors lie in groups, most cells are ruled out; where they are spread evenly, few are, and
work grows with queries times rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

BLOCK = 16_384
PACK = 1_024
#: Centres at most, vectors for each centre as a rule, and vectors that the centres are placed on.
CELLS, CELL, SAMPLE, ROUNDS = 1_024, 4_096, 16_384, 4
SLACK = 1e-9

HITS = "query_id long, vec_id long, score {kind}"


def usable(vectors: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, v): one row for each vec_id, without vectors that are null or empty or hold
    null or non-finite components, nor, unless ``zero``, zero vectors.

    Of several rows with one vec_id the smallest vector counts.  Vectors of another
    length than most have (the longer, if equally many) cannot be compared and are left out.
    """
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")
    ).filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine)
    if not zero:
        rows = rows.filter(F.exists(v, lambda x: x != 0))
    by_size = rows.groupBy(F.size("v").alias("d")).count()
    most = by_size.orderBy(F.desc("count"), F.desc("d")).limit(1).select("d")
    return rows.join(most, F.size("v") == F.col("d")).groupBy("vec_id").agg(F.min("v").alias("v"))


def lifted(v: np.ndarray, longest2: float) -> np.ndarray:
    """Vectors with the component that makes them equally long."""
    rest = np.sqrt(np.maximum(0.0, longest2 - (v * v).sum(axis=1)))
    return np.concatenate([v, rest[:, None]], axis=1)


class Cells:
    """Centres of cells, in lifted vectors, and how far the vectors of each lie from it."""

    def __init__(self, sample: np.ndarray, number: int, longest2: float) -> None:
        self.longest2 = longest2
        z = lifted(sample, longest2)
        self.centres = z[:number]
        for _ in range(ROUNDS if number > 1 else 0):
            near = self.nearest(z)[0]
            n = np.bincount(near, minlength=number)
            total = np.zeros_like(self.centres)
            np.add.at(total, near, z)
            self.centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], self.centres)
        self.radii = np.zeros(number)

    def _squares(self, z: np.ndarray) -> np.ndarray:
        c = self.centres
        return np.maximum(0.0, (z * z).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * z @ c.T)

    def nearest(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each vector, and a bound of the distance."""
        cell = self._squares(z).argmin(axis=1)
        return cell, np.sqrt(((z - self.centres[cell]) ** 2).sum(axis=1)) * (1 + SLACK)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """[query, cell] no inner product of the query with a vector of the cell is higher."""
        z = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        least = np.maximum(0.0, np.sqrt(self._squares(z)) - self.radii)
        most = (q * q).sum(axis=1)[:, None] + self.longest2
        return (most - least**2) / 2 + 1e-6 * (1 + most)


def unpack(ids: bytes, v: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(ids, "<i8")
    return n, np.frombuffer(v, "<f8").reshape(len(n), -1)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _whole(group: pa.Table, keys: list[str], more: tuple[str, ...] = ()) -> dict:
    """ids, vectors (double, one after another) and numbers of a group, in the order of ids."""
    ids = group["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    out = {k: group[k][:1].combine_chunks() for k in keys}
    out["ids"] = pa.array([ids[order].astype("<i8").tobytes()], pa.binary())
    out["v"] = pa.array([_matrix(group["v"].combine_chunks())[order].astype("<f8").tobytes()], pa.binary())
    for name in more:
        out[name] = pa.array([group[name].to_numpy()[order].astype("<f8").tobytes()], pa.binary())
    return out


#: Takes ids and vectors of queries and the scores that a hit of each must reach; yields (query_id, ids, scores) for each.
Search = Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def search(
    vectors: DataFrame,
    is_query: str,
    k: int,
    longest2: float,
    prepare: Callable[[np.ndarray, np.ndarray], bytes],
    searcher: Callable[[bytes], Search],
    kind: str,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best of each query; ``longest2`` is the square of the longest vector's length.

    ``prepare`` turns the ids and vectors of a block into its index, ``searcher`` opens an
    index, and what it gives yields for each query its best in the block, without the query itself.
    """
    spark = vectors.sparkSession
    total = vectors.count()
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not chosen:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {kind}")
    cells = Cells(np.array([r.v for r in chosen]), min(CELLS, len(chosen), max(1, total // CELL)), longest2)

    def assign(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                cell, far = cells.nearest(lifted(_matrix(part.column(1)), longest2))
                columns = [*part.columns, pa.array(cell, pa.int32()), pa.array(far)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "cell", "far"])

    dealt = written(vectors.select("vec_id", "v").mapInArrow(assign, "vec_id long, v array<double>, cell int, far double"), "cells")
    parts_of = np.ones(len(cells.radii), np.int64)
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # at most CELLS rows
        cells.radii[r.cell], parts_of[r.cell] = r.far, -(-r.n // BLOCK)
    first = np.cumsum(parts_of) - parts_of
    of_cell = lambda numbers: F.get(F.array(*[F.lit(int(x)) for x in numbers]), F.col("cell"))
    block = (of_cell(first) + F.pmod(F.xxhash64("vec_id"), of_cell(parts_of))).cast("long").alias("block")

    def index(group: pa.Table) -> pa.Table:
        row = _whole(group, ["block"])
        made = prepare(*unpack(row["ids"][0].as_py(), row["v"][0].as_py()))
        return pa.table({"block": row["block"], "index": pa.array([made], pa.binary())})

    indexed = written(dealt.select(block, "vec_id", "v").groupBy("block").applyInArrow(index, "block long, index binary"), "blocks")

    def pack(group: pa.Table) -> pa.Table:
        return pa.table(_whole(group, ["block"], ("least",)))

    def meet(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, find = None, None
        for part in parts:
            for i in range(len(part)):
                if (now := part["block"][i].as_py()) != last:
                    last, find = now, searcher(part["index"][i].as_py())
                least = np.frombuffer(part["least"][i].as_py(), "<f8")
                found = list(find(*unpack(part["ids"][i].as_py(), part["v"][i].as_py()), least))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat([q for q, _, _ in found], [len(x) for _, x, _ in found]), pa.int64()),
                            pa.array(np.concatenate([x for _, x, _ in found]), pa.int64()),
                            pa.array(np.concatenate([s for _, _, s in found])).cast(
                                pa.float64() if kind == "double" else pa.int64()
                            ),
                        ],
                        names=["query_id", "vec_id", "score"],
                    )

    def round_(asked: DataFrame, rounds: str) -> DataFrame:
        """The best of all (block, vec_id, v, least)."""
        asked = written(asked, rounds)
        packs = asked.groupBy("block").agg(F.ceil(F.count("*") / PACK).alias("packs"))
        part = F.pmod(F.xxhash64("vec_id"), F.col("packs")).alias("pack")
        packed = asked.join(packs, "block").select("block", part, "vec_id", "v", "least").groupBy("block", "pack")
        full = packed.applyInArrow(pack, "block long, ids binary, v binary, least binary")
        met = full.join(indexed, "block").select("block", "index", "ids", "v", "least")
        return met.mapInArrow(meet, HITS.format(kind=kind))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def top_of(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def reach(parts: Iterator[pa.RecordBatch], home: bool) -> Iterator[pa.RecordBatch]:
        """Which blocks each query meets: those of the cell with the highest bound, or of all others that reach its least score."""
        for part in parts:
            if not part.num_rows:
                continue
            bounds = cells.bounds(_matrix(part.column(1)))
            at = bounds.argmax(axis=1)
            least = part.column(2).to_numpy()
            to = bounds >= least[:, None]
            own = np.arange(len(at))
            to[own, at] = False
            if home:
                to[:] = False
                to[own, at] = True
            row, cell = np.nonzero(to)
            n = parts_of[cell]
            row, cell = np.repeat(row, n), np.repeat(cell, n)
            inside = np.arange(len(cell)) - np.repeat(np.cumsum(n) - n, n)
            for a in range(0, len(row), 4096):
                some = pa.array(row[a : a + 4096])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first[cell[a : a + 4096]] + inside[a : a + 4096]), *(part.column(j).take(some) for j in range(3))],
                    ["block", "vec_id", "v", "least"],
                )

    shape = "block long, vec_id long, v array<double>, least double"
    queries = dealt.filter(is_query).select("vec_id", "v")
    nothing = queries.withColumn("least", F.lit(float("-inf")))
    near = written(top_of(round_(nothing.mapInArrow(lambda p: reach(p, True), shape), "asked-first")), "near")
    kth = near.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
    least = queries.join(kth, "vec_id", "left").select("vec_id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("least"))
    other = round_(least.mapInArrow(lambda p: reach(p, False), shape), "asked-then")
    ranked = top_of(near.drop("rank").unionByName(other))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= least
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]
