"""Exact top-k inner products by best-first search in M-trees.

Components become floor(64 x).  One more component, sqrt(M^2 - |y|^2) with M the longest such
vector of all, gives every vector y the length M; a query q has 0 there.  Then
distance^2 = |q|^2 + M^2 - 2 q.y: the highest inner products are the nearest points of a metric.

Cells of the whole table (``vectors``) are ruled out as far as their bounds allow; each block of a cell is an M-tree of pages.  An entry of an inner page has a routing vector, a
covering radius, the distance to its page's own routing vector (its parent) and
a child page; a leaf page has vectors and their distances to its routing vector.  A
search takes pages from a queue by the least distance that anything in them can
have, and ends when that is beyond the k-th best so far.  Within a page, what the stored
distances rule out by the triangle inequality, |d(q, parent) - d(entry, parent)| - radius
beyond the k-th best, is not computed.  Bounds are widened by ``SLACK`` so that
rounding rules nothing out; scores are exact integers.

Vectors that are null or empty or hold null or non-finite components take no part, nor do
rows without vec_id; zero vectors do.  Of several rows with one vec_id one counts; see
``vectors.usable``.  Ties go to the smaller vec_id.  Scores are exact while vectors are
shorter than 2^26.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table, written
from .vectors import lifted, search, top, usable

K = 20
SCALE = 64
LEAF = 512
FAN = 16
SLACK = 1e-6


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a from the one row b."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


class Pages:
    """An M-tree as arrays: per page its entries, per entry what it needs."""

    def __init__(self) -> None:
        self.first: list[int] = []  # entries of a page
        self.size: list[int] = []
        self.leaf: list[bool] = []
        self.point: list[int] = []  # row of the entry's (routing) vector
        self.radius: list[float] = []
        self.parent: list[float] = []  # distance to the routing vector of the page
        self.child: list[int] = []

    def page(self, leaf: bool, entries: list[tuple[int, float, float, int]]) -> int:
        self.first.append(len(self.point))
        self.size.append(len(entries))
        self.leaf.append(leaf)
        for point, radius, parent, child in entries:
            self.point.append(point)
            self.radius.append(radius)
            self.parent.append(parent)
            self.child.append(child)
        return len(self.first) - 1

    def build(self, z: np.ndarray, rows: np.ndarray, routing: int, rng: np.random.Generator) -> int:
        if len(rows) <= LEAF:
            far = _far(z[rows], z[routing])
            return self.page(True, [(int(r), 0.0, float(d), -1) for r, d in zip(rows, far, strict=True)])
        k = min(FAN, -(-len(rows) // LEAF) * 2)
        pivots = rng.choice(rows, k, replace=False)
        far = np.stack([_far(z[rows], z[p]) for p in pivots])
        near = far.argmin(axis=0)
        if np.bincount(near, minlength=k).max() == len(rows):  # all alike: cut anywhere
            near = np.arange(len(rows)) * k // len(rows)
        entries = []
        for i, p in enumerate(pivots):
            own = rows[near == i]
            if len(own):
                to_parent = float(_far(z[p][None], z[routing])[0])
                entries.append((int(p), float(far[i][near == i].max()), to_parent, self.build(z, own, int(p), rng)))
        return self.page(False, entries)


def tree(ids: np.ndarray, v: np.ndarray, longest2: float) -> bytes:
    """The pages of the M-tree of a block."""
    z, pages = lifted(v, longest2), Pages()
    root = pages.build(z, np.arange(len(ids)), 0, np.random.default_rng(3))
    out = io.BytesIO()
    arrays = {name: np.array(getattr(pages, name)) for name in vars(pages)}
    np.savez(out, ids=ids, z=z, root=np.array(root), **arrays)
    return out.getvalue()


class Tree:
    def __init__(self, raw: bytes, longest2: float) -> None:
        got = np.load(io.BytesIO(raw))
        self.longest2 = longest2
        self.ids, z, self.root = got["ids"], got["z"], int(got["root"])
        self.first, self.size = got["first"].tolist(), got["size"].tolist()
        self.leaf = got["leaf"].tolist()
        self.radius, self.parent, self.child = got["radius"], got["parent"], got["child"]
        # Entries in page order, so that a page is one stretch of memory.
        self.of = self.ids[got["point"]]
        self.y = np.ascontiguousarray(z[got["point"], :-1])
        self.start = z[0]  # the routing vector of the root page
        self.computed = 0

    def search(self, ids: np.ndarray, v: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for query_id, q, floor in zip(ids.tolist(), v, least.tolist(), strict=True):
            yield (query_id, *self.best(query_id, q, floor))

    def best(self, own: int, q: np.ndarray, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best that reach ``floor``."""
        base = float(q @ q) + self.longest2
        slack = SLACK * (1 + np.sqrt(base))
        far = lambda dots: np.sqrt(np.maximum(0.0, base - 2 * dots))
        found_ids, found = np.zeros(0, np.int64), np.zeros(0)
        # Distance of the k-th best, here or in what the query has met before.
        limit = float(far(floor)) + slack if floor > -np.inf else np.inf
        queue = [(0.0, self.root, float(far(self.start[:-1] @ q)))]
        while queue:
            least, page, to_routing = heapq.heappop(queue)
            if least > limit:
                break
            a = self.first[page]
            b = a + self.size[page]
            y, of = self.y[a:b], self.of[a:b]
            bound = np.abs(self.parent[a:b] - to_routing) - self.radius[a:b] - slack
            may = bound <= limit
            if not may.all():
                keep = np.flatnonzero(may)
                y, of = y[keep], of[keep]
            else:
                keep = None
            self.computed += len(y)
            dots = y @ q
            if self.leaf[page]:
                good = dots >= (max(floor, found[-1]) if len(found) == K else floor)
                dots, of = dots[good], of[good]
                other = of != own
                if other.any():
                    found_ids, found = top(
                        np.concatenate([found_ids, of[other]]), np.concatenate([found, dots[other]]), K
                    )
                    if len(found) == K:
                        limit = min(limit, float(far(found[-1])) + slack)
            else:
                d = far(dots)
                radius, child = self.radius[a:b], self.child[a:b]
                if keep is not None:
                    radius, child = radius[keep], child[keep]
                low = np.maximum(0.0, d - radius - slack)
                for i in np.flatnonzero(low <= limit).tolist():
                    heapq.heappush(queue, (float(low[i]), int(child[i]), float(d[i])))
        return found_ids, found.astype(np.int64)


def highest(vectors: DataFrame, is_query: str) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``K`` highest scores of each row that is a query."""
    whole = usable(vectors, zero=True).withColumn(
        "v", F.transform("v", lambda x: F.floor(SCALE * x).cast("double"))
    )
    rows = written(whole, "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    longest2 = float(rows.agg(F.max(square)).first()[0] or 0.0)
    return search(
        rows, is_query, K, longest2, lambda ids, v: tree(ids, v, longest2), lambda raw: Tree(raw, longest2).search, "long"
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return highest(table(spark, folder, "embeddings"), "vec_id % 20 = 0")


SQL = """
WITH whole AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS y
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, x.vec_id, list_dot_product(q.y::DOUBLE[], x.y::DOUBLE[])::BIGINT AS score
    FROM whole q JOIN whole x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 20
"""
