import numpy as np
import pytest

from hearthline.llm import hashing, mtree, vectors

SCHEMA = "vec_id long, embedding array<float>, score int, v string"


def rows_of(table):
    return {r.vec_id: np.array(r.embedding, float) for r in table.collect()}


@pytest.mark.parametrize("cell", [4096, 40])
def test_hashing_recall_and_scores(spark, table, monkeypatch, cell):
    """In one cell and in several, some of several blocks."""
    monkeypatch.setattr(vectors, "CELL", cell)
    monkeypatch.setattr(vectors, "BLOCK", min(16_384, cell))
    rows = table("embeddings")
    known = rows_of(rows)
    got = {}
    for r in hashing.nearest(rows, "vec_id % 20 = 0").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q, found in got.items():
        scores = {i: float((v * known[q]).sum()) for i, v in known.items() if i != q}
        want = sorted(scores, key=lambda i: (-scores[i], i))[: hashing.K]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(want) + 1))
        assert [(i, s) for _, i, s in found] == sorted(((i, s) for _, i, s in found), key=lambda x: (-x[1], x[0]))
        assert all(abs(s - scores[i]) < 1e-12 for _, i, s in found)
        hits += len(set(want) & {i for _, i, _ in found})
        total += len(want)
    assert len(got) == sum(i % 20 == 0 for i in known) and hits >= 0.9 * total


def test_pigeonhole_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(3000, 24))
    longest = float(np.sqrt((v * v).sum(axis=1)).max())
    turns = hashing.learned_rotations(hashing.directions(v[:500], longest), 2)
    sub = hashing.codes(hashing.directions(v, longest), turns)
    block = hashing.Block(np.arange(3000), v, sub, turns, longest)
    m, radius = len(sub), 3
    for q in range(0, 3000, 500):
        found = np.unique(np.concatenate([block.probe(sub[:, q], r) for r in range(radius + 1)]))
        away = np.bitwise_count(sub ^ sub[:, q : q + 1]).sum(axis=0)
        assert set(np.flatnonzero(away < m * (radius + 1))) <= set(found)
        assert all((np.bitwise_count(sub[:, i] ^ sub[:, q]) <= radius).any() for i in found)


def test_probed_buckets_grow_with_the_block_and_not_beyond_it(monkeypatch):
    """A small block has short substrings: a query looks up no more buckets than a few for each vector."""
    rng = np.random.default_rng(6)
    asked = []
    probe = hashing.Block.probe
    monkeypatch.setattr(hashing.Block, "probe", lambda b, code, r: asked.append(len(code) * len(b.rings[r])) or probe(b, code, r))
    for n in (300, 4000):
        v = rng.normal(size=(n, 64))
        v /= np.sqrt((v * v).sum(axis=1))[:, None]
        longest = 1.0 + 1e-9
        turns = hashing.learned_rotations(hashing.directions(v, longest), 6)
        block = hashing.opened(hashing.index_of(np.arange(n), v, turns, longest), turns, longest)
        asked.clear()
        hits = 0
        for q, found, _ in block.search(np.arange(0, n, 20), v[::20], np.full(len(v[::20]), -np.inf)):
            scores = v @ v[q]
            scores[q] = -2
            hits += len(set(np.argsort(-scores)[: hashing.K]) & set(found))
        assert hits >= 0.97 * hashing.K * len(v[::20])
        assert sum(asked) < 8 * n * len(v[::20])


def brute(known, k=20):
    whole = {i: np.floor(64 * v) for i, v in known.items()}
    out = []
    for q in (i for i in whole if i % 20 == 0):
        scores = sorted(((-int(v @ whole[q]), i) for i, v in whole.items() if i != q))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def test_mtree_is_exact_over_many_pages_and_blocks(spark, table, monkeypatch, duck):
    monkeypatch.setattr(vectors, "BLOCK", 90)
    monkeypatch.setattr(vectors, "CELL", 50)
    monkeypatch.setattr(vectors, "PACK", 4)
    monkeypatch.setattr(mtree, "LEAF", 8)
    monkeypatch.setattr(mtree, "FAN", 4)
    rows = table("embeddings")
    got = sorted(map(tuple, mtree.highest(rows, "vec_id % 20 = 0").collect()))
    assert got == brute(rows_of(rows))
    assert got == sorted(duck(mtree.SQL, embeddings=rows))


def test_mtree_bounds_spare_computations():
    rng = np.random.default_rng(2)
    v = np.floor(64 * np.concatenate([rng.normal(c, 0.02, (400, 3)) for c in rng.normal(size=(30, 3))]))
    longest2 = float((v * v).sum(axis=1).max())
    ids = np.arange(len(v))
    tree = mtree.Tree(mtree.tree(ids, v, longest2), longest2)
    for q in range(0, len(v), 997):
        found, scores = tree.best(q, v[q])
        want = sorted((-int(x @ v[q]), i) for i, x in enumerate(v) if i != q)[:20]
        assert [(-s, i) for i, s in zip(found.tolist(), scores.tolist(), strict=True)] == want
    assert tree.computed < 0.7 * len(v) * 13


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (40, [0.0, 0.0]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 0.0])]
    rows += [(7, [None, 1.0]), (None, [1.0, 0.0]), (8, [0.5, 0.5, 0.5]), (60, [0.25, -1.0]), (1, [1.0, 0.0]), (9, [-1.0, 0.5])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    near = sorted(map(tuple, hashing.nearest(table, "vec_id % 20 = 0").collect()))
    ids = [20, 1, 2, 60, 9]
    known = {i: np.array(v, float) for i, v in rows if i in ids}
    want = []
    for q in (20, 60):
        order = sorted(((-float(v @ known[q]), i) for i, v in known.items() if i != q))
        want += [(q, n, i, -s) for n, (s, i) in enumerate(order, 1)]
    assert near == sorted(want)
    known[40] = np.array([0.0, 0.0])
    assert sorted(map(tuple, mtree.highest(table, "vec_id % 20 = 0").collect())) == brute(known)
    for search in (hashing.nearest, mtree.highest):
        assert search(table.limit(0), "vec_id % 20 = 0").count() == 0
        alone = search(table.filter("vec_id = 20"), "vec_id % 20 = 0")
        assert alone.count() == 0 and alone.columns == ["query_id", "rank", "vec_id", "score"]


def test_equal_vectors_tie_by_id(spark):
    rows = [(i, [0.6, 0.8]) for i in range(1, 200)] + [(200, [0.6, 0.8])]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    for search in (hashing.nearest, mtree.highest):
        got = [r.vec_id for r in search(table, "vec_id = 200").orderBy("rank").collect()]
        assert got == list(range(1, 21))


def test_cells_rule_out_others_where_vectors_lie_in_groups(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(64, 16))
    centres /= np.sqrt((centres**2).sum(axis=1))[:, None]
    share = {}
    for n in (2_000, 16_000):
        v = centres[rng.integers(0, 64, n)] + rng.normal(0, 0.03, (n, 16))
        longest2 = float((v * v).sum(axis=1).max())
        cells = vectors.Cells(v[:2000], 64, longest2)
        cell, far = cells.nearest(vectors.lifted(v, longest2))
        np.maximum.at(cells.radii, cell, far)
        bounds = cells.bounds(v[::50])
        scores = v[::50] @ v.T
        for c in range(64):
            if (cell == c).any():
                assert (scores[:, cell == c].max(axis=1) <= bounds[:, c]).all()
        kth = np.sort(scores, axis=1)[:, -21]
        share[n] = (bounds >= kth[:, None]).mean()
    assert share[16_000] <= share[2_000] < 0.25
