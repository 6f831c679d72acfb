import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from hearthline.llm import components, jaccard, tables


def brute(rows):
    """(doc_id, size, smallest id reachable) with sets of plain shingles."""
    sets = {}
    for d, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
        sets.setdefault(d, []).append(
            {tuple(words)} if 0 < len(words) < 4 else {tuple(words[i : i + 4]) for i in range(len(words) - 3)}
        )
    best = {d: d for d in sets}
    links = []
    for a, b in combinations([(d, s) for d, each in sets.items() for s in each], 2):
        both = len(a[1] & b[1])
        if both and 100 * both >= 85 * len(a[1] | b[1]):
            links.append((a[0], b[0]))
    for _ in best:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    return sorted(((d, len(s), best[d]) for d, each in sets.items() for s in each), key=str)


def texts(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    hot = " ".join(rng.choice(words) for _ in range(12))
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(rng.choice([1, 2, 9])):
            now = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 25])):
                now[rng.randrange(len(now))] = rng.choice(words)
            rows.append(" ".join(now) + (" " + hot if g % 3 == 0 else ""))
    rows += [hot, hot.upper(), hot + " more", "a b c", "A\tb\nc", "a b", None, "", " \t ", "é É", "é é"]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("frequent,long", [(1024, 400), (3, 10_000), (3, 60)])
def test_brute_force(spark, monkeypatch, frequent, long):
    """Also with nearly all shared shingles taken as frequent, so pairs of them are indexed, for sets of some sizes."""
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "CHUNK", 1500)
    monkeypatch.setattr(jaccard, "HEAVY", 4)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.join(docs).collect()), key=str) == brute(rows)


def test_edges(spark):
    long = "x y z w " * 50_000
    rows = [(1, None, 1), (2, "", 2), (3, long, 3), (9, long, 3), (None, long, 4), (3, long, 3), (4, "one two", 5), (4, long, 5), (7, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id int").repartition(2)
    got = sorted(map(tuple, jaccard.join(docs).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 4, 3), (9, 4, 3), (None, 4, None), (3, 4, 3), (4, 1, 3), (4, 4, 3), (7, 0, 7)], key=str)
    kept = jaccard.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 3, 7, None]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_shingles_hash_order_and_length():
    words = np.arange(1, 9, dtype=np.uint64)
    assert len(set(jaccard.shingles(words).tolist())) == 5
    assert jaccard.shingles(words[:3])[0] != jaccard.shingles(words[[1, 0, 2]])[0]
    assert len(jaccard.shingles(words[:0])) == 0


def test_row_kept_of_a_doc_id_does_not_depend_on_order(spark):
    rows = [(i, f"text {k} of document {i} in words of its own {i * k}", f"s{k}") for i in range(5) for k in range(4)]
    kept = [
        sorted(map(tuple, jaccard.deduplicated(spark.createDataFrame(some, "doc_id long, text string, `a.b` string").coalesce(1)).collect()))
        for some in (rows, rows[::-1])
    ]
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == list(range(5))


def test_keys_grow_with_the_text_and_not_its_square(spark, monkeypatch):
    """Long near copies, all of whose shingles are frequent."""
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**9)}" for _ in range(6000)]
    rows = []
    for i in range(12):
        now = list(words)
        now[500 * i // 2] = f"x{i}"
        rows.append((i, " ".join(now)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    most = jaccard.sets(docs).selectExpr("max(size(keys)) AS n").first().n
    assert 0 < most <= 0.15 * 6000 + 2
    assert {r.component_id for r in jaccard.join(docs).collect()} == {0}


def test_few_links_are_written_as_few_files(spark, monkeypatch):
    """However many shuffle partitions there are: each file makes the executor's JVM start processes."""
    paths = []

    def shared_dir(session, name, make=tables.shared_dir):
        paths.append(make(session, name))
        return paths[-1]

    monkeypatch.setattr(tables, "shared_dir", shared_dir)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = texts()
        got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
        files = {p: len(list(Path(p.removeprefix("file:")).glob("*.parquet"))) for p in paths}
        assert len(files) > 10 and max(n for p, n in files.items() if "/links-" in p or "/label" in p or "/linked-" in p) <= jaccard.FILES
        graph = spark.range(300).selectExpr("id AS a", "id + 1 AS b").filter("a % 3 < 2")
        whole = {r.id: r.label for r in components.components(graph, 5).collect()}
        assert whole == {i: i - i % 3 for i in range(300)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
