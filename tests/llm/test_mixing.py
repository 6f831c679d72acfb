from collections import defaultdict

from hearthline.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, copies string, row_ int"
COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def some(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 53 + 1)), f"s{i % 5}" if i % 3 else "hot") for i in range(600)]
    rows += [(601, None, "s1"), (602, "", None), (603, "a\tb\x0bc d", None), (None, "a b", "s2"), (5, "w w", "s3"), (5, "w w", "s3")]
    return docs(spark, rows)


def level(sizes, weights):
    """Water filling, one step at a time."""
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        open_ = [s for s in sizes if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weights[s] / sum(weights[x] for x in open_) for s in sizes}
        over = [s for s in open_ if target[s] > 3 * sizes[s]]
        if not over:
            return target
        full.update(over)


def test_targets_copies_and_sql(spark, duck):
    table = some(spark)
    result = mixing.mix(table).select(*COLUMNS, "copies")
    rows = result.collect()
    assert len(rows) == table.count()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == duck(
        mixing.SQL, documents=table.select("doc_id", "text", "source")
    )
    by_id = {r.doc_id: r.source for r in table.select("doc_id", "source").collect()}
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = by_id[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        targets[s] = r.target
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = level(sizes, {s: i % 3 + 1 for i, s in enumerate(order)})
    for s in sizes:
        assert abs(targets[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - targets[s]) <= max(60, 0.05 * targets[s])
    assert sorted(map(tuple, mixing.mix(table).select(*COLUMNS, "copies").collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_clashing_columns_and_emitted_copies(spark):
    table = some(spark)
    assert sorted(mixing.mix(table).columns) == sorted(
        ["doc_id", "text", "source", "row_", "size", "source_size", "target", "copies", "taken"]
    )
    out = mixing.emitted(table)
    assert out.columns == table.columns and {r.copies for r in out.collect()} == {"y"}
    assert out.count() == sum(r.copies for r in mixing.mix(table).collect())


def test_empty_and_one_source(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.emitted(docs(spark, [])).count() == 0
    only = mixing.mix(docs(spark, [(1, None, None), (2, "", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)] * 2
    one = mixing.mix(docs(spark, [(i, "a b c", "x") for i in range(10)])).collect()
    assert all(r.copies == 1 and r.target == 30.0 for r in one)


def test_rows_without_doc_id_are_dealt_out_and_taken_alike_in_reruns(spark):
    rows = [(None, f"{i} " * 12, "hot") for i in range(400)] + [(None, "same words", "hot")] * 20 + [(9, "a b", "x")] * 40
    table = docs(spark, rows)
    runs = [sorted(r.text for r in mixing.emitted(table.repartition(n)).collect()) for n in (1, 7)]
    assert runs[0] == runs[1] and len(set(runs[0])) > 100
