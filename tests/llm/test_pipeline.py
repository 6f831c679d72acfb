from collections import Counter, defaultdict

import corpus_pipeline
from hearthline.llm import jaccard, langid, mixing, packing, toxicity
from hearthline.llm.tables import written
from hearthline.session import shared_dir
from tests.llm.conftest import DATA
from tests.llm.test_jaccard import brute
from tests.llm.test_packing import whole

NAMES = ["language_id", "toxicity", "ngram_jaccard_join", "mixing", "best_fit_packing"]


def test_stages_against_brute_force(spark, table):
    """Each stage on what the one before has kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs = table("documents")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = written(stage[name](spark, docs, DATA), f"test-{name}")
        assert name == NAMES[-1] or out.columns == columns
        return out

    told = step("language_id", docs)
    assert sorted(r.doc_id for r in told.collect()) == sorted(
        r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")
    )
    clean = step("toxicity", told)
    model = toxicity.trained(told, table("labels"))
    rejected = {r.doc_id for r in toxicity.score(told, model).filter("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in told.collect()} - rejected
    one = step("ngram_jaccard_join", clean)
    groups = brute([(r.doc_id, r.text) for r in clean.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted({low for _, _, low in groups})
    mixed = step("mixing", one)
    copies = Counter(r.doc_id for r in mixed.collect())
    assert copies == {r.doc_id: r.copies for r in mixing.mix(one).collect() if r.copies}
    packed = step("best_fit_packing", mixed)
    want, path = Counter(), packing.default_tokenizer()
    for r in mixed.collect():
        want[(r.doc_id, len(whole(path, r.text)) + 1)] += 1
    sizes, pieces = defaultdict(int), Counter()
    for r in packed.collect():
        sizes[r.sequence_id] += r.length
        pieces[r.doc_id] += r.length
    assert max(sizes.values()) <= packing.CAPACITY
    assert pieces == Counter({d: sum(n * c for (x, n), c in want.items() if x == d) for d in copies})


def test_run_is_repeatable(spark):
    a, b = ({(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, DATA).collect()} for _ in range(2))
    assert a == b and a


def test_edges_through_all_stages(spark):
    """Null texts, languages and sources, null and repeated doc_ids, an extra column, labels of nobody; an empty table."""
    folder = shared_dir(spark, "odd")
    text = "the words of this document say the same again and "
    rows = [(i, text + f"number {i} " * (5 + i), "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None) for i in range(60)]
    rows += [(3, rows[3][1], "en", "s1"), (4, "other words for the same name " * 4, "en", "s0"), (None, text * 2, "en", "s0"), (None, None, None, None)]
    rows += [(70, None, "en", "s0"), (71, "", "en", "s0"), (72, "1234 !", "en", "s0"), (73, text * 3000, "en", "s0")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    labels = spark.createDataFrame([(999, 0, 1)], "doc_id long, quality long, toxic long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.sequence_id] += r.length
    assert got and max(sizes.values()) <= packing.CAPACITY
    assert {70, 71, 72}.isdisjoint({r.doc_id for r in got}) and {r.doc_id for r in got} <= {r[0] for r in rows}
    empty = shared_dir(spark, "none")
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    labels.limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
