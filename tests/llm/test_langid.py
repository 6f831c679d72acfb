import numpy as np
import pytest

from hearthline.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string, found int"


def costs(sample, parser, text):
    """Cross parsing by substring search."""
    codes, out = parser.normal(text).tolist(), []
    for lang in parser.langs:
        known = bytes(c for t in sample[lang] for c in [2, *parser.normal(t).tolist()])
        phrases = 0
        now = b""
        for c in codes:
            if now + bytes([c]) in known:
                now += bytes([c])
            else:
                phrases += 1
                now = bytes([c]) if bytes([c]) in known else b""
        phrases += now != b""
        out.append(phrases * np.log2(len(known)) / len(codes))
    return out


@pytest.mark.parametrize("stretch,sync", [(1024, 128), (100, 128), (7, 3), (40, 0)])
def test_phrases_equal_brute_force(spark, table, monkeypatch, stretch, sync):
    monkeypatch.setattr(langid, "STRETCH", stretch)  # texts go on over many stretches
    monkeypatch.setattr(langid, "SYNC", sync)
    docs = table("documents")
    sample = langid.labelled_sample(docs)
    assert set(sample) == {"en", "fr", "de", "es"} and max(map(len, sample.values())) <= langid.DOCS
    parser = langid.CrossParser(sample)
    texts = [r.text for r in docs.limit(12).collect()] + ["été 3 Ω кот", "a" * 5000, "x"]
    for which, got in parser.costs(texts):
        for k, i in enumerate(which):
            assert np.allclose(got[:, k], costs(sample, parser, texts[i]))


def test_held_out_accuracy(spark, table):
    docs = table("documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, langid.labelled_sample(docs.filter(~langid.is_held_out())))
    rows = found.filter(langid.is_held_out()).collect()
    assert len(rows) > 20 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [
        (1, None, "en", "s", 1), (2, "", "en", "s", 1), (3, "12 !? \n", "en", "s", 1), (None, "the cat", None, None, None),
        (5, "the cat sat on the mat", "en", "s", 1), (6, "le chat est sur la table", "fr", "s", 1), (7, "the mat " * 40_000, None, "s", 1),
        (7, "the mat " * 40_000, None, "s", 1),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    sample = langid.labelled_sample(docs)
    assert sample == {"en": [rows[4][1]], "fr": [rows[5][1]]}
    found = langid.identify(docs, sample)
    assert found.columns == ["doc_id", "text", "lang", "found", "lang_pred", "score"]
    by = {(r.doc_id): (r.lang_pred, r.score) for r in found.collect()}
    assert [by[k][0] for k in (1, 2, 3, None, 5, 6, 7)] == ["und", "und", "und", "en", "en", "fr", "en"]
    assert by[1][1] == 0.0 and found.count() == 8
    kept = langid.known(docs, sample)
    assert kept.columns == docs.columns and kept.count() == 5
    assert langid.identify(docs.limit(0), sample).count() == 0
    nothing = langid.labelled_sample(docs.limit(0))
    assert nothing == {} and {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_whole_texts_are_learned_from_and_columns_kept(spark):
    texts = ["ab " * 900, "cd " * 300, "x" * (langid.LONGEST + 1), "ef " * 2000] + ["gh"] * (langid.DOCS - 3)
    docs = spark.createDataFrame([(i, t, "en", "a", "b") for i, t in enumerate(texts)], "doc_id long, text string, lang string, found_ string, `l.p` string")
    (sample,) = langid.labelled_sample(docs).values()
    assert sorted(sample, key=len)[-3:] == [texts[1], texts[0], texts[3]] and len(sample) == langid.DOCS
    got = langid.identify(docs.withColumn("lang_pred", docs.lang), {"en": sample})
    assert got.columns == ["doc_id", "text", "lang", "found_", "l.p", "lang_pred", "score"]
    assert {(r.found_, r["l.p"]) for r in got.collect()} == {("a", "b")}


def test_alphabets_of_any_size(monkeypatch):
    rng = np.random.default_rng(1)

    def writer(start, n):
        words = ["".join(chr(start + c) for c in rng.integers(0, n, 3)) for _ in range(150)]
        return lambda: " ".join(words[i] for i in rng.zipf(1.3, 60) % 150)

    alphabets = {"en": (97, 26), "ja": (0x3041, 80), "ko": (0xAC00, 600), "xx": (0xAC00, 600), "zh": (0x4E00, 1500)}
    write = {lang: writer(*of) for lang, of in alphabets.items()}
    sample = {lang: [write[lang]() for _ in range(12)] for lang in write}
    parser = langid.CrossParser(sample)
    assert len({c for ts in sample.values() for t in ts for c in t}) > 600
    texts = {lang: [write[lang]() for _ in range(5)] for lang in write}
    for lang, of in texts.items():
        assert parser.predict(of)[0] == [lang] * len(of)
    some = [t for of in texts.values() for t in of] + ["x" * 3000, "Ω кот " + chr(0xAC00) * 9]
    [(which, want)] = parser.costs(some)
    assert (which, len(want)) == (list(range(len(some))), 5)
    for k, text in enumerate(some):
        codes = parser.normal(text).tolist()
        for i, lang in enumerate(parser.langs):
            known = "".join(chr(c) for t in sample[lang] for c in [2, *parser.normal(t).tolist()])
            phrases = 0
            now = ""
            for c in map(chr, codes):
                if now + c in known:
                    now += c
                else:
                    phrases, now = phrases + 1, c if c in known else ""
            phrases += now != ""
            assert np.isclose(want[i, k], phrases * np.log2(len(known)) / len(codes))
    assert parser.table is None
    monkeypatch.setattr(langid, "DENSE", 0)
    sparse = langid.CrossParser(sample)
    assert sparse.table is not None
    [(_, got)] = sparse.costs(some)
    assert (got == want).all()
