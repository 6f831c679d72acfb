import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from hearthline.llm import toxicity
from hearthline.llm.words import lettered

SCHEMA = "doc_id long, text string, lang string, score string, found int"


def corpus(n=900, seed=5):
    """Texts of two languages; toxic ones hold a word of a few stems."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(n):
        lang = "ab"[i % 2]
        words = [lang + "".join(rng.choice("stuvwx") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(5, 120))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[rng.randrange(len(words))] = "krnk" + rng.choice("stuvwx") * rng.randint(1, 3) if lang == "a" else "zzbad"
        rows.append((i, " ".join(words), lang))
        labels.append((i, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def model(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return toxicity.trained(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_accuracy(spark, model):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = toxicity.score(docs, model).filter(toxicity.is_held_out()).collect()
    truth = dict(labels)
    assert len(found) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in found]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_scores_equal_the_plain_convolution(model):
    rows, _ = corpus(40, 9)
    texts = pa.array([t for _, t, _ in rows] + [None, "", "one", "a b"])
    net, scorer = model.net, model.scorer()
    words = toxicity.texts_to_words(texts, lettered())
    for ids, got in zip(words, scorer.score(texts), strict=True):
        pads = np.full((2, ids.shape[1] if ids.ndim == 2 else 3), toxicity.PAD)
        embedded = net.words[np.concatenate([ids.reshape(-1, 3), pads])].sum(axis=1)
        act = []
        for f, b in zip(net.filters, net.bias, strict=True):
            each = [sum(embedded[i + j] @ f[j] for j in range(len(f))) for i in range(len(ids))]
            act.append(np.maximum(np.max(each, axis=0) + b, 0) if each else np.zeros(toxicity.FILTERS))
        logit = np.concatenate(act) @ net.out + net.base
        lang = model.langs[ids.reshape(-1, 3)[:, 0]].sum(axis=0).argmax()
        assert abs(1 / (1 + np.exp(-(logit - model.thresholds[lang]))) - got) < 1e-3


def test_edges(spark, model):
    rows = [(1, None, "a", "s", 1), (2, "", None, "s", 1), (3, " ?! ", "a", None, None), (None, "zzbad asst", "b", "s", 1), (5, "bs " * 200_000 + "zzbad", "b", "s", 1), (5, "bst bsv", "b", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = toxicity.score(docs, model)
    assert found.columns == ["doc_id", "text", "lang", "found", "score", "predicted"]
    scores = {(r.doc_id, len(r.text or "")): r.predicted for r in found.collect()}
    assert scores == {(1, 0): 0, (2, 0): 0, (3, 4): 0, (None, 10): 1, (5, 600_005): 1, (5, 7): 0}
    assert toxicity.clean(docs, model).columns == docs.columns and toxicity.clean(docs, model).count() == 4
    assert toxicity.score(docs.limit(0), model).count() == 0
    nothing = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    for labels in (nothing, nothing.limit(0)):
        bare = toxicity.trained(docs, labels)
        assert {r.score for r in toxicity.score(docs, bare).collect()} == {0.0}


def test_repeated_rows_do_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TOXIC", 300)
    monkeypatch.setattr(toxicity, "OTHER", 300)
    rows, labels = corpus()
    again = next(r for r in rows if dict(labels)[r[0]] == 0 and zlib.crc32(str(r[0]).encode()) % 5)
    labels = [(d, t) for d, t in labels if t or d == again[0] or d % 4 == 0]
    rows = [(again[0], f"{again[1]} {k}", again[2]) for k in range(1000)] + rows
    scores = []
    for some in (rows, rows[::-1]):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string").coalesce(1)
        model = toxicity.trained(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores.append(model.scorer().score(pa.array(["zzbad asst", *(t for _, t, _ in corpus(20, 9)[0])])))
    assert np.array_equal(*scores) and scores[0].max() > 0.5


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    """A toxic word that only long documents hold, more rows than one shard has, and the same net from any order."""
    monkeypatch.setattr(toxicity, "TOXIC", 100)
    monkeypatch.setattr(toxicity, "OTHER", 200)
    monkeypatch.setattr(toxicity, "RUN", 1000, raising=False)
    rows, labels = corpus()
    for i in range(1000, 1080):
        rows.append((i, "bs bt " * 3000 + ("bs qqvile" if i % 2 else "bs bt") + " bu" * (i % 7), "b"))
        labels.append((i, i % 2))
    scores = []
    for some, parts in ((rows, 1), (rows[::-1], 5)):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string").repartition(parts)
        model = toxicity.trained(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        scores.append(model.scorer().score(pa.array(["bs bt qqvile bs", "bs bt bu bs", "zzbad bs", *(t for _, t, _ in corpus(20, 9)[0])])))
    assert np.array_equal(*scores)
    assert scores[0][0] > 0.5 and scores[0][1] < 0.5 and scores[0][2] > 0.5
