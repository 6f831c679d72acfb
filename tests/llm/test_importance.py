import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import importance
from hearthline.llm.words import lettered

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, [" ".join(words[i : i + m]) for m in range(1, longest + 1) for i in range(len(words) - m + 1)]


def brute(docs, target, longest, buckets, share, least, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    t = Counter(bucket(f) for x in target for f in features(x, longest)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for d, text in docs:
        words, fs = features(text, longest)
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(words), len(fs), weight, score, None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def corpus():
    rng = random.Random(3)
    words = ["a", "É", "ça", "words", "x1", "longer", "日本", "z" * 300] + [f"w{i}" for i in range(200)]
    rows = [(i, rng.choice(" ,.\n").join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(None, "one Word more " * 9), (200, None), (201, ""), (202, " .,"), (7, rows[7][1]), (7, rows[7][1])]
    return rows, ["words x1 longer w3 w4", None, "ÇA a", "w1 w2 w3"]


@pytest.mark.parametrize("longest,share", [(1, 10), (3, 40)])
def test_brute_force(spark, longest, share):
    rows, target = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, weight string, score int").repartition(4)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resampled(docs, aim, longest, 500, share, 20, 7)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, target, longest, 500, share, 20, 7)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert importance.resampled(none, some).count() == 0
    assert importance.resampled(some, none).count() == 1


def test_crcs_of_all_lengths():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 3000, 300)
    length = np.concatenate([rng.integers(0, 40, 290), [255, 256, 257, 1000, 1, 0, 2, 3, 300, 257]])
    want = [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(start, length)]
    assert importance.crcs(data, start, length).tolist() == want
    assert importance.crcs(data, start[:0], length[:0]).tolist() == []


def test_words_of_neighbouring_texts_stay_apart():
    data = np.frombuffer(b"abcd  EF", np.uint8)
    bucket, owner, words = importance.feature_buckets(lettered(), data, np.array([0, 2, 4, 4, 8]), 2, 1000)
    assert owner.tolist() == [0, 1, 3] and words.tolist() == [1, 1, 0, 1]
    assert bucket.tolist() == [zlib.crc32(w) % 1000 for w in (b"ab", b"cd", b"ef")]


def test_many_equal_scores(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(20).alias("n_features"), F.lit(0).alias("weight"), (F.col("id") % 3).alias("score"))
    got = importance.ranked(rows, F.lit(True), 50).filter("rank IS NOT NULL").orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, 501))
    assert [r.doc_id for r in got] == sorted(range(1000), key=lambda i: (-(i % 3), i))[:500]
