import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from hearthline.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least, half, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in (1, 2, 3):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) == 1 or a < least:
                continue
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and b >= least and 100 * b >= half * a for q, b in counts.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        found.sort()
        out += [(lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def some():
    rng = random.Random(5)
    words = ["New", "york", "city", "of", "the", "Straße", "é", "日本"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        said = [rng.choice(["new york", "new york city", "of the", rng.choice(words), rng.choice(words)]) for _ in range(rng.randrange(50))]
        rows.append((["en", "de", None, ""][i % 4], "".join(w + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " \x0b", "\xa0"]) for w in said)))
    return rows + [("en", None), ("fr", ""), ("fr", " . ,"), ("und", "new york " * 30), rows[0], rows[0], ("en", "x" * 100_000)]


@pytest.mark.parametrize("least,top,bits,block", [(10, 2000, 1 << 26, 1 << 20), (2, 7, 1 << 18, 300)])
def test_brute_force(spark, monkeypatch, least, top, bits, block):
    """Also with a crowded filter and small blocks."""
    monkeypatch.setattr(collocations, "FILTER_BITS", bits)
    monkeypatch.setattr(collocations, "BLOCK", block)
    rows = some()
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "lang string, text string, n int, word string").repartition(3)
    got = collocations.collocations(docs, least, 50, top).select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, 50, top)


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(docs).collect() == []


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 9_000_000_000_000
    counts = [("en", 1, "a", None, None, big), ("en", 1, "b", None, None, big - 1), ("en", 2, "a", "b", None, big - 3)]
    totals = [("en", 3 * big)]
    made = (
        spark.createDataFrame(counts, "lang string, size int, w1 string, w2 string, w3 string, n long"),
        spark.createDataFrame(totals, "lang string, total long"),
    )
    monkeypatch.setattr(collocations, "phrase_counts", lambda docs, least: made)
    (row,) = collocations.collocations(made[0]).collect()
    assert row.score == 1000000 * (big - 3) ** 2 // (big * (big - 1)) and row.n == 3 * big


def test_runs_are_counted_packed(spark, monkeypatch):
    """By range and in any chunks, and not as a row each."""
    rng = np.random.default_rng(3)
    runs = rng.integers(0, 1 << 63, 4000, np.uint64) * np.uint64(2)
    met = np.concatenate([np.repeat(runs[:500], 5), runs, runs[:40], runs[-40:]])
    rng.shuffle(met)
    parts = [collocations._packed(x, 16) for x in np.array_split(met, 7)]
    assert sum(p.num_rows for p in parts) <= 7 * 16 and sum(p.nbytes for p in parts) < 7 * len(met)
    found = []
    for r in range(16):
        group = pa.Table.from_batches(parts).filter(pc.field("range") == r)
        found += collocations._frequent_runs(group, 6)["hash"].to_pylist()
    assert sorted(found) == sorted(collocations.mixed(runs[:500] & collocations._LOW).view(np.int64).tolist())
    monkeypatch.setattr(collocations, "CHUNK", 100)
    monkeypatch.setattr(collocations, "BLOCK", 300)
    monkeypatch.setattr(collocations, "RANGE_BYTES", 100)
    rows = some()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert sorted(map(tuple, collocations.collocations(docs, 3).select(*COLUMNS).collect())) == brute(rows, 3, 50, 2000)
    counts, _ = collocations.phrase_counts(docs, 3)
    words = {(r.lang, r.w1): r.n for r in counts.filter("size = 1").collect()}
    assert words["en", "new"] >= 3 and counts.filter("size > 1 AND w2 IS NULL OR n < 3").isEmpty()


def test_windows_end_at_rare_words_and_pieces():
    text = np.frombuffer(b"a b a b. a b x a b", np.uint8)
    block = collocations._Block(collocations._hasher(), text, np.array([0, len(text)]), np.zeros(1, np.uint64))
    assert [block.texts[i].as_py() for i in block.ids] == "a b a b a b x a b".split()
    assert block.goes_on.tolist() == [True, True, True, False, True, True, True, True, False]
