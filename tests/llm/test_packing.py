import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

from hearthline.llm import packing

ODD = (
    "don't we'll l'été 3.14 x\x1cy a\x85b <|endoftext|>x ÀÉ é ́ ΑΣ ΣΑΣ ½ ² ʰ İ İstanbul ªº z ⅷ ー々 "
    "the, THE!! it's'tis a_b __ --- ,.!? naïve&&& co-op ​ ﻿ emoji😀😀 x y ﬁ"
)


def whole(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_words_give_the_ids_of_the_whole_text(table):
    path = packing.default_tokenizer()
    texts = [r.text for r in table("documents").limit(60).collect()] + [ODD, "", " \n", ODD.upper(), "Ž" * 300]
    encoder = packing.WordEncoder(path)
    for _ in range(2):  # fresh, then remembered
        for text, got in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(got, np.uint16).tolist() == whole(path, text)


def test_patterns_use_every_piece_once():
    rng = random.Random(3)
    for most in (1, 3, 500):
        counts = {n: rng.randint(0, most) for n in rng.sample(range(1, 101), 60)}
        shapes = packing.patterns(counts, 100)
        used = Counter()
        for shape, many in shapes:
            assert many > 0 and sum(n * m for n, m in shape.items()) <= 100
            assert sum(m for n, m in shape.items() if 3 * n > 100) <= 2
            for n, m in shape.items():
                used[n] += m * many
        assert used == Counter({n: c for n, c in counts.items() if c})
        least = -(-sum(n * c for n, c in counts.items()) // 100)
        assert sum(many for _, many in shapes) <= 1.15 * least + 2
    assert packing.patterns({}) == []


def check(result, docs, capacity):
    path = packing.default_tokenizer()
    rows = result.collect()
    want = Counter()
    for d, text in docs:
        ids = np.array([*whole(path, text or ""), 1], "<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[(d, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at), sum(r.length for r in rows)


def test_round_trip(spark, table):
    docs = table("documents").repartition(5)
    n, tokens = check(packing.pack(docs), [(r.doc_id, r.text) for r in docs.collect()], packing.CAPACITY)
    assert n <= 1.02 * tokens / packing.CAPACITY + 1


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "the cat", "c"), (4, "the cat " * 500, "d"), (4, "the cat " * 500, "d"), (5, ODD, None)]
    rows += [(10 + i, "equal length here", "x") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(4)
    check(packing.pack(docs, capacity=64), [(r[0], r[1]) for r in rows], 64)
    assert packing.pack(docs.limit(0)).count() == 0
