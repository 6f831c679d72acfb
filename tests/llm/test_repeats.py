import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from hearthline.llm import repeats, suffixes

COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(rows):
    size, least = repeats.LENGTH, {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        for i in range(len(b) - size + 1) if d is not None else ():
            s = b[i : i + size]
            least[s] = min(least.get(s, d), d)
    out = []
    for d, b in raw:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - size + 1) if d is not None else ():
            if least[b[i : i + size]] < d:
                gone[i + 1 : i + 1 + size] = True
        kept = bytes(x for x, g in zip(b, gone[1:-1]) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=2, n=40):
    rng = random.Random(seed)
    make = lambda k: "".join(rng.choice("abcdé \n") for _ in range(k))
    passages = [make(k) for k in (48, 50, 51, 60, 90, 300)] + ["la " * 60, "x" * 120]
    phrase = make(24)  # a common phrase between different neighbours
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(5)):
            parts += [make(rng.randrange(60)), rng.choice(passages) if rng.random() < 0.6 else phrase]
        rows.append((rng.randrange(-20, 2 * n), "".join(parts)))
    rows += [rows[3], (rows[3][0], rows[4][1]), (999, rows[5][1]), (1000, rows[5][1] + "tail"), (-99, rows[6][1])]
    return rows + [(None, rows[5][1]), (None, None), (1001, None), (1002, ""), (1003, "short"), (1004, "x" * 5000)]


@pytest.mark.parametrize("part,crowd,block", [(1 << 19, 20_000, 1 << 18), (256, 4, 640), (1000, 0, 128)])
def test_brute_force(spark, monkeypatch, part, crowd, block):
    """Also with long texts in parts, all anchors crowded, and blocks that cut every anchor."""
    for name, value in (("PART", part), ("CROWD", crowd), ("BLOCK", block)):
        monkeypatch.setattr(repeats, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, key int, bytes string").repartition(3)
    assert sorted(map(tuple, repeats.removed(docs).select(*COLUMNS).collect()), key=str) == brute(rows)


def test_empty(spark):
    assert repeats.removed(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("letters", [1, 2, 26])
def test_deep_shallow_order(letters):
    rng = np.random.default_rng(letters)
    text = rng.integers(97, 97 + letters, 1500).astype(np.uint8)
    text[700:1100] = text[100:500]
    starts = rng.permutation(1400)
    groups = np.sort(rng.integers(0, 3, 1400))
    order, fresh = suffixes.deep_shallow_sort(text, starts, groups, 50)
    seen = [(groups[i], text[starts[i] : starts[i] + 50].tobytes()) for i in order]
    assert sorted(order.tolist()) == list(range(1400)) and seen == sorted(seen)
    assert fresh.tolist() == [True] + [a != b for a, b in zip(seen, seen[1:])]


def test_small_groups_need_no_trie(monkeypatch):
    """Pairs and triples that are alike beyond the shallow depth are ordered all at once; a crowd by a trie."""
    rng = np.random.default_rng(3)
    heads = rng.integers(0, 256, (300, 50)).astype(np.uint8)
    rows = np.repeat(heads, 3, axis=0)
    for k in range(16, 50):
        rows[3 * k + 1, k] ^= 1  # parts at byte k, the second of its group
        rows[3 * k + 2, k] ^= 255
    text, starts, groups = rows.ravel(), np.arange(900) * 50, np.repeat(np.arange(150), 6)
    made = []
    trie = suffixes.BlindTrie
    monkeypatch.setattr(suffixes, "BlindTrie", lambda size: made.append(size) or trie(size))
    crowd = 200
    for t, at, g, tries in ((text, starts, groups, 0), (np.tile(heads[0], crowd), np.arange(crowd) * 50, np.zeros(crowd, int), 1)):
        order, fresh = suffixes.deep_shallow_sort(t, at, g, 50)
        seen = [(g[i], t[at[i] : at[i] + 50].tobytes()) for i in order]
        assert sorted(order.tolist()) == list(range(len(at))) and seen == sorted(seen)
        assert fresh.tolist() == [True] + [a != b for a, b in zip(seen, seen[1:])]
        assert len(made) == tries


def test_bytes_of_stretches_are_taken_out_of_many_texts_at_once(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abé ") for _ in range(200)) for _ in range(100)]
    kind = pa.list_(pa.struct([("place", pa.int64()), ("strings", pa.int32()), ("anchor", pa.int64()), ("apart", pa.bool_()), ("more", pa.binary())]))
    lists = [
        [{"place": 9 * j, "strings": j + 1, "anchor": 100 * i + j, "apart": i == 51 and j == 2, "more": b"12345678" if j == 1 else None} for j in range(i % 4)]
        for i in range(100)
    ]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(range(100)), pa.array(texts), pa.array(lists, kind)], ["d", "h", "t", "some"])
    lists[51] = [x for x in lists[51] if not x["apart"]]  # its strings have keys of their own
    want = [
        (x["anchor"], i, i, x["place"], texts[i].encode()[x["place"] : x["place"] + x["strings"] + 49], x["more"])
        for i, some in enumerate(lists)
        for x in some
    ]
    for at_once, batches in ((8192, 1), (40, 4)):
        monkeypatch.setattr(repeats, "CONTEXTS", at_once)
        for part in (batch.slice(0, 51), batch.slice(52)):
            rows = [r for b in repeats._emit_contexts(iter([part])) for r in b.to_pylist()]
            assert [tuple(r.values()) for r in rows] == [w for w in want if w[1] in part.column(0).to_pylist()]
        made = list(repeats._emit_contexts(iter([batch])))
        assert len(made) == batches + 1
        raw = texts[51].encode()
        assert [(r["doc_id"], r["place"], r["bytes"]) for r in made[-1].to_pylist()] == [(51, k, raw[k : k + 50]) for k in (18, 19, 20)]


def test_stretches_hold_each_string_once():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    at = np.array([0, 0, 49, 99, 100, 1500, 3000])
    start, count, _, _ = repeats.stretches(repeats._Bytes(), data, at)
    held = np.concatenate([np.arange(a, a + n) for a, n in zip(start, count)])
    want = np.concatenate([np.arange(a, b - 49) for a, b in zip(at, at[1:]) if b - a >= 50])
    assert held.tolist() == want.tolist() and count.max() < 1 << 6


def test_spans_that_overlap_or_touch_are_one():
    a, b = repeats.merged(np.array([100, 0, 50, 130, 300]), np.array([50, 50, 50, 10, 60]))
    assert a.tolist() == [0, 300] and b.tolist() == [150, 360]
