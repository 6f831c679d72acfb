"""Removal of repeated passages by suffix sorting.

Texts are UTF-8 bytes.  A byte goes if a string of ``LENGTH`` bytes covers it that also
starts in a document with a smaller doc_id.  Strings are judged on the input, and do not
cross documents.

1. Each string of ``LENGTH`` bytes has an anchor: of its runs of ``ANCHOR`` bytes the one with the
   smallest hash, the first of equal ones.  Equal strings have equal anchors at equal places.
   Neighbouring strings mostly share theirs, so a text falls into stretches of some 18 strings;
   what travels for a stretch is hashes of its anchor and of its whole bytes, not the bytes.
2. Of alike stretches in a batch of documents only that of the smallest doc_id has to travel; the others are
   known to go.  Stretches meet by anchor.  An anchor of a single document proves its strings to be unique.
   A stretch that a smaller document has as a whole goes as a whole.  So a passage that very many documents
   have, or one document very often, comes to its anchor's task once a batch.
3. What is left are the borders of repeats: stretches with one anchor and different
   bytes.  Their first documents send the bytes, and the suffixes that begin in the stretch are
   put in order by deep-shallow sorting (``suffixes``), a block of anchors at a time.  Suffixes
   alike to ``LENGTH`` bytes stand side by side, and all but those of the smallest doc_id go.
   An anchor with more than ``CROWD`` stretches, say a common phrase, does not meet as a
   whole: its strings meet by their own hash.
4. The removed parts come back to their documents, where they are merged.

Hashes of 47 and 48 bits decide together which stretches are alike as a whole, those of an anchor
never remove anything by themselves.

Null and empty text have nothing to remove.  Without a doc_id no other is smaller, nor does the
row make another go.  Rows with one doc_id do not repeat each other; repeated rows are judged alike.
An empty table gives an empty result.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .suffixes import deep_shallow_sort
from .tables import long_texts, table, written
from .words import Hasher, mixed, utf8
from .workers import released

LENGTH = 50
ANCHOR = 16
#: Bytes worked on at once; longer texts are taken in parts that overlap.
PART = 1 << 19
#: Stretches of one anchor that are sorted together at most.
CROWD = 20_000
#: Bytes of stretches that are sorted at once, besides those of an anchor that is not finished.
BLOCK = 1 << 18
#: Stretches whose bytes are taken out at once.
CONTEXTS = 1 << 13

STRETCH = "k1 long, k2 long, doc_id long, text_hash long, base long, more binary"
_PLACE_BITS = 25
_SIZE_BITS = 6


class _Bytes(Hasher):
    """Hashes of bytes as they are."""

    def __init__(self) -> None:
        super().__init__(b"")
        self.table = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, 256, np.uint64)


def _anchor_hashes(hasher: Hasher, data: np.ndarray) -> np.ndarray:
    """A hash of the ``ANCHOR`` bytes at each place, by doubling."""
    out, size, factor = hasher.table[data], 1, 0x9E3779B97F4A7C15
    while size < ANCHOR:
        out = out[:-size] * np.uint64(factor) + out[size:]
        size, factor = 2 * size, (factor * factor + 2) % 2**64
    return mixed(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row."""
    out, size = values, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def stretches(hasher: Hasher, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first string, number of strings, hash of the anchor, hash of the bytes) of each stretch."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    anchors = _anchor_hashes(hasher, data)
    low = np.uint64((1 << 24) - 1)
    least = _least((anchors & ~low) | np.arange(len(anchors), dtype=np.uint64), LENGTH - ANCHOR + 1)
    edge = np.zeros(len(least) + 1, np.int64)
    first, last = at[:-1], at[1:] - LENGTH + 1
    some = last > first
    np.add.at(edge, first[some], 1)
    np.add.at(edge, last[some], -1)
    string = np.flatnonzero(np.cumsum(edge[:-1]) > 0)  # places where a string begins
    place = (least[string] & low).astype(np.int64)
    new = np.ones(len(string), bool)
    new[1:] = (place[1:] != place[:-1]) | (string[1:] != string[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(string)))
    start = string[begin]
    sums = hasher.sums(data)
    whole = mixed((sums[start + count + LENGTH - 1] - sums[start]) * hasher.inverse[start] + count.astype(np.uint64))
    return start, count, anchors[place[begin]], whole


def _parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, where each part begins, its text, its place there): short texts together, long ones in parts."""
    data, at = utf8(texts)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PART, "right")) - 1)
        n = int(at[j] - at[i])
        for a in range(0, max(n - LENGTH + 1, 1), PART) if j == i + 1 else [0]:
            b = min(n, a + PART + LENGTH - 1) if j == i + 1 else n
            own = at[i : j + 1] - at[i] if j > i + 1 else np.array([0, b - a])
            yield data[at[i] + a : at[i] + b], own, np.arange(i, j), np.full(j - i, a)
        i = j


def _emit_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each stretch that is not known to go, with all its places in the text, and one for
    all that is known to go of a text: that has k2 = 0, and places and sizes in ``more``."""
    hasher = _Bytes()
    for batch in batches:
        found = [_stretches_of(hasher, *part) for part in _parts(batch.column(2))]
        if not found or not sum(len(x[0]) for x in found):
            continue
        row, place, count, k1, whole = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = batch.column(0).to_numpy()[row]
        alike = mixed(k1.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + whole)
        order = np.argsort(alike, kind="stable")  # rows and places ascend among alike ones
        begin = _begins(alike[order])
        low = np.repeat(np.minimum.reduceat(doc[order], begin), np.diff(np.append(begin, len(order))))
        gone = doc[order] > low
        known = np.sort(order[gone])
        order = order[~gone]
        first = _begins(alike[order]) if len(order) else order
        other = np.zeros(len(order), bool)
        other[first] = True
        other[1:] |= row[order[1:]] != row[order[:-1]]
        first = np.flatnonzero(other)
        size = np.diff(np.append(first, len(order)))
        more: list[bytes | None] = [None] * len(first)
        for k in np.flatnonzero(size > 1).tolist():
            more[k] = place[order[first[k] + 1 : first[k] + size[k]]].astype("<i8").tobytes()
        own = order[first]
        back = np.argsort(own, kind="stable")  # in the order of the texts
        own = own[back]
        low_place = place[own] & ((1 << _PLACE_BITS) - 1)
        k2 = (whole[own] & np.uint64(0xFFFFFFFF)) << np.uint64(_PLACE_BITS + _SIZE_BITS)
        k2 |= (low_place << _SIZE_BITS | count[own]).astype(np.uint64)
        text = pa.array(row[own])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(k1[own]), pa.array(k2.view(np.int64)), batch.column(0).take(text), batch.column(1).take(text),
                pa.array(place[own] >> _PLACE_BITS), pa.array([more[k] for k in back.tolist()], pa.binary()),
            ],
            [f.split()[0] for f in STRETCH.split(", ")],
        )
        if not len(known):
            continue
        # What goes of each text, neighbouring stretches as one.
        joined = np.ones(len(known), bool)
        joined[1:] = (row[known[1:]] != row[known[:-1]]) | (place[known[1:]] != (place + count)[known[:-1]])
        run = np.flatnonzero(joined)
        end = known[np.append(run[1:], len(known)) - 1]
        run = known[run]
        pairs = np.stack([place[run], place[end] + count[end] - place[run]], axis=1).astype("<i8")
        texts = _begins(row[run])
        cuts = np.append(texts, len(run))
        at = row[run[texts]]
        spread = mixed(batch.column(1).to_numpy()[at].view(np.uint64) + at.astype(np.uint64)) >> np.uint64(1)
        zero = pa.array(np.zeros(len(at), np.int64))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(spread.view(np.int64)), zero, batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), zero,
                pa.array([pairs[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
            ],
            [f.split()[0] for f in STRETCH.split(", ")],
        )


def _begins(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _stretches_of(
    hasher: Hasher, data: np.ndarray, at: np.ndarray, texts: np.ndarray, places: np.ndarray
) -> tuple[np.ndarray, ...]:
    """(text, place, strings, key of the anchor and of some bits of the bytes, the other bits) of each stretch of a part."""
    start, count, anchor, whole = stretches(hasher, data, at)
    own = np.searchsorted(at, start, "right") - 1
    k1 = ((anchor >> np.uint64(17)) << np.uint64(16)) | (whole >> np.uint64(48))
    return texts[own], start - at[own] + places[own], count, k1.view(np.int64), (whole >> np.uint64(16)) & np.uint64(0xFFFFFFFF)


def repeated_stretches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, place, strings, anchor, more) of the stretches with an anchor that several doc_ids have:
    without anchor where a smaller doc_id has the whole stretch; with it where the stretch
    is new but others share the anchor.  ``more``: further places.  Without place: all that is in ``more``, as pairs."""
    found = docs.select("doc_id", "text_hash", "text").mapInArrow(lambda b: released(_emit_stretches(b)), STRETCH)
    dealt = found.repartition(F.shiftright("k1", 16)).select(
        F.shiftright("k1", 16).alias("anchor"),
        F.shiftleft(F.col("k1").bitwiseAND(0xFFFF), 32).bitwiseOR(F.shiftrightunsigned("k2", 31)).alias("whole"),
        F.shiftleft("base", _PLACE_BITS)
        .bitwiseOR(F.shiftright("k2", _SIZE_BITS).bitwiseAND((1 << _PLACE_BITS) - 1))
        .alias("place"),
        F.col("k2").bitwiseAND((1 << _SIZE_BITS) - 1).cast("int").alias("strings"),
        (F.col("k2") == 0).alias("known"),
        "doc_id",
        "text_hash",
        "more",
    )
    alike, met = Window.partitionBy("anchor", "whole"), Window.partitionBy("anchor")
    judged = dealt.select(
        "*",
        F.min("doc_id").over(alike).alias("low"),
        F.min("doc_id").over(met).alias("first"),
        F.max("doc_id").over(met).alias("last"),
        (F.min("whole").over(met) < F.max("whole").over(met)).alias("differ"),
    ).filter("known OR first < last AND (doc_id > low OR differ)")
    return judged.select(
        "doc_id",
        "text_hash",
        F.when(~F.col("known"), F.col("place")).alias("place"),
        "strings",
        F.when(~F.col("known") & (F.col("doc_id") == F.col("low")), F.col("anchor")).alias("anchor"),
        "more",
    )


CONTEXT = "key long, doc_id long, text_hash long, place long, bytes binary, more binary"


def _contexts(
    batch: pa.RecordBatch, row: np.ndarray, data: np.ndarray, at: np.ndarray, place: np.ndarray, count: np.ndarray, key: np.ndarray, more: pa.Array
) -> Iterator[pa.RecordBatch]:
    """The bytes of stretches, some at once; ``at``: where in ``data`` the text of each begins."""
    for a in range(0, len(row), CONTEXTS):
        some = slice(a, a + CONTEXTS)
        size = count[some].astype(np.int64) + LENGTH - 1
        ends = np.zeros(len(size) + 1, np.int32)
        np.cumsum(size, out=ends[1:])
        raw = data[np.repeat(at[some] + place[some] - ends[:-1], size) + np.arange(ends[-1])]
        binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
        who = pa.array(row[some])
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[some]), batch.column(0).take(who), batch.column(1).take(who), pa.array(place[some]), binary, more[some]],
            ["key", "doc_id", "text_hash", "place", "bytes", "more"],
        )


def _emit_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed stretches; of crowded anchors each string by itself."""
    hasher = _Bytes()
    for batch in batches:
        data, at = utf8(batch.column(2))
        lists = batch.column(3)
        row = np.repeat(np.arange(len(lists)), np.asarray(lists.value_lengths()))
        listed = lists.flatten().flatten()
        place, count, key = (np.asarray(listed[i]) for i in (0, 1, 2))
        apart = np.asarray(listed[3].cast(pa.int8())) == 1
        more = listed[4]
        whole = np.flatnonzero(~apart)
        yield from _contexts(batch, row[whole], data, at[row[whole]], place[whole], count[whole], key[whole], more.take(pa.array(whole)))
        apart = np.flatnonzero(apart)
        for k in np.unique(row[apart]).tolist():
            own = apart[row[apart] == k]
            text = data[at[k] : at[k + 1]]
            size = count[own]
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            single = np.repeat(place[own], size) + inside
            sums = hasher.sums(text)
            keys = mixed((sums[single + LENGTH] - sums[single]) * hasher.inverse[single]).view(np.int64)
            moved = [
                (np.frombuffer(other, "<i8") + i).tobytes() if other else None
                for other, n in zip(more.take(pa.array(own)).to_pylist(), size.tolist(), strict=True)
                for i in range(n)
            ]
            one = np.ones(len(single), count.dtype)
            yield from _contexts(
                batch, np.full(len(single), k), text, np.zeros(len(single), np.int64), single, one, keys, pa.array(moved, pa.binary())
            )


SPAN = "doc_id long, text_hash long, start long, size long"


def _sorted_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts in the order of (key, doc_id): what a smaller doc_id has as well.

    Blocks end anywhere.  What a block has of the key it ends in is carried to the next; as
    doc_ids ascend, later rows of the key cannot be the smaller ones."""
    carried: pa.Table | None = None
    waiting: list[pa.RecordBatch] = []
    held = 0

    def flush() -> pa.RecordBatch:
        nonlocal carried, waiting, held
        fresh = pa.Table.from_batches(waiting)
        rows = pa.concat_tables([carried, fresh]) if carried is not None else fresh
        old = len(rows) - len(fresh)
        rows = rows.combine_chunks()
        key, doc = rows["key"].to_numpy(), rows["doc_id"].to_numpy()
        ends = np.cumsum(np.asarray(pc.binary_length(rows["bytes"])).astype(np.int64))
        begin = np.concatenate([[0], ends[:-1]])
        text = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.uint8)
        strings = ends - begin - LENGTH + 1
        owner = np.repeat(np.arange(len(rows)), strings)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(strings) - strings, strings)
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        order, new = deep_shallow_sort(text, begin[owner] + inside, group[owner], LENGTH)
        classes = np.flatnonzero(new)
        low = np.minimum.reduceat(doc[owner[order]], classes)
        gone = np.zeros(len(owner), bool)
        gone[order] = doc[owner[order]] > np.repeat(low, np.diff(np.append(classes, len(order))))
        gone &= owner >= old
        # Runs of strings that go, within a row.
        hit = np.flatnonzero(gone)
        cut = np.ones(len(hit), bool)
        cut[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]])
        run = np.flatnonzero(cut)
        last = hit[np.append(run[1:], len(hit)) - 1] if len(run) else hit
        who = owner[hit[run]]
        open_ = np.flatnonzero(key == key[-1])
        _, once = np.unique(np.array(rows["bytes"].take(pa.array(open_)).to_pylist(), object), return_index=True)
        carried = rows.take(pa.array(np.sort(open_[once])))  # the first of equal ones has the smallest doc_id
        waiting, held = [], 0
        shift, size = inside[hit[run]], last - hit[run] + LENGTH
        start = rows["place"].to_numpy()[who] + shift
        # The same at the other places of the text.
        again = np.flatnonzero(np.asarray(rows["more"].is_valid())[who])
        if len(again):
            others = [np.frombuffer(x, "<i8") for x in rows["more"].take(pa.array(who[again])).to_pylist()]
            times = np.array([len(x) for x in others])
            who = np.concatenate([who, np.repeat(who[again], times)])
            size = np.concatenate([size, np.repeat(size[again], times)])
            start = np.concatenate([start, np.concatenate(others) + np.repeat(shift[again], times)])
        at = pa.array(who)
        return pa.RecordBatch.from_arrays(
            [
                rows["doc_id"].combine_chunks().take(at),
                rows["text_hash"].combine_chunks().take(at),
                pa.array(start),
                pa.array(size),
            ],
            ["doc_id", "text_hash", "start", "size"],
        )

    for batch in batches:
        a = 0
        while a < batch.num_rows:
            room = max(1, (BLOCK - held) // 64)
            piece = batch.slice(a, room)
            waiting.append(piece)
            held += 64 * piece.num_rows
            a += piece.num_rows
            if held >= BLOCK:
                yield flush()
    if waiting:
        yield flush()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for all places of ``more``, and for the own place."""
    for batch in batches:
        places, strings = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        starts, sizes = [], []
        for place, n, raw in zip(places, strings, batch.column(4).to_pylist(), strict=True):
            other = np.frombuffer(raw, "<i8")
            starts.append(other[::2] if place is None else np.append(other, place))
            sizes.append(other[1::2] if place is None else np.full(len(other) + 1, n))
        row = pa.array(np.repeat(np.arange(len(starts)), [len(x) for x in starts]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(starts)), pa.array(np.concatenate(sizes) + LENGTH - 1)],
            ["doc_id", "text_hash", "start", "size"],
        )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, size) of what goes; ``docs`` has doc_id, text_hash and text.

    Spans may overlap."""
    found = written(repeated_stretches(docs), "stretches")
    gone = found.filter("anchor IS NULL").drop("anchor")
    packed = gone.filter("more IS NOT NULL").mapInArrow(lambda b: released(_unpacked(b)), SPAN)
    whole = gone.filter("more IS NULL").select(
        "doc_id", "text_hash", F.col("place").alias("start"), (F.col("strings") + LENGTH - 1).cast("long").alias("size")
    )
    border = found.filter("anchor IS NOT NULL")
    crowded = border.groupBy("anchor").count().filter(F.col("count") > CROWD).select("anchor", F.lit(True).alias("apart"))
    marked = border.join(crowded, "anchor", "left").select(
        "doc_id", "text_hash", F.struct("place", "strings", "anchor", F.coalesce("apart", F.lit(False)).alias("apart"), "more").alias("one")
    )
    lists = marked.groupBy("doc_id", "text_hash").agg(F.collect_list("one").alias("some"))  # at most a text's own
    asked = docs.join(lists, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "some")
    contexts = asked.mapInArrow(lambda b: released(_emit_contexts(b)), CONTEXT)
    ordered = contexts.repartition("key").sortWithinPartitions("key", "doc_id")
    return whole.unionByName(packed).unionByName(ordered.mapInArrow(lambda b: released(_sorted_spans(b)), SPAN))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def merged(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch, as one: where each begins and ends."""
    order = np.argsort(start, kind="stable")
    a = start[order]
    far = np.maximum.accumulate(a + size[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > far[:-1]
    first = np.flatnonzero(new)
    return a[first], far[np.append(first[1:], len(a)) - 1] if len(a) else a


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            raw = (batch.column(1)[k].as_py() or "").encode()
            spans = batch.column(2)[k]
            listed = spans.values.flatten() if spans.is_valid else []
            a, b = merged(*(np.asarray(x) for x in listed)) if len(listed) else (np.zeros(0, int), np.zeros(0, int))
            kept, last, view = hashlib.sha256(), 0, memoryview(raw)
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                kept.update(view[last:x])
                last = y
            kept.update(view[last:])
            rows.append((len(raw), int((b - a).sum()), len(a), kept.hexdigest()))
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        arrays = [pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 3, pa.string()], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *arrays], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, text.  Without an alias where none is needed, or Spark would not see that the
    texts dealt out to two joins are the same."""
    doc_id = F.col("doc_id") if docs.schema["doc_id"].dataType == T.LongType() else F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(doc_id, F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the hash of the bytes that stay, of each document."""
    long_texts(docs.sparkSession)
    rows = keyed(docs)
    named, nameless = rows.filter("doc_id IS NOT NULL"), rows.filter("doc_id IS NULL")
    spans = repeated_spans(named).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "size")).alias("spans"))
    joined = named.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")
    alone = nameless.select("doc_id", "text", F.lit(None).cast("array<struct<start:bigint,size:bigint>>").alias("spans"))
    return joined.unionByName(alone).mapInArrow(lambda b: released(_judge(b)), RESULT)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return removed(table(spark, folder, "documents"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (
  SELECT r, doc_id, i, substring(x, 2 * i + 1, {2 * LENGTH}) AS s
  FROM (SELECT r, doc_id, x, unnest(range(0, length(x) // 2 - {LENGTH - 1})) AS i FROM d WHERE doc_id IS NOT NULL)
),
low AS (SELECT s, min(doc_id) AS low FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT r, i FROM w JOIN low USING (s) WHERE doc_id > low),
runs AS (
  SELECT r, i, sum(CASE WHEN i > before + {LENGTH} OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g
  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM hit)
),
spans AS (SELECT r, min(i) AS a, max(i) + {LENGTH} AS b FROM runs GROUP BY r, g),
gaps AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS last FROM spans
  UNION ALL SELECT r, length(x) // 2, length(x) // 2, coalesce(end_, 0)
  FROM d LEFT JOIN (SELECT r, max(b) AS end_ FROM spans GROUP BY r) USING (r)
),
kept AS (SELECT r, string_agg(substring(x, 2 * last + 1, 2 * (a - last)), '' ORDER BY a, b) AS k FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(m, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (r)
LEFT JOIN (SELECT r, CAST(sum(b - a) AS BIGINT) AS n, count(*) AS m FROM spans GROUP BY r) USING (r)
"""
