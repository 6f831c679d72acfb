"""Best-fit packing of tokenized documents into sequences by large-item matching.

A document's ids end with the id 1.  Up to ``CAPACITY`` ids it is one piece; a longer
one is cut into pieces of ``CAPACITY``, the last may be shorter.  Pieces of the same
length are interchangeable, so the packing is worked out on how many pieces there
are of each length, at most ``CAPACITY`` numbers whatever the size of the corpus:

1. Pieces above a third of the capacity go at most two to a sequence.  From the
   longest on, each is matched with the longest such piece that still fits beside it.
2. Shorter pieces, from the longest on, go where they leave the least room; new
   sequences are begun where none has room for one.

The outcome is a list of patterns (lengths, number of sequences that look so).  Each
piece has a rank among those of its length, and ranks are dealt out to the
patterns.  Ranks are counted inside the tasks that tokenize, and shifted by what
other tasks have of that length, so no task sees all pieces of a length, even if a
third of all documents are equally long.

Null and empty text give the one id 1.  A null doc_id, and repeated rows, are
documents like others.  An empty table gives an empty result.  Other columns are
not read.  A sequence holds at least one piece and is filled without gaps from 0.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from .tables import long_texts, table, written
from .words import PIECE, Hasher, mixed, utf8
from .workers import released

CAPACITY = 4096
END = 1
#: Words, and as many runs of letters, whose ids a task remembers, in some 20 bytes each; others are
#: worked out again where they occur.
REMEMBERED = 1_000_000
#: Signs other than those that begin a run in the middle of signs, or a special token.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Composed Latin letters: such a word is the same in any normal form.
LATIN = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")

PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, task int, own_rank long"
)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class RunTable:
    """64-bit keys to runs of ids, in arrays: some 20 bytes a key at most, whatever a run's word is."""

    def __init__(self, most: int) -> None:
        self.most, self.n = most, 0
        self.keys = np.zeros(1 << 14, np.uint64)  # 0 is free
        self.begin, self.size = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of each key's run; the size is -1 where the key is not known."""
        mask = len(self.keys) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        begin, size = np.zeros(len(keys), np.int64), np.full(len(keys), -1, np.int64)
        live = np.arange(len(keys))
        while len(live):
            there = self.keys[slot[live]]
            hit = there == keys[live]
            at = live[hit]
            begin[at], size[at] = self.begin[slot[at]], self.size[slot[at]]
            live = live[~hit & (there != 0)]
            slot[live] = (slot[live] + 1) & mask
        return begin, size

    def add(self, keys: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """New and distinct keys; they are left out where the table would grow beyond ``most``."""
        if self.n + len(keys) > self.most:
            return
        while 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys, self.begin, self.size
            self.keys = np.zeros(2 * len(old[0]), np.uint64)
            self.begin, self.size = (np.zeros(2 * len(old[0]), np.int32) for _ in range(2))
            used = old[0] != 0
            self._put(*(x[used] for x in old))
        self._put(keys, begin, size)
        self.n += len(keys)

    def _put(self, keys: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        mask = len(self.keys) - 1
        slot = (keys & np.uint64(mask)).astype(np.int64)
        live = np.arange(len(keys))
        while len(live):
            free = live[self.keys[slot[live]] == 0]
            self.keys[slot[free]] = keys[free]  # of several for one slot the last stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.begin[slot[won]], self.size[slot[won]] = begin[won], size[won]
            live = live[self.keys[slot[live]] != keys[live]]
            slot[live] = (slot[live] + 1) & mask


class _Pool:
    """Ids of all runs one after another."""

    def __init__(self) -> None:
        self.ids, self.n = np.zeros(1 << 14, np.uint16), 0

    def add(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of each run."""
        size = np.array([len(r) // 2 for r in runs], np.int64)
        raw = np.frombuffer(b"".join(runs), np.uint16)
        begin = self.n + np.cumsum(size) - size
        if self.n + len(raw) > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.n + len(raw)), np.uint16)
            grown[: self.n] = self.ids[: self.n]
            self.ids = grown
        self.ids[self.n : self.n + len(raw)] = raw
        self.n += len(raw)
        return begin, size


class WordEncoder:
    """ids of texts as unsigned 16-bit numbers.

    This tokenizer splits at white space before all else and drops it, so a text's
    ids are those of its words one after another; words are told apart by 64-bit hashes,
    and those met before are looked up, all words of a block at once.  Most new words are Latin letters
    and then signs; both are runs of their own to the tokenizer, so the letters, in lower
    case, are looked up in turn.  Letters not met before are encoded many at a
    time, without the steps that change nothing.  All else, such as words with white space
    beyond ASCII inside, goes through the whole tokenizer.
    """

    def __init__(self, path: str, remember: int = REMEMBERED) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        # Each thread keeps a model's cache of words beyond the model's end, some MB for each task of a
        # worker; what is worth remembering is in the tables below.  Not every kind of model has a cache.
        if resize := getattr(self.whole.model, "_resize_cache", None):
            resize(0)
        self.letters = Tokenizer(self.whole.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.WhitespaceSplit(),
                pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
            ]
        )
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.remember = remember
        self.hasher = Hasher(b" \t\n\x0b\x0c\r")
        self.hasher.table[65:91] = np.random.Generator(np.random.PCG64(17)).integers(0, 1 << 63, 26, np.uint64)
        self.words, self.stems, self.pool = RunTable(remember), RunTable(remember), _Pool()
        self.tails: dict[str, bytes] = {"": b""}
        self.last = np.zeros(1 << 16, bool)  # ids that end a run
        for token, i in self.whole.get_vocab().items():
            self.last[i] = token.endswith("</w>")

    def one(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint16).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        data, at = utf8(pa.array(texts, pa.large_string()))
        ids, ends = self.block(data, at)
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def block(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts one after another, and where each text's begin and end."""
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(at), np.int64)
        first, last = self.hasher.spans(data, at)
        sums = self.hasher.sums(data)
        keys = mixed((sums[last] - sums[first]) * self.hasher.inverse[first])
        keys[keys == 0] = 1
        begin, size = self.words.find(keys)
        before = self.pool.n
        new = np.flatnonzero(size < 0)
        if len(new):
            fresh, sample, back = np.unique(keys[new], return_index=True, return_inverse=True)
            raw = data.tobytes()
            runs = self._words([raw[a:b].decode() for a, b in zip(first[new[sample]].tolist(), last[new[sample]].tolist(), strict=True)])
            keep = self.pool.n
            b, n = self.pool.add(runs)
            kept = self.words.n
            self.words.add(fresh, b, n)
            begin[new], size[new] = b[back], n[back]
            before = self.pool.n if self.words.n > kept else keep
        ends = np.concatenate([[0], np.cumsum(size)])
        out = self.pool.ids[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        self.pool.n = before if len(new) else self.pool.n  # what is not remembered goes
        return out, ends[np.searchsorted(first, at)]

    def _words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        later: list[tuple[int, str, str]] = []
        for k, w in enumerate(words):
            stem = w.rstrip(SIGNS)
            if not (stem.isalpha() if stem.isascii() else LATIN.fullmatch(stem)):
                out[k] = self.one(w)
                continue
            tail = w[len(stem) :]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails = {"": b""}
                self.tails[tail] = self.one(tail)
            later.append((k, stem.lower(), self.tails[tail]))
        if later:
            stems = list({s for _, s, _ in later})
            ids = dict(zip(stems, self._stems(stems), strict=True))
            for k, stem, tail in later:
                out[k] = ids[stem] + tail
        return out

    def _stems(self, stems: list[str]) -> list[bytes]:
        keys = np.array([hash(s) for s in stems], np.int64).view(np.uint64)
        keys[keys == 0] = 1
        begin, size = self.stems.find(keys)
        new = np.flatnonzero(size < 0)
        if len(new):
            runs = list(self._encoded([stems[k] for k in new]))
            b, n = self.pool.add(runs)
            kept = self.stems.n
            self.stems.add(keys[new], b, n)
            begin[new], size[new] = b, n
        out = [self.pool.ids[a : a + n].tobytes() for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
        if len(new) and self.stems.n == kept:
            self.pool.n = int(b[0])
        return out

    def _encoded(self, stems: list[str]) -> Iterator[bytes]:
        """In lines of many; the ids that end a run tell them apart."""
        for a in range(0, len(stems), 8192):
            lines = [stems[k : k + 128] for k in range(a, min(a + 8192, len(stems)), 128)]
            found = self.letters.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)
            for line, got in zip(lines, found, strict=True):
                ids = np.array(got.ids, np.uint16)
                ends = ((np.flatnonzero(self.last[ids]) + 1) * 2).tolist()
                raw, begin = ids.tobytes(), 0
                for _, end in zip(line, ends, strict=True):
                    yield raw[begin:end]
                    begin = end

    def texts(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text in turn; long texts are cut at white space and worked on in parts."""
        data, at = utf8(texts)
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
            a, b = int(at[i]), int(at[j])
            if j > i + 1 or b - a <= 2 * PIECE:
                ids, ends = self.block(data[a:b], at[i : j + 1] - a)
                for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    yield ids[x:y]
            else:
                parts = []
                while a < b:
                    end = min(b, a + PIECE)
                    while end < b and self.hasher.in_word[data[end]]:
                        end += 1
                    parts.append(self.block(data[a:end], np.array([0, end - a]))[0])
                    a = end
                yield np.concatenate(parts)
            i = j


def _pieces(
    batches: Iterator[pa.RecordBatch], path: str, capacity: int, remember: int
) -> Iterator[pa.RecordBatch]:
    encoder = WordEncoder(path, remember)
    task = TaskContext.get().partitionId()
    ranks = np.zeros(capacity + 1, np.int64)
    for batch in batches:
        doc_ids, texts = batch.column(0), batch.column(1)
        found = encoder.texts(texts)
        for a in range(0, len(texts), 256):
            rows: list[tuple] = []
            for k, own in enumerate(itertools.islice(found, 256)):
                x = np.append(own, END).astype("<u4")
                for n, start in enumerate(range(0, len(x), capacity)):
                    part = x[start : start + capacity]
                    ranks[len(part)] += 1
                    rows.append((a + k, n, start, len(part), zlib.crc32(part.tobytes()), ranks[len(part)] - 1))
            who, piece, start, length, crc, rank = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids.take(pa.array(who, pa.int64())).cast(pa.int64()),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array([task] * len(rows), pa.int32()),
                    pa.array(rank, pa.int64()),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "own_rank"],
            )


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, remember: int = REMEMBERED
) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return released(_pieces(batches, tokenizer, capacity, remember))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


Pattern = tuple[Counter, int]


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Numbers of pieces by length to (lengths of a sequence, number of such sequences)."""
    left = {n: c for n, c in counts.items() if c}
    large = sorted(n for n in left if 3 * n > capacity)
    bins: list[Pattern] = []
    # 1. Matching of large pieces, many equal pairs at a time.
    while large:
        one = large[-1]
        k = bisect.bisect_right(large, capacity - one) - 1
        two = large[k] if k >= 0 else None
        if two is None:
            bins.append((Counter({one: 1}), left[one]))
            left[one] = 0
        elif one == two:
            bins.append((Counter({one: 2}), left[one] // 2))
            if left[one] % 2:
                bins.append((Counter({one: 1}), 1))
            left[one] = 0
        else:
            n = min(left[one], left[two])
            bins.append((Counter({one: 1, two: 1}), n))
            left[one] -= n
            left[two] -= n
            if not left[two]:
                large.pop(k)
        if not left[one]:
            large.pop()
    # 2. Best fit of small pieces.  rooms: sorted (room left, number of the pattern).
    shapes = [b for b in bins if b[1]]
    rooms = sorted((capacity - sum(n * m for n, m in s.items()), i) for i, (s, _) in enumerate(shapes))
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        need = left[n]
        while need:
            k = bisect.bisect_left(rooms, (n, -1))
            if k == len(rooms):
                fit = capacity // n
                if need >= fit:
                    shapes.append((Counter({n: fit}), need // fit))
                    bisect.insort(rooms, (capacity - fit * n, len(shapes) - 1))
                if need % fit:
                    shapes.append((Counter({n: need % fit}), 1))
                    bisect.insort(rooms, (capacity - need % fit * n, len(shapes) - 1))
                break
            room, i = rooms.pop(k)
            shape, many = shapes[i]
            fit = room // n
            full, rest = divmod(need, fit)
            split: list[tuple[int, int]] = []  # (pieces of length n, sequences)
            if full >= many:
                split.append((fit, many))
                need -= fit * many
            else:
                split.append((fit, full))
                if rest:
                    split.append((rest, 1))
                split.append((0, many - full - bool(rest)))
                need = 0
            first = True
            for m, c in split:
                if not c:
                    continue
                new = (shape + Counter({n: m}) if m else shape, c)
                if first:
                    shapes[i], at, first = new, i, False
                else:
                    shapes.append(new)
                    at = len(shapes) - 1
                bisect.insort(rooms, (room - m * n, at))
    return shapes


def slots(shapes: list[Pattern]) -> dict[str, np.ndarray]:
    """Where the ranks of each length go; sorted by (length, first rank)."""
    taken: Counter = Counter()
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for shape, many in shapes:
        offset = 0
        for n in sorted(shape, reverse=True):
            rows.append((n, taken[n], shape[n], sequence, offset))
            taken[n] += shape[n] * many
            offset += n * shape[n]
        sequence += many
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "times", "sequence", "offset"), cols, strict=True))


def place(length: Column, rank: Column, of: dict[str, np.ndarray]) -> Column:
    """struct(sequence_id, offset) of the piece with this rank among those of its length."""

    def find(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        starts = {n: (int(a), int(b)) for n, a, b in _runs(of["length"])}
        for lengths, ranks in parts:
            n, r = lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
            at = np.empty(len(n), np.int64)
            for size in np.unique(n):
                a, b = starts[size]
                own = n == size
                at[own] = a + np.searchsorted(of["rank"][a:b], r[own], "right") - 1
            inside, times = r - of["rank"][at], of["times"][at]
            yield pa.StructArray.from_arrays(
                [
                    pa.array(of["sequence"][at] + inside // times, pa.int64()),
                    pa.array(of["offset"][at] + inside % times * n, pa.int64()),
                ],
                ["sequence_id", "offset"],
            )

    kind = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return F.arrow_udf(find, kind, F.ArrowUDFType.SCALAR_ITER).asNondeterministic()(length, rank)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cut = np.flatnonzero(np.diff(values)) + 1
    first = np.concatenate([[0], cut]) if len(values) else cut
    end = np.append(cut, len(values))
    for a, b in zip(first, end, strict=False):
        yield int(values[a]), a, b


def pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, remember: int = REMEMBERED
) -> DataFrame:
    """The pieces of all documents with their sequence_id and offset."""
    long_texts(docs.sparkSession)
    # Written, as the ranks hold only within one run over the documents.
    cut = written(pieces(docs, tokenizer or default_tokenizer(), capacity, remember), "pieces")
    counted = cut.groupBy("task", "length").count()
    ahead = (
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = counted.select(
        F.col("task").alias("of_task"),
        F.col("length").alias("of_length"),
        F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"),
    )
    # At most ``capacity`` rows.
    totals = {r.length: r["sum(count)"] for r in counted.groupBy("length").sum("count").collect()}
    spots = slots(patterns(totals, capacity))
    ranked = cut.join(
        shifts, (F.col("task") == F.col("of_task")) & (F.col("length") == F.col("of_length"))
    )
    placed = ranked.withColumn(
        "place", place(F.col("length"), F.col("own_rank") + F.col("before"), spots)
    )
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.col("place.sequence_id").alias("sequence_id"), F.col("place.offset").alias("offset"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))
