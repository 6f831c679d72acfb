"""Collocations: phrases whose parts stand together far more often than apart, by language.

Texts (A-Z as a-z) are cut into pieces at ``.,;:!?`` and line ends, and pieces into words
at spaces and tabs.  Only the longest windows are counted: each word with the ``LONGEST - 1``
words after it in its piece, padded with nulls at the end of the piece.  Spark's GROUPING SETS over the
window's columns then sum the counts of longer windows to those of their beginnings, so a
pair and a triple are counted from the same rows.

1. A phrase is no more frequent than its parts, so runs of one, then two, then three words are counted before,
   words as they are and longer runs of frequent parts as numbers only, which go packed by range to the tasks that add them up,
   and windows end where they get below ``LEAST``, like at the end of a piece.  Tasks know the frequent runs from Bloom filters of a fixed size: what these let through
   wrongly, and with very many frequent runs that may be much, is more work and changes no count.
2. Windows of what is left, of two words at least, are counted, first within blocks of texts, and summed to their beginnings.
3. Phrases with a >= ``LEAST`` occurrences are candidates.  Cut after its first k words, a phrase
   scores floor(1000000 a a / (l r)) with l and r the counts of its parts; the lowest cut
   counts, the smallest k among equal ones.  Numbers are decimals, and exact to 10^14 words a language.
4. A candidate inside a longer one that has at least half its count is dropped.  The first
   ``TOP`` of each language stay, by score, count and phrase.

Null text is empty; a null lang is ``und`` and one language with a lang of that name.
Repeated rows count each.  An empty table gives an empty result.  doc_id is not read.
Within a block of texts words are told apart by 64-bit hashes, between blocks as strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jaccard import _five, _from_five
from .tables import long_texts, table, written
from .words import Hasher, mixed, utf8
from .workers import released

LONGEST = 3
LEAST = 10
HALF = 50  # percent
TOP = 2000
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Bits of each filter: 8 MB, whatever the size of the corpus.
FILTER_BITS = 1 << 26
_FILTER_PART = 1 << 15  # bytes
BLOCK = 1 << 20  # bytes of text counted at once, unless one text is longer
#: Bytes of text for each range of hashes: some 2 million runs.
RANGE_BYTES = 12_000_000
CHUNK = 2_000_000  # runs that a task counts before it sends them
_LOW = np.uint64((1 << 40) - 1)

WORD = "lang string, word string, n long"
WINDOW = "lang string, w1 string, w2 string, w3 string, n long"
PACKED = "range long, once binary, runs binary, counts binary"


def _hasher() -> Hasher:
    return Hasher(b" \t" + PIECE_ENDS)


class _Block:
    """The words of some texts: ``ids`` of all in order, ``goes_on`` where the next is in the same
    piece, and for each id its language, its bytes and a hash of both."""

    def __init__(self, hasher: Hasher, data: np.ndarray, at: np.ndarray, langs: np.ndarray) -> None:
        first, last = hasher.spans(data, at)
        sums = hasher.sums(data)
        hashes = mixed((sums[last] - sums[first]) * hasher.inverse[first])
        owner = np.searchsorted(at, first, "right") - 1
        hashes = mixed(hashes ^ langs[owner])
        self.hashes, sample, self.ids, self.counts = np.unique(
            hashes, return_index=True, return_inverse=True, return_counts=True
        )
        ends = np.zeros(len(data) + 1, np.int64)
        np.cumsum(np.isin(data, np.frombuffer(PIECE_ENDS, np.uint8)), out=ends[1:])
        self.goes_on = np.zeros(len(first), bool)
        if len(first):
            same = owner[1:] == owner[:-1]
            self.goes_on[:-1] = same & (ends[first[1:]] == ends[last[:-1]])
        self.owner = owner[sample]  # the text that has the word's language
        self.texts = _strings(data, first[sample], last[sample])


def _strings(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """Stretches of ``data`` as strings, A-Z in lower case."""
    size = last - first
    offsets = np.zeros(len(first) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    raw = data[np.repeat(first - offsets[:-1], size) + np.arange(offsets[-1])]
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw).astype(np.uint8)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(raw))


def _lang_hashes(hasher: Hasher, langs: pa.Array) -> np.ndarray:
    """A hash of each whole string."""
    data, at = utf8(langs)
    sums = hasher.sums(data)
    return mixed((sums[at[1:]] - sums[at[:-1]]) * hasher.inverse[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, pa.Array]]:
    """Blocks of the batches' texts, with the language of each id."""
    hasher = _hasher()
    for batch in batches:
        langs, texts = batch.column(0), batch.column(1)
        data, at = utf8(texts)
        hashes = _lang_hashes(hasher, langs)
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, "right")) - 1)
            block = _Block(hasher, data[at[i] : at[j]], at[i : j + 1] - at[i], hashes[i:j])
            if len(block.ids):
                yield block, langs.take(pa.array(block.owner + i))
            i = j


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, langs in _blocks(batches):
        yield pa.RecordBatch.from_arrays(
            [langs, block.texts, pa.array(block.counts.astype(np.int64))], ["lang", "word", "n"]
        )


def _bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a word in the filter."""
    low = np.uint64(FILTER_BITS - 1)
    return (hashes & low).astype(np.int64), ((hashes >> np.uint64(32)) & low).astype(np.int64)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of the given hashes, in parts that have any."""
    bits = np.zeros(FILTER_BITS, bool)
    for batch in batches:
        for own in _bits(batch.column(0).to_numpy().view(np.uint64)):
            bits[own] = True
    parts = np.packbits(bits).reshape(-1, _FILTER_PART)
    some = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["part", "bits"]
    )


def _merged_marks(group: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(b.as_py(), np.uint8) for b in group["bits"]])
    return pa.table({"part": group["part"][:1], "bits": pa.array([bits.tobytes()], pa.binary())})


def bloom_filter(hashes: DataFrame) -> np.ndarray:
    """A filter of all ``hashes`` (one column), marked in tasks and put together from parts of equal bits."""
    kind = "part int, bits binary"
    marked = hashes.mapInArrow(lambda b: released(_marks(b)), kind)
    out = np.zeros((FILTER_BITS // 8 // _FILTER_PART, _FILTER_PART), np.uint8)
    for row in marked.groupBy("part").applyInArrow(_merged_marks, kind).toLocalIterator():  # 8 MB in all
        out[row.part] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def in_filter(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    one, two = _bits(hashes)
    return ((bits[one >> 3] >> (7 - (one & 7)).astype(np.uint8)) & (bits[two >> 3] >> (7 - (two & 7)).astype(np.uint8)) & 1) == 1


def _hash_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes that ``_Block`` gives (lang, word)."""
    hasher = _hasher()
    for batch in batches:
        data, at = utf8(batch.column(1))
        sums = hasher.sums(data)
        words = mixed((sums[at[1:]] - sums[at[:-1]]) * hasher.inverse[at[:-1]])
        hashes = mixed(words ^ _lang_hashes(hasher, batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])


def _runs(block: _Block, filters: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each size that has a filter, where a run of so many words begins whose parts and which itself
    may be frequent; and the hashes of the runs one longer whose parts may be."""
    words = block.hashes[block.ids]
    fine = [in_filter(filters[0], block.hashes)[block.ids]]
    hashes = words
    for size in range(2, len(filters) + 2):
        may = np.zeros(len(words), bool)
        may[:-1] = block.goes_on[:-1] & fine[-1][:-1] & fine[-1][1:]
        first = np.flatnonzero(may)
        longer = mixed(hashes[first] * np.uint64(0x9E3779B97F4A7C15) + words[first + size - 1])
        if size > len(filters):
            return fine, longer
        may[first] = in_filter(filters[size - 1], mixed(longer & _LOW))
        hashes = np.zeros(len(words), np.uint64)
        hashes[first] = longer
        fine.append(may)
    raise AssertionError


def _packed(runs: np.ndarray, ranges: int) -> pa.RecordBatch:
    """How often each run occurs, in a row for each range of hashes that has any.  Within a range
    40 bits of a hash are left; what these take for one run only lets the filter pass more."""
    runs, counts = np.unique(runs, return_counts=True)
    where = ((runs >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)  # in order like the runs
    begin = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    once, more, often = [], [], []
    for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(runs)], strict=True):
        low, number = runs[a:b] & _LOW, counts[a:b]
        once.append(_five(low[number == 1]))
        more.append(_five(low[number > 1]))
        often.append(number[number > 1].astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(where[begin].astype(np.int64)), *(pa.array(x, pa.binary()) for x in (once, more, often))],
        ["range", "once", "runs", "counts"],
    )


def _count_runs(batches: Iterator[pa.RecordBatch], filters: list[np.ndarray], ranges: int) -> Iterator[pa.RecordBatch]:
    met: list[np.ndarray] = []
    for block, _ in _blocks(batches):
        met.append(_runs(block, filters)[1])
        if sum(map(len, met)) >= CHUNK:
            yield _packed(np.concatenate(met), ranges)
            met = []
    if any(map(len, met)):
        yield _packed(np.concatenate(met), ranges)


def _frequent_runs(group: pa.Table, least: int) -> pa.Table:
    """Of one range, what the filter holds of the runs that occur ``least`` times."""
    once, more = (_from_five(b"".join(group[name].to_pylist())) for name in ("once", "runs"))
    often = np.frombuffer(b"".join(group["counts"].to_pylist()), "<u4")
    runs = np.concatenate([once, more])
    counts = np.concatenate([np.ones(len(once), np.int64), often])
    order = np.argsort(runs)
    runs = runs[order]
    begin = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    frequent = np.add.reduceat(counts[order], begin) >= least
    return pa.table({"hash": mixed(runs[begin[frequent]]).view(np.int64)})


def _count_windows(batches: Iterator[pa.RecordBatch], filters: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for block, langs in _blocks(batches):
        fine, _ = _runs(block, filters)
        if not fine[1].any():
            continue
        ids = block.ids.astype(np.int64) + 1  # 0 pads
        lead = np.zeros((len(ids), LONGEST), np.int64)
        lead[:, 0] = ids
        for k in range(1, LONGEST):  # the word k places on, if the run so far may be frequent
            lead[:-k, k] = np.where(fine[k][:-k], ids[k:], 0)
        lead = lead[fine[1]]  # single words are counted already
        base = len(block.hashes) + 1
        key = lead[:, 0]
        for k in range(1, LONGEST):
            if base**LONGEST >= 1 << 63:  # only within a very long text
                key = np.unique(key, return_inverse=True)[1]
            key = key * base + lead[:, k]
        _, sample, counts = np.unique(key, return_index=True, return_counts=True)
        found = lead[sample] - 1
        columns = [block.texts.take(pa.array(found[:, k], mask=found[:, k] < 0)) for k in range(LONGEST)]
        yield pa.RecordBatch.from_arrays(
            [langs.take(pa.array(found[:, 0])), *columns, pa.array(counts.astype(np.int64))],
            ["lang", *(f"w{k + 1}" for k in range(LONGEST)), "n"],
        )


def _whole(c: Column, digits: int = 14) -> Column:
    return c.cast(f"decimal({digits},0)")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, w1, w2, w3, n) of all runs of words with at least ``least`` occurrences, and
    (lang, total) of all words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = max(16, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    words = texts.mapInArrow(lambda b: released(_count_words(b)), WORD).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # Rare words are needed for the totals only.
    kept = F.when(F.col("n") >= least, F.col("word"))
    counted = written(words.groupBy("lang", kept.alias("word")).agg(F.sum("n").alias("n")), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    share = docs.sparkSession.sparkContext.broadcast
    frequent = counted.filter("word IS NOT NULL").select("lang", "word")
    filters = [share(bloom_filter(frequent.mapInArrow(lambda b: released(_hash_words(b)), "hash long")))]
    for _ in range(1, LONGEST):
        known = list(filters)
        met = texts.mapInArrow(lambda b, known=known: released(_count_runs(b, [f.value for f in known], ranges)), PACKED)
        runs = met.groupBy("range").applyInArrow(lambda g: _frequent_runs(g, least), "hash long")
        filters.append(share(bloom_filter(runs)))

    windows = texts.mapInArrow(lambda b: released(_count_windows(b, [f.value for f in filters])), WINDOW)
    lang, w1, w2, w3 = (F.col(c) for c in ("lang", "w1", "w2", "w3"))
    summed = (
        windows.groupingSets([[lang, w1, w2, w3], [lang, w1, w2]], lang, w1, w2, w3)
        .agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
        .filter(F.col("n") >= least)
    )
    # Level 0 holds triples, 1 pairs; padded windows count only in what they begin with.
    size = F.when(F.col("level") == 0, 3).otherwise(2)
    real = summed.select("lang", size.alias("size"), "w1", "w2", "w3", "n").filter("size = 2 OR w3 IS NOT NULL")
    none = F.lit(None).cast("string")
    single = counted.filter("word IS NOT NULL").select(
        "lang", F.lit(1).alias("size"), F.col("word").alias("w1"), none.alias("w2"), none.alias("w3"), "n"
    )
    return written(real, "phrases").unionByName(single), totals


def collocations(docs: DataFrame, least: int = LEAST, half: int = HALF, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` collocations of each language."""
    long_texts(docs.sparkSession)
    counts, totals = phrase_counts(docs, least)
    text = F.concat_ws(" ", "w1", "w2", "w3")

    def part(alias: str, size: int) -> DataFrame:
        of = counts.filter(F.col("size") == size)
        return of.select(F.col("lang").alias("of_lang"), text.alias(f"{alias}_text"), F.col("n").alias(alias))

    def with_count(df: DataFrame, alias: str, size: int, *words: str) -> DataFrame:
        named = F.concat_ws(" ", *words)
        return df.join(part(alias, size), (F.col("lang") == F.col("of_lang")) & (named == F.col(f"{alias}_text"))).drop(
            "of_lang", f"{alias}_text"
        )

    pairs = counts.filter("size = 2").select("lang", "w1", "w2", "w3", F.col("n").alias("a"))
    triples = counts.filter("size = 3").select("lang", "w1", "w2", "w3", F.col("n").alias("a"))
    pairs = with_count(with_count(pairs, "l1", 1, "w1"), "r1", 1, "w2")
    triples = with_count(with_count(triples, "l1", 1, "w1"), "r1", 2, "w2", "w3")
    triples = with_count(with_count(triples, "l2", 2, "w1", "w2"), "r2", 1, "w3")

    def score(left: str, right: str) -> Column:
        a, b = _whole(F.col("a")), _whole(F.col(left)) * _whole(F.col(right))
        return F.call_function("div", a * a * F.lit(1000000).cast("decimal(7,0)"), b)

    cuts = triples.withColumns({"s1": score("l1", "r1"), "s2": score("l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    triples = cuts.select(
        "lang", text.alias("phrase"), "a",
        F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    # Longer phrases that hold a pair, and the most frequent of them.
    longer = counts.filter("size = 3")
    holders = longer.select("lang", F.concat_ws(" ", "w1", "w2").alias("inner"), "n").unionByName(
        longer.select("lang", F.concat_ws(" ", "w2", "w3").alias("inner"), "n")
    )
    most = holders.groupBy("lang", "inner").agg(F.max("n").alias("most"))
    most = most.select(F.col("lang").alias("of_lang"), F.col("inner").alias("phrase_inside"), "most")
    pairs = pairs.select("lang", text.alias("phrase"), "a", F.col("l1").alias("l"), F.col("r1").alias("r"), score("l1", "r1").alias("score"))
    pairs = pairs.join(
        most, (F.col("lang") == F.col("of_lang")) & (F.col("phrase") == F.col("phrase_inside")), "left"
    ).filter(F.col("most").isNull() | (100 * F.col("most") < half * F.col("a")))
    both = pairs.select(*triples.columns).unionByName(triples)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    whole = totals.select(F.col("lang").alias("of_lang"), F.col("total").alias("n"))
    return best.join(whole, F.col("lang") == F.col("of_lang")).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


SQL = f"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece
    FROM documents)
),
words AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS ws FROM pieces),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM words GROUP BY lang),
runs AS (
  SELECT lang, m, array_to_string(list_slice(ws, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS m))
),
f AS (SELECT lang, m, phrase, count(*) AS a FROM runs GROUP BY lang, m, phrase HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT f.lang, f.m, f.phrase, f.a, k,
    array_to_string(list_slice(string_split(phrase, ' '), 1, k), ' ') AS one,
    array_to_string(list_slice(string_split(phrase, ' '), k + 1, m), ' ') AS two
  FROM f, (SELECT unnest([1, 2]) AS k) WHERE k < m
),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, k, x.a AS l, y.a AS r,
    CAST(1000000 * c.a::HUGEINT * c.a::HUGEINT // (x.a::HUGEINT * y.a::HUGEINT) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.one AND x.m = k
  JOIN f y ON y.lang = c.lang AND y.phrase = c.two AND y.m = c.m - k
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase, a
  FROM f WHERE m = 3
),
kept AS (
  SELECT * FROM lowest o WHERE NOT EXISTS (
    SELECT 1 FROM inside i WHERE o.m = 2 AND i.lang = o.lang AND i.phrase = o.phrase AND 100 * i.a >= {HALF} * o.a)
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang)
QUALIFY rank <= {TOP}
"""
