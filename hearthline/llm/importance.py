"""Importance resampling towards a target corpus, by hashed word features.

Features of a text are all runs of 1 to ``n`` consecutive words (runs of ASCII letters and
digits and of everything beyond ASCII, A-Z as a-z), joined by one space, with repeats.
A feature's bucket is the CRC-32 of its UTF-8 bytes modulo ``buckets``.  How much more
often the target has a bucket than the corpus, smoothed by one and in thousandths of a
logarithm, is the bucket's gain; a document's weight is the floored mean gain of its
features.  Gumbel noise from a hash of the doc_id is added, and the highest scores are
drawn, which is sampling without replacement in proportion to the weights.

CRCs are worked out for the distinct features of a block of texts.  Those of equal length
form one matrix of bytes, and all their CRCs take in one column after another; the
buckets are then scattered back to the occurrences.

Ranks are dealt out without bringing all rows together: scores are whole numbers in a
range that the counts' logarithms bound, so rows above each score are counted, and ties
are ordered within their score.

Null and empty texts have no features and weight 0.  They have too few words to be drawn,
as have all texts below ``least`` words.  A null doc_id counts as the empty string in the
noise and comes last among ties; repeated rows have equal scores and ranks of their own.
An empty corpus gives an empty result; an empty target gives gains like any other.
Columns of the input other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import long_texts, table, written
from .words import PIECE, Hasher, lettered, mixed, utf8
from .workers import released

LONGEST_RUN = 1
BUCKETS = 10_000
SHARE = 10  # percent drawn
LEAST = 20  # words
SEED = 2024
#: Features longer than this, rare and then few to a matrix, are given to zlib one by one.
WIDE = 256


def _crc_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (crc & np.uint32(1)))
    return crc


CRC = _crc_table()


def crc_columns(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a matrix of bytes, all rows at once, one column after another."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = CRC[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the stretches of ``data``, in matrices of equal length."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for own in np.split(order, cuts):
        if not len(own):
            continue
        size = int(length[own[0]])
        if size > WIDE:
            out[own] = [zlib.crc32(data[a : a + size].tobytes()) for a in start[own].tolist()]
        else:
            out[own] = crc_columns(data[start[own][:, None] + np.arange(size)])
    return out


def _spaced_words(hasher: Hasher, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """All words in lower case with one space after each, where they begin and end there,
    and which words each text has."""
    first, last = hasher.spans(data, at)
    size = last - first
    end = np.cumsum(size + 1) - 1
    start = end - size
    pick = np.repeat(first - start, size + 1) + np.arange(int(end[-1]) + 1 if len(end) else 0)
    text = data[np.minimum(pick, len(data) - 1)] if len(data) else data
    capital = (text >= 65) & (text <= 90)
    text = np.where(capital, text + np.uint8(32), text)
    text[end] = 32
    return text, start, end, np.searchsorted(first, at)


def feature_buckets(
    hasher: Hasher, data: np.ndarray, at: np.ndarray, longest: int, buckets: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, number of the text) of each feature, and the words of each text."""
    text, start, end, bounds = _spaced_words(hasher, data, at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    sums = hasher.sums(text)
    found, owners = [], []
    for m in range(1, longest + 1):
        head = np.arange(max(len(start) - m + 1, 0))
        head = head[owner[head] == owner[head + m - 1]]
        a, b = start[head], end[head + m - 1]
        hashes = mixed((sums[b] - sums[a]) * hasher.inverse[a])
        _, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
        found.append((crcs(text, a[sample], (b - a)[sample]) % np.uint32(buckets))[back])
        owners.append(owner[head])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), np.diff(bounds)


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about ``PIECE`` bytes."""
    data, at = utf8(texts)
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def bucket_counts(texts: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; what reaches the driver is ``buckets`` numbers at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = lettered(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, at in _blocks(batch.column(0)):
                counts += np.bincount(feature_buckets(hasher, data, at, longest, buckets)[0], minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(lambda b: released(counted(b)), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier the target is to have each bucket."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log(float(t + 1) * (s_all + buckets) / (float(s + 1) * (t_all + buckets))))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """doc_id, n_words, n_features, weight of each document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = lettered()
        for batch in batches:
            for i, j, data, at in _blocks(batch.column(1)):
                bucket, owner, words = feature_buckets(hasher, data, at, longest, len(gain))
                n = np.bincount(owner, minlength=j - i)
                total = np.zeros(j - i, np.int64)
                np.add.at(total, owner, gain[bucket])
                arrays = [batch.column(0).slice(i, j - i).cast(pa.int64()), *map(pa.array, (words, n, total // np.maximum(n, 1)))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    kind = "doc_id long, n_words long, n_features long, weight long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: released(each(b)), kind)


def ranked(scored: DataFrame, drawn: F.Column, share: int = SHARE) -> DataFrame:
    """``scored`` with rank: 1, 2, ... by descending score and doc_id for the first ``share``
    percent of the rows that ``drawn`` admits, null for all others."""
    inside, outside = scored.filter(drawn), scored.filter(~drawn)
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    counted = inside.groupBy("score").agg(F.count("*").alias("n_here"))  # as many rows as there are scores
    totals = counted.select(
        "score",
        F.coalesce(F.sum("n_here").over(above), F.lit(0)).alias("n_above"),
        F.floor(F.sum("n_here").over(Window.partitionBy()) * share / 100).alias("n_drawn"),
    )
    ties = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight")
    place = F.col("n_above") + F.row_number().over(ties)
    some = inside.join(totals, "score").withColumn("rank", F.when(place <= F.col("n_drawn"), place))
    columns = [*scored.columns, "rank"]
    return some.select(*columns).unionByName(outside.withColumn("rank", F.lit(None).cast("long")).select(*columns))


def noise(doc_id: F.Column, seed: int = SEED) -> F.Column:
    """Gumbel noise in thousandths, the same in each run."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST_RUN,
    buckets: int = BUCKETS,
    share: int = SHARE,
    least: int = LEAST,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of all documents; rank is null where not drawn."""
    long_texts(docs.sparkSession)
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    weights = weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(written(weights, "weights"), F.col("n_words") >= least, share)


def query(spark: SparkSession, folder: str) -> DataFrame:
    rows = resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


#: CRC-32 of the distinct words, a byte a step, from a table that eight shifts give.
SQL = f"""
WITH RECURSIVE texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
),
cut AS (
  SELECT kind, r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x{{00}}-\\x{{2F}}\\x{{3A}}-\\x{{60}}\\x{{7B}}-\\x{{7F}}]+') AS words
  FROM texts
),
words AS (SELECT kind, r, unnest(words) AS w FROM cut),
shifted AS (
  SELECT range AS b, range AS v, 0 AS k FROM range(256)
  UNION ALL SELECT b, xor(v >> 1, 3988292384 * (v & 1)), k + 1 FROM shifted WHERE k < 8
),
crc AS (
  SELECT w, hex(encode(w)) AS hx, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT w FROM words)
  UNION ALL
  SELECT w, hx, i + 1, xor(v, c >> 8)
  FROM crc JOIN shifted ON k = 8 AND b = xor(c & 255, CAST(('0x' || substring(hx, 2 * i + 1, 2)) AS BIGINT))
  WHERE 2 * i < length(hx)
),
bucket AS (SELECT w, xor(c, 4294967295) % {BUCKETS} AS b FROM crc WHERE 2 * i = length(hx)),
counts AS (
  SELECT b, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 't') AS t
  FROM words JOIN bucket USING (w) GROUP BY b
),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
gain AS (
  SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + {BUCKETS})::DOUBLE
    / ((s + 1)::DOUBLE * (t_all + {BUCKETS})::DOUBLE))) AS BIGINT) AS g FROM counts, sums
),
weights AS (
  SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS g
  FROM words JOIN bucket USING (w) JOIN gain USING (b) WHERE kind = 'd' GROUP BY r
),
scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN CAST(floor(g::DOUBLE / n) AS BIGINT) ELSE 0 END AS weight,
    CAST(('0x' || substring(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h
  FROM (SELECT * FROM cut WHERE kind = 'd') LEFT JOIN weights USING (r)
),
summed AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM scored
),
placed AS (
  SELECT *, CASE WHEN n_features >= {LEAST} THEN
    row_number() OVER (PARTITION BY n_features >= {LEAST} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS place,
    count(*) FILTER (n_features >= {LEAST}) OVER () AS n_all
  FROM summed
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= n_all * {SHARE} // 100 THEN place END AS rank FROM placed
"""
