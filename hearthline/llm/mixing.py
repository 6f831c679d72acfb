"""Mixing sources to target weights by systematic sampling.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share all
words by weight.  A target stops at ``MAX_COPIES`` times the source's words; the
excess goes to the others by weight until none is above.  All documents of a
source have the same expected number of copies, target / words.  In a fixed order
the expected copies are summed up, one random offset per source is added, and a
document is taken once for each integer that its stretch of the sum crosses: the
copies differ from the expected ones by less than one, and no document is taken
more often than ``MAX_COPIES`` times.

The order goes by size class first, so the sampled sizes follow the source's
sizes and the words taken come near the target.  A place in that order is a rank
within (source, size class, salt) plus the rows of the groups before it, so a
source with a third of all rows is ranked by many tasks.  What is summed up in one
place are the counts of these groups, at most 1024 salts by a few hundred classes
for a source, and one row per source.  Salts and order within a group come from doc_id and text, so reruns
take the same, and rows without doc_id are as well dealt out as others.

Null or empty text has size 0, and so has a source of such documents (target 0).
A null source is a source of its own.  A null doc_id is kept like any other.
Repeated rows are documents of their own.  An empty table gives an empty result.
Other columns are carried along whatever their names; where one has the name of a
column that ``mix`` adds, the added one is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import table, written

MAX_COPIES = 3
SALTS = 1024
WORD = r"[^\x20\x09-\x0D]+"


def _unit(text: Column) -> Column:
    """A number in [0, 1) that looks random but always is the same for ``text``."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _key() -> Column:
    """Source and group as text that is never null."""
    source = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    return F.concat_ws("/", F.col("group_.bits"), F.col("group_.head"), F.col("group_.salt"), source)


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate, offset).

    With limits l = MAX_COPIES * size the targets are min(l, weight * level) for the one
    level at which they add up to all words.  In the order of l / weight the
    sources that reach their limit come first, so running sums find the level.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_need = Window.orderBy("need", F.col("source").isNull(), "source")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    after = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighed = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn(
        "need", MAX_COPIES * F.col("source_size") / F.col("weight")
    )
    left = F.col("total") - MAX_COPIES * F.col("done")
    levelled = weighed.select(
        "*",
        F.sum("source_size").over(every).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("done"),
        F.sum("weight").over(after).alias("open"),
    ).withColumn("full", F.col("need") * F.col("open") <= left)
    # The first source that stays under its limit gives the level of all that do.
    first = F.min(F.when(~F.col("full"), F.struct("need", left.alias("left"), "open"))).over(every)
    return (
        levelled.withColumn("first", first)
        .withColumn(
            "target",
            F.when(F.col("full"), (MAX_COPIES * F.col("source_size")).cast("double")).otherwise(
                F.col("weight") * F.col("first.left") / F.col("first.open")
            ),
        )
        .select(
            "source",
            "source_size",
            "target",
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
            .otherwise(F.lit(0.0))
            .alias("rate"),
            _unit(F.concat(F.lit("mix/"), F.coalesce("source", F.lit("\x00")))).alias("start"),
        )
    )


def mix(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken; with ``whole`` also the
    original row as "mix row"."""
    bits = F.bin(F.col("size"))
    held = docs.select(F.struct(*docs.columns).alias("mix row"), "doc_id", "text", "source")
    sized = held.withColumn("text_md5", F.md5(F.coalesce("text", F.lit("")))).withColumn(
        "size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    ).withColumn(
        "group_",
        F.struct(
            F.length(bits).alias("bits"),
            F.rpad(F.substring(bits, 1, 4), 4, "0").alias("head"),
            F.conv(
                F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.col("text_md5"))), 1, 4), 16, 10
            )
            .cast("int")
            .alias("salt"),
        ),
    )
    sized = sized.withColumn("group_", F.col("group_").withField("salt", F.col("group_.salt") % SALTS))
    # Two scans of the table: the sizes are worked out again, rather than held.
    groups = written(
        sized.groupBy("source", "group_").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")), "mix-groups"
    )
    sources = groups.groupBy("source").agg(F.sum("words").alias("source_size"))
    ahead = (
        Window.partitionBy("source").orderBy("group_").rowsBetween(Window.unboundedPreceding, -1)
    )
    places = groups.select(
        F.col("source").alias("of_source"),
        _key().alias("of_key"),
        F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("rows_before"),
    )
    goals = targets(sources)
    goals = goals.select(*[F.col(c).alias(f"goal_{c}") for c in goals.columns])
    places = places.join(goals, F.col("of_source").eqNullSafe(F.col("goal_source")))
    # Ranked and joined by one key, so the rows are shuffled once.
    own = Window.partitionBy("key_").orderBy("doc_id", "size", "text_md5")
    ranked = sized.withColumn("key_", _key()).withColumn("own_rank", F.row_number().over(own))
    placed = ranked.join(places, F.col("key_") == F.col("of_key"))
    rank = F.col("rows_before") + F.col("own_rank")
    crossed = lambda r: F.floor(F.col("goal_start") + F.col("goal_rate") * r)
    added = ("size", "source_size", "target", "copies", "taken")
    return placed.select(
        *[F.col("mix row")[c].alias(c) for c in docs.columns if c not in added],
        *([] if not whole else ["mix row"]),
        "size",
        F.col("goal_source_size").alias("source_size"),
        F.col("goal_target").alias("target"),
        (crossed(rank) - crossed(rank - 1)).cast("long").alias("copies"),
    ).withColumn("taken", F.col("copies") * F.col("size"))


def emitted(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as it is taken."""
    mixed = mix(docs, whole=True).filter("copies > 0").select("mix row", "copies")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.select("mix row", copies).select("`mix row`.*")


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sized AS (
    SELECT doc_id, source, md5(coalesce(text, '')) AS text_md5,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM totals
), needs AS (
    SELECT *, 3 * source_size::DOUBLE / weight AS need FROM weighed
), levels AS (
    SELECT *,
           sum(source_size) OVER () AS total,
           coalesce(sum(source_size) OVER (ORDER BY need, source IS NULL, source
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
           sum(weight) OVER (ORDER BY need, source IS NULL, source
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
    FROM needs
), full_or_not AS (
    SELECT *, need * open <= total - 3 * done AS is_full FROM levels
), level AS (
    SELECT (total - 3 * done)::DOUBLE AS rest, open AS open_weight
    FROM full_or_not WHERE NOT is_full ORDER BY need, source IS NULL, source LIMIT 1
), goals AS (
    SELECT source, source_size,
           CASE WHEN is_full THEN (3 * source_size)::DOUBLE
                ELSE weight * (SELECT rest FROM level) / (SELECT open_weight FROM level) END AS target,
           ('0x' || substr(md5('mix/' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start
    FROM full_or_not
), ranked AS (
    SELECT *, row_number() OVER (
        PARTITION BY source
        ORDER BY length(bin(size)), rpad(substr(bin(size), 1, 4), 4, '0'),
                 ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || text_md5), 1, 4))::INT % 1024,
                 doc_id NULLS FIRST, size, text_md5
    ) AS place
    FROM sized
), rated AS (
    SELECT r.*, g.source_size, g.target, g.start,
           CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate
    FROM ranked r JOIN goals g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (floor(start + rate * place) - floor(start + rate * (place - 1)))::BIGINT * size AS taken
FROM rated
"""
