"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, repeated up to three times. A document's
virtual finish time is the number of its source's words up to and with it, divided by the source's
weight. All copies are put in the order of finish times, and the mix is the longest prefix that
stays within the total budget, which is the sum of all sizes. So sources are served in proportion
to their weights, and what a source that is used up leaves over goes to the others by weight.

No running sum goes over a whole source or table in one task. A source is cut into ``BUCKETS``
slices of its shuffled order and the table into ``BUCKETS`` slices of finish time; sums of slices
are added up first, then the rows within each slice.

Sources rank by code point, null last, and weigh 1, 2, 3, repeating. Defined results: a null text
has size 0 and is never taken (it would add nothing); a null doc_id is shuffled as an empty string;
rows with equal ids are told apart by size only, equal rows share one order and are all taken or
left by their summed position; an empty table gives no rows; other columns are ignored.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import n_words, query, table, written

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BUCKETS = 1024


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, weight, source_size, target) from (source, size); one row per source.

    The common level at which ``sum(least(3 * size, level * weight))`` is the sum of all sizes is
    found on the piece between two sources of the order in which they are used up.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")))
    cap = MAX_REPEATS * F.col("source_size")
    by_end = Window.orderBy("end", "rank")
    before = by_end.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_end.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    levels = (
        ranked.withColumn("end", cap / F.col("weight"))
        .withColumn("used", F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(onwards))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("level", (F.col("total") - F.col("used")) / F.col("open"))
        .withColumn("level", F.coalesce(F.max(F.when(F.col("level") <= F.col("end"), F.col("level"))).over(whole), F.lit(0.0)))
    )
    return levels.select("source", "rank", "weight", "source_size", "total",
                         F.least(cap.cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every document of ``docs``."""
    sized = docs.select(F.col("doc_id").cast("long"), "source", n_words(F.col("text")).alias("size"))
    sized = sized.withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # Its first ten bits cut a source's shuffled order into slices.
    sized = written(sized.withColumn(
        "slice", F.floor(F.conv(F.substring("turn", 1, 3), 16, 10).cast("long") * BUCKETS / 4096)), "sized")
    targets = written(source_targets(sized), "targets")

    slices = sized.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(F.col("source").alias("s"), F.col("slice").alias("at"),
                           F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    known = targets.select(F.col("source").alias("t"), "rank", "weight", "source_size", "total", "target")
    # Equal documents share their position: the sum runs over all rows up to the last of them.
    within = Window.partitionBy("source", "slice").orderBy("turn", "size").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    queued = (
        sized.withColumn("within", F.sum("size").over(within))
        .join(slices, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("at")))
        .join(known, F.col("source").eqNullSafe(F.col("t")))
        .withColumn("position", F.col("ahead") + F.col("within"))
        .select("doc_id", "source", "size", "turn", "position", "rank", "weight", "source_size", "total", "target")
    )
    # Copies that cannot finish before the common level, plus one round for certainty, stay out.
    rounds = F.least(F.lit(MAX_REPEATS), F.floor(F.col("target") / F.greatest("source_size", F.lit(1))) + 2)
    copies = written(queued.withColumn("round", F.explode(F.sequence(F.lit(0), (rounds - 1).cast("int")))).withColumn(
        "finish", (F.col("round") * F.col("source_size") + F.col("position")) / F.col("weight")), "copies")

    last = copies.agg(F.max("finish").alias("last"))
    cut = copies.crossJoin(F.broadcast(last)).withColumn(
        "part", F.least(F.floor(F.col("finish") / F.greatest("last", F.lit(1.0)) * BUCKETS), F.lit(BUCKETS - 1)))
    parts = cut.groupBy("part").agg(F.sum("size").alias("words"), F.max("total").alias("budget"))
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("upto", F.sum("words").over(run))
    cut = cut.join(parts.select("part", "words", "upto", "budget"), "part")
    # All but one slice lie wholly within or beyond the budget.
    border = cut.where("upto > budget and upto - words < budget")
    order = Window.partitionBy("part").orderBy("finish", "rank", "turn", "size").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    border = border.withColumn("sum", F.sum("size").over(order) + F.col("upto") - F.col("words")).where("sum <= budget")
    taken = cut.where("upto <= budget").select("source", "turn", "size", "round").unionByName(
        border.select("source", "turn", "size", "round"))
    taken = taken.distinct().groupBy("source", "turn", "size").agg(F.count("*").alias("rounds"))
    return (
        queued.alias("q").join(
            taken.alias("t"),
            F.col("q.source").eqNullSafe(F.col("t.source")) & (F.col("q.turn") == F.col("t.turn")) & (F.col("q.size") == F.col("t.size")),
            "left",
        ).select("q.doc_id", "q.source", "q.size", "q.source_size", "q.target",
                 (F.coalesce("t.rounds", F.lit(0)) * F.col("q.size")).alias("taken"))
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS turn,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), ends AS (
  SELECT *, 3 * source_size / weight AS fin, sum(source_size) OVER () AS total FROM sums
), levels AS (
  SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY fin, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY fin, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ends
), level AS (SELECT coalesce(max(level), 0) AS level FROM levels WHERE level <= fin
), targets AS (
  SELECT source, rank, weight, source_size, total,
         least((3 * source_size)::DOUBLE, level.level * weight) AS target
  FROM ends, level
), queued AS (
  SELECT s.doc_id, s.size, s.turn, t.*,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, (n * source_size + position) / weight AS finish FROM queued, (SELECT unnest([0, 1, 2]) AS n)
), summed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, turn, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM copies
), taken AS (
  SELECT source, turn, size, count(DISTINCT n) AS rounds FROM summed WHERE upto <= total GROUP BY ALL
)
SELECT q.doc_id, q.source, q.size::BIGINT AS size, q.source_size::BIGINT AS source_size, q.target::DOUBLE AS target,
       (coalesce(t.rounds, 0) * q.size)::BIGINT AS taken
FROM queued q LEFT JOIN taken t
  ON q.source IS NOT DISTINCT FROM t.source AND q.turn = t.turn AND q.size = t.size
"""


@query("op6_fair_queue_mixing", SQL)
def op6(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))
