"""Mixing sources to target weights under a time-varying curriculum. SQL and DataFrame functions only.

Every source has a piecewise linear weight schedule over training time 0..1. Its integral,
scaled so that the whole course demands the source's target, is the source's cumulative
token demand; inverting that demand at a document copy's offset in its source gives the
copy's position in the course, and a range sort by position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmill.llm.common import stored, table

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
#: Weight of a source at the start, middle and end of the course, by the place of the source in the order.
SCHEDULES = ((1.0, 1.0, 1.0), (2.0, 1.0, 0.5), (0.5, 1.0, 2.0))
SHARE, MOST = 1.5, 2.0
#: Hash slices of a source; offsets are summed per slice first, so no source is one window.
SLICES = 4096


def sizes(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row per input row: id, source, size and a slice and rank from a hash of id and content."""
    rank = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("mix")).cast("binary"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"),
        rank.alias("_rank"),
        F.conv(F.substring(rank, 1, 3), 16, 10).cast("int").alias("_slice"),
    )


def source_targets(stats: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, place, weight, target) from (source, source_size).

    Targets are min(level * weight, most * size) with the level at which they sum to share of
    all words; sources are met in the order of most * size / weight, so the level after k
    capped sources is one running sum away.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = stats.withColumn("place", F.row_number().over(order) - 1).withColumn("weight", w)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("_all", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("_weights", F.sum("weight").over(every))
        .withColumn("_capped", F.coalesce(F.sum(F.col("source_size") * most).over(upto), F.lit(0.0)))
        .withColumn("_used", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_capped")) / (F.col("_weights") - F.col("_used")))
    )
    cap = F.col("source_size") * F.lit(most)
    # The level is that of the first source it does not cap; with none, every source is at its cap.
    first = F.min(F.when(F.col("_level") * F.col("weight") <= cap, F.struct(F.col("source_size") / F.col("weight"), "place", "_level"))).over(every)
    level = first["_level"]
    target = F.when(level.isNull(), cap).otherwise(F.least(level * F.col("weight"), cap))
    return s.select("source", "source_size", "place", "weight", target.cast("double").alias("target"))


def _time(offset: Column, demand: Column, a: Column, b: Column, c: Column) -> Column:
    """Time of the course at which a source's cumulative demand reaches `offset` words, null beyond its whole demand.

    The demand follows the integral of the weight, linear from a to b and on to c, scaled to
    `demand` words at time 1.
    """
    first, second = (a + b) / 4, (b + c) / 4
    need = F.least(offset / F.nullif(demand, F.lit(0.0)), F.lit(1.0)) * (first + second)

    def root(area: Column, lo: Column, hi: Column) -> Column:
        # lo*x + (hi-lo)*x*x = area on a piece of length 1/2
        below = lo + F.sqrt(F.greatest(lo * lo + 4 * (hi - lo) * area, F.lit(0.0)))
        return F.coalesce(2 * area / F.nullif(below, F.lit(0.0)), F.lit(0.0))

    return F.when(offset <= demand, F.when(need <= first, root(need, a, b)).otherwise(F.lit(0.5) + root(need - first, b, c)))


def positioned(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, schedules=SCHEDULES, **cols) -> DataFrame:
    """One row per input row: sizes(), source_size, target and `positions`, the times at which the course takes the row.

    Passes over a source repeat its documents in one hash order, `most` passes at most. A
    pass takes a document where the source's inverted cumulative demand gives the middle of
    its words a time; beyond the demand there is none, so a source misses its target by half
    a document at most. Null texts have size 0 and are never taken; a null source is a
    source; repeated rows are documents of their own; an empty table gives no rows.
    """
    if not all(min(p) >= 0 < sum(p) for p in schedules):
        raise ValueError("weights of a schedule are not negative, and not all zero")
    s = stored(sizes(docs, **cols), "sizes")  # texts are read once; all that follows works on ids and sizes
    slices = s.groupBy("source", "_slice").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    targets = source_targets(s.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = F.array(*[F.array(*[F.lit(float(x)) for x in p]) for p in schedules])
    head = slices.join(targets, slices["source"].eqNullSafe(targets["source"])).select(
        slices["source"].alias("_s"), F.col("_slice").alias("_t"), "_before", "source_size", "target", F.element_at(plan, (F.col("place") % len(schedules) + 1).cast("int")).alias("_plan")
    )
    within = Window.partitionBy("source", "_slice").orderBy("_rank", "size").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    s = s.join(head, s["source"].eqNullSafe(head["_s"]) & (s["_slice"] == head["_t"]))
    middle = F.col("_before") + F.col("_start") + F.col("size") / 2
    times = [_time(middle + k * F.col("source_size"), F.col("target"), *(F.col("_plan")[i] for i in range(3))) for k in range(int(most))]
    taken = F.when(F.col("size") > 0, F.array_compact(F.array(*times))).otherwise(F.array().cast("array<double>"))
    return s.select("doc_id", "source", "size", "source_size", "target", taken.alias("positions"), "_rank")


def mix(docs: DataFrame, **params) -> DataFrame:
    """One row per document and copy taken, with `position` in the course, and one with copy 0 for documents not taken.

    Columns: doc_id, source, size, source_size, target, copy, words, position; rows as in positioned().
    """
    s = positioned(docs, **params).select("*", F.posexplode_outer("positions").alias("_at", "position"))
    copy = F.coalesce(F.col("_at") + 1, F.lit(0))
    return s.select(
        "doc_id", "source", "size", "source_size", "target", copy.alias("copy"), F.when(copy > 0, F.col("size")).otherwise(F.lit(0)).alias("words"), "position", "_rank"
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """The copies taken, range-sorted by position; ties go by hash, then copy."""
    return mixed.where("copy > 0").orderBy("position", "_rank", "copy").drop("_rank")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = positioned(table(spark, sf_dir, "documents")).withColumn("position", F.get("positions", F.lit(0))).orderBy("position", "_rank")
    taken = F.col("size") * F.size("positions")
    return m.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken.alias("taken"), F.round("position", 6).alias("position"))


OP9_SQL = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), 'mix')) AS rk,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
st AS (SELECT source, CAST(sum(size) AS DOUBLE) AS ss FROM s GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM st),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight FROM o),
f(step, level) AS (
  SELECT 0, (SELECT 1.5 * sum(ss) / sum(weight) FROM w)
  UNION ALL
  SELECT step + 1, (SELECT (1.5 * sum(ss) - sum(CASE WHEN f.level * weight > 2 * ss THEN 2 * ss ELSE 0 END))
                    / nullif(sum(CASE WHEN f.level * weight > 2 * ss THEN 0 ELSE weight END), 0) FROM w)
  FROM f WHERE step < (SELECT count(*) FROM w)),
t AS (SELECT source, ss, place, least((SELECT level FROM f ORDER BY step DESC LIMIT 1) * weight, 2 * ss) AS target FROM w),
c AS (SELECT s.*, t.ss, t.target, t.place,
             coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY rk, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2 AS middle
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE place % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS a, 1.0::DOUBLE AS b,
             CASE place % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 2.0::DOUBLE END AS c FROM c),
q AS (SELECT *, (a + b) / 4 AS f, least(middle / nullif(target, 0), 1) * ((a + b) / 4 + (b + c) / 4) AS need FROM p)
SELECT doc_id, size, CAST(ss AS BIGINT) AS source_size, round(target, 6) AS target,
       CAST(CASE WHEN size = 0 THEN 0 WHEN middle + ss <= target THEN 2 * size WHEN middle <= target THEN size ELSE 0 END AS BIGINT) AS taken,
       CASE WHEN size > 0 AND middle <= target THEN round(CASE WHEN need <= f THEN 2 * need / (a + sqrt(greatest(a * a + 4 * (b - a) * need, 0)))
            ELSE 0.5 + 2 * (need - f) / (b + sqrt(greatest(b * b + 4 * (c - b) * (need - f), 0))) END, 6) END AS position
FROM q
"""
