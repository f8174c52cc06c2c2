"""Co-occurrence of entities in signals."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cooccurrences(links: DataFrame, cap: int = 50) -> DataFrame:
    """(signal_id, a, b, posted_on) for a < b among the `cap` lowest distinct entities of a signal.

    The cap is the operator's own rule; it bounds a signal's pairs.
    """
    e = links.groupBy("signal_id", "entity").agg(F.min("posted_on").alias("posted_on"))
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("signal_id").orderBy("entity"))).where(F.col("n") <= cap)
    s = e.groupBy("signal_id").agg(F.min("posted_on").alias("posted_on"), F.array_sort(F.collect_list("entity")).alias("es"))
    rest = lambda x, i: F.transform(F.slice("es", i + 2, F.size("es")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    return s.where(F.size("es") > 1).select("signal_id", "posted_on", F.inline(F.flatten(F.transform("es", rest))))


def _window(df: DataFrame, as_of: datetime.date, a: int, b: int, col: str = "posted_on") -> DataFrame:
    return df.where(F.datediff(F.lit(as_of), F.col(col)).between(a, b))


def pair_lift(links: DataFrame, cooc: DataFrame, as_of: datetime.date, days: int = 14, least_joint: int = 5, least_lift: float = 2.0) -> DataFrame:
    """Pairs whose joint count is at least the floor and `least_lift` times what independence gives."""
    now = _window(links, as_of, 0, days)
    joint = _window(cooc, as_of, 0, days).groupBy("a", "b").agg(F.count_distinct("signal_id").alias("joint")).where(F.col("joint") >= least_joint)
    per = now.groupBy("entity").agg(F.count_distinct("signal_id").alias("n"))
    total = now.agg(F.count_distinct("signal_id").alias("total"))
    j = joint.join(per.select(F.col("entity").alias("a"), F.col("n").alias("count_a")), "a").join(per.select(F.col("entity").alias("b"), F.col("n").alias("count_b")), "b")
    j = j.crossJoin(F.broadcast(total))  # one row
    expected = F.col("count_a") * F.col("count_b") / F.col("total")
    return j.withColumn("expected", expected).withColumn("lift", F.col("joint") / expected).where(F.col("lift") >= least_lift)


def prior_joint(pairs: DataFrame, cooc: DataFrame, as_of: datetime.date, days: int = 14) -> DataFrame:
    """Joint count in the window before, 0 when absent; the windows share their boundary day."""
    p = _window(cooc, as_of, days, 2 * days).groupBy("a", "b").agg(F.count_distinct("signal_id").alias("p"))
    return pairs.join(p, ["a", "b"], "left").withColumn("prior_joint", F.coalesce("p", F.lit(0))).drop("p")


def pair_sparkline(cooc: DataFrame, as_of: datetime.date, days: int = 14) -> DataFrame:
    """Joint counts per day, `days` slots from the oldest; the newest calendar day has no slot."""
    d = _window(cooc, as_of, 0, days).withColumn("slot", F.lit(days) - F.datediff(F.lit(as_of), F.col("posted_on")))
    d = d.groupBy("a", "b", "slot").agg(F.count_distinct("signal_id").alias("n")).groupBy("a", "b").agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"))
    return d.select("a", "b", F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("sparkline"))


def label_pairs(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Both sides' labels and types, live entities only."""
    e = entities.where("deleted_at is null")
    a = e.select(F.col("entity").alias("a"), F.col("label").alias("label_a"), F.col("entity_type").alias("type_a"))
    b = e.select(F.col("entity").alias("b"), F.col("label").alias("label_b"), F.col("entity_type").alias("type_b"))
    return pairs.join(a, "a").join(b, "b")


def order_pairs(pairs: DataFrame) -> DataFrame:
    """pairs expected at least once come first, then by lift."""
    return pairs.orderBy(F.when(F.col("expected") >= 1, 0).otherwise(1), F.desc("lift"), "a", "b")
