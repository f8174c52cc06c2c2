"""Read models: compositions of operators that serve lists, details and series."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmill.operators.buckets import daily_totals, interest_for_entity, total_mentions, trend_series
from signalmill.operators.growth import share_of_voice
from signalmill.operators.ordinal import with_prefix_sums
from signalmill.operators.pairs import label_pairs, order_pairs
from signalmill.operators.seeds import match_seeds


def top_evidence(links: DataFrame, signals: DataFrame, n: int = 20) -> DataFrame:
    """the n newest signals of each entity and how many it has in all.

    The total is aggregated apart, so the window keeps n rows per entity and group limit push-down applies.
    """
    j = links.select("signal_id", "entity").distinct().join(signals.select("signal_id", "posted_on", "captured_on"), "signal_id")
    total = j.groupBy("entity").agg(F.count("*").alias("total"))
    order = Window.partitionBy("entity").orderBy(F.desc_nulls_last("posted_on"), F.desc("captured_on"), "signal_id")
    top = j.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    return top.join(total, "entity")


def filter_trends(df: DataFrame, archived: bool = False, types: list[str] | None = None) -> DataFrame:
    """C11: archived flag and a type list; no list means all, a null type is other."""
    df = df.where(F.coalesce("archived", F.lit(False)) == archived)
    return df.where(F.coalesce("entity_type", F.lit("other")).isin(types)) if types else df


def sort_trends(df: DataFrame, key: str = "signal", descending: bool = True) -> DataFrame:
    """nulls last both ways, ties by entity."""
    return df.orderBy(F.desc_nulls_last(key) if descending else F.asc_nulls_last(key), "entity")


def page(df: DataFrame, by: str, key: str, descending: bool = True, limit: int = 100, offset: int = 0) -> DataFrame:
    """a stable page, 500 rows at most."""
    order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
    return df.orderBy(order, key).offset(offset).limit(min(limit, 500))


def signal_percentile(states: DataFrame, items: DataFrame) -> DataFrame:
    """Percent of the surfaced population with a strictly lower evidence score.

    Scores go to a histogram, whose prefix sums come from range partitions.
    """
    s = states.join(items.where("not archived").select("item_id", "evidence_count"), "item_id")
    s = s.withColumn("score", F.greatest(F.lit(0), F.coalesce("evidence_count", F.lit(0))) * F.greatest(F.lit(1), F.size(F.coalesce("platforms", F.array().cast("array<string>")))))
    h = with_prefix_sums(s.groupBy("score").agg(F.count("*").alias("c")), ["score"], {"below": "c"})
    h = h.crossJoin(F.broadcast(h.agg(F.sum("c").alias("n"))))  # a single row
    return s.join(h, "score").select("entity", "geography", "score", F.floor(F.col("below") / F.col("n") * 100 + 0.5).cast("int").alias("percentile"))


def facets(trends: DataFrame) -> DataFrame:
    """Trends by type, the largest first and other last."""
    t = F.coalesce("entity_type", F.lit("other"))
    return trends.groupBy(t.alias("entity_type")).agg(F.count("*").alias("n")).orderBy(F.col("entity_type") == "other", F.desc("n"), "entity_type")


def top_per_category(ranked: DataFrame, n: int = 25) -> DataFrame:
    """F6"""
    w = Window.partitionBy("category").orderBy(F.desc("current"), "attribute")
    return ranked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def trends(states: DataFrame, entities: DataFrame, items: DataFrame, buckets: DataFrame, vocab: DataFrame, seeds: DataFrame, types=None) -> DataFrame:
    """States with entity, item, share of voice, percentile and seed match; core terms and archived items are out.

    discovered is true when no seed term matches the label.
    """
    t = states.join(entities.select("entity", "entity_type"), "entity").join(items.select("item_id", "archived", "evidence_count"), "item_id")
    t = filter_trends(t, False, types)
    core = vocab.select(F.lower(F.trim("term")).alias("_t")).distinct()
    t = t.join(core, F.lower(F.trim(F.col("entity"))) == F.col("_t"), "left_anti")
    t = t.join(share_of_voice(buckets).select("entity", "sov_growth"), "entity", "left")
    t = t.join(signal_percentile(states, items).select("entity", "geography", "percentile"), ["entity", "geography"], "left")
    m = match_seeds(entities.select("entity"), seeds)
    t = t.join(m.select("entity", F.col("term").alias("seed_term"), "query_id"), "entity", "left")
    return t.withColumn("discovered", F.col("query_id").isNull())


def split_scored(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J7"""
    return t.where("sov_growth is not null"), t.where("sov_growth is null")


def trend_detail(trend_rows: DataFrame, entity: str, buckets: DataFrame, links: DataFrame, signals: DataFrame, as_of: datetime.date, n: int = 20) -> DataFrame:
    """A trend's columns with mentions in 7, 30 and 90 days, its newest evidence and how much there is."""
    ago = F.datediff(F.lit(as_of), F.col("bucket_date"))
    t = lambda d: F.coalesce(F.sum(F.when(ago.between(0, d), F.col("mentions"))), F.lit(0)).alias(f"mentions_{d}d")
    w = buckets.where(F.col("entity") == entity).groupBy("entity").agg(t(7), t(30), t(90))
    own = links.where(F.col("entity") == entity)
    e = top_evidence(own, signals, n).groupBy("entity").agg(F.max("total").alias("evidence_total"), F.array_sort(F.collect_list(F.struct("rn", "signal_id", "posted_on"))).alias("evidence"))
    return trend_rows.where(F.col("entity") == entity).join(w, "entity", "left").join(e, "entity", "left")


def trend_timeseries(entities: DataFrame, buckets: DataFrame, interest: DataFrame, since: datetime.date) -> DataFrame:
    """Mentions and interest by day since a date, with flags whether an entity has either at all."""
    i = interest_for_entity(entities, interest)
    s = trend_series(buckets.where(F.col("bucket_date") >= F.lit(since)), i.where(F.col("bucket_date") >= F.lit(since)))
    flags = s.groupBy("entity").agg(F.bool_or(F.col("interest").isNotNull()).alias("has_interest"), F.bool_or(F.col("mentions") > 0).alias("has_mentions"))
    return s.join(flags, "entity")


def long_tail_list(candidates: DataFrame, entities: DataFrame, buckets: DataFrame, seeds: DataFrame, as_of: datetime.date, days: int = 30) -> DataFrame:
    """Candidates with a dense daily sparkline, all-time mentions and seed match."""
    slot = F.lit(days - 1) - F.datediff(F.lit(as_of), F.col("bucket_date"))
    d = daily_totals(buckets).withColumn("slot", slot).where(F.col("slot").between(0, days - 1))
    d = d.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("slot", "mentions"))).alias("m"))
    spark = F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    c = candidates.join(d, "entity", "left").withColumn("sparkline", spark).drop("m").join(total_mentions(entities, buckets), "entity", "left")
    m = match_seeds(candidates.select("entity"), seeds)
    return c.join(m.select("entity", F.col("term").alias("seed_term")), "entity", "left")


def pair_list(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """J5"""
    return order_pairs(label_pairs(pairs, entities))


def entity_states(states: DataFrame, entities: DataFrame, buckets: DataFrame, state=None, geography=None, least_v7: int = 0) -> DataFrame:
    """J6"""
    s = states.where(F.col("volume_7d") >= least_v7)
    s = s if state is None else s.where(F.col("state") == state)
    s = s if geography is None else s.where(F.col("geography") == geography)
    return s.join(entities.select("entity", "entity_type"), "entity").join(share_of_voice(buckets).select("entity", "sov_growth"), "entity", "left")


def radar_status(states: DataFrame, entities: DataFrame) -> DataFrame:
    """Verdict fields, passes first, then by label. states hold `verdict` struct(decision, p_value, entropy_bits)."""
    s = states.where("verdict is not null").join(entities.select("entity", "entity_type"), "entity")
    out = s.select("entity", "geography", "entity_type", F.col("verdict.decision").alias("decision"), F.col("verdict.p_value").alias("p_value"), F.col("verdict.entropy_bits").alias("entropy_bits"))
    return out.orderBy(F.col("decision") != "pass", "entity", "geography")
