"""Day buckets and series built on them."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["entity", "platform", "geography", "bucket_date"]


def live_entities(entities: DataFrame) -> DataFrame:
    """C10"""
    return entities.where("deleted_at is null")


def entity_signals(signals: DataFrame, links: DataFrame, entities: DataFrame) -> DataFrame:
    """Signals with their links to live entities."""
    return signals.join(links, "signal_id").join(live_entities(entities).select("entity"), "entity")


def day_buckets(links: DataFrame, distinct_signals: bool = False, by: tuple = (), tasks: int | None = None) -> DataFrame:
    """Per entity, platform, geography and day: mentions, authors, sum and median of positive engagement, first flag. `by` names keys beside these.

    Authors are counted by a mark on the first link of each in a bucket, so that no histogram
    is kept by author. `tasks` is the number of tasks that links are dealt into by bucket and
    author; None leaves it to Spark.
    """
    keys = [*by, *KEY]
    rows = links.withColumn("bucket_date", F.col("posted_on"))
    if tasks:
        rows = rows.repartition(tasks, *keys, "author")
    first = F.row_number().over(Window.partitionBy(*keys, "author").orderBy(F.lit(0))) == 1
    rows = rows.withColumn("_new", first & (F.col("author") != ""))
    positive = F.when(F.col("engagement") > 0, F.col("engagement"))
    aggs = [
        (F.countDistinct("signal_id") if distinct_signals else F.count("*")).alias("mentions"),
        F.count_if("_new").alias("unique_authors"),
        F.coalesce(F.sum(positive), F.lit(0.0)).alias("engagement_sum"),
        F.coalesce(F.percentile(positive, F.lit(0.5)), F.lit(0.0)).alias("engagement_median"),
    ]
    if "backfill_derived" in links.columns:
        aggs.append(F.min_by("backfill_derived", "signal_id").alias("backfill_derived"))
    return rows.groupBy(*keys).agg(*aggs)


def bucket_parts(links: DataFrame) -> DataFrame:
    """What buckets add up from: per bucket a row for each author (item null), and one for each positive engagement (author null), with how often it came."""
    keyed = links.withColumn("bucket_date", F.col("posted_on"))
    none = F.lit(None)
    authors = keyed.groupBy(*KEY, F.coalesce("author", F.lit("")).alias("author")).agg(F.count("*").alias("n")).withColumn("value", none.cast("double"))
    values = keyed.where("engagement > 0").groupBy(*KEY, F.col("engagement").cast("double").alias("value")).agg(F.count("*").alias("n")).withColumn("author", none.cast("string"))
    return authors.select(*KEY, "author", "value", "n").unionByName(values.select(*KEY, "author", "value", "n"))


def add_parts(*parts: DataFrame) -> DataFrame:
    """Parts of the union of the links that each was made of."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(*KEY, "author", "value").agg(F.sum("n").alias("n"))


def buckets_of(parts: DataFrame) -> DataFrame:
    """E1's measures from parts: authors are an exact set, and the median comes from the histogram."""
    seen = F.col("author").isNotNull()
    return parts.groupBy(*KEY).agg(
        F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("mentions"), F.count_if(seen & (F.col("author") != "")).alias("unique_authors"),
        F.coalesce(F.sum(F.col("value") * F.col("n")), F.lit(0.0)).alias("engagement_sum"), F.coalesce(F.percentile("value", F.lit(0.5), F.coalesce(F.when(~seen, F.col("n")), F.lit(0))), F.lit(0.0)).alias("engagement_median"),
    )


def platforms_seen(buckets: DataFrame) -> DataFrame:
    """E7"""
    return buckets.groupBy("entity", "geography").agg(F.array_sort(F.collect_set("platform")).alias("platforms"))


def platform_days(buckets: DataFrame) -> DataFrame:
    """Buckets added up over geographies, for readers of sums: a row per tenant, entity, platform and day, whatever the number of links."""
    return buckets.groupBy("tenant", "entity", "platform", "bucket_date").agg(F.sum("mentions").alias("mentions"), F.sum(F.greatest("unique_authors", F.lit(0))).alias("unique_authors"))


def daily_totals(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("entity", "bucket_date").agg(F.sum("mentions").alias("mentions"))


def daily_series(buckets: DataFrame, max_days: int = 180) -> DataFrame:
    """One row per day up to the entity's last active day, zero where nothing came; the first active day or max_days limits it."""
    d = daily_totals(buckets)
    span = d.groupBy("entity").agg(F.max("bucket_date").alias("last"), F.min("bucket_date").alias("first"))
    start = F.greatest("first", F.date_sub("last", max_days - 1))
    days = span.select("entity", F.explode(F.sequence(start, F.col("last"))).alias("bucket_date"))
    return days.join(d, ["entity", "bucket_date"], "left").select("entity", "bucket_date", F.coalesce("mentions", F.lit(0)).alias("mentions"))


def attribute_buckets(attributed: DataFrame, signals: DataFrame, as_of: datetime.date, days: int = 365, tasks: int | None = None) -> DataFrame:
    """Rows and distinct authors per category, attribute and day. With `tasks`, rows are dealt into so many by bucket and author before they are counted."""
    since = as_of - datetime.timedelta(days=days)
    s = signals.where((F.col("posted_on") >= F.lit(since)) & (F.col("posted_on") <= F.lit(as_of)))
    j = attributed.join(s.select("signal_id", F.col("posted_on").alias("bucket_date"), "author"), "signal_id")
    j = j.repartition(tasks, "category", "attribute", "bucket_date", "author") if tasks else j
    return j.groupBy("category", "attribute", "bucket_date").agg(F.count("*").alias("mentions"), F.countDistinct("author").alias("unique_authors"))


def total_mentions(entities: DataFrame, buckets: DataFrame) -> DataFrame:
    """All-time mentions of every entity, 0 for those without buckets."""
    t = buckets.groupBy("entity").agg(F.sum("mentions").alias("t"))
    return entities.join(t, "entity", "left").select("entity", F.coalesce("t", F.lit(0)).alias("total_mentions"))


def recent_days(buckets: DataFrame, n: int = 14) -> DataFrame:
    """the last n active days of each entity."""
    w = Window.partitionBy("entity").orderBy(F.desc("bucket_date"))
    return daily_totals(buckets).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def rolling(series: DataFrame, w: int = 7) -> DataFrame:
    """sum over w rows, null until w rows are there."""
    frame = Window.partitionBy("entity").orderBy("bucket_date").rowsBetween(-w + 1, 0)
    return series.withColumn("rolling", F.when(F.count("*").over(frame) == w, F.sum("mentions").over(frame)))


def recent_vs_prior(series: DataFrame, w: int = 28) -> DataFrame:
    """sums of the last w rows and the w before, at each entity's last row."""
    order = Window.partitionBy("entity").orderBy("bucket_date")
    s = series.withColumn("recent", F.sum("mentions").over(order.rowsBetween(-w + 1, 0))).withColumn("prior", F.sum("mentions").over(order.rowsBetween(-2 * w + 1, -w)))
    return s.groupBy("entity").agg(F.max_by("recent", "bucket_date").alias("recent"), F.coalesce(F.max_by("prior", "bucket_date"), F.lit(0)).alias("prior"))


def trend_series(buckets: DataFrame, interest: DataFrame) -> DataFrame:
    """Per entity and day, mentions (0 when absent) and the highest interest (null when absent)."""
    m = daily_totals(buckets)
    i = interest.groupBy("entity", "bucket_date").agg(F.max("interest_value").alias("interest"))
    return m.join(i, ["entity", "bucket_date"], "full_outer").select("entity", "bucket_date", F.coalesce("mentions", F.lit(0)).alias("mentions"), "interest")


def interest_for_entity(entities: DataFrame, interest: DataFrame) -> DataFrame:
    """Interest rows whose keyword is the entity's label or an alias, case apart."""
    terms = F.array_union(F.array(F.lower("label")), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), F.lower))
    e = entities.select("entity", F.explode(terms).alias("_k"))
    return interest.join(e, F.lower(F.col("keyword")) == F.col("_k")).select("entity", "bucket_date", "interest_value")
