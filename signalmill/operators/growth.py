"""Growth windows, share of voice, lifecycle metrics."""

from __future__ import annotations

import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions.measures import growth_rate


def _ago(as_of: datetime.date) -> Column:
    return F.datediff(F.lit(as_of), F.col("bucket_date"))


def in_windows(buckets: DataFrame, as_of: datetime.date, *spans: tuple[int, int]) -> DataFrame:
    """The rows from some spans of days ago, ends included. Of a table laid out by bucket_month or by bucket_date only the folders of the spans are read."""
    ends = [(as_of - datetime.timedelta(days=last), as_of - datetime.timedelta(days=first)) for first, last in spans]
    if "bucket_month" in buckets.columns:
        buckets = buckets.where(reduce(or_, [F.col("bucket_month").between(F.lit(a.replace(day=1)), F.lit(b)) for a, b in ends]))
    return buckets.where(reduce(or_, [F.col("bucket_date").between(F.lit(a), F.lit(b)) for a, b in ends]))


def deltas(buckets: DataFrame, as_of: datetime.date, least_days: int = 30, entities: DataFrame | None = None) -> DataFrame:
    """Month and year over year per entity in one pass over the four windows.

    With `entities` (a row per entity) only the days of the windows are read, and an entity
    without one of them has zeros; without, all days are read for the entities they name.
    """
    ago = _ago(as_of)
    if entities is not None:
        buckets = in_windows(buckets, as_of, (0, 89), (365, 454))
    total = lambda a, b: F.coalesce(F.sum(F.when(ago.between(a, b), F.col("mentions"))), F.lit(0))
    d = buckets.groupBy("entity").agg(
        total(0, 29).alias("month"), total(30, 59).alias("prior_month"), total(0, 89).alias("quarter"), total(365, 454).alias("prior_year"),
        F.count_distinct(F.when(ago.between(0, 59), F.col("bucket_date"))).alias("covered_days"),
    )
    if entities is not None:
        d = entities.select("entity").join(d, "entity", "left").fillna(0, ["month", "prior_month", "quarter", "prior_year", "covered_days"])
    mom = F.when((F.col("prior_month") > 0) & (F.col("covered_days") >= least_days), (F.col("month") - F.col("prior_month")) / F.col("prior_month"))
    yoy = F.when(F.col("prior_year") > 0, (F.col("quarter") - F.col("prior_year")) / F.col("prior_year"))
    return d.select("*", mom.alias("delta_mom"), yoy.alias("delta_yoy"))


def volumes(buckets: DataFrame, as_of: datetime.date) -> DataFrame:
    """Volumes per entity and geography; `N days` are N + 1 calendar days."""
    ago = _ago(as_of)
    b = buckets.where(ago.between(0, 90))
    v = lambda n: F.coalesce(F.sum(F.when(ago <= n, F.col("mentions"))), F.lit(0)).alias(f"volume_{n}d")
    return b.groupBy("entity", "geography").agg(v(7), v(30), v(90)).withColumn("velocity", F.col("volume_7d") / 7)


def _weeks(days: Column) -> Column:
    """Greedy weeks of a sorted array of struct(d, m): a week ends at the first active day 7 or more days after its first."""
    start = F.struct(F.lit(None).cast("date").alias("first"), F.array().cast("array<long>").alias("done"), F.lit(0).cast("long").alias("sum"))

    def step(s: Column, x: Column) -> Column:
        new = s["first"].isNull() | (F.datediff(x["d"], s["first"]) >= 7)
        return F.struct(
            F.when(new, x["d"]).otherwise(s["first"]).alias("first"),
            F.when(new & s["first"].isNotNull(), F.concat(s["done"], F.array(s["sum"]))).otherwise(s["done"]).alias("done"),
            F.when(new, x["m"]).otherwise(s["sum"] + x["m"]).cast("long").alias("sum"),
        )

    return F.aggregate(days, start, step, lambda s: F.when(s["first"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["sum"]))))


def _active_days(buckets: DataFrame, dates: list[datetime.date], days: int = 90) -> DataFrame:
    """(entity, geography, as_of, days): for each of a few dates the sorted day sums of the `days` days up to it, in one pass over the buckets."""
    near = F.filter(F.array(*[F.lit(d) for d in sorted(dates)]), lambda d: F.datediff(d, F.col("bucket_date")).between(0, days))
    span = (F.col("bucket_date") >= F.lit(min(dates) - datetime.timedelta(days=days))) & (F.col("bucket_date") <= F.lit(max(dates)))
    d = buckets.where(span).groupBy("entity", "geography", "bucket_date").agg(F.sum("mentions").alias("m"))
    d = d.select("entity", "geography", F.struct(F.col("bucket_date").alias("d"), "m").alias("x"), F.explode(near).alias("as_of"))
    return d.groupBy("entity", "geography", "as_of").agg(F.array_sort(F.collect_list("x")).alias("days"))


def week_buckets(buckets: DataFrame, as_of: datetime.date, days: int = 90) -> DataFrame:
    """Array of greedy weeks per entity and geography, over a bounded number of days."""
    return _active_days(buckets, [as_of], days).select("entity", "geography", _weeks(F.col("days")).alias("weeks"))


def state_metrics_at(buckets: DataFrame, dates: list[datetime.date]) -> DataFrame:
    """E3 to E6 at each of a few dates (column as_of): volumes, velocity, growth and volatility per entity and geography active in the 90 days before."""
    v = lambda n: F.aggregate(F.filter("days", lambda x: F.datediff("as_of", x["d"]) <= n), F.lit(0).cast("long"), lambda s, x: s + x["m"]).alias(f"volume_{n}d")
    m = _active_days(buckets, dates).select("entity", "geography", "as_of", v(7), v(30), v(90), _weeks(F.col("days")).alias("weeks"))
    n = F.size("weeks")
    this = F.when(n >= 1, F.element_at("weeks", -1)).otherwise(0)
    prev = F.when(n >= 2, F.try_element_at("weeks", F.lit(-2))).otherwise(0)
    month = F.when(F.col("volume_30d") > 0, (F.col("volume_90d") - F.col("volume_30d")) / 2).otherwise(0.0)
    last = F.slice("weeks", F.greatest(n - 4, F.lit(1)), 5)
    mean = F.aggregate(last, F.lit(0.0), lambda s, x: s + x) / F.size(last)
    spread = F.aggregate(last, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return m.select(
        "entity", "geography", "as_of", "volume_7d", "volume_30d", "volume_90d", (F.col("volume_7d") / 7).alias("velocity"), "weeks",
        growth_rate(prev, this).alias("growth_wow"), growth_rate(month, F.col("volume_30d")).alias("growth_mom"),
        F.when(n >= 2, F.sqrt(spread / (F.size(last) - 1))).otherwise(0.0).alias("volatility"),
    )


def state_metrics(buckets: DataFrame, as_of: datetime.date) -> DataFrame:
    """E3 to E6 at one date."""
    return state_metrics_at(buckets, [as_of]).drop("as_of")


def rank_attributes(buckets: DataFrame, days: int, as_of: datetime.date) -> DataFrame:
    """Mentions of attributes in the last `days` days and the same span before."""
    ago = _ago(as_of)
    total = lambda a, b: F.coalesce(F.sum(F.when(ago.between(a, b), F.col("mentions"))), F.lit(0))
    near = buckets.where(F.col("bucket_date").between(F.lit(as_of - datetime.timedelta(days=2 * days - 1)), F.lit(as_of)))
    r = near.groupBy("category", "attribute").agg(total(0, days - 1).alias("current"), total(days, 2 * days - 1).alias("prior")).where("current > 0 or prior > 0")
    return r.withColumn("delta", F.when(F.col("prior") > 0, (F.col("current") - F.col("prior")) / F.col("prior")))


def with_bounds(buckets: DataFrame, days: int, keys=("tenant",)) -> DataFrame:
    """Rows with their tenant's last day and the edges of two windows of `days` days."""
    last = buckets.groupBy(*keys).agg(F.max("bucket_date").alias("last_day"))
    last = last.withColumn("mid_day", F.date_sub("last_day", days)).withColumn("first_day", F.date_sub("last_day", 2 * days))
    return buckets.join(last, list(keys))


def share_of_voice(buckets: DataFrame, days: int = 60, least_prior: int = 3, least_platforms: int = 2) -> DataFrame:
    """Median over platforms of the growth of an entity's share of the platform's mentions.

    Windows are (start, end] and end on the tenant's last day. Platforms count with
    `least_prior` mentions of the entity before; fewer than `least_platforms` give null.
    """
    b = with_bounds(buckets, days).where("bucket_date > first_day")  # older days count in neither window
    recent = (F.col("bucket_date") > F.col("mid_day")) & (F.col("bucket_date") <= F.col("last_day"))
    prior = (F.col("bucket_date") > F.col("first_day")) & (F.col("bucket_date") <= F.col("mid_day"))
    per = b.groupBy("tenant", "entity", "platform").agg(
        F.coalesce(F.sum(F.when(recent, F.col("mentions"))), F.lit(0)).alias("recent_n"), F.coalesce(F.sum(F.when(prior, F.col("mentions"))), F.lit(0)).alias("prior_n")
    )
    total = per.groupBy("tenant", "platform").agg(F.sum("recent_n").alias("recent_total"), F.sum("prior_n").alias("prior_total"))
    return sov_of_windows(per.join(total, ["tenant", "platform"]), least_prior, least_platforms)


def sov_of_windows(per: DataFrame, least_prior: int = 3, least_platforms: int = 2) -> DataFrame:
    """E8 from rows (tenant, entity, platform, recent_n, prior_n, recent_total, prior_total)."""
    use = (F.col("prior_n") >= least_prior) & (F.col("recent_total") > 0) & (F.col("prior_total") > 0)
    growth = (F.col("recent_n") / F.col("recent_total")) / (F.col("prior_n") / F.col("prior_total")) - 1
    s = per.where(use).withColumn("growth", growth).groupBy("tenant", "entity").agg(
        F.count("*").alias("platforms"), F.percentile("growth", F.lit(0.5)).alias("m"),
        F.array_sort(F.collect_list(F.struct("platform", "recent_n", "prior_n", F.round("growth", 6).alias("growth")))).alias("audit"),
    )
    return s.select("tenant", "entity", "platforms", F.when(F.col("platforms") >= least_platforms, F.col("m")).alias("sov_growth"), "audit")
