"""Long-tail candidates: small entities that rose against their own past."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from signalmill.functions.text import well_formed
from signalmill.operators.growth import in_windows


def uplift_windows(buckets: DataFrame, as_of: datetime.date, entities: DataFrame | None = None) -> DataFrame:
    """Mentions in the last 30 days, the 30 before, and the same days a year back.

    With `entities` (a row per tenant and entity) only the days of the windows are read, and
    an entity without one of them has zeros; without, all days are read for the entities they name.
    """
    ago = F.datediff(F.lit(as_of), F.col("bucket_date"))
    total = lambda a, b: F.coalesce(F.sum(F.when(ago.between(a, b), F.col("mentions"))), F.lit(0))
    if entities is not None:
        buckets = in_windows(buckets, as_of, (0, 59), (365, 394))
    w = buckets.groupBy("tenant", "entity").agg(total(0, 29).alias("current"), total(30, 59).alias("prior"), total(365, 394).alias("yoy"))
    if entities is None:
        return w
    return entities.select("tenant", "entity").join(w, ["tenant", "entity"], "left").fillna(0, ["current", "prior", "yoy"])


def volume_ceiling(df: DataFrame, pct: float = 50, floor: int = 5) -> DataFrame:
    """Per tenant the nearest-rank percentile of counts at or above the floor.

    Counts are aggregated to a histogram first, so the window holds distinct counts, not entities.
    """
    h = df.where(F.col("current") >= floor).groupBy("tenant", "current").agg(F.count("*").alias("c"))
    w = Window.partitionBy("tenant")
    h = h.withColumn("upto", F.sum("c").over(w.orderBy("current"))).withColumn("n", F.sum("c").over(w))
    index = F.least(F.floor(F.lit(min(100.0, max(0.0, pct)) / 100) * F.col("n")), F.col("n") - 1)
    return h.where(F.col("upto") > index).groupBy("tenant").agg(F.min("current").alias("ceiling"))


def _upper_beta(cur: np.ndarray, base: np.ndarray, x: float = 2 / 3) -> np.ndarray:
    """1 - I(x; 1 + cur, 1 + base) of a whole batch, by the continued fraction of the regularised incomplete beta function."""
    from math import lgamma

    a, b = cur.astype(float) + 1, base.astype(float) + 1
    gamma = np.frompyfunc(lgamma, 1, 1)
    front = np.exp((gamma(a + b) - gamma(a) - gamma(b)).astype(float) + a * np.log(x) + b * np.log1p(-x))
    # The fraction converges fast on one side of the mean; the other side is its complement.
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(p), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    h = d.copy()
    for m in range(1, 10_000):
        moved = np.zeros(len(p), bool)
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
            moved |= np.abs(d * c - 1) > 1e-15
        if not moved.any():
            break
    part = front * h / p
    return np.clip(np.where(flip, part, 1 - part), 0.0, 1.0)


@F.pandas_udf(DoubleType())
def uplift_posterior(cur: pd.Series, base: pd.Series) -> pd.Series:
    """Posterior probability that the rate rose, from two counts; each distinct pair is worked out once per batch."""
    both = pd.DataFrame({"c": cur.fillna(0), "b": base.fillna(0)})
    once = both.drop_duplicates()
    return both.merge(once.assign(p=_upper_beta(once["c"].to_numpy(), once["b"].to_numpy())), on=["c", "b"], how="left")["p"]


def posterior_column(cur: Column, base: Column) -> Column:
    """E19 in columns, for counts below some hundreds: running products of binomial terms."""
    n = (cur + base + 1).cast("double")
    first = F.struct((n * F.log(F.lit(1 / 3))).alias("t"), F.lit(0.0).alias("s"))
    step = lambda a, k: F.struct(
        (a["t"] + F.log((n - k) / (k + 1)) + F.log(F.lit(2.0))).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")
    )
    return F.least(F.aggregate(F.sequence(F.lit(0), cur.cast("int")), first, step, lambda a: a["s"]), F.lit(1.0))


def long_tail_stages(windows: DataFrame, vocab: DataFrame, floor: int = 5, pct: float = 50, least: float = 0.9) -> DataFrame:
    """Every entity with its baseline, posterior and the stage that it ends in.

    windows: tenant, entity (the label), current, prior, yoy. Stages in order: floor,
    ceiling, vocabulary, malformed, no_baseline, low_posterior, candidate.
    """
    w = windows.join(volume_ceiling(windows, pct, floor), "tenant", "left")
    terms = vocab.select(F.lower(F.trim("term")).alias("_t")).distinct().withColumn("_core", F.lit(True))
    w = w.join(terms, F.lower(F.trim(F.col("entity"))) == F.col("_t"), "left").drop("_t")
    base = F.when(F.col("yoy") > 0, F.col("yoy")).otherwise(F.col("prior"))
    w = w.withColumn("baseline", base).withColumn("baseline_kind", F.when(F.col("yoy") > 0, "yoy").otherwise("prior_window"))
    w = w.withColumn("posterior", uplift_posterior("current", "baseline"))
    stage = (
        F.when(F.col("current") < floor, "floor").when(F.col("current") >= F.col("ceiling"), "ceiling").when(F.col("_core"), "vocabulary")
        .when(~well_formed(F.col("entity"))["ok"], "malformed").when(F.col("baseline") == 0, "no_baseline").when(F.col("posterior") < least, "low_posterior").otherwise("candidate")
    )
    return w.withColumn("stage", stage).withColumn("uplift", F.col("current") / F.greatest("baseline", F.lit(1))).drop("_core")


def long_tail(windows: DataFrame, vocab: DataFrame, verdicts: DataFrame | None = None, **params) -> DataFrame:
    """The candidates; verdicts (entity, keep) drop those not kept, missing ones keep."""
    c = long_tail_stages(windows, vocab, **params).where("stage = 'candidate'")
    return c if verdicts is None else c.join(verdicts.where("not keep"), "entity", "left_anti")


def stage_counts(stages: DataFrame) -> DataFrame:
    return stages.groupBy("tenant", "stage").agg(F.count("*").alias("n"))


def sort_long_tail(df: DataFrame, key: str = "posterior", descending: bool = True, **facets) -> DataFrame:
    """by posterior, uplift, current or total, nulls last, after facet filters."""
    for col, value in facets.items():
        df = df.where(F.col(col) == value)
    return df.orderBy(F.desc_nulls_last(key) if descending else F.asc_nulls_last(key), "entity")
