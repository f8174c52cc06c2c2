"""Confirmation gate: source breadth, surge significance, verdicts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.measures import seeded_key

BITS, AUTHORS, ALPHA, PERMUTATIONS = 1.0, 10, 0.05, 1000


def source_breadth(buckets: DataFrame, least_bits: float = BITS, least_authors: int = AUTHORS) -> DataFrame:
    """Shannon entropy of authors over platforms; authors are summed over days."""
    a = buckets.groupBy("entity", "platform").agg(F.sum(F.greatest("unique_authors", F.lit(0))).alias("a"))
    a = a.withColumn("t", F.sum("a").over(Window.partitionBy("entity")))
    p = F.col("a") / F.col("t")
    e = a.groupBy("entity").agg(F.coalesce(F.sum(F.when(F.col("a") > 0, -p * F.log2(p))), F.lit(0.0)).alias("entropy_bits"), F.max("t").alias("total_authors"))
    return e.withColumn("breadth_pass", (F.col("total_authors") > 0) & (F.round("entropy_bits", 9) >= least_bits) & (F.col("total_authors") >= least_authors))


def surge_stat(series: DataFrame) -> DataFrame:
    """Sum of the last 7 days less the mean of all sums of 7 days; entities of fewer than 7 days have none."""
    w = Window.partitionBy("entity").orderBy("bucket_date").rowsBetween(-6, 0)
    s = series.withColumn("s", F.sum("mentions").over(w)).withColumn("c", F.count("*").over(w)).where("c = 7")
    return s.groupBy("entity").agg((F.max_by("s", "bucket_date") - F.avg("s")).alias("surge"))


def _surge(a: np.ndarray) -> np.ndarray:
    """Statistic of the rows of a."""
    c = np.cumsum(np.pad(a, ((0, 0), (1, 0))), 1)
    sums = c[:, 7:] - c[:, :-7]
    return sums[:, -1] - sums.mean(1)


#: Fixed values of the shuffle: a prime p with p % 3 = 2, so that x -> x^3 is a bijection modulo p, steps of replicates and places, and what each round adds.
PRIME, STEPS, ADDED = 2147483579, (1000003, 69069), (12345, 67890, 424242)


def shuffle_keys(entity: str, replicates: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Sort keys of the places (from 1) in each replicate: integers that any engine computes, no generator to replay."""
    seed = int(hashlib.md5(entity.encode()).hexdigest()[:8], 16)
    x = (seed + replicates[:, None] * STEPS[0] + places[None, :] * STEPS[1]) % PRIME
    for r in ADDED:
        x = (x * x % PRIME * x % PRIME + r) % PRIME
    return x


def permutation_test(series: DataFrame, permutations: int = PERMUTATIONS, alpha: float = ALPHA) -> DataFrame:
    """Share of shuffles of an entity's own days whose surge reaches the observed one; under 14 days p is 1.

    A series is bounded by the days of E10 and becomes one array, so a task works through
    many entities a batch. Days are ordered by shuffle_keys, equal keys by place.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for entity, x in zip(batch["entity"], batch["x"]):
                x, p, seen = np.asarray(x, np.float64), 1.0, 0.0
                if len(x) >= 14:
                    seen = float(_surge(x[None])[0])
                    order = np.argsort(shuffle_keys(str(entity), np.arange(1, permutations + 1), np.arange(1, len(x) + 1)), axis=1, kind="stable")
                    p = float(((_surge(x[order]) >= seen - 1e-9).sum() + 1) / (permutations + 1))
                out.append((entity, seen, p, p <= alpha))
            yield pd.DataFrame(out, columns=["entity", "surge", "p_value", "significance_pass"])

    kind = series.schema["entity"].dataType.simpleString()
    days = F.array_sort(F.collect_list(F.struct("bucket_date", F.col("mentions").cast("double").alias("m"))))
    packed = series.groupBy("entity").agg(F.transform(days, lambda d: d["m"]).alias("x"))
    return packed.mapInPandas(each, f"entity {kind}, surge double, p_value double, significance_pass boolean")


def permutation_test_sql(series: DataFrame, permutations: int = 20, alpha: float = ALPHA) -> DataFrame:
    """E12 in columns for few permutations: days are ordered by a hash of entity, replicate and day."""
    w = Window.partitionBy("entity").orderBy("bucket_date")
    s = series.withColumn("i", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("entity")))
    long = s.where("n >= 14")
    r = long.select("entity", "mentions", "i", F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("k"))
    # Replicate 0 keeps the order of days.
    r = r.withColumn("key", F.when(F.col("k") == 0, F.lpad(F.col("i").cast("string"), 6, "0")).otherwise(seeded_key(F.col("entity"), F.col("k"), F.col("i"))))
    f = Window.partitionBy("entity", "k").orderBy("key", "i")
    r = r.withColumn("s", F.sum("mentions").over(f.rowsBetween(-6, 0))).withColumn("at", F.row_number().over(f)).where("at >= 7")
    r = r.groupBy("entity", "k").agg((F.max_by("s", "at") - F.avg("s")).alias("surge"))
    seen = r.where("k = 0").select("entity", F.col("surge").alias("seen"))
    p = r.where("k > 0").join(seen, "entity").groupBy("entity").agg(((F.count_if(F.col("surge") >= F.col("seen") - 1e-9) + 1) / (permutations + 1)).alias("p"), F.max("seen").alias("surge"))
    out = s.select("entity").distinct().join(p, "entity", "left")
    p_value = F.coalesce("p", F.lit(1.0))
    return out.select("entity", F.coalesce("surge", F.lit(0.0)).alias("surge"), p_value.alias("p_value"), (p_value <= alpha).alias("significance_pass"))


def gate_verdict(df: DataFrame, enabled: bool = True, require_significance: bool = True) -> DataFrame:
    """Decision and reasons from significance_pass and breadth_pass."""
    if not enabled:
        return df.withColumn("decision", F.lit("pass")).withColumn("reasons", F.array(F.lit("gate disabled")))
    sig = F.coalesce("significance_pass", F.lit(False))
    broad = F.coalesce("breadth_pass", F.lit(False))
    ok = (sig | F.lit(not require_significance)) & broad
    said = F.concat(F.when(sig, "significant").otherwise("within own noise"), F.lit("" if require_significance else " (not required)"))
    return df.withColumn("decision", F.when(ok, "pass").otherwise("hold")).withColumn("reasons", F.array(said, F.when(broad, "broad").otherwise("concentrated")))


def gate(buckets: DataFrame, permutations: int = PERMUTATIONS, max_days: int = 180, least_bits: float = BITS, least_authors: int = AUTHORS, test=permutation_test, **rules) -> DataFrame:
    """E9 to E13 on buckets; `test` is either form of E12."""
    from signalmill.operators.buckets import daily_series

    tested = test(daily_series(buckets, max_days), permutations)
    return gate_verdict(tested.join(source_breadth(buckets, least_bits, least_authors), "entity", "left"), **rules)


def gate_cases(cases: DataFrame, permutations: int = PERMUTATIONS, least_bits: float = BITS, least_authors: int = AUTHORS, test=permutation_test) -> DataFrame:
    """Labelled cases (name, expected, daily array, sources array of struct(platform, unique_authors)) against their decisions."""
    series = cases.select(F.col("name").alias("entity"), F.posexplode("daily").alias("i", "mentions"))
    series = series.select("entity", F.date_add(F.lit("2000-01-01").cast("date"), F.col("i")).alias("bucket_date"), "mentions")
    sources = cases.select(F.col("name").alias("entity"), F.inline("sources"))
    v = gate_verdict(test(series, permutations).join(source_breadth(sources, least_bits, least_authors), "entity", "left"))
    return cases.select(F.col("name").alias("entity"), "expected").join(v, "entity").select("entity", "expected", "decision", (F.col("expected") == F.col("decision")).alias("match"))
