"""Ordinals and prefix sums against plain Python, with ties, nulls and a value that a third of all rows share."""

import random

import pytest
from pyspark.sql import functions as F

from signalmill.operators.ordinal import with_ordinals, with_prefix_sums
from signalmill.operators.studies import avg_rank, mann_whitney, systematic_sample

KIND = "id long, value long, w long"


def data(n=500, seed=3):
    rng = random.Random(seed)
    return [(i, None if i % 17 == 0 else 7 if i % 3 == 0 else rng.randint(0, 40), None if i % 29 == 0 else rng.randint(0, 9)) for i in range(n)]


@pytest.mark.parametrize("n", [0, 1, 500])
def test_places_and_sums(spark, n):
    df = spark.createDataFrame(data(n), KIND).repartition(5)
    key = lambda r: (r[1] is not None, r[1] or 0, r[0])
    want = sorted(data(n), key=key)
    got = with_ordinals(df, ["value", "id"], "at", "all").collect()
    assert sorted((r["at"], r["id"], r["all"]) for r in got) == [(i, r[0], n) for i, r in enumerate(want)]
    got = {r["id"]: r["s"] for r in with_prefix_sums(df, ["value", "id"], {"s": "w"}).collect()}
    total = 0
    for r in want:
        assert got[r[0]] == total
        total += r[2] or 0


def test_no_window_over_all_rows(spark):
    df = spark.createDataFrame(data(), KIND)
    plan = systematic_sample(df.withColumnRenamed("value", "volume").withColumnRenamed("id", "entity"), 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange SinglePartition") == 1  # of the heads of partitions alone
    assert "HashAggregate" in plan


def test_average_ranks_by_group(spark):
    rows = [(i, i % 3, (i * 7) % 5) for i in range(60)]
    got = avg_rank(spark.createDataFrame(rows, "id long, g long, value long"), "value", ["g"]).collect()
    for r in got:
        mine = sorted(x[2] for x in rows if x[1] == r["g"])
        at = [i + 1 for i, v in enumerate(mine) if v == r["value"]]
        assert r["rank"] == sum(at) / len(at)


def test_rank_sums_are_those_of_all_pairs(spark):
    rows = [(g, i % 2, (i * 13 + g) % 11) for g in range(4) for i in range(40)]
    got = mann_whitney(spark.createDataFrame(rows, "seg long, grp int, value long"), by=["seg"]).collect()
    assert len(got) == 4
    for r in got:
        a, b = ([v for g, k, v in rows if g == r["seg"] and k == side] for side in (0, 1))
        assert r["u"] == sum((x > y) + 0.5 * (x == y) for x in a for y in b)


def test_systematic_sample_takes_every_step(spark):
    df = spark.range(103).select(F.col("id").alias("entity"), (F.col("id") * 31 % 103).alias("volume"))
    got = sorted(r["volume"] for r in systematic_sample(df, 10).collect())
    assert got == list(range(0, 100, 10))
