"""Operators whose work must grow with their input and no faster."""

import datetime
import random
import re
import time

from pyspark.sql import functions as F

from signalmill.operators import buckets, ingest, seeds
from signalmill.plans import queries_states as states
from signalmill.sources import fixtures


def test_trigrams_of_a_long_text(spark):
    """600,000 characters took minutes while each trigram was a substring of the text."""
    began = time.time()
    profiles = spark.createDataFrame([("a", "xyz", 0.5), ("b", "\U0001f600é ", 0.25), ("b", "zz ", 1.0)], "language string, gram string, weight double")
    docs = spark.createDataFrame([(1, "XYZ " * 150_000), (2, "\U0001f600É " * 200_000), (3, "xyz xyz")], "signal_id long, text string")
    assert {tuple(r) for r in ingest.detect_language(docs, profiles).collect()} == {(1, "a"), (2, "b")}
    counts = ingest.gram_counts(docs.where("signal_id = 1"), "signal_id").groupBy("gram").agg(F.sum("c"))
    assert {tuple(r) for r in counts.collect()} == {("xyz", 150_000), ("yz ", 150_000), ("z x", 149_999), (" xy", 149_999)}
    assert time.time() - began < 30


def test_attribute_runs_is_the_largest_overlap(spark):
    rng = random.Random(4)
    some = lambda n: [(k, [rng.choice((" A", "b", "C ", "d", "e", "f")) for _ in range(rng.randrange(5))]) for k in range(n)]
    runs, queries = some(150) + [(900, None), (901, [None, "a"])], some(40)[3:] + [(2, ["zz"])]
    clean = lambda ts: {t.strip().lower() for t in ts or [] if t}
    want = {}
    for k, ts in runs:
        n = [(-len(clean(ts) & clean(qs)), q) for q, qs in queries if clean(ts) & clean(qs)]
        want[k] = min(n)[1] if n else None
    got = seeds.attribute_runs(spark.createDataFrame(runs, "run_id long, terms array<string>"), spark.createDataFrame(queries, "query_id long, keywords array<string>"))
    rows = got.collect()
    assert len(rows) == len(runs) and {r["run_id"]: r["query_id"] for r in rows} == want


def test_a_term_of_all_runs_and_queries(spark):
    """F2: 40,000 runs and queries that share a term were 1.6e9 pairs."""
    began = time.time()
    of = lambda key, col: spark.range(40_000).select(F.col("id").alias(key), F.array(F.lit("all"), F.concat(F.lit("t"), (F.col("id") + int(key == "run_id")).cast("string"))).alias(col))
    got = seeds.attribute_runs(of("run_id", "terms"), of("query_id", "keywords"))
    assert got.where("query_id = run_id + 1").count() == 39_999
    assert got.where("run_id = 39999").first()["query_id"] == 0
    assert time.time() - began < 40


def test_links_are_dealt_by_their_rows(spark, monkeypatch):
    """Tasks of a join kept the session's number, so what one sorted grew with the tables."""
    d = "/root/testdata/sf0.001"
    want = fixtures.signal_links(spark, d, "p_name")
    monkeypatch.setattr(fixtures, "TASK_ROWS", 500)
    monkeypatch.setattr(fixtures, "SMALL_SIDE", 10)
    got = fixtures.signal_links(spark, d, "p_name")
    lines = fixtures.table(spark, d, "lineitem").count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    for key in ("l_orderkey", "l_partkey"):
        assert re.search(rf"hashpartitioning\({key}#\d+L, {lines // 500 + 1}\), REPARTITION_BY_NUM", plan)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_yields_are_dealt_before_they_are_counted(spark):
    """two distinct counts doubled the links, and as many tasks as the session has took them, so what one held grew with the tables."""
    queries = spark.createDataFrame([(q, "old", ["a", "b"]) for q in range(6)], "query_id long, cohort string, keywords array<string>")
    runs = spark.createDataFrame([(r % 4, r) for r in range(40)] + [(1, 8), (1, 8), (None, 9)], "query_id long, run_id long")
    signals = spark.createDataFrame([(r, r // 2) for r in range(36)] + [(3, 99)], "run_id long, signal_id long")
    links = spark.createDataFrame([(s, e if e != "e3" else None) for s in range(1, 20) for e in ("e1", f"e{s % 5}", f"e{s % 5}")], "signal_id long, entity string")
    s = runs.join(signals, "run_id").join(links, "signal_id", "left").groupBy("query_id").agg(F.count_distinct("signal_id").alias("signals"), F.count_distinct("entity").alias("entities"))
    want = queries.join(s, "query_id", "left").na.fill(0).select("query_id", "cohort", "signals", "entities", (F.col("entities") / 2).alias("per_keyword"))
    for tasks in (None, 9):
        got = seeds.seed_yield(queries, runs, signals, links, *([tasks] if tasks else []))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan and ("REPARTITION_BY_NUM" in plan) == bool(tasks)
    assert re.search(r"hashpartitioning\(query_id#\d+L, entity#\d+, 9\), REPARTITION_BY_NUM", plan)


def test_day_buckets_keep_no_histogram_by_author(spark):
    """the distinct count of authors made Spark keep, store and merge a histogram for every author of a bucket; links are dealt into as many tasks as asked for."""
    d = "/root/testdata/sf0.001"
    links = fixtures.signal_links(spark, d).withColumn("author", F.when(F.col("signal_id") % 7 == 0, None).when(F.col("signal_id") % 5 == 0, "").otherwise((F.col("signal_id") % 3).cast("string")))
    links = links.withColumn("posted_on", F.trunc("posted_on", "year"))  # buckets of several links
    got = buckets.day_buckets(links, tasks=9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_percentile") == 1 and "merge_percentile" not in plan and re.search(r"author#\d+, 9\), REPARTITION_BY_NUM", plan)
    key = ["entity", "platform", "geography", F.col("posted_on").alias("bucket_date")]
    named, positive = F.when(F.col("author") != "", F.col("author")), F.when(F.col("engagement") > 0, F.col("engagement"))
    want = links.groupBy(*key).agg(F.count("*").alias("mentions"), F.countDistinct(named).alias("unique_authors"), F.round(F.sum(positive), 4).alias("s"), F.median(positive).alias("m"))
    got = got.select(*buckets.KEY, "mentions", "unique_authors", F.round("engagement_sum", 4).alias("s"), F.col("engagement_median").alias("m"))
    assert got.where("unique_authors > 1").count() > 0
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_studies_read_stored_days(spark, monkeypatch):
    """each reader of the buckets joined and counted all links again."""
    d, seen = "/root/testdata/sf0.001", []
    for f in ("predictor_study", "variant_sweep"):
        monkeypatch.setattr(states.Y, f, lambda df: seen.append(df) or df.select(*[F.lit(0.0).alias(c) for c in ("u", "z", "p", "pass_rate", "edge")]))
    states.k5(spark, d), states.k6(spark, d)
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "l_orderkey" not in plan and "percentile" not in plan and "bucket_date" in plan


def test_refresh_reads_landed_links(spark, monkeypatch):
    """Every step of both batches joined all lines and orders again."""
    seen, stream = [], states.jobs.stream_refresh
    monkeypatch.setattr(states, "tasks_of", lambda spark, rows: 7)
    monkeypatch.setattr(states.jobs, "stream_refresh", lambda runs, links, *more: seen.append((links, more)) or stream(runs, links, *more))
    states.refreshed(spark, "/root/testdata/sf0.001")
    assert len(seen) == 2
    for links, more in seen:
        plan = links(spark)._jdf.queryExecution().executedPlan().toString()
        assert "l_orderkey" not in plan and "Join" not in plan and more[-1] == 7


def test_attribute_days_are_dealt_before_they_are_counted(spark):
    """rows of a bucket and author went to as many tasks as the session has, so what one held grew with the tables."""
    day = lambda k: datetime.date(2001, 7, 1) + datetime.timedelta(k % 3)
    attributed = spark.createDataFrame([(k, f"c{k % 2}", a) for k in range(60) for a in {"x", f"y{k % 4}"}] + [(7, None, None)], "signal_id long, category string, attribute string")
    signals = spark.createDataFrame([(k, day(k), f"u{k % 5}" if k % 7 else None) for k in range(50)] + [(55, datetime.date(1999, 1, 1), "u1")], "signal_id long, posted_on date, author string")
    want, got = (buckets.attribute_buckets(attributed, signals, datetime.date(2001, 8, 1), tasks=n) for n in (None, 9))
    assert got.columns == ["category", "attribute", "bucket_date", "mentions", "unique_authors"]
    assert got.where("unique_authors > 1").count() > 0
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(category#\d+, attribute#\d+, bucket_date#\d+, author#\d+, 9\), REPARTITION_BY_NUM", plan)
