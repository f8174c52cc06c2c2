"""Known answers and properties of operators on small rows."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from signalmill.functions import text as T
from signalmill.operators import buckets, gate, growth, longtail, states, studies
from signalmill.sources import items, sinks


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(f(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize("label,want", [("Gummies", "gummy"), ("citrus", "citrus"), ("glass", "glass"), ("boxes", "box"), ("mocktails", "mocktail"), ("brussels", "brussels"),
                                        ("  Athletic  Brewing Co. ", "athletic brewing"), ("gummy bears", "gummy bears"), ("co inc", "co"), ("", "")])
def test_canonical_label(spark, label, want):
    assert one(spark, T.canonical_label, label) == want


@pytest.mark.parametrize("label,ok", [("vegan", False), ("brunch", False), ("", False), ("vegan cheese", True), ("kefir", True)])
def test_well_formed(spark, label, ok):
    assert one(spark, T.well_formed, label)["ok"] is ok


def series(spark, values, entity="e"):
    day = datetime.date(2024, 1, 1)
    return spark.createDataFrame([(entity, day + datetime.timedelta(days=i), v) for i, v in enumerate(values)], "entity string, bucket_date date, mentions long")


def test_surge_and_significance(spark):
    flat, surge = [5] * 30, [1] * 23 + [50] * 7
    s = series(spark, flat, "flat").union(series(spark, surge, "surge")).union(series(spark, [1] * 10, "short"))
    p = {r["entity"]: r for r in gate.permutation_test(s, 200).collect()}
    assert p["flat"]["p_value"] == 1.0 and p["short"]["p_value"] == 1.0 and p["surge"]["p_value"] < 0.02
    assert all(0 < r["p_value"] <= 1 for r in p.values())


def test_greedy_weeks(spark):
    d = datetime.date(2024, 1, 1)
    rows = [("e", "g", d + datetime.timedelta(days=k), 1) for k in (0, 3, 8, 9, 16)]
    b = spark.createDataFrame(rows, "entity string, geography string, bucket_date date, mentions long")
    assert growth.week_buckets(b, d + datetime.timedelta(days=20)).first()["weeks"] == [2, 2, 1]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(scale=st.integers(2, 9))
def test_share_of_voice_ignores_platform_volume(spark, scale):
    cols = "tenant int, entity string, platform string, recent_n long, prior_n long, recent_total long, prior_total long"
    rows = [(1, "a", "x", 10, 5, 100, 100), (1, "a", "y", 8, 8, 50, 50)]
    more = [(1, "a", "x", 10 * scale, 5, 100 * scale, 100), (1, "a", "y", 8, 8, 50, 50)]
    got = [growth.sov_of_windows(spark.createDataFrame(r, cols)).first()["sov_growth"] for r in (rows, more)]
    assert got[0] == pytest.approx(got[1]) == pytest.approx(0.5)


def test_posterior_identity(spark):
    df = spark.createDataFrame([(0, 0), (5, 1), (30, 10), (1, 20)], "c long, b long")
    for r in df.select("c", "b", longtail.uplift_posterior("c", "b").alias("p"), longtail.posterior_column(F.col("c"), F.col("b")).alias("q")).collect():
        assert r["p"] == pytest.approx(r["q"], abs=1e-9)
        assert 0 <= r["p"] <= 1


def test_mann_whitney_known(spark):
    df = spark.createDataFrame([(float(v), 0) for v in (1, 2, 3, 4, 5)] + [(float(v), 1) for v in (6, 7, 8, 9, 10)], "value double, grp int")
    r = studies.mann_whitney(df).first()
    assert r["u"] == 0 and r["p"] == pytest.approx(0.00902, abs=1e-4)
    same = spark.createDataFrame([(1.0, 0), (1.0, 1)], "value double, grp int")
    assert studies.mann_whitney(same).first()["p"] == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("args,want", [(("candidate", 0, 0, 0.0, 0.0), "dormant"), (("dormant", 5, 9, 0.5, 0.0), "resurgent"), (("emerging", 2, 20, -0.5, -0.5), "declining"),
                                       (("declining", 5, 20, 0.1, 0.9), "sustained"), (("sustained", 5, 20, 0.0, 0.2), "peaking"), (("sustained", 5, 20, -0.44, 1.25), "peaking")])
def test_next_state(spark, args, want):
    assert one(spark, lambda *c: states.next_state(*c)["state"], *args) == want


def test_sinks_are_idempotent(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    assert sinks.append_new(t, t, ["k"]).count() == 0
    once = sinks.upsert_latest(t, t, ["k"], "v")
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 2)]


def test_bucket_totals_are_link_rows(spark):
    day = datetime.date(2024, 1, 1)
    k = spark.createDataFrame([(1, "e", "x", "g", day, "u", 2.0), (1, "e", "x", "g", day, "u", -1.0), (2, "e", "y", "g", day, None, None)],
                              "signal_id long, entity string, platform string, geography string, posted_on date, author string, engagement double")
    b = buckets.day_buckets(k)
    assert b.agg(F.sum("mentions")).first()[0] == 3
    assert buckets.day_buckets(k, True).agg(F.sum("mentions")).first()[0] == 2
    assert {(r["platform"], r["unique_authors"], r["engagement_sum"]) for r in b.collect()} == {("x", 1, 2.0), ("y", 0, 0.0)}


def test_broken_items_are_dropped(spark):
    df = spark.createDataFrame([("x", '{"id": "1", "text": "hi"}'), ("x", "[1]"), ("x", "nonsense"), ("x", "{}")], "platform string, raw string")
    it = items.parse_items(df)
    assert items.item_stats(it).first()["dropped"] == 2
    assert [r["source_id"] for r in items.normalize(it).collect()] == ["1"]


@pytest.mark.parametrize("f", ["day_buckets", "daily_series", "deltas", "volumes"])
def test_empty(spark, f):
    k = spark.createDataFrame([], "signal_id long, entity string, platform string, geography string, posted_on date, author string, engagement double")
    b = buckets.day_buckets(k)
    out = {"day_buckets": lambda: b, "daily_series": lambda: buckets.daily_series(b), "deltas": lambda: growth.deltas(b, datetime.date(2024, 1, 1)), "volumes": lambda: growth.volumes(b, datetime.date(2024, 1, 1))}[f]()
    assert out.count() == 0


def test_terms_are_normalised_to_their_end(spark, tmp_path):
    from signalmill.plans import catalog

    catalog.load()
    said = ["#" + "Ab " * 100 + "\u00c9T\u00c9", " x" * 150 + " Z ", "short \u00d1", None]
    spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["term"] for r in catalog.QUERIES["b17_normalize_term"](spark, str(tmp_path)).collect()}
    assert got == {0: "ab " * 100 + "ete", 1: "x" + " x" * 149 + " z", 2: "short n", 3: None}


def test_attributes_and_items_are_of_whole_documents(spark, tmp_path):
    from signalmill.plans import catalog, queries_states

    catalog.load()
    said = [(1, "en", "a " * 60 + "marigold tiny"), (2, "en", "Marigold"), (3, "de", "marigold? nein"), (7, "de", "keine")]
    spark.createDataFrame(said, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalog.QUERIES["d22_tag_attributes"](spark, str(tmp_path)).select("signal_id", "category", "attribute").collect()}
    assert got == {(1, "en", "marigold"), (2, "en", "marigold"), (3, "de", "marigold"), (7, "de", None)}
    events = [(1, 5, 2.0, datetime.datetime(2024, 1, 1)), (3, 5, 2.0, datetime.datetime(2024, 1, 1))]
    spark.createDataFrame(events, "event_id long, user_id long, value double, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    raw = [r["raw"] for r in queries_states.landed(spark, str(tmp_path)).select("raw").collect()]
    assert any(said[0][2] in x for x in raw)


def test_uplift_posterior_is_the_binomial_tail():
    from math import comb

    import numpy as np

    from signalmill.operators.longtail import _upper_beta

    pairs = [(0, 0), (1, 0), (0, 5), (7, 3), (40, 41), (200, 90), (90, 200)]
    got = _upper_beta(np.array([c for c, _ in pairs]), np.array([b for _, b in pairs]))
    for p, (c, b) in zip(got, pairs):
        n = c + b + 1
        assert abs(p - sum(comb(n, k) * 2**k for k in range(c + 1)) / 3**n) < 1e-9


def test_controls_far_away_and_many_platforms(spark):
    from signalmill.operators.runlog import run_rollups
    from signalmill.operators.studies import match_controls

    cases = spark.createDataFrame([(1, 100), (2, 7)], "entity long, volume long")
    pool = spark.createDataFrame([(10, 130), (11, 7)], "entity long, volume long")
    assert {tuple(r) for r in match_controls(cases, pool).collect()} == {(1, 100, 10, 130), (2, 7, 11, 7)}
    assert match_controls(cases.where("false"), pool).count() == 0
    runs = spark.createDataFrame([(1, f"p{i}", "x", 1, None) for i in range(130)], "query_id long, platform string, status string, batch_id long, started_on date")
    assert len(run_rollups(runs)["query"].columns) == 131 and run_rollups(runs)["query_rows"].count() == 130


def test_benchmark_names_inside_words(spark):
    from signalmill.operators.studies import match_benchmark

    e = spark.createDataFrame([("rod",), ("spring settle",), ("plate",)], "entity string")
    b = spark.createDataFrame([("ring set",), ("small rod deluxe",), ("plate",), ("no match",), ("x",)], "name string")
    got = {r["name"]: r["entity"] for r in match_benchmark(b, e).collect()}
    assert got == {"ring set": "spring settle", "small rod deluxe": "rod", "plate": "plate", "no match": None, "x": None}


def test_plain_rules_are_the_column_rules(spark):
    from pyspark.sql import functions as F

    from signalmill.operators.states import next_state, next_state_of

    cases = [(s, v7, v30, w, m) for s in ("candidate", "declining", "dormant", "peaking") for v7 in (0, 4) for v30 in (0, 4, 6, 20) for w in (-0.5, 0.05, 0.2, 0.6) for m in (-0.5, 0.1, 0.6)]
    df = spark.createDataFrame(cases, "s string, v7 long, v30 long, w double, m double")
    for r in df.withColumn("n", next_state(*(F.col(c) for c in df.columns))["state"]).collect():
        assert r["n"] == next_state_of(*r[:5])


def test_states_carried_between_batches(spark, tmp_path):
    import datetime

    from signalmill.streaming.jobs import read_stream, stream_states

    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    rows = [("a", day(n), 2 + n % 5) for n in range(0, 40, 2)] + [("b", day(3), 1)]
    kind = "entity string, bucket_date date, mentions long"

    def run(name, parts, delay="60 days"):
        for part in parts:
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
            s = stream_states(read_stream(spark, f"{tmp_path}/{name}", kind), delay)
            s.writeStream.format("parquet").option("path", f"{tmp_path}/{name}-out").option("checkpointLocation", f"{tmp_path}/{name}-ck").trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"{tmp_path}/{name}-out").collect()))

    whole = run("whole", [rows])
    assert run("split", [rows[:9], rows[9:]]) == whole and sum(r[3] for r in whole) == len(rows)
    late = run("late", [rows, [("a", day(1), 5)]])
    assert late == whole  # a late day gives no state of its own

    # Silence: `a` turns dormant on the first day without 3 mentions in 30 days, comes back, falls silent for good; `tick` moves the watermark on.
    tick = lambda *days: [("tick", day(n), 5) for n in days]
    burst = [("a", day(n), 2) for n in (0, 1)]
    parts = [burst + tick(*range(0, 10)), tick(*range(10, 40)), [("a", day(41), 9), *tick(40, 41)], tick(*range(42, 150)), [("a", day(151), 1), *tick(150, 151)]]
    got = [r for r in run("silent", parts, "1 day") if r[0] == "a"]
    assert [r[1:] for r in got] == [
        (day(0), "candidate", True), (day(1), "emerging", True), (day(31), "dormant", False), (day(41), "resurgent", True), (day(42), "sustained", False), (day(72), "dormant", False), (day(151), "candidate", True)
    ]
    assert [r for r in run("once", [sum(parts, [])], "1 day") if r[0] == "a"] == got


def test_states_of_silent_keys_are_let_go(spark, tmp_path):
    import datetime

    from signalmill.streaming.jobs import read_stream, stream_states

    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
    kind, kept = "entity string, bucket_date date, mentions long", []
    for part in ([(f"e{i}", day(0), 4) for i in range(20)], [("tick", day(n), 1) for n in range(80)], [("tick", day(95), 1)], [("tick", day(96), 1)]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        s = stream_states(read_stream(spark, f"{tmp_path}/in", kind)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
        s.trigger(availableNow=True).start().awaitTermination()
        kept.append(spark.read.format("statestore").load(f"{tmp_path}/ck").count())
    assert kept[1] == 21 and kept[-1] == 1
    assert spark.read.parquet(f"{tmp_path}/out").where("state = 'dormant' and entity like 'e%'").count() == 20


def test_counted_shuffles_are_fair_and_replayable(spark):
    """Keys order places like random permutations do, and p agrees with a generator's shuffles."""
    import datetime

    import numpy as np

    from signalmill.operators.gate import PRIME, _surge, permutation_test, shuffle_keys

    n, times = 20, 4000
    keys = shuffle_keys("NATION_1/x", np.arange(1, times + 1), np.arange(1, n + 1))
    assert keys.min() >= 0 and keys.max() < PRIME
    places = np.argsort(keys, 1, kind="stable")
    seen = np.stack([np.bincount(places[:, j], minlength=n) for j in range(n)])
    assert abs((seen - times / n) ** 2 / (times / n)).sum() < 1.25 * n * n  # chi-square of every place against every day
    assert abs(np.corrcoef(places[:-1, 0], places[1:, 0])[0, 1]) < 0.06  # replicates follow each other without a trend

    rng = np.random.default_rng(3)
    series = {e: rng.poisson(3, 60) + np.where(np.arange(60) >= 53, lift, 0) for e, lift in (("flat", 0), ("some", 1), ("rise", 9))} | {"short": np.ones(13)}
    rows = [(e, datetime.date(2024, 1, 1) + datetime.timedelta(days=i), int(v)) for e, x in series.items() for i, v in enumerate(x)]
    got = {r["entity"]: r for r in permutation_test(spark.createDataFrame(rows, "entity string, bucket_date date, mentions long")).collect()}
    assert got["short"]["p_value"] == 1.0 and got["rise"]["significance_pass"]
    for e in ("flat", "some", "rise"):
        x = series[e].astype(float)
        p = (_surge(rng.permuted(np.tile(x, (20000, 1)), axis=1)) >= _surge(x[None])[0] - 1e-9).mean()
        assert abs(got[e]["p_value"] - p) < 0.05


def test_terms_of_any_length_tag(spark):
    import random
    import re

    from signalmill.operators.ingest import tag_entities

    rng = random.Random(6)
    words = ["extra", "virgin", "olive", "oil", "a", "Öl", "of"]
    terms = [("extra virgin olive oil", "evoo"), ("olive oil", "oil"), ("Oil", "oil"), ("of a of a of a", "loop"), ("of a", "pair"), ("öl-extra", "dash"), ("", "none"), (None, "none"), ("virgin olive", "vo")]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(99, None), (100, "Extra, virgin; OLIVE oil!"), (101, "of a of a of a of a")]
    got = {tuple(r) for r in tag_entities(spark.createDataFrame(texts, "signal_id long, text string"), spark.createDataFrame(terms, "term string, entity string"), most=3).collect()}
    cut = lambda t: [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]
    want = set()
    for i, text in texts:
        w, first = cut(text), {}
        for t, e in terms:
            k = cut(t)
            at = [j for j in range(len(w) - len(k) + 1) if k and w[j : j + len(k)] == k]
            if at:
                first[e] = min(at[0], first.get(e, at[0]))
        want |= {(i, e, n + 1) for n, (_, e) in enumerate(sorted((p, e) for e, p in first.items())[:3])}
    assert got == want and (100, "evoo", 1) in got


def test_labelled_gate_cases(spark):
    """The three labelled cases: one author's spike holds, a broad rise passes, flat noise holds."""
    from signalmill.operators.gate import gate_cases

    flat, spike = [4 + i % 2 for i in range(60)], [2] * 53 + [40] * 7
    cases = [
        ("single-author-spike", "hold", spike, [("tiktok", 1, 40)]), ("broad-organic-rise", "pass", spike, [("tiktok", 9, 30), ("youtube", 7, 22), ("googletrends", 5, 10)]),
        ("flat-noise", "hold", flat, [("tiktok", 6, 20), ("youtube", 5, 18)]),
    ]
    df = spark.createDataFrame(cases, "name string, expected string, daily array<long>, sources array<struct<platform:string,unique_authors:long,mentions:long>>")
    got = {r["entity"]: r for r in gate_cases(df).collect()}
    assert len(got) == 3 and all(r["match"] for r in got.values())


def test_controls_have_the_least_sum_of_differences(spark):
    """Against the best assignment, by a table over both sides in order, on random tables with ties, either side larger, and nulls."""
    import random

    from signalmill.operators.studies import match_controls

    def best(small, large):
        cost = [0] * (len(large) + 1)
        for v in small:
            new = [float("inf")]
            for j, w in enumerate(large):
                new.append(min(new[-1], cost[j] + abs(v - w)))
            cost = new
        return cost[-1]

    rng = random.Random(5)
    for n, m, top in ((9, 14, 30), (14, 6, 12), (20, 20, 400)):
        a, b = ([rng.randrange(top) for _ in range(k)] for k in (n, m))
        cases = spark.createDataFrame([*enumerate(a), (900, None)], "entity long, volume long")
        pool = spark.createDataFrame([(1000 + i, v) for i, v in enumerate(b)], "entity long, volume long")
        got = match_controls(cases, pool).collect()
        assert len(got) == len({r["entity"] for r in got}) == len({r["control"] for r in got}) == min(n, m)
        assert all(a[r["entity"]] == r["volume"] and b[r["control"] - 1000] == r["control_volume"] for r in got)
        small, large = sorted((sorted(a), sorted(b)), key=len)
        assert sum(abs(r["volume"] - r["control_volume"]) for r in got) == best(small, large)


def test_ranked_attributes_read_their_windows_only(spark, tmp_path):
    import datetime

    from signalmill.operators.growth import rank_attributes

    day = datetime.date(2024, 5, 31)
    rows = [("c", "a", day - datetime.timedelta(days=i), 1) for i in (0, 29, 30, 59, 60, 400)] + [("c", "old", day - datetime.timedelta(days=70), 5)]
    spark.createDataFrame(rows, "category string, attribute string, bucket_date date, mentions long").write.partitionBy("bucket_date").parquet(f"{tmp_path}/b")
    got = rank_attributes(spark.read.parquet(f"{tmp_path}/b"), 30, day)
    assert [tuple(r)[:4] for r in got.collect()] == [("c", "a", 2, 2)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket_date" in plan and "bucket_date#" in plan.split("PartitionFilters: ")[1].split("]")[0] and ">=" in plan


def test_authors_meet_before_a_bucket_is_counted(spark):
    """The plan of day_buckets deals by bucket and author first, so that no task takes all links of a busy bucket, and merges histograms after."""
    import re

    from signalmill.operators.buckets import day_buckets

    links = spark.createDataFrame([("e", "p", "g", None, 1, "a", 2.0)], "entity string, platform string, geography string, posted_on date, signal_id long, author string, engagement double")
    plan = day_buckets(links)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)
    assert len(dealt) == 2  # the last exchange is printed first
    assert "author" not in dealt[0] and "author" in dealt[1]


def test_windows_of_a_day_store_read_their_months_only(spark, tmp_path):
    import datetime

    from signalmill.operators.growth import deltas
    from signalmill.operators.longtail import uplift_windows
    from signalmill.sources import daystore
    from signalmill.sources.versions import TableSet

    as_of = datetime.date(2024, 5, 31)
    day = lambda n: as_of - datetime.timedelta(days=n)
    kind = "tenant int, entity string, bucket_date date, mentions long"
    rows = [(1, f"e{n % 7}", day(n), 1 + n % 5) for n in range(-3, 500)] + [(1, "silent", day(200), 9), (1, "old", day(454), 2), (2, "silent2", day(600), 1)]
    tables = TableSet(spark, f"{tmp_path}/set")
    all_days = spark.createDataFrame(rows, kind)
    daystore.store_days(tables.change(), all_days, slices=2).commit()
    days, names = tables.read("days"), tables.read("entities")
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))
    assert same(deltas(days, as_of, entities=names), deltas(all_days, as_of))
    assert same(uplift_windows(days, as_of, names), uplift_windows(all_days, as_of))
    for got in (deltas(days, as_of, entities=names), uplift_windows(days, as_of, names)):
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert any("bucket_month" in p.split("]")[0] and " OR " in p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:])
    # Other contents of two months, one of which loses its rows, and a new entity; files of other months stay.
    months = [datetime.date(2024, 5, 1), datetime.date(2024, 4, 1)]
    kept = {tuple(p) for p in tables.manifest()["days"]["parts"] if p[0] not in map(str, months)}
    daystore.renew_months(tables.change(), spark.createDataFrame([(1, "new", day(0), 50)], kind), months).commit()
    now = spark.createDataFrame([r for r in rows if r[2].replace(day=1) not in months] + [(1, "new", day(0), 50)], kind)
    assert same(uplift_windows(tables.read("days"), as_of, tables.read("entities")), uplift_windows(now, as_of))
    assert {p[0] for p in tables.manifest()["days"]["parts"] if tuple(p) not in kept} == {"2024-05-01"}
    daystore.store_days(tables.change(), all_days.where("false")).commit()
    assert deltas(tables.read("days"), as_of, entities=tables.read("entities")).count() == 0
