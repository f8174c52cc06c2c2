"""Streams over table sets: whole runs once, buckets that re-open, refresh that leaves the rest alone; failures between write and commit."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from signalmill.operators.buckets import day_buckets
from signalmill.operators.states import run_states
from signalmill.sources.versions import Change, TableSet
from signalmill.streaming import jobs

DAY = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


class Feed:
    """A folder of files and a job over it."""

    def __init__(self, spark, folder, kind, start):
        self.spark, self.folder, self.kind, self.start = spark, str(folder), kind, start

    def add(self, part):
        self.spark.createDataFrame(part, self.kind).coalesce(1).write.mode("append").parquet(self.folder)
        return self.run()

    def run(self):
        self.start(jobs.read_stream(self.spark, self.folder, self.kind)).awaitTermination()


@pytest.fixture
def failing(monkeypatch):
    """failing(n): the n-th write of a change from now on fails; failing(): none does."""
    write, commit = Change._write, Change.commit

    def at(n=None):
        monkeypatch.setattr(Change, "_write", write)
        monkeypatch.setattr(Change, "commit", commit)
        if n == "commit":
            monkeypatch.setattr(Change, "commit", lambda self, **note: (_ for _ in ()).throw(OSError("stopped before the commit")))
        elif n:
            left = [n]

            def once(self, *a):
                left[0] -= 1
                if not left[0]:
                    raise OSError("stopped between files")
                return write(self, *a)

            monkeypatch.setattr(Change, "_write", once)

    return at


def item(i, user="u"):
    return json.dumps({"id": str(i), "full_text": f"text {i}", "createdAt": "2024-01-05T10:00:00Z", "author": {"username": user}})


def test_runs_are_ingested_whole_and_once(spark, tmp_path, failing):
    landed = [(1, item(1)), (1, item(2)), (1, "[1]"), (2, item(2, "late")), (2, item(3)), (3, "not json"), (4, item(9))]
    read = lambda s, ids: s.createDataFrame(landed, "run_id int, raw string").where(F.col("run_id").isin(ids))
    tables = TableSet(spark, f"{tmp_path}/set")
    feed = Feed(spark, tmp_path / "runs", "tenant int, run_id int, platform string", lambda s: jobs.stream_ingest(s, read, tables, f"{tmp_path}/ck"))
    feed.add([(1, 1, "x"), (1, 1, "x")])
    assert rows(tables.read("signals").select("run_id", "source_id", "author")) == [(1, "1", "u"), (1, "2", "u")]
    for stop in (1, 2, "commit"):
        failing(stop)
        with pytest.raises(Exception, match="stopped"):
            feed.add([(1, 2, "x"), (1, 3, "x")]) if stop == 1 else feed.run()
        assert tables.read("signals").count() == 2 and rows(tables.read("ledger").select("run_id")) == [(1,)]  # nothing of a run shows
    failing()
    feed.run()
    feed.add([(1, 2, "x"), (1, 4, "x"), (1, 7, "x")])  # a run that comes again, one that landed nothing
    assert rows(tables.read("signals").select("run_id", "source_id", "author")) == [(1, "1", "u"), (1, "2", "u"), (2, "3", "u"), (4, "9", "u")]
    assert rows(tables.read("ledger").drop("tenant", "platform")) == [(1, 3, 1, 2), (2, 2, 0, 1), (3, 1, 1, 0), (4, 1, 0, 1), (7, 0, 0, 0)]


LINK = "signal_id long, entity string, platform string, geography string, author string, engagement double, posted_on date"


def test_late_posts_reopen_their_day_once(spark, tmp_path, failing):
    batches = [
        [(1, "a", "x", "G", "p", 2.0, DAY(0)), (2, "a", "x", "G", "p", 4.0, DAY(0)), (3, "a", "x", "G", None, -1.0, DAY(1)), (3, "b", "y", "G", "", 0.0, DAY(1))],
        [(4, "a", "x", "G", "q", 10.0, DAY(0)), (5, "a", "x", "G", "p", 2.0, DAY(0)), (6, "c", "x", "G", "p", None, DAY(2)), (7, "c", "x", "G", "p", 1.0, None)],
        [(8, "b", "y", "G", "z", 5.0, DAY(1))],
    ]
    tables = TableSet(spark, f"{tmp_path}/set")
    feed = Feed(spark, tmp_path / "links", LINK, lambda s: jobs.stream_day_buckets(s, tables, f"{tmp_path}/ck"))
    feed.add(batches[0])
    failing("commit")
    with pytest.raises(Exception, match="stopped"):
        feed.add(batches[1])
    failing()
    feed.run()  # the same batch again
    parts = {p[0]: p[1] for p in tables.manifest()["buckets"]["parts"]}
    feed.add(batches[2])
    after = {p[0]: p[1] for p in tables.manifest()["buckets"]["parts"]}
    assert {d for d in after if after[d] != parts[d]} == {str(DAY(1))}  # a batch touches its own days
    whole = day_buckets(spark.createDataFrame([r for b in batches for r in b if r[-1]], LINK))
    assert rows(tables.read("buckets").select(*whole.columns)) == rows(whole)


def test_refresh_equals_a_full_recompute_and_leaves_other_tenants_alone(spark, tmp_path, failing):
    kind = "tenant int, run_id int, " + LINK
    def link(tenant, run, e, day, n=1):
        return [(tenant, run, run * 100 + i, f"{tenant}|{e}", "xy"[i % 2], "G", f"u{i % 7}", float(i), DAY(day)) for i in range(n)]

    every = link(1, 1, "a", 50, 9) + link(1, 1, "b", 20, 4) + link(1, 2, "a", 50, 3) + link(1, 2, "a", 55, 12) + link(2, 3, "a", 54, 8) + link(2, 4, "c", 58, 6) + link(3, 5, "a", 1, 2)
    landed = spark.createDataFrame(every, kind)
    as_of = DAY(60)
    prior = spark.createDataFrame([(1, "1|a", "G", "dormant", DAY(30))], "tenant int, entity string, geography string, state string, entered_on date")
    tables = TableSet(spark, f"{tmp_path}/set")
    tables.change().replace("prior", prior, "tenant").commit()
    feed = Feed(spark, tmp_path / "runs", "tenant int, run_id int, status string", lambda s: jobs.stream_refresh(s, lambda x: landed, tables, as_of, f"{tmp_path}/ck"))
    feed.add([(1, 1, "succeeded"), (2, 3, "succeeded"), (3, 5, "succeeded")])
    first = tables.manifest()
    failing(3)
    with pytest.raises(Exception, match="stopped"):
        feed.add([(1, 2, "succeeded"), (2, 4, "failed"), (1, 1, "succeeded")])
    assert tables.manifest() == first
    failing()
    feed.run()
    for name in ("buckets", "states", "trends"):
        now, was = ({p[0]: p[1] for p in m[name]["parts"]} for m in (tables.manifest(), first))
        assert {t: p for t, p in now.items() if t != "1"} == {t: p for t, p in was.items() if t != "1"} and now["1"] != was["1"]
    feed.add([(2, 4, "succeeded")])
    whole = day_buckets(landed, by=("tenant",))
    assert rows(tables.read("buckets").select(*whole.columns)) == rows(whole)
    states = run_states(whole, prior.drop("tenant"), as_of).select(*jobs.STATES)
    assert rows(tables.read("states").select(*jobs.STATES)) == rows(states)
    assert {r["entity"] for r in tables.read("trends").collect()} == {r["entity"] for r in states.where(F.col("state").isin(*jobs.SURFACING)).collect()} != set()
