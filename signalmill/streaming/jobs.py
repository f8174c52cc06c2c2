"""Streaming forms of ingestion, buckets and states."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from signalmill.operators.buckets import add_parts, bucket_parts, buckets_of, day_buckets
from signalmill.operators.growth import share_of_voice
from signalmill.operators.states import SURFACING, next_state_of, run_states
from signalmill.sources.items import normalize, parse_items
from signalmill.sources.scratch import scratch_path
from signalmill.sources.sinks import append_new
from signalmill.sources.versions import Change, TableSet

STATES = ("entity", "geography", "state", "reason", "previous", "volume_7d", "volume_30d", "volume_90d", "growth_wow", "growth_mom", "entered_on", "transitioned")


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def _batches(stream: DataFrame, tables: TableSet, name: str, take: Callable[[DataFrame, Change], None], checkpoint: str) -> StreamingQuery:
    """foreachBatch over a set of tables: a batch changes all its tables and notes its number in one commit, so one that comes again after a failure changes nothing twice."""

    def each(batch: DataFrame, number: int) -> None:
        if number > tables.note(name, -1):
            change = tables.change()
            take(batch, change)
            change.commit(**{name: number})

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SIGNAL_KEY = ("tenant", "platform", "source_id")


def stream_ingest(runs: DataFrame, landed: Callable[[SparkSession, list], DataFrame], tables: TableSet, checkpoint: str) -> StreamingQuery:
    """L1, A3: signals of finished runs, each run whole and once.

    runs (tenant, run_id, platform) is a stream of runs whose items have all landed; landed
    gives the items (run_id, raw) of some runs. A batch reads the items of its runs that the
    ledger does not hold, inserts the signals whose (tenant, platform, source_id) is not
    there yet (of a batch the lowest run wins), and enters the runs with their numbers of
    items, malformed items and new signals, all in one change of `signals` and `ledger`.
    """

    def take(batch: DataFrame, change: Change) -> None:
        spark = batch.sparkSession
        fresh = batch.where("run_id is not null").dropDuplicates(["run_id"])
        if "ledger" in change.new:
            fresh = fresh.join(change.read("ledger").select("run_id"), "run_id", "left_anti")
        claimed = [tuple(r) for r in fresh.select("tenant", "run_id", "platform").collect()]  # the runs of one batch
        if not claimed:
            return
        runs = spark.createDataFrame(claimed, fresh.select("tenant", "run_id", "platform").schema)
        ids = [r[1] for r in claimed]
        parsed = parse_items(landed(spark, ids).join(F.broadcast(runs), "run_id"))
        new = normalize(parsed.where("item is not null"), carry=("tenant", "run_id"))
        new = append_new(new, change.read("signals"), list(SIGNAL_KEY), "run_id") if "signals" in change.new else append_new(new, new.where("false"), list(SIGNAL_KEY), "run_id")
        if "signals" in change.new:
            change.replace_scope("signals", new, ids)
        else:
            change.replace("signals", new, "run_id")
        kept = change.read("signals", ids).groupBy("run_id").agg(F.count("*").alias("inserted"))
        items = parsed.groupBy("run_id").agg(F.count("*").alias("items"), F.count_if(F.col("item").isNull()).alias("malformed"))
        entry = runs.join(items, "run_id", "left").join(kept, "run_id", "left").na.fill(0, ["items", "malformed", "inserted"]).select("tenant", "run_id", "platform", "items", "malformed", "inserted")
        if "ledger" in change.new:
            change.replace_scope("ledger", entry, ids)
        else:
            change.replace("ledger", entry, "run_id")

    return _batches(runs, tables, "ingest", take, checkpoint)


def stream_dedupe(sdf: DataFrame, delay: str = "1 day", keys=("tenant", "platform", "source_id"), time: str = "posted_at") -> DataFrame:
    """L2: the first row of a key within the watermark; state of older keys is let go."""
    return sdf.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_day_buckets(links: DataFrame, tables: TableSet, checkpoint: str) -> StreamingQuery:
    """L3: day buckets that a batch adds to, so late posts re-open their day.

    `parts` holds what buckets add up from (exact author sets and value histograms) and
    `buckets` the measures, both laid out by day. A batch reads its own rows and the parts of
    its days, never the links of earlier batches; both tables change in one step. Links
    without a day are left out.
    """

    def take(batch: DataFrame, change: Change) -> None:
        new = bucket_parts(batch.where("posted_on is not null"))
        days = [r[0] for r in new.select("bucket_date").distinct().collect()]  # the days of one batch
        if not days:
            return
        if "parts" not in change.new:
            change.replace("parts", new, "bucket_date").replace("buckets", buckets_of(change.read("parts")), "bucket_date")
        else:
            change.replace_scope("parts", add_parts(change.read("parts", days), new), days)
            change.replace_scope("buckets", buckets_of(change.read("parts", days)), days)

    return _batches(links, tables, "day_buckets", take, checkpoint)


STATE_OUT = "entity string, bucket_date date, state string, active boolean"
#: Days of history that the lifecycle rules look at; a key without a mention in them is let go.
HISTORY = 90
_DAY_MS = 86_400_000
_EPOCH = datetime.date(1970, 1, 1).toordinal()


def _metrics(days: list[int], mentions: list[int], at: int) -> tuple[int, int, float, float]:
    """Volumes of 7 and 30 days, weekly and monthly growth at day `at`, from the sorted days of its history."""
    v7, v30, v90 = (sum(m for d, m in zip(days, mentions) if at - d <= n) for n in (7, 30, 90))
    weeks: list[int] = []
    first = None
    for d, m in zip(days, mentions):
        if first is None or d - first >= 7:
            first = d
            weeks.append(0)
        weeks[-1] += m
    rate = lambda a, b: (1.0 if b > 0 else 0.0) if a == 0 else (b - a) / a
    return v7, v30, rate(weeks[-2] if len(weeks) > 1 else 0, weeks[-1]), rate((v90 - v30) / 2 if v30 > 0 else 0, v30)


class _Life:
    """Lifecycle of one key: its state, the day sums of its history and the last day it was judged on."""

    def __init__(self, now: str, days, sums, upto: int):
        self.now, self.history, self.upto, self.out = now, dict(zip(days, sums)), upto, []

    def judged(self, day: int, active: bool) -> None:
        self.history = {d: m for d, m in sorted(self.history.items()) if day - d <= HISTORY}
        was, self.upto = self.now, day
        self.now = next_state_of(was, *_metrics(list(self.history), list(self.history.values()), day))
        if active or self.now != was:
            self.out.append((datetime.date.fromordinal(day), self.now, active))

    def silent_to(self, day: int) -> None:
        """Every day without mentions up to `day`; a key that has been silent for all of its history starts over."""
        while self.history and self.upto < day:
            if not self.over(self.upto + 1):
                self.judged(self.upto + 1, False)

    def over(self, day: int) -> bool:
        """Does the key start over on this day?"""
        if day - max(self.history) > HISTORY:
            self.now, self.history = "candidate", {}
        return not self.history

    def mentioned(self, day: int, n: int) -> None:
        if self.history and day <= self.upto:  # late: it counts in the history and gives no row
            self.history[day] = self.history.get(day, 0) + n
            return
        self.silent_to(day - 1)
        if self.history:
            self.over(day)
        self.history[day] = n
        self.judged(day, True)


def stream_states(daily: DataFrame, delay: str = "1 day") -> DataFrame:
    """L4: lifecycle state carried between batches; rows (entity, bucket_date, mentions) in.

    Out come the state after each day with mentions (active) and after each silent day that
    changes it. Silent days are judged up to the watermark, the latest day seen less `delay`,
    by a timer on each key's next day, so a key that is never mentioned again turns dormant
    on its day; a key with no mention in 90 days is let go and would start as a candidate.
    A key's state is its lifecycle state and the day sums of 90 days, which give E3 to E6 on
    each day, and H1 the next state. A day not after the last one judged is late: it counts
    in the history and gives no row; days before the watermark are dropped. Rows without a
    day, a key or mentions are left out.
    """

    def each(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        life = _Life(*(state.get if state.exists else ("candidate", [], [], 0)))
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).groupby("bucket_date")["mentions"].sum().sort_index()
            for day, n in rows.items():
                life.mentioned(day.toordinal(), int(n))
        mark = state.getCurrentWatermarkMs()
        seen = mark // _DAY_MS + _EPOCH  # midnight of this day is not after the watermark
        life.silent_to(seen)
        if life.history:
            history = dict(sorted(life.history.items()))
            state.update((life.now, list(history), list(history.values()), life.upto))
            # Timers before the watermark go off, so one just before midnight goes off when the watermark reaches the day.
            state.setTimeoutTimestamp(max((max(life.upto, seen) + 1 - _EPOCH) * _DAY_MS - 1, mark + 1))
        else:
            state.remove()
        yield pd.DataFrame([(key[0], *r) for r in life.out], columns=["entity", "bucket_date", "state", "active"])

    kind = "state string, days array<int>, mentions array<long>, upto int"
    good = daily.where("entity is not null and bucket_date is not null and mentions is not null").select("entity", "bucket_date", "mentions", F.col("bucket_date").cast("timestamp").alias("_at"))
    return good.withWatermark("_at", delay).groupBy("entity").applyInPandasWithState(each, STATE_OUT, kind, "append", "EventTimeTimeout")


def stream_refresh(runs: DataFrame, links: Callable[[SparkSession], DataFrame], tables: TableSet, as_of: datetime.date, checkpoint: str, tasks: int | None = None) -> StreamingQuery:
    """What fresh succeeded runs touch, carried from signals to buckets, states and trends; the rest stays as it is.

    runs (tenant, run_id, status); links gives all landed links with tenant and run_id, and
    the set holds `prior` (tenant, entity, geography, state, entered_on), the states of the
    evening before. Touched buckets (entity and day) are counted again from their links, touched
    entities get states and share-of-voice anew, and the tables of other tenants keep their
    files. Entities belong to one tenant. All of a batch changes in one step, and, as states
    start from `prior`, refreshing an entity twice gives what one refresh gives. `tasks` is that of day_buckets.
    """

    def take(batch: DataFrame, change: Change) -> None:
        spark = batch.sparkSession
        fresh = batch.where("status = 'succeeded'").select("tenant", "run_id").distinct()
        tenants = [r[0] for r in fresh.select("tenant").distinct().collect()]  # the tenants of one batch
        if not tenants:
            return
        every = links(spark)
        path = scratch_path(spark, "touched")
        every.join(fresh, ["tenant", "run_id"], "left_semi").select("tenant", "entity", F.col("posted_on").alias("bucket_date")).distinct().write.parquet(path)
        touched = spark.read.parquet(path)
        names = touched.select("tenant", "entity").distinct()
        keys = touched.withColumnRenamed("bucket_date", "posted_on")
        again = day_buckets(every.join(keys, ["tenant", "entity", "posted_on"], "left_semi"), by=("tenant",), tasks=tasks)

        def put(name: str, new: DataFrame, same: list[str], gone: DataFrame) -> None:
            if name not in change.new:
                change.replace(name, new, "tenant")
            else:
                old = change.read(name, tenants)
                change.replace_scope(name, old.join(gone, same, "left_anti").select(*old.columns).unionByName(new), tenants)

        put("buckets", again, ["tenant", "entity", "bucket_date"], touched)
        now = change.read("buckets", tenants)
        mine = now.join(names, ["tenant", "entity"], "left_semi")
        before = change.read("prior", tenants).join(names, ["tenant", "entity"], "left_semi")
        states = run_states(mine, before, as_of).join(names, "entity").select("tenant", *STATES)
        put("states", states, ["tenant", "entity"], names)
        # Shares are of a tenant's totals, so they move for every entity of a touched tenant.
        share = share_of_voice(now).select("tenant", "entity", "sov_growth")
        trends = change.read("states", tenants).where(F.col("state").isin(*SURFACING)).join(share, ["tenant", "entity"], "left")
        trends = trends.select("tenant", "entity", "geography", "state", "volume_30d", "growth_wow", "sov_growth")
        change.replace("trends", trends, "tenant") if "trends" not in change.new else change.replace_scope("trends", trends, tenants)

    return _batches(runs, tables, "refresh", take, checkpoint)
