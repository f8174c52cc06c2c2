"""Run log: summaries, completeness, reconciliation, costs."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERMINAL = ("succeeded", "failed", "aborted")


def run_summary(runs: DataFrame, since: datetime.date | None = None) -> DataFrame:
    """One row."""
    r = runs if since is None else runs.where(F.col("started_on") >= F.lit(since))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return r.agg(
        F.count("*").alias("runs"), zero(F.sum("records")).alias("records"), zero(F.sum("usable")).alias("usable"), F.round(zero(F.sum("cost")), 4).alias("cost"),
        F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "failed").alias("failed"),
    )


def run_rollups(runs: DataFrame) -> dict[str, DataFrame]:
    """By platform and status, by batch and platform, and platform counts per query, as columns and as rows.

    The columns are all platforms there are; Spark raises an error beyond spark.sql.pivotMaxValues of them.
    """
    return {
        "status": runs.groupBy("platform", "status").agg(
            F.count("*").alias("runs"), F.count_distinct("batch_id").alias("batches"), F.count_distinct("query_id").alias("queries"), F.min("started_on").alias("first_on"), F.max("started_on").alias("last_on")
        ),
        "batch": runs.groupBy("batch_id", "platform").agg(F.count("*").alias("runs")),
        "query": runs.groupBy("query_id").pivot("platform").count().na.fill(0),
        "query_rows": runs.groupBy("query_id", "platform").agg(F.count("*").alias("runs")),
    }


def batch_complete(batches: DataFrame, runs: DataFrame) -> DataFrame:
    """A batch is done when all expected runs are there, terminal, and those that succeeded are ingested."""
    settled = F.col("status").isin(*TERMINAL) & ((F.col("status") != "succeeded") | (F.col("ingestion_status") == "done"))
    r = runs.groupBy("batch_id").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(settled, F.lit(False))).alias("settled"))
    ok = (F.coalesce("n", F.lit(0)) == F.col("expected")) & F.coalesce("settled", F.lit(False))
    return batches.join(r, "batch_id", "left").select("batch_id", "expected", F.coalesce("n", F.lit(0)).alias("runs"), ok.alias("complete"))


def reconcile_runs(runs: DataFrame, signals: DataFrame) -> DataFrame:
    """Stuck runs: those with signals are finished with what they have, others start again."""
    s = signals.groupBy("run_id").agg(F.count("*").alias("found"))
    r = runs.where("ingestion_status = 'processing'").join(s, "run_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return r.select("run_id", "found", F.when(F.col("found") > 0, "finish").otherwise("retry").alias("action"), F.greatest(F.lit(0), F.col("records") - F.col("found")).alias("dropped"))


def cost_rates(runs: DataFrame, least: int = 40) -> DataFrame:
    """Per platform, floor = mean cost of runs without records, rate = cost per record of runs of `least` or more."""
    big = F.col("records") >= least
    return runs.groupBy("platform").agg(
        F.coalesce(F.avg(F.when(F.col("records") == 0, F.col("cost"))), F.lit(0.0)).alias("floor"),
        F.coalesce(F.sum(F.when(big, F.col("cost"))) / F.sum(F.when(big, F.col("records"))), F.lit(0.0)).alias("rate"),
    )


def run_costs(runs: DataFrame, rates: DataFrame) -> DataFrame:
    """Modelled cost of each run."""
    return runs.join(rates, "platform").select("run_id", "platform", "records", F.greatest("floor", F.col("records") * F.col("rate")).alias("modelled"))


def spend(runs: DataFrame) -> DataFrame:
    """Cost of billed runs by platform."""
    return runs.where(F.col("status").isin("succeeded", "failed") & (F.col("cost") > 0)).groupBy("platform").agg(F.count("*").alias("billed"), F.round(F.sum("cost"), 4).alias("spend"))


def pipeline_status(signals: DataFrame, links: DataFrame, entities: DataFrame, runs: DataFrame, as_of: datetime.date, days: int = 90) -> DataFrame:
    """One row of counts and last times."""
    in_window = F.datediff(F.lit(as_of), F.col("posted_on")).between(0, days)
    s = signals.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "done").alias("done"))
    k = links.agg(F.count_if(in_window).alias("links_in_window"), F.count_distinct(F.when(in_window, F.col("entity"))).alias("active_entities"))
    e = entities.agg(F.count("*").alias("entities"))
    r = runs.agg(F.max(F.when(F.col("status") == "succeeded", F.col("completed_on"))).alias("last_run"))
    return s.crossJoin(k).crossJoin(e).crossJoin(r)  # four single rows


def config_impact(states: DataFrame, runs: DataFrame, least_volume: int, least_growth: float) -> DataFrame:
    """Rows that clear each threshold, and fetched against usable records."""
    a = states.agg(
        F.count("*").alias("states"), F.count_if(F.col("volume_30d") >= least_volume).alias("clear_volume"), F.count_if(F.col("growth_wow") >= least_growth).alias("clear_growth"),
        F.count_if(F.col("decision").isNotNull()).alias("evaluated"), F.count_if(F.col("decision") == "pass").alias("passed"),
    )
    return a.crossJoin(runs.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("fetched"), F.coalesce(F.sum("usable"), F.lit(0)).alias("usable")))
