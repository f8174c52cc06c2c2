"""Lifecycle states of entities."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalmill.functions.text import well_formed
from signalmill.operators.growth import deltas, state_metrics, state_metrics_at

SURFACING = ("emerging", "sustained", "peaking", "resurgent")
MIN_WOW, MIN_VOLUME = 0.3, 9


def _rules(current, v7, v30, wow, mom, min_wow: float, min_volume: int) -> list[tuple]:
    """H1's rules in order: condition, state, reason; over columns or plain values."""
    third, half = max(1, min_volume // 3), math.ceil(min_volume / 2)
    fall = -min_wow * 0.8
    back = (current == "declining") & (mom > min_wow) & (v30 >= half)
    return [
        ((v7 <= 0) & (v30 < third), "dormant", "no recent activity"),
        ((current == "dormant") & (wow > min_wow) & (v7 >= math.ceil(min_volume / 3)), "resurgent", "active after dormancy"),
        (v30 < third, "candidate", "little volume"),
        ((wow < fall) & (mom < fall) & (v30 >= half), "declining", "weekly and monthly fall"),
        (back & (wow >= 0) & (v30 >= min_volume), "sustained", "no longer declining"),
        (back, "emerging", "no longer declining"),
        (((current == "sustained") | (current == "peaking")) & (wow < min_wow * 0.2) & (mom > min_wow * 0.3), "peaking", "growth slows"),
        ((mom > min_wow) & (v30 >= min_volume) & (wow >= 0), "sustained", "monthly growth"),
        ((wow > min_wow * 0.35) & (v30 >= third), "emerging", "weekly growth"),
    ]


def next_state(current: Column, v7: Column, v30: Column, wow: Column, mom: Column, min_wow: float = MIN_WOW, min_volume: int = MIN_VOLUME) -> Column:
    """H1: struct(state, reason); the first rule that holds decides."""
    out = F.struct(current.alias("state"), F.lit("unchanged").alias("reason"))
    for rule, state, reason in reversed(_rules(current, v7, v30, wow, mom, min_wow, min_volume)):
        out = F.when(rule, F.struct(F.lit(state).alias("state"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


def next_state_of(current: str, v7: int, v30: int, wow: float, mom: float, min_wow: float = MIN_WOW, min_volume: int = MIN_VOLUME) -> str:
    """H1's state of plain values, for stateful streaming."""
    return next((state for rule, state, _ in _rules(current, v7, v30, wow, mom, min_wow, min_volume) if rule), current)


def run_states(buckets: DataFrame, prior: DataFrame, as_of: datetime.date, **params) -> DataFrame:
    """H2: a row per entity and geography active in 90 days; entered_on moves only on a change of state.

    prior (entity, geography, state, entered_on); new keys start as candidates.
    """
    m = state_metrics(buckets, as_of).join(deltas(buckets, as_of).select("entity", "delta_mom", "delta_yoy"), "entity", "left")
    p = prior.select("entity", "geography", F.col("state").alias("_old"), F.col("entered_on").alias("_since"))
    m = m.join(p, ["entity", "geography"], "left").withColumn("previous", F.coalesce("_old", F.lit("candidate")))
    m = m.withColumn("_n", next_state(*(F.col(c) for c in ("previous", "volume_7d", "volume_30d", "growth_wow", "growth_mom")), **params))
    changed = F.col("_old").isNull() | (F.col("_n.state") != F.col("previous"))
    return m.select(
        "entity", "geography", F.col("_n.state").alias("state"), F.col("_n.reason").alias("reason"), "previous", "volume_7d", "volume_30d", "volume_90d",
        "velocity", "growth_wow", "growth_mom", "volatility", "delta_mom", "delta_yoy",
        F.when(changed, F.lit(as_of)).otherwise(F.col("_since")).alias("entered_on"), (F.col("_n.state") != F.col("previous")).alias("transitioned"),
    )


def apply_gate(states: DataFrame, verdicts: DataFrame, specificity: DataFrame) -> DataFrame:
    """H3: decision for surfacing states; malformed or unspecific labels turn pass into hold; other states have none.

    verdicts (entity, decision), specificity (entity, keep); no verdict holds, no specificity keeps.
    """
    s = states.join(verdicts.select("entity", F.col("decision").alias("_d")), "entity", "left").join(specificity.select("entity", F.col("keep").alias("_k")), "entity", "left")
    passed = (F.col("_d") == "pass") & well_formed(F.col("entity"))["ok"] & F.coalesce("_k", F.lit(True))
    return s.withColumn("decision", F.when(F.col("state").isin(*SURFACING), F.when(F.coalesce(passed, F.lit(False)), "pass").otherwise("hold"))).drop("_d", "_k")


def reuse_verdicts(states: DataFrame, cache: DataFrame) -> DataFrame:
    """H4: a cached verdict counts only for the label it was given for."""
    c = cache.select("entity_id", F.col("label").alias("_l"), F.col("keep").alias("cached"))
    return states.join(c, (states["entity_id"] == c["entity_id"]) & (states["label"] == c["_l"]), "left").drop(c["entity_id"]).drop("_l")


def surface_items(states: DataFrame, items: DataFrame, tenant: int = 1) -> DataFrame:
    """H5: items by (tenant, label, geography): passed states are upserted, held ones archive what is there, the rest stays.

    Strength is 3 per mention in 7 days, 40 times weekly and 30 times monthly growth, 100 at most.
    """
    strength = F.least(F.lit(100), F.floor(F.col("volume_7d") / 10 * 30 + F.greatest(F.lit(0.0), "growth_wow") * 40 + F.greatest(F.lit(0.0), "growth_mom") * 30 + 0.5))
    s = states.where("decision is not null").select(
        F.lit(tenant).alias("tenant"), F.col("entity").alias("label"), "geography", "decision", F.col("state").alias("_s"), F.col("volume_30d").alias("_e"), strength.cast("long").alias("_g")
    )
    j = items.join(s, ["tenant", "label", "geography"], "full_outer").where("decision is null or decision = 'pass' or status is not null")
    new = F.coalesce(F.col("decision") == "pass", F.lit(False))
    pick = lambda fresh, old: F.when(new, F.col(fresh)).otherwise(F.col(old)).alias(old)
    archived = F.when(new, F.lit(False)).when(F.col("decision") == "hold", F.lit(True)).otherwise(F.col("archived")).alias("archived")
    return j.select("tenant", "label", "geography", pick("_s", "status"), pick("_e", "evidence_count"), pick("_g", "strength"), archived)


def promote(states: DataFrame, wanted: DataFrame) -> DataFrame:
    """H6: rows of the wanted entities, flagged; the geography with most 30-day volume is primary and sets the strength."""
    s = states.join(wanted.select("entity").distinct(), "entity", "left_semi")
    p = s.groupBy("entity").agg(F.max(F.struct("volume_30d", "geography")).alias("m"))
    strength = F.greatest(F.lit(50), F.floor(F.col("m.volume_30d") / 10 * 30 + 0.5)).cast("long")
    return s.join(p, "entity").select("entity", "geography", "volume_30d", F.lit(True).alias("promoted"), (F.col("geography") == F.col("m.geography")).alias("is_primary"), strength.alias("strength"))


def rename_state(df: DataFrame, old: str, new: str) -> DataFrame:
    """H7"""
    return df.replace(old, new, ["state"])


def replay_states(buckets: DataFrame, dates: list[datetime.date], **params) -> DataFrame:
    """H8: states at each of a few dates, each from the one before; one fold per entity and geography.

    Metrics of all dates come from one pass over the buckets; dates without activity in 90 days keep no row.
    """
    per = state_metrics_at(buckets, dates)
    steps = per.groupBy("entity", "geography").agg(F.array_sort(F.collect_list(F.struct("as_of", "volume_7d", "volume_30d", "growth_wow", "growth_mom"))).alias("steps"))
    kind = "array<struct<as_of:date,state:string>>"
    start = F.struct(F.lit("candidate").alias("state"), F.array().cast(kind).alias("out"))

    def step(a: Column, x: Column) -> Column:
        n = next_state(a["state"], x["volume_7d"], x["volume_30d"], x["growth_wow"], x["growth_mom"], **params)["state"]
        return F.struct(n.alias("state"), F.concat(a["out"], F.array(F.struct(x["as_of"].alias("as_of"), n.alias("state")))).alias("out"))

    return steps.select("entity", "geography", F.inline(F.aggregate("steps", start, step, lambda a: a["out"])))
