"""Queries for states, read models, studies, sources and streams."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from signalmill.operators import buckets as B
from signalmill.operators import gate as G
from signalmill.operators import growth as W
from signalmill.operators import ingest as I
from signalmill.operators import runlog as L
from signalmill.operators import seeds as S
from signalmill.operators import states as H
from signalmill.operators import studies as Y
from signalmill.plans import readmodels as J
from signalmill.plans.catalog import ENTITIES, INTEREST, RUNS, SEEDS, VOCAB, buckets, core_vocab, entities, interest, links, query, rounded, runs, seed_queries
from signalmill.plans.queries_seeds import _SEEDVOC
from signalmill.plans.lifecycle_sql import REASON, STATE, growth, metrics_sql
from signalmill.plans.queries_series import _BREADTH, _HASHED, _SERIES, _VOLUMES, X, recursive, sov_sql, stages, windows
from signalmill.plans.queries_text import _SINGULAR
from signalmill.sources import items as A
from signalmill.sources import sinks as K
from signalmill.sources.fixtures import AS_OF, BUCKETS_SQL, event_links, links_sql, table, tasks_of, with_links
from signalmill.sources.scratch import scratch_path as _shared
from signalmill.sources.versions import TableSet
from signalmill.streaming import jobs

# -- states ------------------------------------------------------------------------------------

@query("h1_next_state", f"WITH m AS (SELECT o_orderkey AS id, ['candidate', 'emerging', 'sustained', 'peaking', 'declining', 'dormant'][o_orderkey % 6 + 1] AS cur, o_orderkey % 7 AS v7, o_custkey % 23 AS v30, (o_orderkey % 40 - 20) / 20 AS wow, (o_custkey % 40 - 20) / 20 AS mom FROM orders) SELECT id, {STATE} AS state FROM m")
def h1(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = F.array(*[F.lit(x) for x in ("candidate", "emerging", "sustained", "peaking", "declining", "dormant")])
    n = H.next_state(F.element_at(names, (k % 6 + 1).cast("int")), k % 7, c % 23, (k % 40 - 20) / 20, (c % 40 - 20) / 20)
    return table(spark, d, "orders").select(k.alias("id"), n["state"].alias("state"))


def prior(spark, d):
    b = buckets(spark, d).where("bucket_date <= '2001-07-01'")
    none = b.where("false").select("entity", "geography", F.lit("candidate").alias("state"), "bucket_date").withColumnRenamed("bucket_date", "entered_on")
    return H.run_states(b, none, datetime.date(2001, 7, 1)).select("entity", "geography", "state", "entered_on")


def states(spark, d):
    return H.run_states(buckets(spark, d), prior(spark, d), AS_OF)


_RUN = f"""pb AS (SELECT * FROM buckets WHERE bucket_date <= DATE '2001-07-01'), {metrics_sql("DATE '2001-07-01'", '0', 'pb')}, pr AS (SELECT *, {STATE} AS state FROM (SELECT *, 'candidate' AS cur FROM met0)), {metrics_sql(X, '1')},
dt AS (SELECT entity, coalesce(sum(mentions) FILTER ({X} - bucket_date BETWEEN 0 AND 29), 0) AS a, coalesce(sum(mentions) FILTER ({X} - bucket_date BETWEEN 30 AND 59), 0) AS b, coalesce(sum(mentions) FILTER ({X} - bucket_date BETWEEN 0 AND 89), 0) AS q,
coalesce(sum(mentions) FILTER ({X} - bucket_date BETWEEN 365 AND 454), 0) AS y, count(DISTINCT bucket_date) FILTER ({X} - bucket_date BETWEEN 0 AND 59) AS days FROM buckets GROUP BY entity),
cu AS (SELECT m.*, pr.state AS old, coalesce(pr.state, 'candidate') AS cur, CASE WHEN b > 0 AND days >= 30 THEN (a - b) / b END AS delta_mom, CASE WHEN y > 0 THEN (q - y) / y END AS delta_yoy
FROM met1 m JOIN dt ON m.entity = dt.entity LEFT JOIN pr ON m.entity = pr.entity AND m.geography = pr.geography), st AS (SELECT *, {STATE} AS state, {REASON} AS reason FROM cu)"""


@query("h2_run_states", recursive(f"""{with_links()}, {_RUN} SELECT entity, geography, state, reason, cur AS previous, v7 AS volume_7d, v30 AS volume_30d, v90 AS volume_90d, round(v7 / 7, 6) AS velocity, round(wow, 6) AS growth_wow, round(mom, 6) AS growth_mom,
round(vol, 6) AS volatility, round(delta_mom, 6) AS delta_mom, round(delta_yoy, 6) AS delta_yoy, CASE WHEN old IS NULL OR state <> cur THEN {X} ELSE DATE '2001-07-01' END AS entered_on, state <> cur AS transitioned FROM st"""))
def h2(spark, d):
    return rounded(states(spark, d), "velocity", "growth_wow", "growth_mom", "volatility", "delta_mom", "delta_yoy")


def gated(spark, d):
    v = G.gate_verdict(G.source_breadth(buckets(spark, d, authors=True), 2.32).withColumn("significance_pass", F.lit(True))).select("entity", "decision")
    keep = table(spark, d, "part").groupBy(F.col("p_brand").alias("entity")).agg((F.max("p_size") % 2 == 0).alias("keep"))
    return H.apply_gate(states(spark, d), v, keep)


@query("h3_apply_gate", recursive(f"""{with_links()}, {_RUN}, {_BREADTH}, kp AS (SELECT p_brand AS entity, max(p_size) % 2 = 0 AS keep FROM part GROUP BY ALL)
SELECT st.entity, geography, state, CASE WHEN state IN ('emerging', 'sustained', 'peaking', 'resurgent') THEN CASE WHEN round(entropy_bits, 9) >= 2.32 AND total_authors >= 10 AND coalesce(keep, true) THEN 'pass' ELSE 'hold' END END AS decision
FROM st LEFT JOIN breadth b ON st.entity = b.entity LEFT JOIN kp ON st.entity = kp.entity"""))
def h3(spark, d):
    return gated(spark, d).select("entity", "geography", "state", "decision")


@query("h4_reuse_verdicts", f"WITH {ENTITIES} SELECT id AS entity_id, CASE WHEN id % 3 = 0 THEN upper(entity) ELSE entity END AS label, CASE WHEN id % 3 <> 0 AND id % 2 = 0 THEN id % 4 = 0 END AS cached FROM entities")
def h4(spark, d):
    e = entities(spark, d)
    s = e.select(F.col("id").alias("entity_id"), F.when(F.col("id") % 3 == 0, F.upper("entity")).otherwise(F.col("entity")).alias("label"))
    return H.reuse_verdicts(s, e.where("id % 2 = 0").select(F.col("id").alias("entity_id"), F.col("entity").alias("label"), (F.col("id") % 4 == 0).alias("keep")))


@query("h5_surface_items", f"""{with_links()}, {_VOLUMES}, s AS (SELECT *, CASE WHEN volume_30d % 3 = 0 THEN 'hold' WHEN volume_30d % 3 = 1 THEN 'pass' END AS decision FROM volumes),
it AS (SELECT DISTINCT p_brand AS label, 'NATION_3' AS geography FROM part)
SELECT 1 AS tenant, coalesce(it.label, s.entity) AS label, coalesce(it.geography, s.geography) AS geography, CASE WHEN decision = 'pass' THEN 'emerging' WHEN it.label IS NOT NULL THEN 'sustained' END AS status,
CASE WHEN decision = 'pass' THEN volume_30d WHEN it.label IS NOT NULL THEN 5 END AS evidence_count, CASE WHEN decision = 'pass' THEN CAST(least(100, floor(volume_7d / 10 * 30 + 20 + 0.5)) AS BIGINT) WHEN it.label IS NOT NULL THEN 50 END AS strength,
CASE WHEN decision = 'pass' THEN false WHEN decision = 'hold' THEN true ELSE false END AS archived
FROM it FULL JOIN (SELECT * FROM s WHERE decision IS NOT NULL) s ON it.label = s.entity AND it.geography = s.geography WHERE decision IS NULL OR decision = 'pass' OR it.label IS NOT NULL""")
def h5(spark, d):
    r = F.col("volume_30d") % 3
    s = W.volumes(buckets(spark, d), AS_OF).withColumn("decision", F.when(r == 0, "hold").when(r == 1, "pass")).withColumn("state", F.lit("emerging"))
    s = s.withColumn("growth_wow", F.lit(0.5)).withColumn("growth_mom", F.lit(-0.5))
    it = table(spark, d, "part").select(F.lit(1).alias("tenant"), F.col("p_brand").alias("label"), F.lit("NATION_3").alias("geography")).distinct()
    it = it.withColumn("status", F.lit("sustained")).withColumn("evidence_count", F.lit(5).cast("long")).withColumn("strength", F.lit(50).cast("long")).withColumn("archived", F.lit(False))
    return H.surface_items(s, it)


@query("h6_promote", f"{with_links()}, {_VOLUMES}, p AS (SELECT entity, max((volume_30d, geography)) AS m FROM volumes GROUP BY entity) SELECT v.entity, geography, volume_30d, true AS promoted, geography = m[2] AS is_primary, CAST(greatest(50, floor(m[1] / 10 * 30 + 0.5)) AS BIGINT) AS strength FROM volumes v JOIN p ON v.entity = p.entity WHERE v.entity < 'Brand#2'")
def h6(spark, d):
    v = W.volumes(buckets(spark, d), AS_OF)
    return H.promote(v, v.where("entity < 'Brand#2'"))


@query("h7_rename_state", f"WITH {RUNS} SELECT run_id, CASE status WHEN 'succeeded' THEN 'sustained' ELSE status END AS state FROM runs")
def h7(spark, d):
    return H.rename_state(runs(spark, d).select("run_id", F.col("status").alias("state")), "succeeded", "sustained")


def _replay_sql(dates: list[str]) -> str:
    """CTEs r1 ... rn: the state after each date, from the one after the date before."""
    out = []
    for n, day in enumerate(dates, 1):
        cur = f"SELECT m.*, coalesce({', '.join(f's{k}.state' for k in range(n - 1, 0, -1))}, 'candidate') AS cur FROM met{n} m " if n > 1 else f"SELECT *, 'candidate' AS cur FROM met{n}"
        cur += " ".join(f"LEFT JOIN r{k} s{k} ON m.entity = s{k}.entity AND m.geography = s{k}.geography" for k in range(1, n))
        out.append(f"{metrics_sql(f"DATE '{day}'", str(n))}, r{n} AS (SELECT entity, geography, DATE '{day}' AS as_of, {STATE} AS state FROM ({cur}))")
    return ", ".join(out)


_DATES = ["2001-02-01", "2001-04-01", "2001-06-01", "2001-08-01"]


@query("h8_replay_states", recursive(f"{with_links()}, {_replay_sql(_DATES)} " + " UNION ALL ".join(f"SELECT * FROM r{n}" for n in range(1, 5))))
def h8(spark, d):
    return H.replay_states(buckets(spark, d), [datetime.date.fromisoformat(x) for x in _DATES])


# -- read models -------------------------------------------------------------------------------


def simple_states(spark, d):
    """Volumes as states with items, so that SQL can express what reads them."""
    v = W.volumes(buckets(spark, d, "p_name"), AS_OF)
    s = v.withColumn("state", F.when(F.col("volume_7d") > 0, "emerging").otherwise("declining"))
    return s.withColumn("item_id", F.concat_ws("|", "entity", "geography")).join(B.platforms_seen(buckets(spark, d, "p_name")), ["entity", "geography"])


def simple_items(spark, d):
    return simple_states(spark, d).select("item_id", F.col("volume_90d").alias("evidence_count"), (F.col("volume_90d") % 5 == 0).alias("archived"))


_ST = f"""{_VOLUMES}, pl AS (SELECT entity, geography, count(DISTINCT platform) AS np FROM buckets GROUP BY ALL), ss AS (SELECT v.*, CASE WHEN volume_7d > 0 THEN 'emerging' ELSE 'declining' END AS state, v.entity || '|' || v.geography AS item_id, np, volume_90d % 5 = 0 AS archived, volume_90d * greatest(1, np) AS score
FROM volumes v JOIN pl ON v.entity = pl.entity AND v.geography = pl.geography),
pc AS (SELECT entity, geography, score, CAST(floor((rank() OVER (ORDER BY score) - 1) / count(*) OVER () * 100 + 0.5) AS INT) AS percentile FROM ss WHERE NOT archived)"""


@query("e21_signal_percentile", f"{with_links('p_name')}, {_ST} SELECT * FROM pc")
def e21(spark, d):
    return J.signal_percentile(simple_states(spark, d), simple_items(spark, d))


def trend_rows(spark, d):
    return J.trends(simple_states(spark, d), entities(spark, d), simple_items(spark, d), buckets(spark, d, "p_name"), core_vocab(spark, d), S.seed_vocabulary(seed_queries(spark, d)))


_J1 = f"""{with_links('p_name')}, {_ST}, {sov_sql()}, {ENTITIES}, {VOCAB}, {SEEDS}, {_SEEDVOC}, lw AS (SELECT entity, unnest(string_split(entity, ' ')) AS w FROM entities), hh AS (SELECT entity, term, query_id, 0 AS p FROM entities JOIN seeds ON entity = term
UNION ALL SELECT entity, term, query_id, 1 FROM lw JOIN seeds ON {_SINGULAR.format(w='lw.w')} = {_SINGULAR.format(w='term')} WHERE NOT contains(term, ' ')), mm AS (SELECT entity, min((p, query_id, term)) AS m FROM hh GROUP BY entity),
j1 AS (SELECT ss.entity, ss.geography, ss.state, volume_30d, e.entity_type, sov.sov_growth, pc.percentile, m[3] AS seed_term, m IS NULL AS discovered FROM ss JOIN entities e ON ss.entity = e.entity LEFT JOIN sov ON ss.entity = sov.entity
LEFT JOIN pc ON ss.entity = pc.entity AND ss.geography = pc.geography LEFT JOIN mm ON ss.entity = mm.entity WHERE NOT archived AND ss.entity NOT IN (SELECT term FROM vocab))"""


@query("j1_trends", f"{_J1} SELECT entity, geography, state, volume_30d, entity_type, round(sov_growth, 6) AS sov_growth, percentile, seed_term, discovered FROM j1")
def j1(spark, d):
    return rounded(trend_rows(spark, d).select("entity", "geography", "state", "volume_30d", "entity_type", "sov_growth", "percentile", "seed_term", "discovered"), "sov_growth")


@query("j2_trend_detail", f"""{_J1}, mt AS (SELECT {', '.join(f"coalesce(sum(mentions) FILTER ({X} - bucket_date BETWEEN 0 AND {n}), 0) AS mentions_{n}d" for n in (7, 30, 90))} FROM buckets WHERE entity = 'small ring'),
sg AS (SELECT signal_id, max(posted_on) AS posted_on, max(captured_on) AS captured_on FROM links GROUP BY ALL), ev AS (SELECT signal_id, posted_on, row_number() OVER (ORDER BY posted_on DESC NULLS LAST, captured_on DESC, signal_id) AS rn, count(*) OVER () AS total
FROM (SELECT DISTINCT signal_id FROM links WHERE entity = 'small ring') JOIN sg USING (signal_id)),
ea AS (SELECT max(total) AS evidence_total, list(signal_id ORDER BY rn) AS evidence, list(CAST(posted_on AS VARCHAR) ORDER BY rn) AS evidence_days FROM ev WHERE rn <= 20)
SELECT entity, geography, state, mt.*, ea.* FROM j1, mt, ea WHERE entity = 'small ring'""")
def j2(spark, d):
    k = links(spark, d, "p_name")
    s = k.groupBy("signal_id").agg(F.max("posted_on").alias("posted_on"), F.max("captured_on").alias("captured_on"))
    t = J.trend_detail(trend_rows(spark, d).select("entity", "geography", "state"), "small ring", buckets(spark, d, "p_name"), k.select("signal_id", "entity"), s, AS_OF)
    days = F.transform("evidence", lambda x: x["posted_on"].cast("string")).alias("evidence_days")
    return t.select(*[c for c in t.columns if c != "evidence"], F.transform("evidence", lambda x: x["signal_id"]).alias("evidence"), days)


@query("j3_trend_timeseries", f"""{with_links('p_name')}, {INTEREST}, {ENTITIES}, m AS (SELECT entity, bucket_date, sum(mentions) AS mentions FROM buckets WHERE bucket_date >= DATE '2001-05-03' GROUP BY ALL),
i AS (SELECT e.entity, bucket_date, max(interest_value) AS interest FROM interest JOIN entities e ON keyword = lower(label) WHERE bucket_date >= DATE '2001-05-03' GROUP BY ALL),
s AS (SELECT coalesce(m.entity, i.entity) AS entity, coalesce(m.bucket_date, i.bucket_date) AS bucket_date, coalesce(mentions, 0) AS mentions, interest FROM m FULL JOIN i ON m.entity = i.entity AND m.bucket_date = i.bucket_date)
SELECT *, bool_or(interest IS NOT NULL) OVER (PARTITION BY entity) AS has_interest, bool_or(mentions > 0) OVER (PARTITION BY entity) AS has_mentions FROM s""")
def j3(spark, d):
    return J.trend_timeseries(entities(spark, d), buckets(spark, d, "p_name"), interest(spark, d), datetime.date(2001, 5, 3))


@query("j4_long_tail_list", f"""{with_links('p_name')}, {ENTITIES}, ds AS (SELECT entity, 29 - ({X} - bucket_date) AS slot, sum(mentions) AS n FROM buckets WHERE {X} - bucket_date BETWEEN 0 AND 29 GROUP BY ALL), mp AS (SELECT entity, map(list(slot), list(n)) AS m FROM ds GROUP BY entity),
tm AS (SELECT entity, sum(mentions) AS total_mentions, sum(mentions) FILTER ({X} - bucket_date BETWEEN 0 AND 29) AS current FROM buckets GROUP BY entity)
SELECT tm.entity, total_mentions, list_transform(range(0, 30), lambda i: coalesce(m[i], 0)) AS sparkline FROM tm JOIN mp ON tm.entity = mp.entity WHERE current >= 5""")
def j4(spark, d):
    c = windows(spark, d).where("current >= 5").select("entity")
    return J.long_tail_list(c, entities(spark, d), buckets(spark, d, "p_name"), S.seed_vocabulary(seed_queries(spark, d)), AS_OF).select("entity", "total_mentions", "sparkline")


@query("j6_entity_states", f"{with_links('p_name')}, {_ST}, {ENTITIES}, {sov_sql()} SELECT ss.entity, geography, volume_7d, e.entity_type, round(sov_growth, 6) AS sov_growth FROM ss JOIN entities e ON ss.entity = e.entity LEFT JOIN sov ON ss.entity = sov.entity WHERE state = 'emerging' AND volume_7d >= 2")
def j6(spark, d):
    s = J.entity_states(simple_states(spark, d), entities(spark, d), buckets(spark, d, "p_name"), state="emerging", least_v7=2)
    return rounded(s.select("entity", "geography", "volume_7d", "entity_type", "sov_growth"), "sov_growth")


@query("j7_split_scored", f"{_J1} SELECT entity, geography, sov_growth IS NOT NULL AS scored FROM j1")
def j7(spark, d):
    a, b = J.split_scored(trend_rows(spark, d))
    return a.select("entity", "geography", F.lit(True).alias("scored")).union(b.select("entity", "geography", F.lit(False)))


@query("j8_radar_status", f"{with_links('p_name')}, {_ST}, {ENTITIES} SELECT ss.entity, geography, e.entity_type, CASE WHEN volume_30d % 2 = 0 THEN 'pass' ELSE 'hold' END AS decision, volume_7d / 100 AS p_value, CAST(np AS DOUBLE) AS entropy_bits FROM ss JOIN entities e ON ss.entity = e.entity WHERE volume_30d > 0")
def j8(spark, d):
    v = F.struct(F.when(F.col("volume_30d") % 2 == 0, "pass").otherwise("hold").alias("decision"), (F.col("volume_7d") / 100).alias("p_value"), F.size("platforms").cast("double").alias("entropy_bits"))
    return J.radar_status(simple_states(spark, d).withColumn("verdict", F.when(F.col("volume_30d") > 0, v)), entities(spark, d))


@query("c11_filter_trends", f"{_J1} SELECT entity, geography, entity_type FROM j1 WHERE entity_type IN ('ECONOMY', 'PROMO')")
def c11(spark, d):
    return J.filter_trends(trend_rows(spark, d), False, ["ECONOMY", "PROMO"]).select("entity", "geography", "entity_type")


@query("f1_sort_trends", f"{_J1} SELECT entity, geography, percentile FROM j1 ORDER BY percentile DESC NULLS LAST, entity")
def f1(spark, d):
    return J.sort_trends(trend_rows(spark, d), "percentile").select("entity", "geography", "percentile")


@query("f2_top_evidence", f"WITH {links_sql('p_name')}, s AS (SELECT signal_id, max(posted_on) AS posted_on, max(captured_on) AS captured_on FROM links GROUP BY ALL), e AS (SELECT DISTINCT signal_id, entity FROM links), r AS (SELECT e.entity, signal_id, posted_on, row_number() OVER (PARTITION BY e.entity ORDER BY posted_on DESC NULLS LAST, captured_on DESC, signal_id) AS rn, count(*) OVER (PARTITION BY e.entity) AS total FROM e JOIN s USING (signal_id)) SELECT * FROM r WHERE rn <= 20")
def f2(spark, d):
    k = links(spark, d, "p_name")
    s = k.groupBy("signal_id").agg(F.max("posted_on").alias("posted_on"), F.max("captured_on").alias("captured_on"))
    return J.top_evidence(k.select("signal_id", "entity"), s).select("entity", "signal_id", "posted_on", "rn", "total")


@query("f3_page", f"WITH {RUNS} SELECT run_id, completed_on FROM runs ORDER BY completed_on DESC NULLS LAST, run_id LIMIT 100 OFFSET 250")
def f3(spark, d):
    return J.page(runs(spark, d), "completed_on", "run_id", True, 100, 250).select("run_id", "completed_on")


@query("e35_facets", f"{_J1} SELECT entity_type, count(*) AS n FROM j1 GROUP BY entity_type")
def e35(spark, d):
    return J.facets(trend_rows(spark, d))


@query("e26_config_impact", f"{with_links()}, {_VOLUMES}, {RUNS} SELECT (SELECT count(*) FROM volumes) AS states, (SELECT count(*) FROM volumes WHERE volume_30d >= 9) AS clear_volume, (SELECT count(*) FROM volumes WHERE volume_7d / 10 >= 0.3) AS clear_growth, (SELECT count(*) FROM volumes WHERE volume_30d % 3 < 2) AS evaluated, (SELECT count(*) FROM volumes WHERE volume_30d % 3 = 1) AS passed, (SELECT sum(records) FROM runs) AS fetched, (SELECT sum(usable) FROM runs) AS usable")
def e26(spark, d):
    r = F.col("volume_30d") % 3
    s = W.volumes(buckets(spark, d), AS_OF).withColumn("growth_wow", F.col("volume_7d") / 10).withColumn("decision", F.when(r == 0, "hold").when(r == 1, "pass"))
    return L.config_impact(s, runs(spark, d), 9, 0.3)


# -- studies ------------------------------------------------------------------------------------

_HOLD = """hc AS (SELECT max(bucket_date) - 56 AS cut FROM buckets), hold AS (SELECT entity, coalesce(sum(mentions) FILTER (bucket_date > cut - 56 AND bucket_date <= cut), 0) AS pre, coalesce(sum(mentions) FILTER (bucket_date > cut AND bucket_date <= cut + 56), 0) AS post FROM buckets, hc GROUP BY entity),
ho AS (SELECT *, (post + 1) / (pre + 1) AS ratio, post > 0 AS survived, pre % 2 = 0 AS flag FROM hold WHERE pre >= 3)"""
_ERF = "(1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x))"


def mw_sql(source: str, by: str = "") -> str:
    """CTEs that end in mw: rank test of `source` (value, grp[, by])."""
    g = f"{by}, " if by else ""
    p = f"PARTITION BY {by} " if by else ""
    j = f"GROUP BY {by}" if by else ""
    return f"""hh AS (SELECT {g}value, count(*) FILTER (grp = 0) AS a, count(*) FILTER (grp = 1) AS b FROM {source} WHERE value IS NOT NULL GROUP BY ALL),
hr AS (SELECT *, coalesce(sum(a + b) OVER ({p}ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (a + b + 1) / 2 AS rk FROM hh),
hs AS (SELECT {g}CAST(sum(a) AS DOUBLE) AS n1, CAST(sum(b) AS DOUBLE) AS n2, CAST(sum(a * rk) AS DOUBLE) AS r1, CAST(sum((a + b) * (a + b) * (a + b) - (a + b)) AS DOUBLE) AS ties FROM hr {j}),
hu AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, sqrt(greatest(n1 * n2 / 12 * (n1 + n2 + 1 - ties / nullif((n1 + n2) * (n1 + n2 - 1), 0)), 0)) AS sg FROM hs),
hz AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 AND sg > 0 THEN (u - n1 * n2 / 2) / nullif(sg, 0) ELSE 0 END AS z FROM hu), hx AS (SELECT *, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM hz),
mw AS (SELECT {g}CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, CASE WHEN n1 > 0 AND n2 > 0 THEN u ELSE 0 END AS u, z, CASE WHEN n1 > 0 AND n2 > 0 THEN least(greatest(1 - {_ERF}, 0), 1) ELSE 1 END AS p FROM hx)"""


@query("f10_avg_rank", "SELECT o_orderkey AS id, round(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1) / 2, 6) AS rank FROM orders")
def f10(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("value"), F.col("o_orderstatus").alias("s"))
    return Y.avg_rank(o, "value", ["s"]).select("id", F.round("rank", 6).alias("rank"))


def study_days(spark, d, authors=False):
    """The days of part names that studies read several times, as a table written once, so that links are joined and counted once."""
    days = B.platform_days(buckets(spark, d, "p_name", authors=authors))
    days = days if authors else days.drop("unique_authors")
    return spark.read.schema(days.schema).parquet(_staged(days, "days"))


def flagged(days):
    return Y.holdout(days).withColumn("flag", F.col("pre") % 2 == 0)


def holdout(spark, d):
    return flagged(study_days(spark, d))


@query("k1_holdout", f"{with_links('p_name')}, {_HOLD} SELECT entity, pre, post, round(ratio, 6) AS ratio, survived FROM ho")
def k1(spark, d):
    return rounded(holdout(spark, d).select("entity", "pre", "post", "ratio", "survived"), "ratio")


@query("k2_mann_whitney", f"WITH v AS (SELECT c_mktsegment AS seg, floor(c_acctbal / 100) AS value, CAST(c_custkey % 2 AS INT) AS grp FROM customer), {mw_sql('v', 'seg')} SELECT seg, n1, n2, round(u, 4) AS u, round(z, 6) AS z, round(p, 6) AS p FROM mw")
def k2(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), F.floor(F.col("c_acctbal") / 100).alias("value"), (F.col("c_custkey") % 2).cast("int").alias("grp"))
    return rounded(rounded(Y.mann_whitney(c, by=["seg"]), "u", n=4), "z", "p")


_COHORT = """SELECT {g}round(median(ratio) FILTER (flag), 6) AS growth_yes, round(median(ratio) FILTER (NOT flag), 6) AS growth_no, round(median(post) FILTER (flag), 6) AS post_yes, round(median(post) FILTER (NOT flag), 6) AS post_no FROM {s} {j}"""


@query("k3_compare_cohorts", f"{with_links('p_name')}, {_HOLD}, v AS (SELECT ratio AS value, CASE WHEN flag THEN 0 ELSE 1 END AS grp FROM ho), {mw_sql('v')}, co AS ({_COHORT.format(g='', s='ho', j='')}) SELECT co.*, n1, n2, round(z, 6) AS z, round(p, 6) AS p, n1 < 20 OR n2 < 20 AS underpowered FROM co, mw")
def k3(spark, d):
    c = Y.compare_cohorts(holdout(spark, d), "flag")
    return rounded(c.select("growth_yes", "growth_no", "post_yes", "post_no", "n1", "n2", "z", "p", "underpowered"), "growth_yes", "growth_no", "post_yes", "post_no", "z", "p")


_BANDS = "bd AS (SELECT *, CASE WHEN post BETWEEN 3 AND 5 THEN '3-5' WHEN post BETWEEN 6 AND 10 THEN '6-10' WHEN post BETWEEN 11 AND 20 THEN '11-20' WHEN post >= 21 THEN '21+' END AS band FROM ho), bb AS (SELECT * FROM bd WHERE band IN (SELECT band FROM bd GROUP BY band HAVING count(*) >= 10))"


@query("k4_compare_in_bands", f"{with_links('p_name')}, {_HOLD}, {_BANDS}, v AS (SELECT band, ratio AS value, CASE WHEN flag THEN 0 ELSE 1 END AS grp FROM bb), {mw_sql('v', 'band')}, co AS ({_COHORT.format(g='band, ', s='bb', j='GROUP BY band')}) SELECT co.band, growth_yes, growth_no, n1, n2, round(p, 6) AS p FROM co JOIN mw ON co.band = mw.band")
def k4(spark, d):
    h = holdout(spark, d)
    return rounded(Y.compare_in_bands(h.withColumn("pre", F.col("post")), "flag").select("band", "growth_yes", "growth_no", "n1", "n2", "p"), "growth_yes", "growth_no", "p")


_PAST = "pc0 AS (SELECT max(bucket_date) - 56 AS cut FROM buckets), past AS (SELECT b.* FROM buckets b, pc0 WHERE bucket_date <= cut)"


@query("k5_predictor_study", f"""{with_links('p_name')}, {_HOLD}, {_PAST}, la AS (SELECT max(bucket_date) AS l FROM past),
wn AS (SELECT entity, {', '.join(f"coalesce(sum(mentions) FILTER (la.l - bucket_date BETWEEN {a} AND {b}), 0) AS {n}" for n, a, b in (('w0', 0, 6), ('w1', 7, 13), ('m0', 0, 29), ('m1', 30, 59)))} FROM past, la GROUP BY entity),
{sov_sql().replace("FROM buckets", "FROM past")}, jn AS (SELECT ho.entity, ratio, CASE WHEN w1 > 0 THEN (w0 - w1) / w1 END AS wow, CASE WHEN m1 > 0 THEN (m0 - m1) / m1 END AS mom, CAST(m0 AS DOUBLE) AS volume, sov_growth FROM ho JOIN wn ON ho.entity = wn.entity LEFT JOIN sov ON ho.entity = sov.entity),
lg AS (SELECT 'wow' AS predictor, ratio, wow AS x FROM jn UNION ALL SELECT 'mom', ratio, mom FROM jn UNION ALL SELECT 'volume', ratio, volume FROM jn UNION ALL SELECT 'sov_growth', ratio, sov_growth FROM jn),
md AS (SELECT predictor, median(x) AS mid FROM lg WHERE x IS NOT NULL GROUP BY predictor), v AS (SELECT lg.predictor, ratio AS value, CASE WHEN x > mid THEN 0 ELSE 1 END AS grp FROM lg JOIN md ON lg.predictor = md.predictor WHERE x IS NOT NULL),
ra AS (SELECT predictor, avg(CASE WHEN grp = 0 THEN 1 ELSE 0 END) AS pass_rate FROM v GROUP BY predictor), {mw_sql('v', 'predictor')}
SELECT mw.predictor, n1, n2, round(u, 6) AS u, round(z, 6) AS z, round(p, 6) AS p, round(pass_rate, 6) AS pass_rate FROM mw JOIN ra ON mw.predictor = ra.predictor""")
def k5(spark, d):
    return rounded(Y.predictor_study(study_days(spark, d)), "u", "z", "p", "pass_rate")


def cases(spark, d):
    days = study_days(spark, d, authors=True)
    past = Y.before_cut(days)
    t = G.permutation_test_sql(B.daily_series(past), 20)
    return flagged(days).join(t, "entity").join(G.source_breadth(past), "entity")


_SWEEP = ", ".join(f"('{n}', {b}, {a}, {p}, {str(s).lower()}, {str(r).lower()})" for n, b, a, p, s, r in Y.VARIANTS)


@query("k6_variant_sweep", f"""{with_links('p_name')}, {_HOLD}, {_PAST}, {_SERIES.format(n=179).replace("FROM buckets", "FROM past")}, {_HASHED}, {_BREADTH.replace("FROM buckets", "FROM past")}, vr(variant, bits, authors, alpha, use_sig, use_breadth) AS (VALUES {_SWEEP}),
cs AS (SELECT ratio, p_value, entropy_bits, total_authors FROM ho JOIN hashed h ON ho.entity = h.entity JOIN breadth b ON ho.entity = b.entity),
v AS (SELECT variant, ratio AS value, CASE WHEN (NOT use_sig OR p_value <= alpha) AND (NOT use_breadth OR (entropy_bits >= bits AND total_authors >= authors)) THEN 0 ELSE 1 END AS grp FROM cs, vr),
eg AS (SELECT variant, median(value) FILTER (grp = 0) / median(value) FILTER (grp = 1) AS edge FROM v GROUP BY variant), {mw_sql('v', 'variant')}
SELECT mw.variant, n1, n2, round(u, 6) AS u, round(z, 6) AS z, round(p, 6) AS p, round(edge, 6) AS edge FROM mw JOIN eg ON mw.variant = eg.variant""")
def k6(spark, d):
    return rounded(Y.variant_sweep(cases(spark, d)), "u", "z", "p", "edge")


@query("k7_significance_diagnostics", f"""{with_links('p_name')}, {_HOLD} SELECT flag AS breadth_pass, count(*) AS n, round(avg(CASE WHEN post % 2 = 0 THEN 1 ELSE 0 END), 6) AS pass_rate, round(median(ratio) FILTER (post % 2 = 0), 6) AS growth_pass, round(median(ratio) FILTER (post % 2 <> 0), 6) AS growth_fail FROM ho GROUP BY flag""")
def k7(spark, d):
    h = holdout(spark, d).withColumn("breadth_pass", F.col("flag")).withColumn("significance_pass", F.col("post") % 2 == 0)
    return rounded(Y.significance_diagnostics(h), "pass_rate", "growth_pass", "growth_fail")


@query("k8_normalised_slope", f"WITH {links_sql('p_name')}, {INTEREST}, i AS (SELECT keyword, interest_value AS v, row_number() OVER (PARTITION BY keyword ORDER BY bucket_date) - 1 AS i FROM interest) SELECT keyword AS entity, count(*) AS n, CASE WHEN count(*) >= 4 AND avg(v) > 0 THEN round(regr_slope(v, i) / avg(v), 9) END AS slope FROM i GROUP BY keyword")
def k8(spark, d):
    s = interest(spark, d).select(F.col("keyword").alias("entity"), F.col("bucket_date").alias("at"), F.col("interest_value").alias("value"))
    return rounded(Y.normalised_slope(s), "slope", n=9)


@query("k9_pre_post_ratio", f"WITH {links_sql('p_name')}, {INTEREST}, s AS (SELECT keyword AS entity, count(*) FILTER (bucket_date - DATE '2001-06-01' BETWEEN -55 AND 0) AS na, count(*) FILTER (bucket_date - DATE '2001-06-01' BETWEEN 1 AND 56) AS nb, avg(interest_value) FILTER (bucket_date - DATE '2001-06-01' BETWEEN -55 AND 0) AS before, avg(interest_value) FILTER (bucket_date - DATE '2001-06-01' BETWEEN 1 AND 56) AS after FROM interest GROUP BY ALL) SELECT entity, round(before, 6) AS before, round(after, 6) AS after, CASE WHEN na >= 4 AND nb >= 4 AND before > 0 THEN round(after / before, 6) END AS ratio FROM s")
def k9(spark, d):
    s = interest(spark, d).select(F.col("keyword").alias("entity"), F.col("bucket_date").alias("at"), F.col("interest_value").alias("value"))
    return rounded(Y.pre_post_ratio(s, datetime.date(2001, 6, 1), 56), "before", "after", "ratio")


@query("k10_interest_crosscheck", f"""WITH {links_sql('p_name')}, {INTEREST}, {ENTITIES}, sp AS (SELECT keyword AS entity, count(*) FILTER (bucket_date - DATE '2001-06-01' BETWEEN -55 AND 0) AS na, count(*) FILTER (bucket_date - DATE '2001-06-01' BETWEEN 1 AND 56) AS nb,
avg(interest_value) FILTER (bucket_date - DATE '2001-06-01' BETWEEN -55 AND 0) AS before, avg(interest_value) FILTER (bucket_date - DATE '2001-06-01' BETWEEN 1 AND 56) AS after FROM interest GROUP BY ALL),
tj AS (SELECT CAST(id % 2 AS INT) AS grp, id % 5 = 0 AS calendar, CASE WHEN na >= 4 AND nb >= 4 AND before > 0 THEN after / before END AS value FROM entities e LEFT JOIN sp ON e.entity = sp.entity),
v AS (SELECT 'all' AS arm, grp, value FROM tj UNION ALL SELECT 'no_calendar', grp, value FROM tj WHERE NOT calendar), {mw_sql('v', 'arm')},
md AS (SELECT arm, median(value) FILTER (grp = 0) AS surfaced, median(value) FILTER (grp = 1) AS controls, count(*) FILTER (value IS NULL AND grp = 0) AS missing_surfaced, count(*) FILTER (value IS NULL AND grp = 1) AS missing_controls FROM v GROUP BY arm)
SELECT md.arm, round(surfaced, 6) AS surfaced, round(controls, 6) AS controls, missing_surfaced, missing_controls, n1, n2, round(u, 6) AS u, round(z, 6) AS z, round(p, 6) AS p, n1 < 8 OR n2 < 8 AS underpowered FROM md JOIN mw ON md.arm = mw.arm""")
def k10(spark, d):
    s = interest(spark, d).select(F.col("keyword").alias("entity"), F.lit(datetime.date(2001, 8, 2)).alias("fetched_at"), F.col("bucket_date").alias("at"), F.col("interest_value").alias("value"))
    t = entities(spark, d).select("entity", (F.col("id") % 2).cast("int").alias("grp"), F.lit("en").alias("language"), F.lit(True).alias("ok"), (F.col("id") % 5 == 0).alias("calendar"))
    return rounded(Y.interest_crosscheck(t, s, datetime.date(2001, 6, 1), 56), "surfaced", "controls", "u", "z", "p")


_BENCH = """bn AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) WHEN p_partkey % 3 = 1 THEN p_name || ' deluxe' ELSE 'no such ' || p_brand END AS name FROM part),
be AS (SELECT entity, id FROM entities), bx AS (SELECT name, lower(name) AS k FROM bn), bm AS (SELECT name, coalesce((SELECT min(entity) FROM be WHERE be.entity = k), (SELECT min(entity) FROM be WHERE contains(be.entity, k) OR contains(k, be.entity))) AS entity FROM bx),
bo AS (SELECT bm.name, bm.entity, CASE WHEN bm.entity IS NULL THEN 'not-found' WHEN id % 4 = 0 THEN 'held-no-signal' WHEN id % 4 = 1 THEN 'confirmed' ELSE 'held-flat' END AS outcome FROM bm LEFT JOIN be ON bm.entity = be.entity)"""


def bench(spark, d):
    k = F.col("p_partkey") % 3
    return table(spark, d, "part").select(F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat("p_name", F.lit(" deluxe"))).otherwise(F.concat(F.lit("no such "), "p_brand")).alias("name")).distinct()


@query("d10_match_benchmark", f"WITH {ENTITIES}, {_BENCH} SELECT name, entity FROM bm")
def d10(spark, d):
    return Y.match_benchmark(bench(spark, d), entities(spark, d))


def outcomes(spark, d):
    e = entities(spark, d)
    v = e.select("entity", (F.col("id") % 4 != 0).alias("had_data"), F.when(F.col("id") % 4 == 1, "pass").otherwise("hold").alias("decision"))
    return Y.benchmark_outcomes(Y.match_benchmark(bench(spark, d), e), v)


@query("k11_benchmark_outcomes", f"WITH {ENTITIES}, {_BENCH} SELECT name, entity, outcome FROM bo")
def k11(spark, d):
    return outcomes(spark, d).select("name", "entity", "outcome")


@query("k11_outcome_tallies", f"WITH {ENTITIES}, {_BENCH} SELECT 'pass' AS expected, outcome, count(*) AS n FROM bo GROUP BY outcome")
def k11t(spark, d):
    return Y.outcome_tallies(outcomes(spark, d).withColumn("expected", F.lit("pass")))


@query("k12_label_checks", f"{with_links('p_name')}, {_ST}, s AS (SELECT entity, max(CASE WHEN volume_30d > 1 THEN 1 ELSE 0 END) AS p, max(volume_7d) AS m FROM ss GROUP BY entity), e AS (SELECT DISTINCT p_name AS entity, CASE WHEN p_name < 'm' THEN 'pass' ELSE 'hold' END AS expected FROM part) SELECT e.entity, expected, CASE WHEN coalesce(p, 0) = 1 THEN 'pass' ELSE 'hold' END AS got, CASE WHEN coalesce(p, 0) = 1 THEN 'pass' ELSE 'hold' END = expected AS match, m IS NULL OR m < 2 AS stale FROM e LEFT JOIN s ON e.entity = s.entity")
def k12(spark, d):
    now = datetime.datetime(2001, 8, 1, 12)
    s = simple_states(spark, d).select("entity", F.when(F.col("volume_30d") > 1, "pass").otherwise("hold").alias("decision"), F.when(F.col("volume_7d") >= 2, F.lit(now)).otherwise(F.lit(datetime.datetime(2001, 7, 1))).alias("checked_at"))
    e = table(spark, d, "part").select(F.col("p_name").alias("entity"), F.when(F.col("p_name") < "m", "pass").otherwise("hold").alias("expected")).distinct()
    return Y.label_checks(s, e, now)


@query("k13_judge_accuracy", """WITH t AS (SELECT quality = toxic AS correct, doc_id % 4 AS grp, toxic AS expected, doc_id % 3 = 0 AS held_out FROM labels WHERE doc_id % 11 <> 0), u AS (SELECT correct, 'overall' AS "grouping", 'all' AS value FROM t UNION ALL SELECT correct, 'group', CAST(grp AS VARCHAR) FROM t UNION ALL SELECT correct, 'expected', CAST(expected AS VARCHAR) FROM t UNION ALL SELECT correct, 'held_out', CAST(held_out AS VARCHAR) FROM t)
SELECT "grouping", value, count(*) FILTER (correct) AS "right", count(*) AS trials, round(count(*) FILTER (correct) / count(*), 6) AS accuracy FROM u GROUP BY ALL""")
def k13(spark, d):
    k = table(spark, d, "labels")
    t = k.select((F.col("quality") == F.col("toxic")).alias("correct"), (F.col("doc_id") % 4).alias("grp"), F.col("toxic").alias("expected"), (F.col("doc_id") % 3 == 0).alias("held_out"), (F.col("doc_id") % 11 == 0).alias("ambiguous"))
    return rounded(Y.judge_accuracy(t), "accuracy")


_ARMS = "ar AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'old' ELSE 'new' END AS arm, CASE WHEN doc_id % 13 = 0 THEN 'error' WHEN quality = 0 THEN 'instance' ELSE 'category' END AS kind FROM labels), rt AS (SELECT arm, count(*) FILTER (kind <> 'error') AS n, count(*) FILTER (kind = 'instance') / nullif(count(*) FILTER (kind <> 'error'), 0) AS instance_rate, count(*) FILTER (kind = 'error') AS errors FROM ar GROUP BY arm)"


def arms(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "labels").select(F.when(k % 2 == 0, "old").otherwise("new").alias("arm"), F.when(k % 13 == 0, "error").when(F.col("quality") == 0, "instance").otherwise("category").alias("kind"))


@query("k14_bucket_rates", f"WITH {_ARMS} SELECT arm, n, round(instance_rate, 6) AS instance_rate, errors FROM rt")
def k14(spark, d):
    return rounded(Y.bucket_rates(arms(spark, d)), "instance_rate")


@query("k14_half_rate_gate", f"WITH {_ARMS} SELECT round(max(instance_rate) FILTER (arm = 'old'), 6) AS old_rate, round(max(instance_rate) FILTER (arm = 'new'), 6) AS new_rate, max(instance_rate) FILTER (arm = 'new') <= max(instance_rate) FILTER (arm = 'old') / 2 AS passes FROM rt")
def k14g(spark, d):
    return rounded(Y.half_rate_gate(Y.bucket_rates(arms(spark, d))), "old_rate", "new_rate")


@query("k15_gate_cases", f"""{with_links()}, {_SERIES.format(n=59)}, {_HASHED}, {_BREADTH}, g AS (SELECT h.entity, CASE WHEN significance_pass AND round(entropy_bits, 9) >= 1.0 AND total_authors >= 10 THEN 'pass' ELSE 'hold' END AS decision FROM hashed h LEFT JOIN breadth b ON h.entity = b.entity)
SELECT entity, 'hold' AS expected, decision, decision = 'hold' AS match FROM g""")
def k15(spark, d):
    b = buckets(spark, d)
    s = B.daily_series(b, 60).groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket_date", "mentions"))), lambda x: x["mentions"]).alias("daily"))
    src = b.groupBy("entity", "platform").agg(F.sum("unique_authors").alias("unique_authors"), F.sum("mentions").alias("mentions")).groupBy("entity").agg(F.collect_list(F.struct("platform", "unique_authors", "mentions")).alias("sources"))
    c = s.join(src, "entity").select(F.col("entity").alias("name"), F.lit("hold").alias("expected"), "daily", "sources")
    return G.gate_cases(c, 20, test=G.permutation_test_sql)


@query("e27_dominant_language", "WITH c AS (SELECT source AS entity, lang AS language, count(*) AS n FROM documents GROUP BY ALL) SELECT entity, arg_min(language, (-n, language)) AS language FROM c GROUP BY entity")
def e27(spark, d):
    x = table(spark, d, "documents")
    return Y.dominant_language(x.select(F.col("doc_id").alias("signal_id"), F.col("source").alias("entity")), x.select(F.col("doc_id").alias("signal_id"), F.col("lang").alias("language")))


_VOL = "vo AS (SELECT o_custkey AS entity, count(*) AS volume FROM orders GROUP BY o_custkey)"


def volume(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("volume"))


_NEAREST = """vs AS (SELECT 0 AS side, entity, volume FROM vo WHERE entity % 3 = 0 UNION ALL SELECT 1, entity, volume FROM vo WHERE entity % 3 = 1 AND entity % 2 = 0),
hv AS (SELECT volume, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM vs GROUP BY volume),
hs AS (SELECT *, coalesce(sum(a - b) OVER (ORDER BY volume ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM hv),
rk AS (SELECT vs.*, a, b, s, row_number() OVER (PARTITION BY vs.volume, side ORDER BY entity) - 1 AS n FROM vs JOIN hs ON vs.volume = hs.volume),
eq AS (SELECT c.entity, c.volume, p.entity AS control, p.volume AS control_volume FROM rk c JOIN rk p ON c.volume = p.volume AND c.n = p.n WHERE c.side = 0 AND p.side = 1),
lv AS (SELECT side, entity, volume, CASE WHEN side = 0 THEN s + n - least(a, b) ELSE s - (n - least(a, b)) - 1 END AS level FROM rk WHERE n >= least(a, b)),
ch AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY volume) AS i, count(*) OVER (PARTITION BY level) AS m FROM lv),
cost AS (SELECT x.level, x.i, sum(CASE WHEN y.i < x.i THEN (CASE WHEN y.i % 2 = 0 THEN y.volume ELSE -y.volume END) WHEN y.i > x.i THEN (CASE WHEN y.i % 2 = 1 THEN y.volume ELSE -y.volume END) ELSE 0 END) AS c
  FROM ch x JOIN ch y ON x.level = y.level WHERE x.m % 2 = 1 AND x.i % 2 = 1 GROUP BY x.level, x.i),
gone AS (SELECT level, arg_min(i, (c, i)) AS o FROM cost GROUP BY level),
pr AS (SELECT side, entity, volume, ch.level, (i - CASE WHEN o IS NOT NULL AND i > o THEN 2 ELSE 1 END) // 2 AS k FROM ch LEFT JOIN gone ON ch.level = gone.level WHERE o IS NULL OR i <> o)"""


@query("d12_match_controls", f"WITH {_VOL}, {_NEAREST} SELECT * FROM eq UNION ALL SELECT c.entity, c.volume, p.entity, p.volume FROM pr c JOIN pr p ON c.level = p.level AND c.k = p.k WHERE c.side = 0 AND p.side = 1")
def d12(spark, d):
    v = volume(spark, d)
    return Y.match_controls(v.where("entity % 3 = 0"), v.where("entity % 3 = 1 and entity % 2 = 0"))  # fewer controls than cases


@query("f8_systematic_sample", f"WITH {_VOL}, r AS (SELECT *, row_number() OVER (ORDER BY volume, entity) - 1 AS i, greatest(count(*) OVER () // 40, 1) AS s FROM vo) SELECT entity, volume FROM r WHERE i % s = 0 AND i // s < 40")
def f8(spark, d):
    return Y.systematic_sample(volume(spark, d), 40)


@query("g3_bottom_k_overlap", "WITH b AS (SELECT p_brand AS grp, p_name AS label, sum(p_size) AS breadth FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY breadth, label) AS n FROM b) SELECT grp, label, breadth FROM r WHERE n <= 3 AND label IN (SELECT p_name FROM part WHERE p_size = 2)")
def g3(spark, d):
    p = table(spark, d, "part")
    b = p.groupBy(F.col("p_brand").alias("grp"), F.col("p_name").alias("label")).agg(F.sum("p_size").alias("breadth"))
    return Y.bottom_k_overlap(b, p.where("p_size = 2").select(F.col("p_name").alias("label")).distinct())


# -- sources -------------------------------------------------------------------------------------


def landed(spark, d, shape: str = "all"):
    """Events and documents as landed JSON items of all platforms."""
    e = table(spark, d, "events").join(table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), F.col("text").alias("t")), "event_id", "left")
    k, sec = F.col("event_id"), F.unix_timestamp("ts")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    likes, few = F.round("value").cast("long"), k % 7
    s = lambda **c: F.to_json(F.struct(*[v.alias(n) for n, v in c.items()]))
    raw = {
        "instagram": s(id=k, caption=F.col("t"), timestamp=iso, ownerUsername=user, ownerFollowersCount=k * 37, likesCount=likes, commentsCount=few),
        "tiktok": s(id=k, text=F.col("t"), createTime=sec, authorMeta=F.struct(user.alias("name"), (k * 11).alias("fans")), diggCount=likes, commentCount=few, hashtags=F.array(F.struct(F.lit("a").alias("name")))),
        "reddit": s(id=k.cast("string"), title=F.lit("Title"), selftext=F.col("t"), created_utc=sec, author=user, score=likes, num_comments=few, permalink=F.concat(F.lit("/r/"), k.cast("string"))),
        "x": s(id=k.cast("string"), full_text=F.col("t"), createdAt=iso, author=F.struct(user.alias("username")), likeCount=likes, replyCount=few),
        "youtube": s(id=k.cast("string"), title=F.lit("Video"), description=F.col("t"), date=iso, channelName=user, likes=likes, commentsCount=few),
        "xiaohongshu": s(noteId=k, title=F.col("t"), time=sec, user=F.struct(user.alias("nickname"), k.alias("fans")), likedCount=likes, commentCount=few, collected=few),
    }
    names = list(raw)
    platform = F.element_at(F.array(*[F.lit(n) for n in names], F.lit("pinterest")), (k % 7 + 1).cast("int"))
    pick = F.lit("[1, 2]")
    for n, c in raw.items():
        pick = F.when(platform == n, c).otherwise(pick)
    return A.parse_items(e.select(k.alias("event_id"), platform.alias("platform"), pick.alias("raw")))


@query("a1_item_stats", "SELECT ['instagram', 'tiktok', 'reddit', 'x', 'youtube', 'xiaohongshu', 'pinterest'][event_id % 7 + 1] AS platform, count(*) AS items, count(*) FILTER (event_id % 7 = 6) AS dropped FROM events GROUP BY ALL")
def a1(spark, d):
    return A.item_stats(landed(spark, d))


_NORMAL = """n AS (SELECT event_id, ['instagram', 'tiktok', 'reddit', 'x', 'youtube', 'xiaohongshu'][event_id % 7 + 1] AS platform, 'u' || user_id AS author, CAST(round(value) AS BIGINT) AS l, event_id % 7 AS c, date_trunc('second', ts) AS posted_at, d.text AS t FROM events LEFT JOIN documents d ON doc_id = event_id WHERE event_id % 7 < 6)
SELECT platform, CAST(event_id AS VARCHAR) AS source_id, author, posted_at, CAST(l + c * CASE platform WHEN 'instagram' THEN 3 WHEN 'tiktok' THEN 5 WHEN 'reddit' THEN 2 WHEN 'x' THEN 0 WHEN 'youtube' THEN 2 ELSE 7 END AS BIGINT) AS score,
CASE WHEN platform NOT IN ('instagram', 'tiktok', 'xiaohongshu') THEN 'nano' ELSE CASE WHEN f < 1000 THEN 'nano' WHEN f < 10000 THEN 'micro' WHEN f < 100000 THEN 'mid' WHEN f < 1000000 THEN 'macro' ELSE 'mega' END END AS author_tier,
md5(nullif(CASE platform WHEN 'reddit' THEN concat_ws(' ', 'Title', nullif(t, '')) WHEN 'youtube' THEN concat_ws(' ', 'Video', nullif(t, '')) ELSE t END, '')) AS text_md5, CASE platform WHEN 'tiktok' THEN ['a'] ELSE [] END AS hashtags, false AS verified
FROM (SELECT *, event_id * CASE platform WHEN 'instagram' THEN 37 WHEN 'tiktok' THEN 11 ELSE 1 END AS f FROM n)"""


def _told(signals):
    return signals.select("platform", "source_id", "author", "posted_at", "score", "author_tier", F.md5(F.col("text").cast("binary")).alias("text_md5"), "hashtags", "verified")


def _normal(platform: str):
    def run(spark, d):
        return _told(A.normalize_platform(landed(spark, d), platform))

    return run


for _id, _platform in (("b1", "instagram"), ("b2", "tiktok"), ("b3", "reddit"), ("b4", "x"), ("b5", "youtube"), ("b6", "xiaohongshu")):
    query(f"{_id}_normalize_{_platform}", f"WITH {_NORMAL} WHERE platform = '{_platform}'")(_normal(_platform))


@query("b7_normalize", f"WITH {_NORMAL}")
def b7(spark, d):
    return _told(A.normalize(landed(spark, d)))


def interest_items(spark, d):
    """Interest items in the shapes that scrapers give, from daily values."""
    i = interest(spark, d)
    g = i.groupBy("keyword", F.trunc("bucket_date", "month").alias("m")).agg(F.array_sort(F.collect_list(F.struct(F.date_format("bucket_date", "yyyy-MM-dd").alias("date"), F.col("interest_value").alias("v")))).alias("p"))
    g = g.withColumn("h", F.pmod(F.instr(F.lit("0123456789abcdef"), F.substring(F.md5(F.concat("keyword", F.col("m").cast("string"))), 1, 1)), F.lit(5)))
    one = lambda f: F.transform("p", f)
    shapes = [
        F.struct(F.lit("US").alias("geo"), one(lambda x: F.struct(x["date"].alias("date"), F.array(F.struct(F.col("keyword").alias("keyword"), x["v"].alias("value"))).alias("values"))).alias("interestOverTime")),
        F.struct(F.array("keyword").alias("keywords"), one(lambda x: F.struct(x["date"].alias("date"), F.array(x["v"]).alias("values"))).alias("data")),
        F.struct(F.col("keyword").alias("searchTerm"), one(lambda x: F.struct(x["date"].alias("time"), F.array(x["v"]).alias("value"))).alias("timelineData")),
        F.struct(F.col("keyword").alias("term"), one(lambda x: F.struct(x["date"].alias("date"), x["v"].alias("value"))).alias("interest_over_time")),
        F.struct(F.col("keyword").alias("keyword"), F.element_at("p", 1)["date"].alias("date"), F.element_at("p", 1)["v"].alias("value")),
    ]
    raw = F.to_json(shapes[4])
    for n in range(4):
        raw = F.when(F.col("h") == n, F.to_json(shapes[n])).otherwise(raw)
    return A.parse_items(g.select(F.concat("keyword", F.col("m").cast("string")).alias("item_id"), "h", raw.alias("raw"), F.lit("trends").alias("platform")))


_II = f"""WITH {links_sql('p_name')}, {INTEREST}, i AS (SELECT keyword, bucket_date, interest_value, keyword || CAST(date_trunc('month', bucket_date) AS DATE) AS item_id, row_number() OVER (PARTITION BY keyword, date_trunc('month', bucket_date) ORDER BY bucket_date) AS rn FROM interest),
g AS (SELECT *, strpos('0123456789abcdef', substr(md5(item_id), 1, 1)) % 5 AS h FROM i)"""


@query("b11_interest_flat", f"{_II} SELECT item_id, keyword, '' AS geo, bucket_date, interest_value FROM g WHERE h = 4 AND rn = 1")
def b11(spark, d):
    return A.interest_flat(interest_items(spark, d))


@query("b12_interest_series", f"{_II} SELECT item_id, keyword, CASE WHEN h = 0 THEN 'US' ELSE '' END AS geo, bucket_date, interest_value FROM g WHERE h < 4")
def b12(spark, d):
    return A.interest_series(interest_items(spark, d))


@query("b11_b12_interest_rows", f"WITH {links_sql('p_name')}, {INTEREST}, k AS (SELECT keyword, date_trunc('month', bucket_date) AS m, count(*) AS n FROM interest GROUP BY ALL) SELECT keyword, count(*) AS items FROM k GROUP BY keyword")
def b1112(spark, d):
    i = interest_items(spark, d)
    rows = A.interest_flat(i).unionByName(A.interest_series(i))
    return rows.groupBy("keyword").agg(F.count_distinct("item_id").alias("items"))


@query("a13_explode_payload", "SELECT c_custkey AS candidate_id, 0 AS place, c_mktsegment AS topic, lang AS language, [c_name] AS keywords FROM customer, (SELECT unnest(['en', 'fr']) AS lang) WHERE c_custkey % 3 <> 0")
def a13(spark, d):
    q = lambda lang: F.struct(F.lit(lang).alias("language"), F.array("c_name").alias("keywords"))
    t = F.struct(F.col("c_mktsegment").alias("topic"), F.when(F.col("c_custkey") % 3 == 0, "killed").alias("status"), F.array(q("en"), q("fr")).alias("queries"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("candidate_id"), F.to_json(F.array(t)).alias("payload"))
    return A.explode_payload(c)


@query("a2_read_benchmark", "SELECT p_name AS name, p_type AS description, 'pass' AS expected, [p_brand] AS sheets, count(*) AS n FROM part GROUP BY p_name, p_type, p_brand")
def a2(spark, d):
    path = _shared(spark, "benchmark")
    entry = F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.lit("pass").alias("expected"), F.array("p_brand").alias("sheets"))
    p = table(spark, d, "part").groupBy(F.col("p_brand").alias("sheet")).agg(F.to_json(F.collect_list(entry)).alias("value"))
    p.write.partitionBy("sheet").text(path)  # one array per file
    return A.read_benchmark(spark, path).groupBy("name", "description", "expected", "sheets").agg(F.count("*").alias("n"))


@query("a6_replace_snapshot", f"""{with_links()} SELECT platform, CAST(count(*) AS BIGINT) AS n, CAST(sum(mentions) AS BIGINT) AS mentions FROM buckets WHERE platform NOT IN ('5-LOW', '2-HIGH') OR platform = '5-LOW' AND mentions > 1 GROUP BY platform""")
def a6(spark, d):
    """Two platforms are replaced; one of them has no rows any more."""
    tables, b = TableSet(spark, _shared(spark, "snapshot")), buckets(spark, d)
    K.replace_snapshot(tables, "buckets", b, by="platform")
    K.replace_snapshot(tables, "buckets", b.where("platform = '5-LOW' and mentions > 1"), ["5-LOW", "2-HIGH"])
    return tables.read("buckets").groupBy("platform").agg(F.count("*").alias("n"), F.sum("mentions").alias("mentions"))


# -- streams ---------------------------------------------------------------------------------------


def _staged(df, name):
    path = _shared(df.sparkSession, name)
    df.write.parquet(path)
    return path


def ingested(spark, d):
    """Landed items in runs of one platform, as text files by run; the runs come in two halves, and the first half comes twice."""
    src, come, ck = (_shared(spark, n) for n in ("landed", "runs", "ck"))
    run = (F.col("event_id") % 7 * 100 + F.col("event_id") % 5).cast("int").alias("run_id")
    items = landed(spark, d).select(run, "platform", "raw")
    items.select("run_id", "raw").write.partitionBy("run_id").text(src)
    runs, tables = items.select(F.lit(1).alias("tenant"), "run_id", "platform").distinct(), TableSet(spark, _shared(spark, "signals"))
    read = lambda s, ids: s.read.text(src).where(F.col("run_id").isin(ids)).select("run_id", F.col("value").alias("raw"))
    for half in ("run_id % 2 = 0", "run_id % 2 = 1 or run_id = 0", "run_id % 2 = 0"):
        runs.where(half).coalesce(1).write.mode("append").parquet(come)
        jobs.stream_ingest(jobs.read_stream(spark, come, runs.schema), read, tables, ck).awaitTermination()
    return tables


@query("l1_stream_ingest", f"WITH {_NORMAL}")
def l1(spark, d):
    return _told(ingested(spark, d).read("signals"))


@query("l1_run_ledger", "SELECT CAST(event_id % 7 * 100 + event_id % 5 AS INT) AS run_id, count(*) AS items, count(*) FILTER (event_id % 7 = 6) AS malformed, count(*) FILTER (event_id % 7 < 6) AS inserted FROM events GROUP BY ALL")
def l1_ledger(spark, d):
    return ingested(spark, d).read("ledger").select("run_id", "items", "malformed", "inserted")


@query("l2_stream_dedupe", "SELECT DISTINCT event_id % 2000 AS source_id FROM events")
def l2(spark, d):
    e = table(spark, d, "events").select(F.lit(1).alias("tenant"), F.col("event_type").alias("platform"), (F.col("event_id") % 2000).alias("source_id"), F.col("ts").alias("posted_at"))
    e = e.withColumn("platform", F.lit("x"))
    src, out = _staged(e, "events"), _shared(spark, "deduped")
    s = jobs.stream_dedupe(jobs.read_stream(spark, src, e.schema), "60 days")
    s.writeStream.format("parquet").option("path", out).option("checkpointLocation", _shared(spark, "ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("source_id")


@query("l3_stream_day_buckets", """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS entity, CAST(ts AS DATE) AS bucket_date, event_type AS platform, count(*) AS mentions, count(DISTINCT user_id) AS unique_authors,
round(coalesce(sum(value) FILTER (value > 0), 0), 4) AS engagement_sum, round(coalesce(median(value) FILTER (value > 0), 0), 6) AS engagement_median FROM events GROUP BY ALL""")
def l3(spark, d):
    """Files hold events of all days, so every batch re-opens the days of those before."""
    e = event_links(spark, d).withColumnRenamed("entity_id", "entity").select("signal_id", "entity", "platform", "geography", "author", "engagement", "posted_on")
    src, tables = _shared(spark, "links"), TableSet(spark, _shared(spark, "buckets"))
    e.repartition(4, "signal_id").write.parquet(src)
    s = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(src)
    jobs.stream_day_buckets(s, tables, _shared(spark, "ck")).awaitTermination()
    b = tables.read("buckets").select("entity", "bucket_date", "platform", "mentions", "unique_authors", "engagement_sum", "engagement_median")
    return rounded(rounded(b, "engagement_sum", n=4), "engagement_median")


#: Every day of an entity from a mention to the day before the next, or for 90 days, or to the last day but one of all; the 90 days before it as a sorted list, folded to greedy weeks.
_DAILY = """dd AS (SELECT n_name || '/' || c_mktsegment AS entity, CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS BIGINT) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
ed AS (SELECT max(day) - 1 AS as_of FROM dd),
nx AS (SELECT *, lag(day) OVER (PARTITION BY entity ORDER BY day) AS bef, lead(day) OVER (PARTITION BY entity ORDER BY day) AS nxt FROM dd),
ev AS (SELECT entity, day AS last, bef, CAST(unnest(generate_series(day, greatest(day, least(coalesce(nxt - 1, as_of), CAST(day + 90 AS DATE))), INTERVAL 1 DAY)) AS DATE) AS day FROM nx, ed),
hs AS (SELECT ev.entity, ev.day, ev.last, ev.bef, sum(b.m) FILTER (ev.day - b.day <= 7) AS v7, sum(b.m) FILTER (ev.day - b.day <= 30) AS v30, sum(b.m) AS v90, list({'first': b.day, 'prev': CAST(0 AS BIGINT), 'this': b.m} ORDER BY b.day) AS ds
  FROM ev JOIN dd b ON ev.entity = b.entity AND b.day <= ev.day AND ev.day - b.day <= 90 GROUP BY ALL),
gw AS (SELECT *, list_reduce(ds, lambda a, x: CASE WHEN x.first - a.first >= 7 THEN {'first': x.first, 'prev': a.this, 'this': x.this} ELSE {'first': a.first, 'prev': a.prev, 'this': a.this + x.this} END) AS w FROM hs),
mt AS (SELECT entity, day, day = last AS active, day = last AND (bef IS NULL OR day - bef > 90) AS fresh, coalesce(v7, 0) AS v7, coalesce(v30, 0) AS v30, v90, w.prev AS prev, w.this AS this FROM gw),
"""


@query("l4_stream_states", f"""WITH RECURSIVE {_DAILY}me AS (SELECT *, {growth('prev', 'this')} AS wow, {growth('(CASE WHEN v30 > 0 THEN (v90 - v30) / 2 ELSE 0 END)', 'v30')} AS mom FROM mt),
ls(entity, day, active, was, state) AS (SELECT entity, day, active, cur, {STATE} FROM (SELECT *, 'candidate' AS cur FROM me WHERE fresh) UNION ALL
  SELECT entity, day, active, cur, {STATE} FROM (SELECT me.*, ls.state AS cur FROM ls JOIN me ON ls.entity = me.entity AND me.day = ls.day + 1 AND NOT me.fresh))
SELECT entity, day AS bucket_date, state, active FROM ls WHERE active OR state <> was""")
def l4(spark, d):
    """Order lines a day by nation and segment of the customer; the first half of the days is a batch, the second another, with the stream stopped between them."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    j = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    e = j.groupBy(F.concat_ws("/", "n_name", "c_mktsegment").alias("entity"), F.to_date("o_orderdate").alias("bucket_date")).agg(F.count("*").alias("mentions"))
    src, out, ck = (_shared(spark, x) for x in ("daily", "states", "ck"))
    for half in ("bucket_date < '1998-05-01'", "bucket_date >= '1998-05-01'"):
        e.where(half).write.mode("append").parquet(src)
        s = jobs.stream_states(jobs.read_stream(spark, src, e.schema))
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def run_links(spark, d):
    """Links of succeeded runs (orders of status F), with the run's tenant; a tenant's brands are entities of its own."""
    done = runs(spark, d).where("status = 'succeeded'").select(F.col("run_id").alias("signal_id"), F.col("tenant").alias("_t"))
    j = links(spark, d).join(done, "signal_id")
    return j.withColumn("tenant", F.col("_t")).withColumn("run_id", F.col("signal_id")).withColumn("entity", F.concat_ws("|", F.col("_t").cast("string"), "entity")).drop("_t")


def refreshed(spark, d):
    """Tables after a stream of runs in two halves, each a batch of its own, from the states of a month before. Links land once, as a table that every step reads."""
    made = run_links(spark, d).select("tenant", "run_id", "signal_id", "entity", "platform", "geography", "posted_on", "author", "engagement")
    every, r = spark.read.schema(made.schema).parquet(_staged(made, "landed")), runs(spark, d).select("tenant", "run_id", "status")
    was = B.day_buckets(every.where("posted_on <= '2001-07-01'"), by=("tenant",))
    none = was.where("false").select("entity", "geography", F.lit("").alias("state"), F.col("bucket_date").alias("entered_on"))
    before = H.run_states(was, none, datetime.date(2001, 7, 1)).select(F.substring_index("entity", "|", 1).cast("int").alias("tenant"), "entity", "geography", "state", "entered_on")
    tables, src, ck = TableSet(spark, _shared(spark, "refreshed")), _shared(spark, "runs"), _shared(spark, "ck")
    tables.change().replace("prior", before, "tenant").commit()
    tasks = tasks_of(spark, every.count())
    for half in ("run_id % 2 = 0", "run_id % 2 = 1"):
        r.where(half).coalesce(1).write.mode("append").parquet(src)
        jobs.stream_refresh(jobs.read_stream(spark, src, r.schema), lambda s: every, tables, AS_OF, ck, tasks).awaitTermination()
    return tables


_REFRESH = f"""{links_sql(name='ln0')}, links AS (SELECT * REPLACE (CAST(signal_id % 3 AS VARCHAR) || '|' || entity AS entity) FROM ln0 WHERE signal_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')), {BUCKETS_SQL}"""


@query("l5_stream_refresh", f"""WITH RECURSIVE {_REFRESH}, {_RUN} SELECT CAST(split_part(entity, '|', 1) AS INT) AS tenant, entity, geography, state, reason, cur AS previous, v7 AS volume_7d, v30 AS volume_30d, v90 AS volume_90d, round(wow, 6) AS growth_wow, round(mom, 6) AS growth_mom,
CASE WHEN old IS NULL OR state <> cur THEN {X} ELSE DATE '2001-07-01' END AS entered_on, state <> cur AS transitioned FROM st""")
def l5(spark, d):
    return rounded(refreshed(spark, d).read("states"), "growth_wow", "growth_mom")


@query("l5_refreshed_buckets", f"WITH {_REFRESH} SELECT CAST(split_part(entity, '|', 1) AS INT) AS tenant, entity, platform, geography, bucket_date, mentions, unique_authors, round(engagement_sum, 2) AS engagement_sum, round(engagement_median, 4) AS engagement_median FROM buckets")
def l5_buckets(spark, d):
    return rounded(rounded(refreshed(spark, d).read("buckets"), "engagement_sum", n=2), "engagement_median", n=4)
