"""Queries for buckets, growth, share of voice, gate, pairs and long tail."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import functions as F

from signalmill.operators import buckets as B
from signalmill.operators import gate as G
from signalmill.operators import growth as W
from signalmill.operators import longtail as LT
from signalmill.operators import pairs as P
from signalmill.plans.catalog import ENTITIES, INTEREST, SQL, VOCAB, buckets, core_vocab, entities, interest, links, query, rounded
from signalmill.plans.lifecycle_sql import metrics_sql, weeks_sql
from signalmill.sources import daystore as S
from signalmill.sources.fixtures import AS_OF, BUCKETS_SQL, EVENT_LINKS_SQL, event_links, link_tasks, links_sql, table, with_links
from signalmill.sources.scratch import scratch_path
from signalmill.sources.versions import TableSet

X = "DATE '2001-08-01'"


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)



@query("d1_entity_signals", f"WITH {links_sql('p_name')}, {ENTITIES} SELECT signal_id, entity, platform FROM links WHERE entity IN (SELECT entity FROM entities WHERE deleted_at IS NULL)")
def d1(spark, d):
    k = links(spark, d, "p_name")
    return B.entity_signals(k.select("signal_id", "platform").distinct(), k.select("signal_id", "entity"), entities(spark, d)).select("signal_id", "entity", "platform")


@query("e1_day_buckets", f"{with_links()} SELECT entity, platform, geography, bucket_date, mentions, unique_authors, round(engagement_sum, 4) AS engagement_sum, round(engagement_median, 4) AS engagement_median FROM buckets")
def e1(spark, d):
    return rounded(B.day_buckets(links(spark, d), tasks=link_tasks(spark, d)), "engagement_sum", "engagement_median", n=4)


@query("e2_deltas", f"""{with_links("p_name")}, t AS (SELECT entity, coalesce(sum(mentions) FILTER ({X} - bucket_date BETWEEN 0 AND 29), 0) AS month, coalesce(sum(mentions) FILTER ({X} - bucket_date BETWEEN 30 AND 59), 0) AS prior_month,
coalesce(sum(mentions) FILTER ({X} - bucket_date BETWEEN 0 AND 89), 0) AS quarter, coalesce(sum(mentions) FILTER ({X} - bucket_date BETWEEN 365 AND 454), 0) AS prior_year,
count(DISTINCT bucket_date) FILTER ({X} - bucket_date BETWEEN 0 AND 59) AS covered_days FROM buckets GROUP BY entity)
SELECT *, CASE WHEN prior_month > 0 AND covered_days >= 30 THEN round((month - prior_month) / prior_month, 6) END AS delta_mom, CASE WHEN prior_year > 0 THEN round((quarter - prior_year) / prior_year, 6) END AS delta_yoy FROM t""")
def e2(spark, d):
    return rounded(W.deltas(buckets(spark, d, "p_name"), AS_OF), "delta_mom", "delta_yoy")


def day_store(spark, d):
    """Buckets of part names laid out by month, and the names."""
    tables = TableSet(spark, scratch_path(spark, "days"))
    S.store_days(tables.change(), buckets(spark, d, "p_name").select("tenant", "entity", "bucket_date", "mentions")).commit()
    return tables.read(S.DAYS), tables.read(S.KEYS)


@query("e2_deltas_day_store", SQL["e2_deltas"])
def e2_stored(spark, d):
    days, names = day_store(spark, d)
    return rounded(W.deltas(days, AS_OF, entities=names), "delta_mom", "delta_yoy")


_VOLUMES = f"""volumes AS (SELECT entity, geography, coalesce(sum(mentions) FILTER ({X} - bucket_date <= 7), 0) AS volume_7d, coalesce(sum(mentions) FILTER ({X} - bucket_date <= 30), 0) AS volume_30d,
coalesce(sum(mentions) FILTER ({X} - bucket_date <= 90), 0) AS volume_90d FROM buckets WHERE {X} - bucket_date BETWEEN 0 AND 90 GROUP BY ALL)"""


@query("e3_volumes", f"{with_links()}, {_VOLUMES} SELECT *, round(volume_7d / 7, 6) AS velocity FROM volumes")
def e3(spark, d):
    return rounded(W.volumes(buckets(spark, d), AS_OF), "velocity")


@query("e4_week_buckets", recursive(f"{with_links()}, {weeks_sql(X)} SELECT * FROM weeks"))
def e4(spark, d):
    return W.week_buckets(buckets(spark, d), AS_OF)


@query("e5_e6_state_metrics", recursive(f"""{with_links()}, {metrics_sql(X)} SELECT entity, geography, v7 AS volume_7d, v30 AS volume_30d, v90 AS volume_90d, round(v7 / 7, 6) AS velocity, weeks,
round(wow, 6) AS growth_wow, round(mom, 6) AS growth_mom, round(vol, 6) AS volatility FROM met"""))
def e56(spark, d):
    return rounded(W.state_metrics(buckets(spark, d), AS_OF), "growth_wow", "growth_mom", "volatility", "velocity")


@query("e7_platforms_seen", f"{with_links()} SELECT entity, geography, list_sort(list(DISTINCT platform)) AS platforms FROM buckets GROUP BY ALL")
def e7(spark, d):
    return B.platforms_seen(buckets(spark, d))


@query("d5_with_bounds", f"{with_links()}, e AS (SELECT max(bucket_date) AS last_day FROM buckets) SELECT entity, platform, geography, bucket_date, last_day, last_day - 60 AS mid_day, last_day - 120 AS first_day FROM buckets, e")
def d5(spark, d):
    return W.with_bounds(buckets(spark, d), 60).select("entity", "platform", "geography", "bucket_date", "last_day", "mid_day", "first_day")


def sov_sql(day: int = 60) -> str:
    return f"""e AS (SELECT max(bucket_date) AS l FROM buckets),
per AS (SELECT entity, platform, coalesce(sum(mentions) FILTER (bucket_date > l - {day} AND bucket_date <= l), 0) AS recent_n, coalesce(sum(mentions) FILTER (bucket_date > l - {2 * day} AND bucket_date <= l - {day}), 0) AS prior_n FROM buckets, e GROUP BY ALL),
tot AS (SELECT platform, sum(recent_n) AS rt, sum(prior_n) AS pt FROM per GROUP BY ALL),
g AS (SELECT entity, per.platform, recent_n, prior_n, (recent_n / rt) / (prior_n / pt) - 1 AS growth FROM per JOIN tot ON per.platform = tot.platform WHERE prior_n >= 3 AND rt > 0 AND pt > 0),
sov AS (SELECT entity, count(*) AS platforms, CASE WHEN count(*) >= 2 THEN median(growth) END AS sov_growth FROM g GROUP BY entity)"""


@query("e8_share_of_voice", f"{with_links()}, {sov_sql()} SELECT 1 AS tenant, entity, platforms, round(sov_growth, 6) AS sov_growth FROM sov")
def e8(spark, d):
    return rounded(W.share_of_voice(buckets(spark, d)), "sov_growth").drop("audit")


@query("e8_share_of_voice_audit", f"{with_links()}, {sov_sql()} SELECT entity, platform, recent_n, prior_n, round(growth, 6) AS growth FROM g")
def e8a(spark, d):
    return W.share_of_voice(buckets(spark, d)).select("entity", F.inline("audit"))


_BREADTH = """a AS (SELECT entity, platform, sum(unique_authors) AS a FROM buckets GROUP BY ALL), t AS (SELECT *, sum(a) OVER (PARTITION BY entity) AS t FROM a),
breadth AS (SELECT entity, coalesce(sum(CASE WHEN a > 0 THEN -(a / t) * log2(a / t) END), 0) AS entropy_bits, max(t) AS total_authors FROM t GROUP BY entity)"""


@query("e9_source_breadth", f"{with_links()}, {_BREADTH} SELECT entity, round(entropy_bits, 6) AS entropy_bits, total_authors, round(entropy_bits, 9) >= 2.32 AND total_authors >= 10 AS breadth_pass FROM breadth")
def e9(spark, d):
    return rounded(G.source_breadth(buckets(spark, d, authors=True), 2.32), "entropy_bits")


_SERIES = """dt AS (SELECT entity, bucket_date, sum(mentions) AS m FROM buckets GROUP BY ALL), sp AS (SELECT entity, max(bucket_date) AS l, min(bucket_date) AS f FROM dt GROUP BY entity),
dy AS (SELECT entity, CAST(unnest(generate_series(greatest(f, l - {n}), l, INTERVAL 1 DAY)) AS DATE) AS bucket_date FROM sp),
series AS (SELECT dy.entity, dy.bucket_date, coalesce(m, 0) AS mentions FROM dy LEFT JOIN dt ON dy.entity = dt.entity AND dy.bucket_date = dt.bucket_date)"""


@query("e10_daily_series", f"{with_links('p_name')}, {_SERIES.format(n=179)} SELECT * FROM series")
def e10(spark, d):
    return B.daily_series(buckets(spark, d, "p_name"))


@query("e11_surge_stat", f"""{with_links('p_name')}, {_SERIES.format(n=179)}, w AS (SELECT entity, bucket_date, sum(mentions) OVER f AS s, count(*) OVER f AS c FROM series WINDOW f AS (PARTITION BY entity ORDER BY bucket_date ROWS 6 PRECEDING))
SELECT entity, round(arg_max(s, bucket_date) - avg(s), 6) AS surge FROM w WHERE c = 7 GROUP BY entity""")
def e11(spark, d):
    return rounded(G.surge_stat(B.daily_series(buckets(spark, d, "p_name"))), "surge")


_HASHED = """s AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY bucket_date) AS i, count(*) OVER (PARTITION BY entity) AS n FROM series),
r AS (SELECT entity, mentions, i, unnest(range(0, 21)) AS k FROM s WHERE n >= 14),
o AS (SELECT *, CASE WHEN k = 0 THEN lpad(CAST(i AS VARCHAR), 6, '0') ELSE md5(entity || '|' || k || '|' || i) END AS key FROM r),
w AS (SELECT entity, k, sum(mentions) OVER f AS s, row_number() OVER (PARTITION BY entity, k ORDER BY key, i) AS p FROM o WINDOW f AS (PARTITION BY entity, k ORDER BY key, i ROWS 6 PRECEDING)),
u AS (SELECT entity, k, arg_max(s, p) - avg(s) AS surge FROM w WHERE p >= 7 GROUP BY ALL),
z AS (SELECT a.entity, (count(*) FILTER (a.surge >= b.surge - 1e-9) + 1) / 21 AS p, max(b.surge) AS surge FROM u a JOIN u b ON a.entity = b.entity AND b.k = 0 WHERE a.k > 0 GROUP BY a.entity),
hashed AS (SELECT e.entity, coalesce(surge, 0) AS surge, coalesce(p, 1) AS p_value, coalesce(p, 1) <= 0.05 AS significance_pass FROM (SELECT DISTINCT entity FROM series) e LEFT JOIN z ON e.entity = z.entity)"""


@query("e12_permutation_hashed", f"{with_links()}, {_SERIES.format(n=59)}, {_HASHED} SELECT entity, round(surge, 6) AS surge, round(p_value, 6) AS p_value, significance_pass FROM hashed")
def e12(spark, d):
    return rounded(G.permutation_test_sql(B.daily_series(buckets(spark, d), 60), 20), "surge", "p_value")


def _rounds() -> str:
    x = f"(CAST('0x' || substr(md5(entity), 1, 8) AS BIGINT) + k * {G.STEPS[0]} + i * {G.STEPS[1]}) % {G.PRIME}"
    ctes = [f"x0 AS (SELECT entity, mentions, i, k, {x} AS x FROM r)"]
    for n, add in enumerate(G.ADDED):
        ctes.append(f"x{n + 1} AS (SELECT entity, mentions, i, k, (((x * x) % {G.PRIME}) * x % {G.PRIME} + {add}) % {G.PRIME} AS x FROM x{n})")
    return ", ".join(ctes) + f", o AS (SELECT entity, mentions, i, k, CASE WHEN k = 0 THEN i ELSE x END AS key FROM x{len(G.ADDED)})"


#: _HASHED at 1,000 replicates, with the integer keys of gate.shuffle_keys.
_COUNTED = re.sub(r"o AS \(SELECT \*.*?FROM r\)", lambda m: _rounds(), _HASHED, flags=re.S).replace("range(0, 21)", "range(0, 1001)").replace("/ 21 AS p", "/ 1001 AS p")


@query("e12_permutation_test", f"{with_links('p_name')}, {_SERIES.format(n=179)}, {_COUNTED} SELECT entity, round(surge, 6) AS surge, round(p_value, 6) AS p_value, significance_pass FROM hashed")
def e12_fast(spark, d):
    return rounded(G.permutation_test(B.daily_series(buckets(spark, d, "p_name"))), "surge", "p_value")


def _gate_sql(entity: str, test: str) -> str:
    return f"""{with_links(entity)}, {_SERIES.format(n=179)}, {test}, {_BREADTH}, b AS (SELECT *, round(entropy_bits, 9) >= 1.0 AND total_authors >= 10 AS breadth_pass FROM breadth)
SELECT h.entity, round(surge, 6) AS surge, round(p_value, 6) AS p_value, significance_pass, round(entropy_bits, 6) AS entropy_bits, total_authors, breadth_pass, CASE WHEN significance_pass AND coalesce(breadth_pass, false) THEN 'pass' ELSE 'hold' END AS decision,
[CASE WHEN significance_pass THEN 'significant' ELSE 'within own noise' END, CASE WHEN breadth_pass THEN 'broad' ELSE 'concentrated' END] AS reasons FROM hashed h LEFT JOIN b ON h.entity = b.entity"""


@query("e13_gate", _gate_sql("p_name", _COUNTED))
def e13(spark, d):
    return rounded(G.gate(buckets(spark, d, "p_name", authors=True)), "surge", "p_value", "entropy_bits")


@query("e13_gate_hashed", _gate_sql("p_name", _HASHED))
def e13h(spark, d):
    return rounded(G.gate(buckets(spark, d, "p_name", authors=True), 20, test=G.permutation_test_sql), "surge", "p_value", "entropy_bits")


@query("e13_gate_breadth_only", f"{with_links()}, {_BREADTH} SELECT entity, CASE WHEN round(entropy_bits, 9) >= 2.32 AND total_authors >= 10 THEN 'pass' ELSE 'hold' END AS decision FROM breadth")
def e13b(spark, d):
    b = G.source_breadth(buckets(spark, d, authors=True), 2.32).withColumn("significance_pass", F.lit(False))
    return G.gate_verdict(b, require_significance=False).select("entity", "decision")


_COOC = """le AS (SELECT signal_id, entity, min(posted_on) AS posted_on FROM links GROUP BY ALL), ln AS (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY entity) AS n FROM le),
cooc AS (SELECT x.signal_id, least(x.posted_on, y.posted_on) AS posted_on, x.entity AS a, y.entity AS b FROM ln x JOIN ln y ON x.signal_id = y.signal_id AND x.entity < y.entity WHERE x.n <= 50 AND y.n <= 50)"""


@query("d2_cooccurrences", f"WITH {links_sql()}, {_COOC} SELECT signal_id, posted_on, a, b FROM cooc")
def d2(spark, d):
    return P.cooccurrences(links(spark, d))


_LIFT = f"""jt AS (SELECT a, b, count(DISTINCT signal_id) AS joint FROM cooc WHERE {X} - posted_on BETWEEN 0 AND 90 GROUP BY ALL HAVING count(DISTINCT signal_id) >= 5),
pe AS (SELECT entity, count(DISTINCT signal_id) AS n FROM links WHERE {X} - posted_on BETWEEN 0 AND 90 GROUP BY ALL), tt AS (SELECT count(DISTINCT signal_id) AS total FROM links WHERE {X} - posted_on BETWEEN 0 AND 90),
lift AS (SELECT jt.a, jt.b, joint, p.n AS count_a, q.n AS count_b, total, p.n * q.n / total AS expected, joint / (p.n * q.n / total) AS lift FROM jt JOIN pe p ON a = p.entity JOIN pe q ON b = q.entity, tt)"""


def lift(spark, d):
    k = links(spark, d)
    return P.pair_lift(k, P.cooccurrences(k), AS_OF, 90, 5, 1.2)


@query("e14_pair_lift", f"WITH {links_sql()}, {_COOC}, {_LIFT} SELECT a, b, joint, count_a, count_b, total, round(expected, 6) AS expected, round(lift, 6) AS lift FROM lift WHERE lift >= 1.2")
def e14(spark, d):
    return rounded(lift(spark, d), "expected", "lift")


@query("e15_prior_joint", f"WITH {links_sql()}, {_COOC}, {_LIFT}, pj AS (SELECT a, b, count(DISTINCT signal_id) AS p FROM cooc WHERE {X} - posted_on BETWEEN 90 AND 180 GROUP BY ALL) SELECT l.a, l.b, joint, coalesce(p, 0) AS prior_joint FROM lift l LEFT JOIN pj ON l.a = pj.a AND l.b = pj.b WHERE lift >= 1.2")
def e15(spark, d):
    return P.prior_joint(lift(spark, d), P.cooccurrences(links(spark, d)), AS_OF, 90).select("a", "b", "joint", "prior_joint")


@query("e16_pair_sparkline", f"""WITH {links_sql()}, {_COOC}, s AS (SELECT a, b, 14 - ({X} - posted_on) AS slot, count(DISTINCT signal_id) AS n FROM cooc WHERE {X} - posted_on BETWEEN 0 AND 14 GROUP BY ALL),
m AS (SELECT a, b, map(list(slot), list(n)) AS m FROM s GROUP BY ALL) SELECT a, b, list_transform(range(0, 14), lambda i: coalesce(m[i], 0)) AS sparkline FROM m""")
def e16(spark, d):
    return P.pair_sparkline(P.cooccurrences(links(spark, d)), AS_OF, 14)


_PAIRS = "ents AS (SELECT p_brand AS entity, upper(p_brand) AS label, min(p_type) AS entity_type FROM part GROUP BY p_brand HAVING p_brand <> 'Brand#3')"


def brands(spark, d):
    b = table(spark, d, "part").groupBy(F.col("p_brand").alias("entity")).agg(F.upper(F.first("p_brand")).alias("label"), F.min("p_type").alias("entity_type"))
    return b.withColumn("deleted_at", F.when(F.col("entity") == "Brand#3", F.lit("2001-01-01").cast("date")))


@query("d4_label_pairs", f"WITH {links_sql()}, {_COOC}, {_LIFT}, {_PAIRS} SELECT l.a, l.b, x.label AS label_a, y.label AS label_b, x.entity_type AS type_a, y.entity_type AS type_b FROM lift l JOIN ents x ON l.a = x.entity JOIN ents y ON l.b = y.entity WHERE lift >= 1.2")
def d4(spark, d):
    return P.label_pairs(lift(spark, d), brands(spark, d)).select("a", "b", "label_a", "label_b", "type_a", "type_b")


@query("f4_order_pairs", f"WITH {links_sql()}, {_COOC}, {_LIFT} SELECT a, b, round(lift, 6) AS lift FROM lift WHERE lift >= 1.2 ORDER BY expected < 1, lift DESC, a, b")
def f4(spark, d):
    return rounded(P.order_pairs(lift(spark, d)).select("a", "b", "lift"), "lift")


@query("j5_pair_list", f"WITH {links_sql()}, {_COOC}, {_LIFT}, {_PAIRS} SELECT l.a, l.b, x.label AS label_a, y.label AS label_b, joint, round(lift, 6) AS lift FROM lift l JOIN ents x ON l.a = x.entity JOIN ents y ON l.b = y.entity WHERE lift >= 1.2")
def j5(spark, d):
    from signalmill.plans.readmodels import pair_list

    return rounded(pair_list(lift(spark, d), brands(spark, d)).select("a", "b", "label_a", "label_b", "joint", "lift"), "lift")


_WINDOWS = f"""win AS (SELECT 1 AS tenant, entity, coalesce(sum(mentions) FILTER ({X} - bucket_date BETWEEN 0 AND 29), 0) AS current, coalesce(sum(mentions) FILTER ({X} - bucket_date BETWEEN 30 AND 59), 0) AS prior,
coalesce(sum(mentions) FILTER ({X} - bucket_date BETWEEN 365 AND 394), 0) AS yoy FROM buckets GROUP BY entity)"""
_CEIL = "ceil AS (SELECT current AS ceiling FROM (SELECT current, row_number() OVER (ORDER BY current) AS rn, count(*) OVER () AS n FROM win WHERE current >= 5) WHERE rn = least(CAST(floor(0.5 * n) AS BIGINT), n - 1) + 1)"
_POST = "(SELECT least(sum(exp(lgamma({c} + {b} + 2) - lgamma(k + 1) - lgamma({c} + {b} + 2 - k) + k * ln(2.0 / 3) + ({c} + {b} + 1 - k) * ln(1.0 / 3))), 1) FROM (SELECT unnest(range(0, CAST({c} AS BIGINT) + 1)) AS k))"


def windows(spark, d):
    return LT.uplift_windows(buckets(spark, d, "p_name"), AS_OF)


@query("e17_uplift_windows", f"{with_links('p_name')}, {_WINDOWS} SELECT * FROM win")
def e17(spark, d):
    return windows(spark, d)


@query("e17_uplift_day_store", SQL["e17_uplift_windows"])
def e17_stored(spark, d):
    days, names = day_store(spark, d)
    return LT.uplift_windows(days, AS_OF, names)


@query("e18_volume_ceiling", f"{with_links('p_name')}, {_WINDOWS}, {_CEIL} SELECT 1 AS tenant, ceiling FROM ceil")
def e18(spark, d):
    return LT.volume_ceiling(windows(spark, d))


@query("e19_uplift_posterior", f"{with_links('p_name')}, {_WINDOWS} SELECT entity, round({_POST.format(c='current', b='prior')}, 6) AS posterior, round({_POST.format(c='current', b='prior')}, 6) AS in_columns FROM win")
def e19(spark, d):
    return rounded(windows(spark, d).select("entity", LT.uplift_posterior("current", "prior").alias("posterior"), LT.posterior_column(F.col("current"), F.col("prior")).alias("in_columns")), "posterior", "in_columns")


_STAGES = f"""st AS (SELECT entity, current, ceiling, CASE WHEN yoy > 0 THEN yoy ELSE prior END AS baseline, CASE WHEN yoy > 0 THEN 'yoy' ELSE 'prior_window' END AS baseline_kind, entity IN (SELECT term FROM vocab) AS core FROM win, ceil),
sp AS (SELECT *, {_POST.format(c='current', b='baseline')} AS posterior FROM st),
stages AS (SELECT *, current / greatest(baseline, 1) AS uplift, CASE WHEN current < 5 THEN 'floor' WHEN current >= ceiling THEN 'ceiling' WHEN core THEN 'vocabulary' WHEN baseline = 0 THEN 'no_baseline' WHEN posterior < 0.6 THEN 'low_posterior' ELSE 'candidate' END AS stage FROM sp)"""


def stages(spark, d):
    return LT.long_tail_stages(windows(spark, d), core_vocab(spark, d), least=0.6)


@query("e20_long_tail_stages", f"{with_links('p_name')}, {_WINDOWS}, {_CEIL}, {VOCAB}, {_STAGES} SELECT entity, stage, baseline, baseline_kind, round(posterior, 6) AS posterior, round(uplift, 6) AS uplift FROM stages")
def e20(spark, d):
    return rounded(stages(spark, d).select("entity", "stage", "baseline", "baseline_kind", "posterior", "uplift"), "posterior", "uplift")


@query("e20_stage_counts", f"{with_links('p_name')}, {_WINDOWS}, {_CEIL}, {VOCAB}, {_STAGES} SELECT 1 AS tenant, stage, count(*) AS n FROM stages GROUP BY stage")
def e20c(spark, d):
    return LT.stage_counts(stages(spark, d))


@query("f5_sort_long_tail", f"{with_links('p_name')}, {_WINDOWS}, {_CEIL}, {VOCAB}, {_STAGES} SELECT entity, round(uplift, 6) AS uplift FROM stages WHERE stage = 'candidate' AND baseline_kind = 'yoy' ORDER BY uplift DESC, entity")
def f5(spark, d):
    c = LT.long_tail(windows(spark, d), core_vocab(spark, d), least=0.6)
    return rounded(LT.sort_long_tail(c, "uplift", baseline_kind="yoy").select("entity", "uplift"), "uplift")


@query("f7_recent_days", f"{with_links('p_name')}, r AS (SELECT entity, bucket_date, sum(mentions) AS mentions, row_number() OVER (PARTITION BY entity ORDER BY bucket_date DESC) AS rn FROM buckets GROUP BY entity, bucket_date) SELECT * FROM r WHERE rn <= 14")
def f7(spark, d):
    return B.recent_days(buckets(spark, d, "p_name"))


@query("f9_rolling", f"{with_links()}, {_SERIES.format(n=179)} SELECT entity, bucket_date, mentions, CASE WHEN count(*) OVER f = 7 THEN sum(mentions) OVER f END AS rolling FROM series WINDOW f AS (PARTITION BY entity ORDER BY bucket_date ROWS 6 PRECEDING)")
def f9(spark, d):
    return B.rolling(B.daily_series(buckets(spark, d)))


@query("f9_recent_vs_prior", f"""{with_links()}, {_SERIES.format(n=179)}, w AS (SELECT entity, bucket_date, sum(mentions) OVER (PARTITION BY entity ORDER BY bucket_date ROWS 27 PRECEDING) AS recent,
sum(mentions) OVER (PARTITION BY entity ORDER BY bucket_date ROWS BETWEEN 55 PRECEDING AND 28 PRECEDING) AS prior FROM series) SELECT entity, arg_max(recent, bucket_date) AS recent, coalesce(arg_max(prior, bucket_date), 0) AS prior FROM w GROUP BY entity""")
def f9b(spark, d):
    return B.recent_vs_prior(B.daily_series(buckets(spark, d)))


_TREND = f"{with_links('p_name')}, {INTEREST}, {ENTITIES}"


@query("d17_interest_for_entity", f"{_TREND} SELECT e.entity, bucket_date, interest_value FROM interest i JOIN (SELECT entity, unnest(list_distinct(list_concat([lower(label)], list_transform(aliases, lambda x: lower(x))))) AS k FROM entities) e ON lower(i.keyword) = e.k")
def d17(spark, d):
    return B.interest_for_entity(entities(spark, d), interest(spark, d))


@query("d16_trend_series", f"""{_TREND}, m AS (SELECT entity, bucket_date, sum(mentions) AS mentions FROM buckets GROUP BY ALL), i AS (SELECT keyword AS entity, bucket_date + 1 AS bucket_date, max(interest_value) AS interest FROM interest GROUP BY ALL)
SELECT coalesce(m.entity, i.entity) AS entity, coalesce(m.bucket_date, i.bucket_date) AS bucket_date, coalesce(mentions, 0) AS mentions, interest FROM m FULL JOIN i ON m.entity = i.entity AND m.bucket_date = i.bucket_date""")
def d16(spark, d):
    i = interest(spark, d).select(F.col("keyword").alias("entity"), F.date_add("bucket_date", 1).alias("bucket_date"), "interest_value")
    return B.trend_series(buckets(spark, d, "p_name"), i)


@query("g1_day_keys", f"WITH {links_sql('p_name')}, {INTEREST} SELECT DISTINCT keyword AS entity, bucket_date FROM interest UNION SELECT DISTINCT entity, posted_on FROM links")
def g1(spark, d):
    a = interest(spark, d).select(F.col("keyword").alias("entity"), "bucket_date")
    return a.union(links(spark, d, "p_name").select("entity", "posted_on")).distinct()


_ATTR = f"attributed AS (SELECT DISTINCT signal_id, entity_type AS category, split_part(entity, ' ', 1) AS attribute FROM links), sg AS (SELECT signal_id, min(posted_on) AS posted_on, min(author) AS author FROM links GROUP BY ALL), abk AS (SELECT category, attribute, posted_on AS bucket_date, count(*) AS mentions, count(DISTINCT author) AS unique_authors FROM attributed JOIN sg USING (signal_id) WHERE posted_on BETWEEN {X} - 365 AND {X} GROUP BY ALL)"


def attribute_buckets(spark, d):
    k = links(spark, d, "p_name")
    a = k.select("signal_id", F.col("entity_type").alias("category"), F.substring_index("entity", " ", 1).alias("attribute")).distinct()
    return B.attribute_buckets(a, k.groupBy("signal_id").agg(F.min("posted_on").alias("posted_on"), F.min("author").alias("author")), AS_OF, tasks=link_tasks(spark, d))


@query("e22_attribute_buckets", f"WITH {links_sql('p_name')}, {_ATTR} SELECT * FROM abk")
def e22(spark, d):
    return attribute_buckets(spark, d)


_RANK = f"rk AS (SELECT category, attribute, coalesce(sum(mentions) FILTER ({X} - bucket_date BETWEEN 0 AND 29), 0) AS current, coalesce(sum(mentions) FILTER ({X} - bucket_date BETWEEN 30 AND 59), 0) AS prior FROM abk GROUP BY ALL)"


@query("e23_rank_attributes", f"WITH {links_sql('p_name')}, {_ATTR}, {_RANK} SELECT *, CASE WHEN prior > 0 THEN round((current - prior) / prior, 6) END AS delta FROM rk WHERE current > 0 OR prior > 0")
def e23(spark, d):
    return rounded(W.rank_attributes(attribute_buckets(spark, d), 30, AS_OF), "delta")


@query("f6_top_per_category", f"WITH {links_sql('p_name')}, {_ATTR}, {_RANK} SELECT category, attribute, current, rn FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY current DESC, attribute) AS rn FROM rk WHERE current > 0 OR prior > 0) WHERE rn <= 3")
def f6(spark, d):
    from signalmill.plans.readmodels import top_per_category

    return top_per_category(W.rank_attributes(attribute_buckets(spark, d), 30, AS_OF), 3).select("category", "attribute", "current", "rn")


@query("e37_total_mentions", f"{with_links('p_name')}, {ENTITIES} SELECT e.entity, coalesce(sum(mentions), 0) AS total_mentions FROM entities e LEFT JOIN buckets b ON e.entity = b.entity GROUP BY ALL")
def e37(spark, d):
    return B.total_mentions(entities(spark, d), buckets(spark, d, "p_name"))


@query("e1_event_buckets", f"WITH {EVENT_LINKS_SQL} SELECT entity_id AS entity, platform, geography, posted_on AS bucket_date, count(*) AS mentions, count(DISTINCT author) AS unique_authors FROM elinks GROUP BY ALL")
def e1e(spark, d):
    return B.day_buckets(event_links(spark, d).withColumnRenamed("entity_id", "entity")).drop("engagement_sum", "engagement_median")
