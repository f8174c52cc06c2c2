"""Queries for label, term, tag and measure columns (B) and ingest filters (C)."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from signalmill.functions import measures as M
from signalmill.functions import text as T
from signalmill.operators import ingest as I
from signalmill.operators import seeds as S
from signalmill.plans.catalog import ENTITIES, RUNS, SEEDS, SIGNALS, VOCAB, core_vocab, entities, events_as_signals, query, rounded, runs, seed_queries
from signalmill.sources.fixtures import table


@query("b8_author_tier", "SELECT o_orderkey AS id, CASE WHEN f IS NULL OR f < 1000 THEN 'nano' WHEN f < 10000 THEN 'micro' WHEN f < 100000 THEN 'mid' WHEN f < 1000000 THEN 'macro' ELSE 'mega' END AS tier FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN (o_orderkey * o_orderkey) % 2000000 END AS f FROM orders)")
def b8(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("id"), M.author_tier(F.when(k % 10 != 0, (k * k) % 2000000)).alias("tier"))


@query("b9_engagement", f"""WITH {SIGNALS}, c AS (SELECT row_id, platform, value AS likes, row_id % 7 AS comments, row_id % 3 AS shares, row_id % 1000 AS views FROM signals),
t AS (SELECT row_id, CASE platform WHEN 'tiktok' THEN likes + comments * 5 + shares * 3 + views * 0.05 WHEN 'reddit' THEN likes + comments * 2 WHEN 'x' THEN likes ELSE likes + comments * 3 + shares * 5 + views * 0.1 END AS c FROM c)
SELECT row_id, CAST(floor(c + 0.5) AS BIGINT) AS score, round(c, 6) AS composite FROM t""")
def b9(spark, d):
    s = events_as_signals(spark, d)
    e = M.engagement(F.col("platform"), {"likes": F.col("value"), "comments": F.col("row_id") % 7, "shares": F.col("row_id") % 3, "views": F.col("row_id") % 1000})
    return s.select("row_id", e["score"].alias("score"), F.round(e["composite"], 6).alias("composite"))


_GRAMS = "list_transform(range(1, length(text) - 1), lambda i: substring(lower(text), i, 3))"


@query("b10_detect_language", f"""WITH t AS (SELECT doc_id, lang, unnest({_GRAMS}) AS gram FROM documents WHERE length(text) >= 20),
g AS (SELECT doc_id, lang, gram, count(*) AS c FROM t GROUP BY ALL),
p0 AS (SELECT lang AS language, gram, sum(c) AS c FROM g GROUP BY ALL), p1 AS (SELECT language, gram, c / sum(c) OVER (PARTITION BY language) AS weight, row_number() OVER (PARTITION BY language ORDER BY c DESC, gram) AS n FROM p0),
s AS (SELECT doc_id, language, round(sum(g.c * weight), 6) AS s FROM g JOIN p1 ON g.gram = p1.gram AND n <= 300 GROUP BY ALL)
SELECT doc_id AS signal_id, arg_min(language, (-s, language)) AS language FROM s GROUP BY doc_id""")
def b10(spark, d):
    docs = table(spark, d, "documents")
    p = I.language_profiles(docs.select("text", F.col("lang").alias("language")))
    return I.detect_language(docs.select(F.col("doc_id").alias("signal_id"), "text"), p)


@query("b10_language_gate", """SELECT doc_id, CASE WHEN length(text) >= 20 THEN CASE lang WHEN 'en' THEN 'en' WHEN 'fr' THEN 'fr' ELSE lang END END AS language,
CASE WHEN length(text) >= 20 AND lang IS NOT NULL THEN round(least(0.5 + length(text) / 500, 0.99), 6) ELSE 0 END AS confidence FROM documents""")
def b10_gate(spark, d):
    three = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "fr", "fra").otherwise(F.col("lang"))
    g = M.language_gate(F.col("text"), three)
    return table(spark, d, "documents").select("doc_id", g["language"].alias("language"), F.round(g["confidence"], 6).alias("confidence"))


@query("b13_interest_values", "SELECT event_id AS id, CAST(greatest(0, least(100, floor((value * 3 - 20) + 0.5))) AS INT) AS v, CAST(ts AS DATE) AS day FROM events")
def b13(spark, d):
    said = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).otherwise(F.date_format("ts", "MMM d, yyyy"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), M.clamp_interest(F.col("value") * 3 - 20).alias("v"), M.to_day(said).alias("day"))


@query("b14_bucket_columns", "SELECT l_orderkey AS id, l_linenumber AS n, CAST(coalesce(CASE WHEN l_linenumber <> 2 THEN o_orderdate END, l_shipdate) AS DATE) AS bucket_date, coalesce(CASE WHEN l_linenumber <> 3 THEN l_returnflag END, 'Global') AS geography, coalesce(CASE WHEN l_linenumber <> 4 THEN l_extendedprice END, 0) AS composite FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def b14(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    not_ = lambda k, c: F.when(F.col("l_linenumber") != k, F.col(c))
    return j.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), *M.bucket_cols(not_(2, "o_orderdate"), F.col("l_shipdate"), not_(3, "l_returnflag"), not_(4, "l_extendedprice")))


_WORDS = r"words AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents) WHERE w <> '')"
_SINGULAR = """CASE WHEN {w} IN ('molasses','brussels','swiss','bolognese','caprese','anise') OR regexp_matches({w}, '(us|is|ss)$') THEN {w}
 WHEN length({w}) > 3 AND {w} LIKE '%ies' THEN left({w}, -3) || 'y' WHEN length({w}) > 4 AND regexp_matches({w}, '(ss|ch|sh|x|z)es$') THEN left({w}, -2)
 WHEN length({w}) > 3 AND {w} LIKE '%s' THEN left({w}, -1) ELSE {w} END"""


def words(spark, d):
    w = F.explode(F.split(F.lower("text"), "[^a-z]+"))
    return table(spark, d, "documents").select(w.alias("w")).where("w <> ''").distinct()


@query("b16_singularize", f"WITH {_WORDS} SELECT w, {_SINGULAR.format(w='w')} AS singular FROM words")
def b16(spark, d):
    return words(spark, d).select("w", T.singularize(F.col("w")).alias("singular"))


_CASES = "labels AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '  ' || upper(p_name) || '  Co.' WHEN 1 THEN split_part(p_name, ' ', 2) || 's' WHEN 2 THEN p_name || ' company inc' ELSE p_name END AS label FROM part)"


def raw_labels(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    label = (
        F.when(k == 0, F.concat(F.lit("  "), F.upper(n), F.lit("  Co."))).when(k == 1, F.concat(F.substring_index(n, " ", -1), F.lit("s"))).when(k == 2, F.concat(n, F.lit(" company inc"))).otherwise(n)
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), label.alias("label"))


@query("b15_canonical_label", f"""WITH {_CASES}, c AS (SELECT id, lower(regexp_replace(trim(label), '\\s+', ' ', 'g')) AS l FROM labels)
SELECT id, CASE WHEN contains(l, ' ') THEN regexp_replace(l, '(\\s(co|co\\.|company|inc|inc\\.|llc|ltd|ltd\\.|corp|corp\\.))+$', '') ELSE {_SINGULAR.format(w='l')} END AS canonical FROM c""")
def b15(spark, d):
    return raw_labels(spark, d).select("id", T.canonical_label(F.col("label")).alias("canonical"))


@query("b17_normalize_term", "SELECT doc_id, trim(regexp_replace(replace(strip_accents(replace(lower(text), 'ß', '§')), '§', 'ß'), '^#', '')) AS term FROM documents")
def b17(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_term(F.col("text")).alias("term"))


@query("b18_hashtag_variants", f"""WITH {SEEDS},
q AS (SELECT query_id, generate_subscripts(list_concat(hashtags, keywords), 1) AS i, unnest(list_concat(hashtags, keywords)) AS h FROM seed_queries),
r AS (SELECT query_id, i, lower(regexp_replace(regexp_replace(h, '^#+', ''), '[\\s_-]+', '', 'g')) AS b FROM q),
f AS (SELECT query_id, i, CASE WHEN b LIKE '%ies' THEN [b, left(b, -3) || 'y'] WHEN b LIKE '%s' THEN [b, left(b, -1)] WHEN b LIKE '%y' THEN [b, b || 's', left(b, -1) || 'ies'] ELSE [b, b || 's'] END AS v FROM r),
g AS (SELECT query_id, i, generate_subscripts(v, 1) AS j, unnest(v) AS variant FROM f),
m AS (SELECT query_id, variant, min((i, j)) AS ij FROM g GROUP BY ALL),
n AS (SELECT query_id, variant, row_number() OVER (PARTITION BY query_id ORDER BY ij) AS n FROM m)
SELECT * FROM n WHERE n <= 4""")
def b18(spark, d):
    q = seed_queries(spark, d)
    return S.expand_hashtags(q.select("query_id", F.concat("hashtags", "keywords").alias("hashtags")))


@query("b19_sanitize_hashtags", r"""WITH t AS (SELECT p_brand AS grp, p_partkey AS place, lower(regexp_replace(trim(CASE WHEN p_partkey % 3 = 0 THEN '#' || replace(p_name, ' ', '') WHEN p_partkey % 3 = 1 THEN p_name ELSE split_part(p_name, ' ', 1) || p_size END), '^#', '')) AS tag FROM part),
u AS (SELECT grp, tag, min(place) AS place FROM t WHERE regexp_matches(tag, '^[a-z0-9]{3,30}$') AND NOT regexp_matches(tag, '^(green|large|small|widget)+$') GROUP BY ALL)
SELECT grp, tag, n FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY place, tag) AS n FROM u) WHERE n <= 6""")
def b19(spark, d):
    k, n = F.col("p_partkey"), F.col("p_name")
    tag = F.when(k % 3 == 0, F.concat(F.lit("#"), F.regexp_replace(n, " ", ""))).when(k % 3 == 1, n).otherwise(F.concat(F.substring_index(n, " ", 1), F.col("p_size").cast("string")))
    return S.sanitize_hashtags(table(spark, d, "part").select(F.col("p_brand").alias("grp"), k.alias("place"), tag.alias("tag")), ["large", "small", "green", "widget", "red"])


_KEY = r"""list_transform(list_filter(string_split_regex(regexp_replace(strip_accents(lower(regexp_replace(trim({t}), '^#', ''))), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: w <> ''),
 lambda w: CASE WHEN length(w) > 4 AND w LIKE '%es' AND NOT w LIKE '%ses' THEN left(w, -2) WHEN length(w) > 3 AND w LIKE '%s' AND NOT w LIKE '%ss' THEN left(w, -1) ELSE w END)"""


@query("b20_dedupe_terms", f"""WITH t AS (SELECT p_brand AS lang, p_partkey AS place, CASE WHEN p_partkey % 2 = 0 THEN '#' || p_name || 's' ELSE p_name END AS term FROM part),
k AS (SELECT *, array_to_string({_KEY.format(t='term')}, ' ') AS key FROM t) SELECT lang, key, arg_min(regexp_replace(trim(term), '^#', ''), place) AS term FROM k WHERE key <> '' GROUP BY ALL""")
def b20(spark, d):
    term = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("#"), F.col("p_name"), F.lit("s"))).otherwise(F.col("p_name"))
    return S.dedupe_terms(table(spark, d, "part").select(F.col("p_brand").alias("lang"), F.col("p_partkey").alias("place"), term.alias("term")))


@query("b21_fold_language", "SELECT doc_id, CASE lang WHEN 'en' THEN 'en' WHEN 'de' THEN 'de' WHEN 'es' THEN 'es-MX' END AS code FROM documents WHERE lang IN ('en', 'de', 'es')")
def b21(spark, d):
    said = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "de", "DE-at").when(F.col("lang") == "es", "Español").otherwise(F.col("lang"))
    return S.fold_language(table(spark, d, "documents").select("doc_id", said.alias("lang")), ["en", "de", "es-MX"]).select("doc_id", "code")


@query("b22_topic_key", r"SELECT p_partkey AS id, lower(p_name) || ' ' || lower(p_type) AS key FROM part")
def b22(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), T.topic_key(F.concat(F.initcap("p_name"), F.lit("  ("), F.col("p_type"), F.lit(") "))).alias("key"))


@query("b23_geo_code", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN upper(left(c_mktsegment, 2)) ELSE '' END AS geo FROM customer")
def b23(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), T.geo_code(F.when(F.col("c_custkey") % 2 == 0, F.upper(F.substring("c_mktsegment", 1, 2))).otherwise(F.col("c_mktsegment"))).alias("geo"))


@query("b24_tag_text", "SELECT doc_id, substring(concat_ws(' ', text, lang || ' ' || source), 1, 500) AS tagged, substring(text, 1, 300) AS excerpt FROM documents")
def b24(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tag_text(F.col("text"), F.array("lang", "source")).alias("tagged"), T.excerpt(F.col("text")).alias("excerpt"))


@query("b25_percent", "SELECT s_suppkey AS id, floor(s_acctbal / 9999 * 1000 + 0.5) / 10 AS pct FROM supplier")
def b25(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), M.pct1(F.col("s_acctbal") / 9999).alias("pct"))


@query("b26_evidence_window", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 100 IN (7, 30, 90) THEN o_orderkey % 100 ELSE 30 END AS snapped, o_orderdate >= DATE '2001-05-03' AS in_window FROM orders")
def b26(spark, d):
    cut = M.evidence_cutoff(datetime.date(2001, 8, 1), 90)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), M.snap_window(F.col("o_orderkey") % 100).alias("snapped"), (F.col("o_orderdate") >= F.lit(cut)).alias("in_window"))


@query("b27_seeded_order", "SELECT o_custkey AS entity, o_orderkey AS place, row_number() OVER (PARTITION BY o_custkey ORDER BY md5(o_custkey || '|' || 7 || '|' || o_orderkey)) AS at FROM orders")
def b27(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy(M.seeded_key(F.col("o_custkey"), F.lit(7), F.col("o_orderkey")))
    return table(spark, d, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("place"), F.row_number().over(w).alias("at"))


@query("c1_noise_floor", f"WITH {SIGNALS} SELECT row_id, platform, score FROM signals WHERE platform = 'reddit' OR score >= 20")
def c1(spark, d):
    return I.noise_floor(events_as_signals(spark, d), 20).select("row_id", "platform", "score")


_LANG_OK = "(language IS NULL OR confidence IS NULL OR confidence < CASE platform WHEN 'reddit' THEN 0.8 ELSE 0.7 END OR language IN ('en'))"


@query("c2_language_filter", f"WITH {SIGNALS} SELECT row_id, language, confidence FROM signals WHERE {_LANG_OK}")
def c2(spark, d):
    return I.language_filter(events_as_signals(spark, d), ["en"]).select("row_id", "language", "confidence")


@query("c3_ingest_stats", f"""WITH {SIGNALS}, r AS (SELECT *, CASE WHEN source_id IS NULL THEN 'malformed' WHEN platform <> 'reddit' AND score < 20 THEN 'noise' WHEN NOT {_LANG_OK} THEN 'language' END AS r FROM signals),
n AS (SELECT *, row_number() OVER (PARTITION BY tenant, platform, source_id, r IS NULL ORDER BY row_id) AS n FROM r)
SELECT run_id, coalesce(r, CASE WHEN n > 1 THEN 'duplicate' ELSE 'kept' END) AS reason, count(*) AS n, min(posted_at) AS oldest, max(posted_at) AS newest FROM n GROUP BY ALL""")
def c3(spark, d):
    return I.ingest_stats(events_as_signals(spark, d), ["en"], 20)


@query("c4_search_signals", f"WITH {SIGNALS} SELECT row_id FROM signals WHERE platform = 'instagram' AND status = 'done' AND captured_at BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def c4(spark, d):
    return I.search_signals(events_as_signals(spark, d), platform="instagram", status="done", since=datetime.date(2024, 1, 5), until=datetime.date(2024, 1, 20)).select("row_id")


@query("c5_drop_core_vocab", f"WITH {VOCAB} SELECT p_partkey AS id, p_name AS label FROM part WHERE p_name NOT IN (SELECT term FROM vocab)")
def c5(spark, d):
    return I.drop_core_vocab(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label")), core_vocab(spark, d), "label")


@query("c6_coerce_type", "SELECT p_partkey AS id, CASE WHEN p_type IN ('ECONOMY', 'PROMO') THEN p_type ELSE 'other' END AS entity_type FROM part")
def c6(spark, d):
    return I.coerce_type(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("entity_type")), ["ECONOMY", "PROMO", "other"])


_FORMS = "f AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' Vegan ' WHEN 2 THEN 'brunch' WHEN 3 THEN 'sugarfree' ELSE p_name END AS label FROM part)"


def forms(spark, d):
    k = F.col("p_partkey") % 5
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(k == 0, "").when(k == 1, " Vegan ").when(k == 2, "brunch").when(k == 3, "sugarfree").otherwise(F.col("p_name")).alias("label"))


@query("c7_well_formed", f"WITH {_FORMS} SELECT id, id % 5 = 4 AS ok, CASE id % 5 WHEN 0 THEN 'empty' WHEN 1 THEN 'modifier' WHEN 2 THEN 'occasion' WHEN 3 THEN 'modifier' ELSE 'compound' END AS reason FROM f")
def c7(spark, d):
    return forms(spark, d).select("id", T.well_formed(F.col("label"))["ok"].alias("ok"), T.well_formed(F.col("label"))["reason"].alias("reason"))


@query("c8_dangling", f"WITH {_FORMS} SELECT id, id % 5 = 1 AS dangling FROM f")
def c8(spark, d):
    return forms(spark, d).select("id", T.is_dangling(F.col("label")).alias("dangling"))


@query("c9_combine_verdict", "SELECT doc_id, CASE WHEN g IS NOT NULL OR s IS NOT NULL THEN NOT (coalesce(g, false) OR coalesce(s, false)) ELSE coalesce(l, true) END AS keep FROM (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN toxic = 1 END AS g, CASE WHEN doc_id % 2 = 0 THEN quality = 0 END AS s, CASE WHEN doc_id % 5 <> 0 THEN quality = 1 END AS l FROM labels)")
def c9(spark, d):
    k = F.col("doc_id")
    v = table(spark, d, "labels").select(
        "doc_id", F.when(k % 3 != 0, F.col("toxic") == 1).alias("everyday_generic"), F.when(k % 2 == 0, F.col("quality") == 0).alias("category_staple"), F.when(k % 5 != 0, F.col("quality") == 1).alias("specific")
    )
    return I.combine_verdict(v).select("doc_id", "keep")


@query("c10_live_entities", f"WITH {ENTITIES} SELECT entity, entity_type FROM entities WHERE deleted_at IS NULL")
def c10(spark, d):
    from signalmill.operators.buckets import live_entities

    return live_entities(entities(spark, d)).select("entity", "entity_type")


@query("c12_exclude_prefix", "SELECT p_partkey AS id, p_name FROM part WHERE NOT starts_with(p_name, 'red')")
def c12(spark, d):
    return I.exclude_prefix(table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name"), "p_name", "red")


@query("c13_pending_batch", f"WITH {SIGNALS} SELECT row_id AS signal_id, captured_at FROM signals WHERE status = 'pending' ORDER BY captured_at, row_id LIMIT 500")
def c13(spark, d):
    return I.pending_batch(events_as_signals(spark, d).withColumnRenamed("row_id", "signal_id"), 500).select("signal_id", "captured_at")


@query("c14_ingest_backlog", f"""WITH {RUNS}, e AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY completed_on, run_id) AS n FROM runs
WHERE status = 'succeeded' AND dataset_id IS NOT NULL AND coalesce(ingestion_status, '') NOT IN ('done', 'processing') AND completed_on >= DATE '2001-08-01' - 14)
SELECT run_id, CASE WHEN n <= 25 THEN 'ingest' ELSE 'defer' END AS action FROM e""")
def c14(spark, d):
    return I.ingest_backlog(runs(spark, d), datetime.date(2001, 8, 1)).select("run_id", "action")


@query("c15_has_fresh", f"WITH {RUNS} SELECT query_id AS tenant, coalesce(bool_or(status = 'succeeded' AND completed_on > DATE '2001-01-01'), false) AS fresh FROM runs GROUP BY query_id")
def c15(spark, d):
    return I.has_fresh(runs(spark, d).withColumn("tenant", F.col("query_id")), datetime.date(2001, 1, 1))


@query("c16_filtered_runs", f"WITH {RUNS} SELECT run_id, started_on FROM runs WHERE platform = '5-LOW' AND status = 'failed'")
def c16(spark, d):
    return I.filtered(runs(spark, d), [F.desc("started_on"), "run_id"], platform="5-LOW", status="failed", query_id=None).select("run_id", "started_on")
