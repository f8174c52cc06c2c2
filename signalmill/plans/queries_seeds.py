"""Queries for seeds, entity resolution, run log and sinks."""

from __future__ import annotations

import datetime
import zlib

from pyspark.sql import functions as F

from signalmill.operators import ingest as I
from signalmill.operators import resolve as R
from signalmill.operators import runlog as L
from signalmill.operators import seeds as S
from signalmill.plans.catalog import ENTITIES, RUNS, SEEDS, SIGNALS, buckets, entities, events_as_signals, links, query, rounded, runs, seed_queries
from signalmill.plans.queries_text import _SINGULAR
from signalmill.sources import sinks as K
from signalmill.sources.fixtures import link_tasks, links_sql, table, with_links
from signalmill.sources.scratch import scratch_path
from signalmill.sources.versions import TableSet

_NORM = "trim(regexp_replace(lower({t}), '^#', ''))"
_SEEDVOC = f"""sv0 AS (SELECT query_id, watch_topic, unnest(list_concat(list_concat(keywords, hashtags), [topic_label])) AS search_term FROM seed_queries),
sv1 AS (SELECT *, {_NORM.format(t='search_term')} AS term FROM sv0), sv AS (SELECT term, min((query_id, search_term, watch_topic)) AS o FROM sv1 WHERE term <> '' GROUP BY term),
seeds AS (SELECT term, o[1] AS query_id, o[3] AS watch_topic, o[2] AS search_term FROM sv)"""


@query("d3_queries_with_last_ingest", f"WITH {SEEDS}, {RUNS} SELECT q.query_id, watch_topic, max(completed_on) AS last_ingest FROM seed_queries q LEFT JOIN runs r ON q.query_id = r.query_id GROUP BY ALL")
def d3(spark, d):
    return S.queries_with_last_ingest(seed_queries(spark, d), runs(spark, d)).select("query_id", "watch_topic", "last_ingest")


@query("d6_resolve_synonyms", f"""WITH c AS (SELECT p_partkey AS id, upper(p_name) AS label, p_type AS entity_type FROM part), s AS (SELECT DISTINCT p_name AS alias, 'ECONOMY' AS entity_type, split_part(p_name, ' ', 2) AS canonical_label FROM part WHERE p_size < 10)
SELECT id, coalesce(canonical_label, lower(label)) AS canonical FROM c LEFT JOIN s ON lower(label) = alias AND c.entity_type = s.entity_type""")
def d6(spark, d):
    p = table(spark, d, "part")
    df = p.select(F.lit(1).alias("tenant"), F.col("p_partkey").alias("id"), F.upper("p_name").alias("label"), F.col("p_type").alias("entity_type"))
    syn = p.where("p_size < 10").select(F.lit(1).alias("tenant"), F.col("p_name").alias("alias"), F.lit("ECONOMY").alias("entity_type"), F.substring_index("p_name", " ", -1).alias("canonical_label")).distinct()
    return I.resolve_synonyms(df, syn).select("id", "canonical")


@query("d8_seed_vocabulary", f"WITH {SEEDS}, {_SEEDVOC} SELECT * FROM seeds")
def d8(spark, d):
    return S.seed_vocabulary(seed_queries(spark, d))


_LABELS = "lab AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 2) END AS entity FROM part)"


def seed_labels(spark, d):
    return table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.substring_index("p_name", " ", -1)).alias("entity")).distinct()


def _sg(w):
    return _SINGULAR.format(w=w)


@query("d7_match_seeds", f"""WITH {SEEDS}, {_SEEDVOC}, {_LABELS}, sw AS (SELECT term, query_id, unnest(string_split(term, ' ')) AS w FROM seeds), lw AS (SELECT entity, unnest(string_split(entity, ' ')) AS w FROM lab WHERE contains(entity, ' ')),
h AS (SELECT entity, term, query_id, 0 AS p FROM lab JOIN seeds ON entity = term
UNION ALL SELECT entity, term, query_id, 1 FROM lab JOIN sw ON {_sg('entity')} = {_sg('sw.w')} WHERE NOT contains(entity, ' ')
UNION ALL SELECT entity, term, query_id, 1 FROM lw JOIN seeds ON {_sg('lw.w')} = {_sg('term')} WHERE NOT contains(term, ' ')),
m AS (SELECT entity, min((p, query_id, term)) AS m FROM h GROUP BY entity) SELECT entity, m[3] AS term, m[2] AS query_id FROM m""")
def d7(spark, d):
    return S.match_seeds(seed_labels(spark, d), S.seed_vocabulary(seed_queries(spark, d)))


_YIELD = "y AS (SELECT q.query_id, cohort, watch_topic, q.geography, keywords, count(DISTINCT r.run_id) FILTER (l.signal_id IS NOT NULL) AS signals, count(DISTINCT l.entity) AS entities FROM seed_queries q LEFT JOIN runs r ON q.query_id = r.query_id LEFT JOIN links l ON l.signal_id = r.run_id GROUP BY ALL)"


def yields(spark, d):
    k = links(spark, d)
    sig = k.select("signal_id", F.col("signal_id").alias("run_id")).distinct()
    return S.seed_yield(seed_queries(spark, d), runs(spark, d), sig, k, link_tasks(spark, d))


@query("e28_seed_yield", f"WITH {SEEDS}, {RUNS}, {links_sql()}, {_YIELD} SELECT query_id, cohort, signals, entities, round(entities / 2, 6) AS per_keyword FROM y")
def e28(spark, d):
    return rounded(yields(spark, d), "per_keyword")


@query("e28_yield_by_cohort", f"WITH {SEEDS}, {RUNS}, {links_sql()}, {_YIELD} SELECT cohort, count(*) AS n, min(entities) AS low, round(median(entities), 6) AS median, round(avg(entities), 6) AS mean, max(entities) AS high FROM y GROUP BY cohort")
def e28b(spark, d):
    return rounded(S.yield_by_cohort(yields(spark, d)), "median", "mean")


@query("d11_matched_pairs", f"""WITH {SEEDS}, {RUNS}, {links_sql()}, {_YIELD}, c AS (SELECT cohort, watch_topic, geography, avg(entities) AS y FROM y GROUP BY ALL)
SELECT a.watch_topic, a.geography, round(a.y, 6) AS old_yield, round(b.y, 6) AS new_yield, CASE WHEN a.y > 0 THEN round(b.y / a.y - 1, 6) END AS lift FROM c a JOIN c b ON a.watch_topic = b.watch_topic AND a.geography = b.geography WHERE a.cohort = 'old' AND b.cohort = 'new'""")
def d11(spark, d):
    q = seed_queries(spark, d).select("query_id", "watch_topic", "geography")
    y = yields(spark, d).join(q, "query_id").groupBy("cohort", "watch_topic", "geography").agg(F.avg("entities").alias("yield"))
    return rounded(S.matched_pairs(y.where("cohort = 'old'"), y.where("cohort = 'new'")), "old_yield", "new_yield", "lift")


@query("d13_unfired", f"WITH {SEEDS}, {RUNS} SELECT query_id FROM seed_queries WHERE query_id NOT IN (SELECT query_id FROM runs WHERE status = 'succeeded' AND platform = '5-LOW')")
def d13(spark, d):
    return S.unfired(seed_queries(spark, d), runs(spark, d).where("status = 'succeeded' and platform = '5-LOW'")).select("query_id")


@query("d14_signal_categories", f"WITH {links_sql('p_name')}, {ENTITIES} SELECT DISTINCT signal_id, e.entity_type AS category FROM links l JOIN entities e ON l.entity = e.entity WHERE deleted_at IS NULL AND e.entity_type <> 'PROMO'")
def d14(spark, d):
    e = entities(spark, d).withColumn("category", F.when(F.col("entity_type") != "PROMO", F.col("entity_type")))
    return I.signal_categories(links(spark, d, "p_name").select("signal_id", "entity"), e)


@query("d15_uncached_pairs", f"WITH {links_sql('p_name')}, p AS (SELECT DISTINCT signal_id, entity_type AS category FROM links) SELECT signal_id, category FROM p WHERE category IN ('ECONOMY', 'STANDARD', 'MEDIUM') AND signal_id % 3 <> 0")
def d15(spark, d):
    p = links(spark, d, "p_name").select("signal_id", F.col("entity_type").alias("category")).distinct()
    vocab = table(spark, d, "part").where("p_type in ('ECONOMY', 'STANDARD', 'MEDIUM')").select(F.col("p_type").alias("category"))
    return I.uncached_pairs(p, p.where("signal_id % 3 = 0"), vocab).select("signal_id", "category")


@query("d18_attach_verdicts", """WITH t AS (SELECT doc_id % 50 AS batch, doc_id AS place, 'T' || doc_id AS term FROM labels), k AS (SELECT *, doc_id % 50 AS batch, doc_id % 3 AS r FROM labels)
SELECT t.batch, t.place, t.term, CASE WHEN k.r = 2 THEN true ELSE k.quality = 1 END AS keep FROM t JOIN k ON t.place = k.doc_id""")
def d18(spark, d):
    k = table(spark, d, "labels")
    terms = k.select((F.col("doc_id") % 50).alias("batch"), F.col("doc_id").alias("place"), F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("term"))
    named = k.where("doc_id % 3 <> 2").select((F.col("doc_id") % 50).alias("batch"), F.col("doc_id").alias("place"), F.concat(F.lit(" t"), F.col("doc_id").cast("string")).alias("term"), (F.col("quality") == 1).alias("keep"))
    return I.attach_verdicts(terms, named)


@query("d20_recover_topics", """WITH t AS (SELECT p_partkey AS item_id, p_name || ' (' || p_type || ')' AS title, lower(p_name || ' ' || p_type) AS k, p_brand, p_size, DATE '2001-01-01' + CAST(p_partkey % 300 AS INT) AS day FROM part),
p AS (SELECT title, max((day, p_brand)) AS m FROM t WHERE p_size > 25 GROUP BY title), s AS (SELECT k, min(lower(p_brand)) AS topic FROM t GROUP BY k)
SELECT item_id, t.title, coalesce(m[2], s.topic) AS topic FROM t LEFT JOIN p ON t.title = p.title LEFT JOIN s ON t.k = s.k""")
def d20(spark, d):
    p = table(spark, d, "part")
    items = p.select(F.col("p_partkey").alias("item_id"), F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")")).alias("title"))
    rows = p.where("p_size > 25").select(F.col("p_partkey"), F.array(F.struct(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("title"), F.col("p_brand").alias("topic"))).alias("rows"))
    payloads = rows.select(F.date_add(F.lit("2001-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int")).alias("committed_on"), "rows")
    snap = p.select(F.concat(F.initcap("p_name"), F.lit("  "), F.col("p_type")).alias("title"), F.lower("p_brand").alias("topic"))
    return S.recover_topics(items, payloads, snap)


@query("d21_tag_entities", r"""WITH v AS (SELECT DISTINCT lower(w) AS term, lower(w) AS entity FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE regexp_matches(w, '^[A-Za-z]{6,}$')),
w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(w) AS term, unnest(range(0, len(w))) AS p FROM w), h AS (SELECT doc_id, entity, min(p) AS p FROM g JOIN v ON g.term = v.term GROUP BY ALL)
SELECT signal_id, entity, place FROM (SELECT doc_id AS signal_id, entity, row_number() OVER (PARTITION BY doc_id ORDER BY p, entity) AS place FROM h) WHERE place <= 5""")
def d21(spark, d):
    w = table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).where(F.col("w").rlike("^[A-Za-z]{6,}$"))
    v = w.select(F.lower("w").alias("term"), F.lower("w").alias("entity")).distinct()
    return I.tag_entities(table(spark, d, "documents").select(F.col("doc_id").alias("signal_id"), "text"), v)


#: First word and number of words of the terms taken from each benchmark item.
_LONG_TERMS = ((1, 1), (3, 3), (1, 6))


@query("d21_tag_long_terms", r"""WITH bw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
v AS (SELECT DISTINCT array_to_string(w[f:f + k - 1], ' ') AS term, item_id || '/' || k AS entity, k FROM bw, (VALUES (1, 1), (3, 3), (1, 6)) AS t(f, k) WHERE len(w) >= f + k - 1),
w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, k, unnest(list_transform(range(0, len(w) - k + 1), lambda i: {'p': i, 'term': array_to_string(w[i + 1:i + k], ' ')}), recursive := true) FROM w, (VALUES (1), (3), (6)) AS t(k) WHERE len(w) >= k),
h AS (SELECT doc_id, entity, min(p) AS p FROM g JOIN v ON g.term = v.term AND g.k = v.k GROUP BY ALL)
SELECT signal_id, entity, place FROM (SELECT doc_id AS signal_id, entity, row_number() OVER (PARTITION BY doc_id ORDER BY p, entity) AS place FROM h) WHERE place <= 5""")
def d21_long(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("w"))
    some = [w.where(F.size("w") >= f + k - 1).select(F.concat_ws(" ", F.slice("w", f, k)).alias("term"), F.concat(F.col("item_id").cast("string"), F.lit(f"/{k}")).alias("entity")) for f, k in _LONG_TERMS]
    return I.tag_entities(table(spark, d, "documents").select(F.col("doc_id").alias("signal_id"), "text"), some[0].unionByName(some[1]).unionByName(some[2]))


@query("d22_tag_attributes", r"""WITH v AS (SELECT DISTINCT lang AS category, w AS attribute FROM (SELECT lang, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents) WHERE length(w) > 5),
w AS (SELECT DISTINCT doc_id, lang, unnest(string_split_regex(lower(text), '[^\p{L}\p{N}]+')) AS w FROM documents)
SELECT d.doc_id AS signal_id, d.lang AS category, v.attribute FROM documents d LEFT JOIN (SELECT w.doc_id, v.* FROM w JOIN v ON w.lang = v.category AND w.w = v.attribute) v ON d.doc_id = v.doc_id""")
def d22(spark, d):
    docs = table(spark, d, "documents")
    v = docs.select(F.col("lang").alias("category"), F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("attribute")).where("length(attribute) > 5").distinct()
    s = docs.select(F.col("doc_id").alias("signal_id"), "text")
    return I.tag_attributes(s, docs.select(F.col("doc_id").alias("signal_id"), F.col("lang").alias("category")), v)


@query("d23_attribute_runs", f"""WITH {SEEDS}, r AS (SELECT o_orderkey AS run_id, [p_name || ' NOW', split_part(p_name, ' ', 2) || 's'] AS terms FROM orders LEFT JOIN part ON o_custkey % 500 = p_partkey),
a AS (SELECT DISTINCT run_id, lower(trim(unnest(terms))) AS t FROM r), q AS (SELECT DISTINCT query_id, lower(trim(unnest(keywords))) AS t FROM seed_queries),
n AS (SELECT run_id, query_id, count(*) AS n FROM a JOIN q ON a.t = q.t GROUP BY ALL), m AS (SELECT run_id, arg_min(query_id, (-n, query_id)) AS query_id FROM n GROUP BY run_id) SELECT r.run_id, m.query_id FROM r LEFT JOIN m ON r.run_id = m.run_id""")
def d23(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name")
    o = table(spark, d, "orders").join(p, F.col("o_custkey") % 500 == F.col("p_partkey"), "left")
    r = o.select(F.col("o_orderkey").alias("run_id"), F.array(F.concat("p_name", F.lit(" NOW")), F.concat(F.substring_index("p_name", " ", -1), F.lit("s"))).alias("terms"))
    return S.attribute_runs(r, seed_queries(spark, d))


@query("e29_platform_breadth", f"WITH {links_sql()}, n AS (SELECT entity || geography AS e, count(DISTINCT platform) AS platforms FROM links WHERE posted_on >= DATE '2001-07-01' GROUP BY ALL), h AS (SELECT platforms, count(*) AS entities FROM n GROUP BY ALL) SELECT platforms, entities, round(sum(CASE WHEN platforms >= 2 THEN entities ELSE 0 END) OVER () / sum(entities) OVER (), 6) AS share_2plus FROM h")
def e29(spark, d):
    k = links(spark, d).where("posted_on >= '2001-07-01'").withColumn("entity", F.concat("entity", "geography"))
    return rounded(S.platform_breadth(k), "share_2plus")


@query("e30_scrape_conditions", f"WITH {SEEDS}, {RUNS}, g AS (SELECT cohort, platform, count(*) AS runs, sum(records) AS records FROM runs r JOIN seed_queries q ON r.query_id = q.query_id GROUP BY ALL) SELECT *, round(records / runs, 6) AS per_run, round(records / sum(records) OVER (PARTITION BY cohort), 6) AS share FROM g")
def e30(spark, d):
    return rounded(S.scrape_conditions(runs(spark, d), seed_queries(spark, d)), "per_run", "share")


@query("e36_topic_matrix", f"WITH {SEEDS} SELECT watch_topic, count(*) FILTER (geography = 'NATION_0') AS NATION_0, count(*) FILTER (geography = 'NATION_7') AS NATION_7 FROM seed_queries GROUP BY watch_topic")
def e36(spark, d):
    return S.topic_matrix(seed_queries(spark, d), ["NATION_0", "NATION_7"])


# -- entity resolution ------------------------------------------------------------------------

_DUP = """pe AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || CASE WHEN p_partkey % 3 = 0 THEN ' co' ELSE '' END AS entity, count(*) AS total_mentions FROM part GROUP BY ALL),
pc AS (SELECT *, regexp_replace(lower(entity), ' co$', '') AS canonical FROM pe), dups AS (SELECT entity, canonical, first_value(entity) OVER (PARTITION BY canonical ORDER BY total_mentions DESC, entity) AS survivor, count(*) OVER (PARTITION BY canonical) AS n FROM pc),
dup AS (SELECT entity, canonical, survivor FROM dups WHERE n > 1)"""


def _variant():
    return F.concat(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), F.when(F.col("p_partkey") % 3 == 0, " co").otherwise(""))


def variants(spark, d):
    return table(spark, d, "part").groupBy(_variant().alias("entity")).agg(F.count("*").alias("total_mentions")).withColumn("aliases", F.array(F.lower("entity")))


@query("i1_duplicate_groups", f"WITH {_DUP} SELECT * FROM dup")
def i1(spark, d):
    return R.duplicate_groups(variants(spark, d))


_VLINKS = "vlinks AS (SELECT l_orderkey AS signal_id, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || CASE WHEN p_partkey % 3 = 0 THEN ' co' ELSE '' END AS entity, CAST(l_shipdate AS DATE) AS bucket_date, l_returnflag AS platform FROM lineitem JOIN part ON l_partkey = p_partkey)"


def variant_links(spark, d):
    j = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(F.col("l_orderkey").alias("signal_id"), _variant().alias("entity"), F.to_date("l_shipdate").alias("bucket_date"), F.col("l_returnflag").alias("platform"))


@query("i2_repoint_links", f"WITH {_DUP}, {_VLINKS} SELECT DISTINCT signal_id, coalesce(survivor, l.entity) AS entity FROM vlinks l LEFT JOIN dup ON l.entity = dup.entity")
def i2(spark, d):
    return R.repoint_links(variant_links(spark, d), R.duplicate_groups(variants(spark, d)))


@query("i3_merge_buckets", f"""WITH {_DUP}, {_VLINKS}, vb AS (SELECT entity, platform, 'Global' AS geography, bucket_date, count(*) AS mentions, count(DISTINCT signal_id) AS unique_authors FROM vlinks GROUP BY ALL)
SELECT coalesce(survivor, vb.entity) AS entity, platform, geography, bucket_date, sum(mentions) AS mentions, max(unique_authors) AS unique_authors FROM vb LEFT JOIN dup ON vb.entity = dup.entity GROUP BY ALL""")
def i3(spark, d):
    b = variant_links(spark, d).groupBy("entity", "platform", F.lit("Global").alias("geography"), "bucket_date").agg(F.count("*").alias("mentions"), F.count_distinct("signal_id").alias("unique_authors"))
    return R.merge_buckets(b, R.duplicate_groups(variants(spark, d)))


_ALIASES = "al AS (SELECT survivor AS entity, dup.canonical, list_sort(list_distinct(list_concat(list(dup.entity), list(lower(dup.entity))))) AS a, sum(total_mentions) AS total_mentions FROM dup JOIN pe ON dup.entity = pe.entity GROUP BY ALL)"


@query("g2_merge_aliases", f"WITH {_DUP}, {_ALIASES} SELECT entity, canonical, list_filter(a, lambda x: x <> canonical) AS aliases FROM al")
def g2(spark, d):
    v = variants(spark, d)
    return R.merge_aliases(v, R.duplicate_groups(v))


@query("i4_rollup_entities", f"WITH {_DUP}, {_ALIASES} SELECT entity, canonical, list_filter(a, lambda x: x <> canonical) AS aliases, total_mentions FROM al")
def i4(spark, d):
    v = variants(spark, d)
    return R.rollup_entities(v, R.duplicate_groups(v))


_MOD = "me AS (SELECT entity, sum(n) AS total_mentions FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'vegan' WHEN 'small' THEN 'organic' ELSE split_part(p_name, ' ', 1) END ELSE replace(replace(p_name, 'red ', 'vegan '), 'small ', 'organic ') END AS entity, 1 AS n FROM part) GROUP BY entity)"
_PARENT = """par AS (SELECT a.entity, min((-b.total_mentions, length(b.entity), b.entity)) AS b, any_value(a.total_mentions) AS w FROM me a JOIN me b ON starts_with(b.entity, a.entity || ' ') WHERE NOT contains(a.entity, ' ') GROUP BY a.entity),
parent AS (SELECT entity, b[3] AS parent FROM par WHERE w <= -b[1])"""


def modifiers(spark, d):
    swap = F.regexp_replace(F.regexp_replace("p_name", "red ", "vegan "), "small ", "organic ")
    e = F.when(F.col("p_partkey") % 9 == 0, F.substring_index(swap, " ", 1)).otherwise(swap)
    return table(spark, d, "part").groupBy(e.alias("entity")).agg(F.count("*").alias("total_mentions"))


@query("d9_compound_parent", f"WITH {_MOD}, {_PARENT} SELECT * FROM parent")
def d9(spark, d):
    return R.compound_parent(modifiers(spark, d))


def folded(spark, d):
    """The tables after the fold; orders are states and items, an order's state points at the entity of its customer's number."""
    tables, me = TableSet(spark, scratch_path(spark, "folded")), modifiers(spark, d)
    w = me.select("entity", F.pmod(F.crc32(F.col("entity").cast("binary")), F.lit(16)).alias("_h"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.pmod("o_custkey", F.lit(16)).alias("_h"), (F.col("o_orderstatus") == "P").alias("archived"))
    tables.change().replace("entities", me).replace("states", o.join(w, "_h").select("item_id", "entity")).replace("items", o.select("item_id", "archived")).commit()
    R.fold_modifiers_in(tables)
    return tables


@query("i5_fold_modifiers", f"WITH {_MOD}, {_PARENT} SELECT me.entity, total_mentions, parent.entity IS NOT NULL AS removed FROM me LEFT JOIN parent ON me.entity = parent.entity AND me.entity IN ('vegan', 'organic')")
def i5(spark, d):
    return folded(spark, d).read("entities")


@query("i5_fold_synonyms", f"WITH {_MOD}, {_PARENT} SELECT entity AS alias, parent AS canonical_label FROM parent WHERE entity IN ('vegan', 'organic')")
def i5s(spark, d):
    return folded(spark, d).read("synonyms")


#: crc32 of the two folded words, modulo 16.
_FOLDED = {w: zlib.crc32(w.encode()) % 16 for w in ("vegan", "organic")}


@query("i5_fold_items", f"WITH {_MOD}, {_PARENT}, h AS (SELECT CASE entity WHEN 'vegan' THEN {_FOLDED['vegan']} ELSE {_FOLDED['organic']} END AS h FROM parent WHERE entity IN ('vegan', 'organic')) SELECT o_orderkey AS item_id, o_orderstatus = 'P' OR o_custkey % 16 IN (SELECT h FROM h) AS archived FROM orders")
def i5i(spark, d):
    return folded(spark, d).read("items")


@query("i6_repair_labels", f"WITH {ENTITIES} SELECT entity, CASE WHEN id % 2 = 0 THEN replace(entity, 'red', 'blue') ELSE entity || 's' END AS fixed, CASE WHEN id % 2 = 0 THEN replace(entity, 'red', 'blue') ELSE entity || 's' END IN (SELECT entity FROM entities) AS collides FROM entities WHERE entity LIKE 'red%'")
def i6(spark, d):
    e = entities(spark, d)
    m = e.where("entity like 'red%'").select("entity", F.when(F.col("id") % 2 == 0, F.regexp_replace("entity", "red", "blue")).otherwise(F.concat("entity", F.lit("s"))).alias("fixed"))
    return R.repair_labels(e, m)


@query("d19_archive_items", f"WITH {ENTITIES} SELECT o_orderkey AS item_id, o_orderstatus = 'P' OR o_custkey % 64 IN (SELECT rn FROM (SELECT id % 64 AS rn FROM entities WHERE deleted_at IS NOT NULL)) AS archived FROM orders")
def d19(spark, d):
    o = table(spark, d, "orders")
    removed = entities(spark, d).where("deleted_at is not null").select((F.col("id") % 64).alias("entity"))
    return R.archive_items(o.select(F.col("o_orderkey").alias("item_id"), (F.col("o_orderstatus") == "P").alias("archived")), o.select(F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") % 64).alias("entity")), removed)


# -- run log -----------------------------------------------------------------------------------


@query("e24_run_summary", f"WITH {RUNS} SELECT count(*) AS runs, sum(records) AS records, sum(usable) AS usable, round(sum(cost), 2) AS cost, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'failed') AS failed FROM runs WHERE started_on >= DATE '1999-01-01'")
def e24(spark, d):
    return rounded(L.run_summary(runs(spark, d), datetime.date(1999, 1, 1)), "cost", n=2)


@query("e31_runs_by_status", f"WITH {RUNS} SELECT platform, status, count(*) AS runs, count(DISTINCT batch_id) AS batches, count(DISTINCT query_id) AS queries, min(started_on) AS first_on, max(started_on) AS last_on FROM runs GROUP BY ALL")
def e31(spark, d):
    return L.run_rollups(runs(spark, d))["status"]


@query("e31_runs_by_batch", f"WITH {RUNS} SELECT batch_id, platform, count(*) AS runs FROM runs GROUP BY ALL")
def e31b(spark, d):
    return L.run_rollups(runs(spark, d))["batch"]


@query("e31_runs_by_query", f"""WITH {RUNS} SELECT query_id, count(*) FILTER (platform = '1-URGENT') AS "1-URGENT", count(*) FILTER (platform = '2-HIGH') AS "2-HIGH", count(*) FILTER (platform = '3-MEDIUM') AS "3-MEDIUM", count(*) FILTER (platform = '4-NOT SPECIFIED') AS "4-NOT SPECIFIED", count(*) FILTER (platform = '5-LOW') AS "5-LOW" FROM runs GROUP BY query_id""")
def e31c(spark, d):
    return L.run_rollups(runs(spark, d))["query"]


@query("e31_runs_by_query_rows", f"WITH {RUNS} SELECT query_id, platform, count(*) AS runs FROM runs GROUP BY ALL")
def e31d(spark, d):
    return L.run_rollups(runs(spark, d))["query_rows"]


@query("e32_batch_complete", f"""WITH {RUNS}, r AS (SELECT query_id AS batch_id, count(*) AS n, bool_and(coalesce(status IN ('succeeded', 'failed', 'aborted') AND (status <> 'succeeded' OR ingestion_status = 'done'), false)) AS ok FROM runs GROUP BY ALL),
b AS (SELECT c_custkey AS batch_id, 1 + c_custkey % 12 AS expected FROM customer) SELECT b.batch_id, expected, coalesce(n, 0) AS runs, coalesce(n, 0) = expected AND coalesce(ok, false) AS complete FROM b LEFT JOIN r ON b.batch_id = r.batch_id""")
def e32(spark, d):
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("batch_id"), (1 + F.col("c_custkey") % 12).alias("expected"))
    return L.batch_complete(b, runs(spark, d).withColumn("batch_id", F.col("query_id")))


@query("e33_reconcile_runs", f"WITH {RUNS}, s AS (SELECT l_orderkey AS run_id, count(*) AS found FROM lineitem GROUP BY ALL) SELECT r.run_id, coalesce(found, 0) AS found, CASE WHEN coalesce(found, 0) > 0 THEN 'finish' ELSE 'retry' END AS action, greatest(0, records - coalesce(found, 0)) AS dropped FROM runs r LEFT JOIN s ON r.run_id = s.run_id WHERE ingestion_status = 'processing'")
def e33(spark, d):
    return L.reconcile_runs(runs(spark, d), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id")))


_RATES = "rates AS (SELECT platform, coalesce(avg(cost) FILTER (records = 0), 0) AS floor, coalesce(sum(cost) FILTER (records >= 40) / sum(records) FILTER (records >= 40), 0) AS rate FROM runs GROUP BY platform)"


@query("e34_cost_rates", f"WITH {RUNS}, {_RATES} SELECT platform, round(floor, 6) AS floor, round(rate, 6) AS rate FROM rates")
def e34(spark, d):
    return rounded(L.cost_rates(runs(spark, d)), "floor", "rate")


@query("e34_run_costs", f"WITH {RUNS}, {_RATES} SELECT run_id, runs.platform, records, round(greatest(floor, records * rate), 4) AS modelled FROM runs JOIN rates ON runs.platform = rates.platform")
def e34b(spark, d):
    r = runs(spark, d)
    return rounded(L.run_costs(r, L.cost_rates(r)), "modelled", n=4)


@query("e34_spend", f"WITH {RUNS} SELECT platform, count(*) AS billed, round(sum(cost), 2) AS spend FROM runs WHERE status IN ('succeeded', 'failed') AND cost > 0 GROUP BY platform")
def e34c(spark, d):
    return rounded(L.spend(runs(spark, d)), "spend", n=2)


@query("e25_pipeline_status", f"""WITH {SIGNALS}, {RUNS}, {links_sql('p_name')}, {ENTITIES} SELECT (SELECT count(*) FROM signals WHERE status = 'pending') AS pending, (SELECT count(*) FROM signals WHERE status = 'done') AS done,
(SELECT count(*) FROM links WHERE DATE '2001-08-01' - posted_on BETWEEN 0 AND 30) AS links_in_window, (SELECT count(DISTINCT entity) FROM links WHERE DATE '2001-08-01' - posted_on BETWEEN 0 AND 30) AS active_entities, (SELECT count(*) FROM entities) AS entities, (SELECT max(completed_on) FROM runs WHERE status = 'succeeded') AS last_run""")
def e25(spark, d):
    return L.pipeline_status(events_as_signals(spark, d), links(spark, d, "p_name"), entities(spark, d), runs(spark, d), datetime.date(2001, 8, 1), 30)


# -- sinks ---------------------------------------------------------------------------------------


@query("a3_append_new", f"WITH {SIGNALS}, f AS (SELECT *, row_number() OVER (PARTITION BY tenant, platform, source_id ORDER BY row_id) AS n FROM signals WHERE row_id >= 3000 AND source_id IS NOT NULL) SELECT row_id FROM f WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM signals s WHERE s.row_id < 3000 AND s.tenant = f.tenant AND s.platform = f.platform AND s.source_id = f.source_id)")
def a3(spark, d):
    s = events_as_signals(spark, d)
    return K.append_new(s.where("row_id >= 3000 and source_id is not null"), s.where("row_id < 3000"), ["tenant", "platform", "source_id"], "row_id").select("row_id")


@query("a4_upsert_latest", "WITH o AS (SELECT o_custkey AS keyword, CAST(o_orderdate AS DATE) AS fetched, max(o_orderkey) AS value FROM orders GROUP BY ALL) SELECT keyword, max(fetched) AS fetched, arg_max(value, fetched) AS value FROM o GROUP BY keyword")
def a4(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("keyword"), F.to_date("o_orderdate").alias("fetched")).agg(F.max("o_orderkey").alias("value"))
    old = o.where("fetched < '1998-01-01'")
    return K.upsert_latest(old, o.where("fetched >= '1998-01-01'"), ["keyword"], "fetched")


@query("a5_upsert_buckets", f"{with_links()} SELECT entity, platform, geography, bucket_date, CASE WHEN bucket_date >= DATE '2000-01-01' THEN mentions + 100 ELSE mentions END AS mentions, unique_authors FROM buckets WHERE bucket_date < DATE '2000-06-01' OR bucket_date >= DATE '2000-01-01'")
def a5(spark, d):
    b = buckets(spark, d, authors=True).select("entity", "platform", "geography", "bucket_date", "mentions", "unique_authors")
    return K.upsert_buckets(b.where("bucket_date < '2000-06-01'"), b.where("bucket_date >= '2000-01-01'").withColumn("mentions", F.col("mentions") + 100))


@query("a7_upsert_entities", "WITH o AS (SELECT p_name AS label, min(p_type) AS entity_type FROM part WHERE p_size > 25 GROUP BY p_name), t AS (SELECT p_name AS label, arg_min(p_type, p_partkey) AS ty, list(DISTINCT p_brand) AS a FROM part WHERE p_size <= 40 GROUP BY p_name) SELECT 1 AS tenant, coalesce(o.label, t.label) AS label, coalesce(entity_type, ty) AS entity_type, list_sort(list_distinct(list_concat(CASE WHEN o.label IS NULL THEN [] ELSE [upper(o.label)] END, coalesce(a, [])))) AS aliases FROM o FULL JOIN t ON o.label = t.label")
def a7(spark, d):
    p = table(spark, d, "part")
    old = p.where("p_size > 25").groupBy(F.lit(1).alias("tenant"), F.col("p_name").alias("label")).agg(F.min("p_type").alias("entity_type"), F.array(F.upper(F.first("p_name"))).alias("aliases"))
    new = p.where("p_size <= 40").select(F.lit(1).alias("tenant"), F.col("p_name").alias("label"), F.col("p_type").alias("entity_type"), F.col("p_brand").alias("alias"), F.col("p_partkey").alias("place"))
    return K.upsert_entities(old, new)


@query("a8_merge_mention_stats", f"WITH {links_sql('p_name')}, {ENTITIES}, n AS (SELECT entity, count(*) AS n, min(posted_on) AS a, max(posted_on) AS b FROM links GROUP BY ALL) SELECT e.entity, total_mentions + coalesce(n, 0) AS total_mentions, least(DATE '1999-01-01', a) AS first_seen, b AS last_seen FROM entities e LEFT JOIN n ON e.entity = n.entity")
def a8(spark, d):
    e = entities(spark, d).withColumn("first_seen", F.lit("1999-01-01").cast("date")).withColumn("last_seen", F.lit(None).cast("date"))
    return K.merge_mention_stats(e, links(spark, d, "p_name"))


@query("a9_merge_query_counters", f"WITH {SEEDS}, {RUNS} SELECT q.query_id, any_value(q.query_id % 5) + coalesce(sum(records), 0) AS fetched, coalesce(sum(usable), 0) AS usable FROM seed_queries q LEFT JOIN runs r ON q.query_id = r.query_id GROUP BY q.query_id")
def a9(spark, d):
    q = seed_queries(spark, d).withColumn("fetched", F.col("query_id") % 5).withColumn("usable", F.lit(None).cast("long"))
    return K.merge_query_counters(q, runs(spark, d))


@query("a10_diff_vocabulary", "WITH c AS (SELECT DISTINCT p_brand AS category, p_name AS old FROM part WHERE p_size < 35), i AS (SELECT DISTINCT p_brand AS category, CASE WHEN p_brand < 'Brand#2' THEN upper(p_name) ELSE p_name END AS new FROM part WHERE p_size > 15) SELECT coalesce(c.category, i.category) AS category, lower(coalesce(old, new)) AS key, old, new, CASE WHEN old IS NULL THEN 'insert' WHEN new IS NULL THEN 'delete' WHEN old <> new THEN 'update' ELSE 'keep' END AS action FROM c FULL JOIN i ON c.category = i.category AND lower(old) = lower(new)")
def a10(spark, d):
    p = table(spark, d, "part")
    cur = p.where("p_size < 35").select(F.col("p_brand").alias("category"), F.col("p_name").alias("attribute")).distinct()
    new = p.where("p_size > 15").select(F.col("p_brand").alias("category"), F.when(F.col("p_brand") < "Brand#2", F.upper("p_name")).otherwise(F.col("p_name")).alias("attribute")).distinct()
    return K.diff_vocabulary(cur, new)


@query("a11_with_config", "SELECT c_custkey AS tenant, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN CAST(c_custkey % 10 AS INT) ELSE 3 END AS noise_floor, 0.3 AS min_wow FROM customer")
def a11(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("tenant"))
    cfg = c.where("tenant % 2 = 0").select("tenant", F.when(F.col("tenant") % 3 != 0, (F.col("tenant") % 10).cast("int")).alias("noise_floor"))
    return K.with_config(c, cfg, {"noise_floor": 3, "min_wow": 0.3})


def purged(spark, d):
    """Signals laid out by tenant and runs that are not, with tenant 1 removed; and the report."""
    tables = TableSet(spark, scratch_path(spark, "purged"))
    tables.change().replace("signals", events_as_signals(spark, d), "tenant").replace("runs", runs(spark, d)).commit()
    return tables, K.purge_tenant(tables, ["signals", "runs"], 1)


@query("a12_purge_tenant", f"WITH {SIGNALS}, {RUNS} SELECT 'signals' AS name, count(*) AS removed FROM signals WHERE tenant = 1 UNION ALL SELECT 'runs', count(*) FROM runs WHERE tenant = 1")
def a12(spark, d):
    return purged(spark, d)[1]


@query("a12_purged_tables", f"WITH {SIGNALS}, {RUNS} SELECT 'signals' AS name, tenant, count(*) AS n FROM signals WHERE tenant <> 1 GROUP BY tenant UNION ALL SELECT 'runs', tenant, count(*) FROM runs WHERE tenant <> 1 GROUP BY tenant")
def a12t(spark, d):
    tables, _ = purged(spark, d)
    left = [tables.read(n).groupBy(F.lit(n).alias("name"), "tenant").agg(F.count("*").alias("n")) for n in ("signals", "runs")]
    return left[0].union(left[1])
