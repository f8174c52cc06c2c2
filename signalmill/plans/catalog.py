"""Registry of queries: one per operator, each over whole driver tables, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.operators.buckets import day_buckets
from signalmill.sources.fixtures import link_tasks, signal_links, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


# -- the driver tables as the reference data model -------------------------------------------


def links(spark, d, entity="p_brand"):
    return signal_links(spark, d, entity)


def buckets(spark, d, entity="p_brand", authors=False):
    """Day buckets of all links; with `authors`, for readers of unique_authors, links are dealt into tasks by their rows."""
    return day_buckets(links(spark, d, entity), tasks=link_tasks(spark, d) if authors else None).withColumn("tenant", F.lit(1))


def entities(spark, d):
    """Part names as entities."""
    p = table(spark, d, "part").groupBy(F.col("p_name").alias("entity")).agg(F.min("p_type").alias("entity_type"), F.count("*").alias("total_mentions"), F.min("p_partkey").alias("id"))
    deleted = F.when(F.col("id") % 10 == 3, F.lit("2001-01-01").cast("date")).alias("deleted_at")
    return p.select("entity", F.upper("entity").alias("label"), "entity_type", "total_mentions", deleted, F.array(F.substring_index("entity", " ", 1)).alias("aliases"), "id")


ENTITIES = """entities AS (SELECT p_name AS entity, upper(p_name) AS label, min(p_type) AS entity_type, count(*) AS total_mentions,
  CASE WHEN min(p_partkey) % 10 = 3 THEN DATE '2001-01-01' END AS deleted_at, [split_part(p_name, ' ', 1)] AS aliases, min(p_partkey) AS id FROM part GROUP BY p_name)"""


def runs(spark, d):
    """Orders as a run log."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    ing = F.when(k % 4 == 0, "done").when(k % 4 == 1, "processing").when(k % 4 == 2, "pending")
    day = F.to_date("o_orderdate")
    return o.select(
        (k % 3).cast("int").alias("tenant"), k.alias("run_id"), F.col("o_custkey").alias("query_id"), (F.col("o_custkey") % 200).alias("batch_id"), F.col("o_orderpriority").alias("platform"),
        status.alias("status"), day.alias("started_on"), F.when(status != "running", F.date_add(day, 1)).alias("completed_on"), F.when(k % 10 != 0, k).alias("dataset_id"), ing.alias("ingestion_status"),
        F.when(k % 7 == 0, 0).otherwise(k % 120).alias("records"), F.floor((k % 120) * 2 / 3).alias("usable"), (F.col("o_totalprice") / 1000).alias("cost"),
    )


RUNS = """runs AS (SELECT CAST(o_orderkey % 3 AS INT) AS tenant, o_orderkey AS run_id, o_custkey AS query_id, o_custkey % 200 AS batch_id, o_orderpriority AS platform,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, CAST(o_orderdate AS DATE) AS started_on,
  CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + 1 END AS completed_on, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey END AS dataset_id,
  CASE o_orderkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'processing' WHEN 2 THEN 'pending' END AS ingestion_status,
  CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 120 END AS records, CAST(floor((o_orderkey % 120) * 2 / 3) AS BIGINT) AS usable, o_totalprice / 1000 AS cost FROM orders)"""


def seed_queries(spark, d):
    """Customers as seed queries; their terms are part names."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    p = table(spark, d, "part").select("p_partkey", "p_name")
    q = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(p, F.col("c_custkey") == F.col("p_partkey"))
    noun = F.substring_index("p_name", " ", -1)
    return q.select(
        F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("watch_topic"), F.col("n_name").alias("geography"), F.when(F.col("c_custkey") % 2 == 0, "old").otherwise("new").alias("cohort"),
        F.array(F.concat(noun, F.lit("s")), F.concat(F.col("p_name"), F.lit(" now"))).alias("keywords"), F.array(F.concat(F.lit("#"), F.regexp_replace("p_name", " ", ""))).alias("hashtags"), F.col("p_name").alias("topic_label"),
    )


SEEDS = """seed_queries AS (SELECT c_custkey AS query_id, c_mktsegment AS watch_topic, n_name AS geography, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE 'new' END AS cohort,
  [split_part(p_name, ' ', 2) || 's', p_name || ' now'] AS keywords, ['#' || replace(p_name, ' ', '')] AS hashtags, p_name AS topic_label
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN part ON c_custkey = p_partkey)"""


def interest(spark, d):
    """Search interest by part name, from the order days of its lines."""
    b = links(spark, d, "p_name").groupBy(F.col("entity").alias("keyword"), F.col("posted_on").alias("bucket_date")).agg(((F.count("*") * 17 + F.sum(F.col("signal_id") % 13)) % 101).cast("int").alias("interest_value"))
    return b.where("interest_value % 3 <> 0")


INTEREST = """interest AS (SELECT * FROM (SELECT entity AS keyword, posted_on AS bucket_date, CAST((count(*) * 17 + sum(signal_id % 13)) % 101 AS INT) AS interest_value
  FROM links GROUP BY ALL) WHERE interest_value % 3 <> 0)"""


def events_as_signals(spark, d):
    """Events as raw signals with platforms of the normalisers."""
    e = table(spark, d, "events")
    kind = F.col("event_type")
    platform = F.when(kind == "click", "instagram").when(kind == "view", "tiktok").when(kind == "signup", "reddit").when(kind == "error", "x").otherwise("pinterest")
    return e.select(
        (F.col("user_id") % 3).cast("int").alias("tenant"), (F.col("event_id") % 20).alias("run_id"), F.col("event_id").alias("row_id"), platform.alias("platform"),
        F.when(F.col("event_id") % 50 != 0, F.concat(F.lit("s"), (F.col("event_id") % 4000).cast("string"))).alias("source_id"), F.round("value").cast("long").alias("score"),
        F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 3 == 0, "fr").otherwise("en").alias("language"), ((F.col("event_id") % 10) / 10).alias("confidence"),
        F.col("ts").alias("posted_at"), F.to_date("ts").alias("captured_at"), F.when(F.col("event_id") % 4 == 0, "pending").otherwise("done").alias("status"), F.col("value"),
    )


SIGNALS = """signals AS (SELECT CAST(user_id % 3 AS INT) AS tenant, event_id % 20 AS run_id, event_id AS row_id,
  CASE event_type WHEN 'click' THEN 'instagram' WHEN 'view' THEN 'tiktok' WHEN 'signup' THEN 'reddit' WHEN 'error' THEN 'x' ELSE 'pinterest' END AS platform,
  CASE WHEN event_id % 50 <> 0 THEN 's' || CAST(event_id % 4000 AS VARCHAR) END AS source_id, CAST(round(value) AS BIGINT) AS score,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'fr' ELSE 'en' END AS language, (event_id % 10) / 10 AS confidence, ts AS posted_at, CAST(ts AS DATE) AS captured_at,
  CASE WHEN event_id % 4 = 0 THEN 'pending' ELSE 'done' END AS status, value FROM events)"""


def core_vocab(spark, d):
    """Core terms: names of small parts."""
    return table(spark, d, "part").where("p_size = 1").select(F.initcap("p_name").alias("term")).distinct()


VOCAB = "vocab AS (SELECT DISTINCT p_name AS term FROM part WHERE p_size = 1)"


def load() -> None:
    """Import every module of queries beside this one."""
    import importlib

    for p in sorted(Path(__file__).parent.glob("queries_*.py")):
        importlib.import_module(f"{__package__}.{p.stem}")
