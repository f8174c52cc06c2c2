"""The driver tables as signals: three views in this library's data model, and their SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime.date(2001, 8, 1)
EVENTS_AS_OF = datetime.date(2024, 1, 30)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a join's larger side that one task sorts, and rows of a side that Spark may still broadcast.
TASK_ROWS, SMALL_SIDE = 250_000, 2_000_000


def tasks_of(spark: SparkSession, rows: int) -> int | None:
    """How many tasks of some TASK_ROWS rows; None where Spark's own number of shuffle partitions does that."""
    n = rows // TASK_ROWS + 1
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, rows: int, key: str) -> DataFrame:
    """df dealt by key into tasks of some TASK_ROWS of its `rows` rows."""
    n = tasks_of(df.sparkSession, rows)
    return df.repartition(n, key) if n else df


def link_tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """tasks_of() the rows of signal_links()."""
    return tasks_of(spark, table(spark, sf_dir, "lineitem").count())


def signal_links(spark: SparkSession, sf_dir: str, entity: str = "p_brand") -> DataFrame:
    """One row per signal-entity link: order lines as links, orders as signals, brands or part names as entities.

    The number of tasks goes with the rows, which a count reads from the files' footers, so
    that what a task sorts does not grow with the tables. Customers meet orders before lines do.
    """
    line, orders, part, cust, nation = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "customer", "nation"))
    lines, signals = line.count(), orders.count()
    if cust.count() > SMALL_SIDE:
        orders = dealt(orders, signals, "o_custkey")
    o = orders.join(cust, orders.o_custkey == cust.c_custkey).join(nation, cust.c_nationkey == nation.n_nationkey)
    if part.count() > SMALL_SIDE:
        line = dealt(line, lines, "l_partkey")
    j = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    j = dealt(j, lines, "l_orderkey").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.lit(1).alias("tenant"),
        F.col("o_orderkey").alias("signal_id"),
        F.col(entity).alias("entity"),
        F.col("p_type").alias("entity_type"),
        F.col("o_orderpriority").alias("platform"),
        F.coalesce("n_name", F.lit("Global")).alias("geography"),
        F.to_date("o_orderdate").alias("posted_on"),
        F.to_date("l_shipdate").alias("captured_on"),
        F.col("o_custkey").cast("string").alias("author"),
        F.col("l_extendedprice").alias("engagement"),
    )


def event_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: the entity is the key in its properties, the platform its type."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit(1).alias("tenant"), F.col("event_id").alias("signal_id"), F.get_json_object("props", "$.k").cast("long").alias("entity_id"),
        F.col("event_type").alias("platform"), F.lit("Global").alias("geography"), F.to_date("ts").alias("posted_on"), F.col("ts").alias("posted_at"),
        F.col("user_id").cast("string").alias("author"), F.col("value").alias("engagement"),
    )


def links_sql(entity: str = "p_brand", name: str = "links") -> str:
    return f"""{name} AS (SELECT 1 AS tenant, o_orderkey AS signal_id, {entity} AS entity, p_type AS entity_type, o_orderpriority AS platform,
  coalesce(n_name, 'Global') AS geography, CAST(o_orderdate AS DATE) AS posted_on, CAST(l_shipdate AS DATE) AS captured_on,
  CAST(o_custkey AS VARCHAR) AS author, l_extendedprice AS engagement
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


BUCKETS_SQL = """buckets AS (SELECT entity, platform, geography, posted_on AS bucket_date, count(*) AS mentions,
  count(DISTINCT nullif(author, '')) AS unique_authors, coalesce(sum(engagement) FILTER (engagement > 0), 0) AS engagement_sum,
  coalesce(median(engagement) FILTER (engagement > 0), 0) AS engagement_median FROM links GROUP BY ALL)"""

EVENT_LINKS_SQL = """elinks AS (SELECT 1 AS tenant, event_id AS signal_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS entity_id, event_type AS platform,
  'Global' AS geography, CAST(ts AS DATE) AS posted_on, ts AS posted_at, CAST(user_id AS VARCHAR) AS author, value AS engagement FROM events)"""


def with_links(entity: str = "p_brand") -> str:
    return f"WITH {links_sql(entity)}, {BUCKETS_SQL}"
