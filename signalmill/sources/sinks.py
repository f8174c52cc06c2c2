"""Sinks as merges of a target and new rows; writers replace snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmill.sources.versions import TableSet


def append_new(df: DataFrame, target: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """A3: the rows to insert: one per key, none whose key is in the target. The first by `order` wins."""
    if order:
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    else:
        df = df.dropDuplicates(keys)
    return df.join(target.select(*keys), keys, "left_anti")


def upsert_latest(target: DataFrame, df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """A4: one row per key, the latest by `order`; new rows win ties."""
    both = target.withColumn("_new", F.lit(0)).unionByName(df.withColumn("_new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_new")


def upsert_buckets(target: DataFrame, df: DataFrame, keys=("entity", "platform", "geography", "bucket_date")) -> DataFrame:
    """A5: new measures replace old ones; buckets not recomputed stay."""
    keys = list(keys)
    measures = [c for c in df.columns if c not in keys]
    new = df.select(*keys, *[F.col(c).alias(f"_{c}") for c in measures], F.lit(True).alias("_hit"))
    j = target.join(new, keys, "full_outer")
    return j.select(*keys, *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in measures])


def replace_snapshot(tables: TableSet, name: str, df: DataFrame, scope: list | None = None, by: str | None = None) -> int:
    """Delete a snapshot and insert another, in one step; with a scope (values of the table's scope column) only the rows of those values, which end up empty where df has none. Returns the version."""
    change = tables.change()
    return (change.replace(name, df, by) if scope is None else change.replace_scope(name, df, scope)).commit()


def upsert_entities(entities: DataFrame, tagged: DataFrame) -> DataFrame:
    """By tenant and label: the first type stays, unseen aliases are added."""
    n = tagged.groupBy("tenant", "label").agg(F.min_by("entity_type", "place").alias("_t"), F.collect_set("alias").alias("_a"))
    j = entities.join(n, ["tenant", "label"], "full_outer")
    none = F.array().cast("array<string>")
    return j.select("tenant", "label", F.coalesce("entity_type", "_t").alias("entity_type"), F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("_a", none))).alias("aliases"))


def merge_mention_stats(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Counts add up, first and last seen widen; nulls give way."""
    n = links.groupBy("entity").agg(F.count("*").alias("_n"), F.min("posted_on").alias("_a"), F.max("posted_on").alias("_b"))
    return entities.join(n, "entity", "left").select(
        "entity", (F.coalesce("total_mentions", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("total_mentions"), F.least("first_seen", "_a").alias("first_seen"), F.greatest("last_seen", "_b").alias("last_seen")
    )


def merge_query_counters(queries: DataFrame, runs: DataFrame) -> DataFrame:
    """Fetched and usable of a query grow by its runs'."""
    n = runs.groupBy("query_id").agg(F.sum("records").alias("_f"), F.sum("usable").alias("_u"))
    grow = lambda c, d: (F.coalesce(c, F.lit(0)) + F.coalesce(d, F.lit(0))).alias(c)
    return queries.join(n, "query_id", "left").select("query_id", grow("fetched", "_f"), grow("usable", "_u"))


def diff_vocabulary(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """A10: insert, update, delete or keep per category and attribute (case and outer spaces apart)."""
    key = F.lower(F.trim("attribute")).alias("key")
    a = current.select("category", key, F.col("attribute").alias("old"))
    b = incoming.select("category", key, F.col("attribute").alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "update").otherwise("keep")
    return a.join(b, ["category", "key"], "full_outer").select("category", "key", "old", "new", action.alias("action"))


#: Defaults of tenant settings.
DEFAULTS = {"noise_floor": 3, "language_least": 0.7, "min_wow": 0.3, "min_volume": 9, "joint_least": 5, "lift_least": 2.0, "pair_days": 14, "long_tail_floor": 5, "posterior_least": 0.9}


def with_config(tenants: DataFrame, config: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Every tenant with its settings, defaults where a row or a value is missing."""
    d = defaults or DEFAULTS
    have = [c for c in d if c in config.columns]
    j = tenants.select("tenant").distinct().join(config.select("tenant", *have), "tenant", "left")
    return j.select("tenant", *[F.coalesce(F.col(c), F.lit(v)).alias(c) if c in have else F.lit(v).alias(c) for c, v in d.items()])


def purge_tenant(tables: TableSet, names: list[str], tenant) -> DataFrame:
    """Remove a tenant's rows from the named tables, all at once; returns (name, removed). Tables that are not named, such as settings, stay.

    Tables laid out by tenant lose a folder of their version, others are written without the rows.
    """
    before, change = tables.version(), tables.change()
    counts = None
    for n in names:
        t = tables.read(n, before)
        removed = t.where(F.col("tenant") == tenant).agg(F.lit(n).alias("name"), F.count("*").alias("removed"))
        counts = removed if counts is None else counts.union(removed)
        if change.new[n]["by"] == "tenant":
            change.drop_scope(n, [tenant])
        else:
            change.replace(n, t.where(~F.col("tenant").eqNullSafe(tenant)), change.new[n]["by"])
    report = tables.spark.createDataFrame(counts.collect(), counts.schema)  # one row a table
    change.commit()
    return report
