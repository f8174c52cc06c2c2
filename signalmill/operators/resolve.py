"""Entity resolution: duplicates, merges, repairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmill.functions.text import canonical_label, is_dangling
from signalmill.sources.versions import TableSet


def duplicate_groups(entities: DataFrame) -> DataFrame:
    """(entity, canonical, survivor) of labels that share a canonical form; most mentions survive, then the lowest label."""
    w = Window.partitionBy("canonical")
    e = entities.withColumn("canonical", canonical_label(F.col("entity"))).withColumn("n", F.count("*").over(w)).where("n > 1")
    return e.withColumn("survivor", F.first("entity").over(w.orderBy(F.desc("total_mentions"), "entity"))).select("entity", "canonical", "survivor")


def repoint_links(links: DataFrame, mapping: DataFrame) -> DataFrame:
    """Links of merged entities go to the survivor, once per signal."""
    m = mapping.select(F.col("entity"), "survivor")
    return links.join(m, "entity", "left").select("signal_id", F.coalesce("survivor", "entity").alias("entity")).distinct()


def merge_buckets(buckets: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mentions add up, authors take the maximum."""
    j = buckets.join(mapping.select("entity", "survivor"), "entity", "left").withColumn("entity", F.coalesce("survivor", "entity"))
    return j.groupBy("entity", "platform", "geography", "bucket_date").agg(F.sum("mentions").alias("mentions"), F.max("unique_authors").alias("unique_authors"))


def merge_aliases(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """All labels and aliases of a group but the canonical one."""
    j = entities.join(mapping.select("entity", "canonical", "survivor"), "entity")
    a = j.groupBy("survivor", "canonical").agg(F.array_union(F.collect_set("entity"), F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>"))))).alias("a"))
    return a.select(F.col("survivor").alias("entity"), "canonical", F.array_sort(F.array_except("a", F.array("canonical"))).alias("aliases"))


def rollup_entities(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """I4: survivor with canonical label, total mentions and aliases."""
    t = entities.join(mapping, "entity").groupBy("survivor").agg(F.sum("total_mentions").alias("total_mentions"))
    return merge_aliases(entities, mapping).join(t, F.col("entity") == F.col("survivor")).drop("survivor")


def compound_parent(entities: DataFrame) -> DataFrame:
    """(entity, parent) of one-word labels that begin a compound; the heaviest, then shortest compound, unless the word outweighs it."""
    low = F.lower(F.trim("entity"))
    one = entities.where(~low.contains(" ")).select("entity", F.col("total_mentions").alias("weight"), low.alias("k"))
    many = entities.where(low.contains(" ")).select(F.col("entity").alias("parent"), F.col("total_mentions").alias("parent_weight"), F.substring_index(low, " ", 1).alias("k"), F.length(low).alias("len"))
    best = F.min(F.struct((-F.col("parent_weight")).alias("w"), "len", "parent")).alias("b")
    j = one.join(many, "k").groupBy("entity", "weight").agg(best)
    return j.where(F.col("weight") <= -F.col("b.w")).select("entity", F.col("b.parent").alias("parent"))


def fold_modifiers(entities: DataFrame, states: DataFrame | None = None, items: DataFrame | None = None) -> dict[str, DataFrame]:
    """Dangling modifiers with a compound: synonym rows, the entities with `removed` set on the folded ones, and the items that their states point at, archived."""
    folded = compound_parent(entities).where(is_dangling(F.col("entity")))
    synonyms = folded.select(F.col("entity").alias("alias"), F.col("parent").alias("canonical_label"))
    gone = folded.select("entity").withColumn("_gone", F.lit(True))
    marked = entities.join(gone, "entity", "left").withColumn("removed", F.coalesce("_gone", F.lit(False))).drop("_gone")
    out = {"synonyms": synonyms, "entities": marked}
    return out if items is None else out | {"items": archive_items(items, states, folded)}


def fold_modifiers_in(tables: TableSet) -> int:
    """I5 over the tables `entities`, `states` and `items` of a set: synonyms, entities and items change in one step. Returns the version."""
    change = tables.change()
    for name, df in fold_modifiers(tables.read("entities"), tables.read("states"), tables.read("items")).items():
        change.replace(name, df)
    return change.commit()


def archive_items(items: DataFrame, states: DataFrame, removed: DataFrame) -> DataFrame:
    """Items whose state rows point at a removed entity are archived."""
    hit = states.join(removed.select("entity"), "entity", "left_semi").select("item_id").distinct().withColumn("_hit", F.lit(True))
    return items.join(hit, "item_id", "left").withColumn("archived", F.col("archived") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def repair_labels(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Curated label repairs, with a flag where the new label exists already. mapping (entity, fixed)."""
    have = entities.select(F.col("entity").alias("fixed")).distinct().withColumn("_have", F.lit(True))
    return entities.join(mapping, "entity").join(have, "fixed", "left").select("entity", "fixed", F.coalesce("_have", F.lit(False)).alias("collides"))
