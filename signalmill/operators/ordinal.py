"""A distributed ordinal index: places and prefix sums over all rows of a table in one order.

Rows are range-partitioned by the order and written; a partition's heads (its count and
sums) add up to the offsets of those after it, so that no task holds more than its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.sources.scratch import scratch_path

_LOW = (1 << 33) - 1


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """df sorted over range partitions, with the partition (_part) and the place in it (_at), as a written table: a second run of a range shuffle may cut elsewhere."""
    path = scratch_path(df.sparkSession, "ordinal")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Spark numbers rows as partition * 2**33 + place.
    rows = rows.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW)).alias("_at"))
    rows.write.parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def _offsets(rows: DataFrame, sums: dict[str, str]) -> DataFrame:
    """One row a partition: what stands before it, and the number of all rows."""
    heads = rows.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(F.coalesce(F.col(x), F.lit(0))).alias(f"_s_{i}") for i, x in enumerate(sums.values())])
    w = Window.orderBy("_part")  # over partitions, not rows
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    each = [F.coalesce(F.sum(f"_s_{i}").over(before), F.lit(0)).alias(f"_o_{i}") for i in range(len(sums))]
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return heads.select(F.col("_part"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), F.sum("_n").over(every).alias("_all"), *each)


def with_ordinals(df: DataFrame, order: list[Column | str], into: str = "ordinal", total: str | None = None) -> DataFrame:
    """df with the place of each row in `order`, from 0, and, where `total` names a column, the number of rows.

    Rows that the order does not tell apart get places in any order; nulls sort as the order
    says. An empty table stays empty. Columns of df keep their names.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = _ranged(df, order)
    j = rows.join(F.broadcast(_offsets(rows, {})), "_part")
    return j.select(*df.columns, (F.col("_o") + F.col("_at")).alias(into), *([F.col("_all").alias(total)] if total else []))


def with_prefix_sums(df: DataFrame, order: list[Column | str], sums: dict[str, str]) -> DataFrame:
    """df with, for each (new column: column) of `sums`, the sum of the column over all rows before; nulls add nothing."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    rows = _ranged(df, order)
    before = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"_w_{i}") for i, x in enumerate(sums.values())])
    j = rows.join(F.broadcast(_offsets(rows.drop(*[f"_w_{i}" for i in range(len(sums))]), sums)), "_part")
    return j.select(*df.columns, *[(F.col(f"_o_{i}") + F.col(f"_w_{i}")).alias(name) for i, name in enumerate(sums)])
