"""Helpers shared by the operators: table access, shared scratch tables, row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="signalmill-")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode (tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = _own_dir()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/signalmill/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _MADE:
        _MADE[-1][path] = out
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of stored() whose every reader has been stored itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of the open cleared() blocks, the innermost last.
_MADE: list[dict[str, DataFrame]] = []


@contextmanager
def cleared() -> Iterator[dict[str, DataFrame]]:
    """The tables that stored() writes in the block, by path; those still in the dict at its end, or when it fails, are deleted."""
    _MADE.append({})
    try:
        yield _MADE[-1]
    finally:
        release(*_MADE.pop().values())


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A table of few narrow columns, marked for a broadcast if it is counted at no more than `rows` rows; beyond, joins shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def boxed(docs: DataFrame, *extra: Column) -> DataFrame:
    """All columns of docs as one, `_row`, beside own ones, so that no names clash; select("_row.*") opens it."""
    return docs.select(F.expr("struct(*)").alias("_row"), *extra)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits naming a row by id and content; equal rows share it, null ids are allowed."""
    return [
        F.xxhash64(F.col(id_col), F.lit(1)).alias("_k1"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.lit(2)).alias("_k2"),
    ]


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


#: Bytes of rows that go to Python in one Arrow batch.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session end at BATCH_BYTES, unless it has a limit of its own.

    Spark's default of 10,000 rows or 64 MB is held several times in each task outside the
    heap: as vectors that double as they grow, as the bytes sent, and again in Python.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def map_texts(df: DataFrame, make: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str, rows: int = 500) -> DataFrame:
    """mapInPandas that sees `rows` rows at a time, whatever the session's Arrow batches hold, so few whole texts are in memory as objects."""
    small_batches(df.sparkSession)
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for out in make(batch.slice(at, rows).to_pandas()):
                    yield pa.RecordBatch.from_pandas(out, kind, preserve_index=False)

    return df.mapInArrow(each, schema)
