"""Line dedup: a sharded minimal perfect hash over hashes of repeated lines indexes compact arrays of fingerprints, document counts and keepers; documents probe the arrays.

Lines are named by two 64-bit hashes of their keys. Hashes that stand in enough documents
are dealt to shards of bounded size, and a task turns each into one row: the bit levels of
a minimal perfect hash and three arrays in its order. Probes (the hashes of a document's
lines) are dealt to the shards, meet the shard's row first and stream past it in batches.
A shard that frequent lines make hot is copied, in proportion to the lines that the counts
say it will meet, and its probes are dealt over the copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from signalmill.llm.common import boxed, release, row_key, stored, table
from signalmill.llm.textbytes import mixed

U = np.uint64
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_CHARS, LEAST_DOCS = 20, 3
#: Keys of a shard on average, and shards at least.
SHARD_KEYS, LEAST_SHARDS = 1 << 17, 32
#: Copies of shards are at most so many times the shards.
COPIES = 4
#: Bits of a level for each key that is left.
ROOM = 1.6


def line_key(line: Column) -> Column:
    """A line without [\\x20\\x09-\\x0D] at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(h1 + U(level + 1) * (h2 | U(1))) % U(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64-bit hashes, as levels of bits.

    A key's number is the rank of its bit: on each level a key whose place no other key
    shares sets its bit, and the others go on to the next.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1

    @classmethod
    def over(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(h1):
            size = max(64, int(len(h1) * ROOM))
            at = _places(h1, h2, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            rest = ~alone[at]
            h1, h2 = h1[rest], h2[rest]
        return cls(sizes, np.concatenate([np.zeros(0, bool), *levels]))

    def of(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Numbers of keys; other pairs get the number of some key, or -1."""
        out, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            at = base + _places(h1[left], h2[left], level, size)
            hit = self.bits[at]
            out[left[hit]] = self.rank[at[hit]]
            left, base = left[~hit], base + size
        return out


def repeated_lines(occurrences: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(_h1, _h2, docs, lines, keeper) of keys in `least_docs` documents or more; documents are told apart by id, a null id is one document and never the keeper."""
    docs = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    return occurrences.groupBy("_h1", "_h2").agg(docs.alias("docs"), F.count("*").alias("lines"), F.max("doc_id").alias("keeper")).where(F.col("docs") >= least_docs)


def line_index(keys: DataFrame, shards: int) -> DataFrame:
    """One row a shard: (shard, sizes, bits, prints, docs, keepers), packed; `prints` are the second hashes, which tell other lines off."""

    def build(group: pa.Table) -> pa.Table:
        h1, h2, docs, keeper = (group[c].to_numpy() for c in ("_h1", "_h2", "docs", "keeper"))
        h1, h2 = h1.view(U), h2.view(U)
        ph = PerfectHash.over(h1, h2)
        place = np.argsort(ph.of(h1, h2))
        packed = [np.array(ph.sizes, "<i8"), np.packbits(ph.bits), h2[place].astype("<u8"), docs[place].astype("<i8"), keeper[place].astype("<i8")]
        return pa.table([pa.array([group["shard"][0].as_py()], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in packed]], ["shard", "sizes", "bits", "prints", "docs", "keepers"])

    dealt = keys.select(F.pmod("_h1", F.lit(shards)).alias("shard"), "_h1", "_h2", F.col("docs").cast("bigint").alias("docs"), "keeper")
    return dealt.groupBy("shard").applyInArrow(build, "shard bigint, sizes binary, bits binary, prints binary, docs binary, keepers binary")


class _Shard:
    def __init__(self, sizes: bytes, bits: bytes, prints: bytes, docs: bytes, keepers: bytes):
        sizes = np.frombuffer(sizes, "<i8")
        self.hash = PerfectHash(sizes.tolist(), np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes.sum())).astype(bool))
        self.prints, self.docs, self.keepers = np.frombuffer(prints, "<u8"), np.frombuffer(docs, "<i8"), np.frombuffer(keepers, "<i8")

    def keeper(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is the line in the index, the id of the document that keeps it)."""
        n = self.hash.of(h1, h2)
        known = (n >= 0) & (self.prints[n] == h2)
        return known, self.keepers[n]


_PACKED = ("sizes", "bits", "prints", "docs", "keepers")
_PROBE = ("_k1", "_k2", "doc_id", "pos", "_h1", "_h2")


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Probes of lines that another document keeps, as (_k1, _k2, pos). Rows come by shard and copy, the shard's arrays before its probes."""
    shard, at = None, None
    for batch in batches:
        where = batch.column("shard").to_numpy() * (1 << 20) + batch.column("copy").to_numpy()
        arrays = batch.column("bits").is_valid().to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | arrays[1:] | arrays[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if arrays[a]:
                shard, at = _Shard(*[batch.column(c)[int(a)].as_py() for c in _PACKED]), where[a]
            elif at == where[a]:
                part = batch.slice(a, b - a)
                h1, h2 = (part.column(c).to_numpy().view(U) for c in ("_h1", "_h2"))
                known, keeper = shard.keeper(h1, h2)
                own = part.column("doc_id")
                gone = known & (own.is_null().to_numpy(zero_copy_only=False) | (own.fill_null(0).to_numpy() != keeper))
                yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(gone)) for c in ("_k1", "_k2", "pos")], ["_k1", "_k2", "pos"])


def lost_lines(occurrences: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(_k1, _k2, pos) of the lines that go, from (_k1, _k2, doc_id, pos, _h1, _h2) of all lines with a key."""
    keys = stored(repeated_lines(occurrences, least_docs), "line-keys")
    shards = max(LEAST_SHARDS, -(-keys.count() // SHARD_KEYS))
    index = stored(line_index(keys, shards), "line-index")
    met = stored(keys.groupBy(F.pmod("_h1", F.lit(shards)).alias("shard")).agg(F.sum("lines").alias("n")), "line-loads")  # one row a shard
    total = met.agg(F.sum("n")).first()[0] or 0
    copies = F.broadcast(met.select("shard", F.ceil(F.col("n") / max(1, total // (COPIES * shards))).cast("bigint").alias("copies")))
    arrays = index.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"), *_PACKED, *[F.lit(None).cast("bigint").alias(c) for c in _PROBE])
    dealt = occurrences.withColumn("shard", F.pmod("_h1", F.lit(shards))).join(copies, "shard")  # a shard without keys drops no line
    probes = dealt.select("shard", F.pmod(F.xxhash64("_k1", "_k2", "pos"), "copies").alias("copy"), *[F.lit(None).cast("binary").alias(c) for c in _PACKED], *_PROBE)
    both = arrays.unionByName(probes).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("bits").isNull())
    lost = stored(both.mapInArrow(_probed, "_k1 bigint, _k2 bigint, pos bigint"), "lost-lines")
    release(keys, index, met)
    return lost


def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    def cut(t: str, g) -> str:
        if g is None or not len(g):
            return t
        g = set(g.tolist())
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g)

    return pd.Series([cut(t, g) for t, g in zip(text, gone)], dtype=object)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Each row of docs as `_row`, with `kept` (the text without the lines that go), n_lines and n_dropped.

    Texts are cut at line feeds; a null or empty text is one empty line. A line goes if its
    key has `least_chars` code points, stands in `least_docs` documents and another document
    is the largest to hold it; the largest keeps all of them. Documents are told apart by
    integer id: rows of one id are one document, null ids too, which is below all others. An
    empty table gives no rows; other columns, whatever their names, stay in `_row`.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = boxed(docs, F.col(id_col).cast("bigint").alias("doc_id"), text.alias("_text"), *row_key(id_col, text_col))
    cut = d.select("_k1", "_k2", "doc_id", F.posexplode(F.split("_text", "\n")).alias("pos", "_line")).withColumn("_key", line_key(F.col("_line"))).where(F.length("_key") >= least_chars)
    hashes = [F.xxhash64(F.lit(n), F.col("_key")).alias(f"_h{n}") for n in (1, 2)]
    occurrences = stored(cut.select("_k1", "_k2", "doc_id", F.col("pos").cast("bigint").alias("pos"), *hashes), "lines")
    lost = lost_lines(occurrences, least_docs).groupBy("_k1", "_k2").agg(F.collect_set("pos").alias("_gone"))
    release(occurrences)
    j = d.join(lost, ["_k1", "_k2"], "left").withColumn("kept", F.pandas_udf(_without, StringType())("_text", "_gone"))
    return j.select("_row", "kept", F.size(F.split("_text", "\n")).cast("bigint").alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint").alias("n_dropped"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("_row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rw, doc_id, str_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rw, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
r AS (SELECT k.*, h.keeper IS NOT NULL AND k.doc_id IS DISTINCT FROM h.keeper AS gone FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY rw, doc_id
"""
