"""Target-distribution importance resampling: hashed n-gram histograms of a corpus and of a target, and a weighted draw without replacement.

An untrained regex split of the `tokenizers` library returns words with their byte offsets
in the lower-cased text; windows of offset pairs become CRC-32 buckets, the buckets of a
document stay beside it in one written table, and everything after works on that table:
corpus and target histograms, gains of buckets, summed gains of documents, and the draw by
Gumbel noise, whose places come from a distributed ordinal index.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import release, stored, table
from signalmill.operators.ordinal import with_ordinals

#: A word is a run of digits, lower-case letters and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS, BUCKETS, SHARE, LEAST_WORDS, SEED = 2, 10_000, 25, 20, 7
#: Bytes of text that are split at a time, and bytes of texts that are hashed at a time; a longer text is hashed alone.
BLOCK, SLICE = 1 << 20, 1 << 22
_EDGE = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Words of more bytes are hashed one by one.
_LONG = 64


@cache
def _split():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)


def lowered(texts: list[bytes | None]) -> tuple[bytes, np.ndarray]:
    """All texts in lower-case A-Z as one string, a line feed after each, and where each starts; bytes that are not UTF-8 count as U+FFFD."""
    clean = []
    for t in texts:
        t = t or b""
        try:
            t.decode()
        except UnicodeDecodeError:
            t = t.decode("utf-8", "replace").encode()
        clean.append(t)
    low = b"".join(t.lower() + b"\n" for t in clean)  # bytes.lower() leaves all but A-Z
    return low, np.concatenate([[0], np.cumsum([len(t) + 1 for t in clean])])


def word_offsets(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (starts, ends) of the words, split block by block; blocks end at a byte that no word holds."""
    from tokenizers import PreTokenizedString

    starts, ends, at = [], [], 0
    while at < len(low):
        edge = _EDGE.search(low, at + BLOCK)
        end = edge.end() if edge else len(low)
        block = PreTokenizedString(low[at:end].decode())
        _split().pre_tokenize(block)
        spans = np.array([x[1] for x in block.get_splits(offset_referential="original", offset_type="byte")], np.int64).reshape(-1, 2)
        starts.append(spans[:, 0] + at)
        ends.append(spans[:, 1] + at)
        at = end
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends])


@cache
def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


def crc_on(state: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 states (of zlib.crc32, before its last inversion) after the bytes of the ranges as well, all ranges at once."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    s, n, first = state[order], size[order], start[order]
    long = int(np.searchsorted(-n, -_LONG))
    t = _crc_table()
    upto = np.searchsorted(-n[long:], -np.arange(1, _LONG + 1), "right") + long  # ranges that reach a length
    for j, m in enumerate(upto):
        if m == long:
            break
        part = s[long:m]
        s[long:m] = t[(part ^ raw[first[long:m] + j]) & 255] ^ (part >> np.uint32(8))
    for i in range(long):
        s[i] = ~np.uint32(zlib.crc32(raw[first[i] : first[i] + n[i]].tobytes(), int(~s[i])))
    out = np.empty_like(s)
    out[order] = s
    return out


def feature_buckets(texts: list[bytes | None], most: int = WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, features of each text, buckets of all features, text by text): runs of 1 to `most` words, joined by one space."""
    low, at = lowered(texts)
    raw = np.frombuffer(low, np.uint8)
    start, end = word_offsets(low)
    doc = np.searchsorted(at, start, "right") - 1
    words = np.bincount(doc, minlength=len(texts))
    owner, bucket = [], []
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    space, t = np.uint32(32), _crc_table()
    for k in range(most):
        if k:
            state = state[: len(start) - k]
            state = t[(state ^ space) & 255] ^ (state >> np.uint32(8))
        state = crc_on(state, raw, start[k:], end[k:])
        inside = doc[: len(state)] == doc[k : k + len(state)]  # a window of offset pairs lies in one text
        owner.append(doc[: len(state)][inside])
        bucket.append((~state[inside]) % np.uint32(buckets))
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    return words, np.bincount(owner, minlength=len(texts)), bucket[np.argsort(owner, kind="stable")]


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """Texts of a column, SLICE bytes at a time, or one that is longer."""
    first, held, some = 0, 0, []
    for i, t in enumerate(column.cast(pa.binary())):
        t = t.as_py()
        if some and held + len(t or b"") > SLICE:
            yield first, some
            first, held, some = i, 0, []
        some.append(t)
        held += len(t or b"")
    if some:
        yield first, some


def featurised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """One row per input row: doc_id, n_words, n_features and `_buckets`, the buckets of all its features as 16-bit integers.

    A null or empty text, and one without words, has no features; ids may be null or repeat.
    """
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets fit 16 bits")
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in _slices(batch.column(1)):
                words, features, found = feature_buckets(texts, most, buckets)
                ends = np.concatenate([[0], np.cumsum(features * 2)]).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(found.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(words, pa.int64()), pa.array(features, pa.int64()), packed], ["doc_id", "n_words", "n_features", "_buckets"])

    kind = ids.schema["doc_id"].dataType.simpleString()
    return ids.mapInArrow(each, f"doc_id {kind}, n_words bigint, n_features bigint, _buckets binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all 16-bit integers of a binary column, the offsets of its rows in them)."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[0] == ends[-1]:
        return np.zeros(0, "<u2"), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], "<u2", (ends[-1] - ends[0]) // 2, ends[0]), (ends - ends[0]).astype(np.int64) // 2


def histogram(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of all features; a task adds up its rows, so at most `buckets` rows of it are shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_unpacked(batch.column(0))[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return features.select("_buckets").mapInArrow(each, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for every bucket: thousandths of the log ratio of its smoothed shares in the target and in the corpus, from two histograms."""
    every = F.broadcast(corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket"))
    h = every.join(corpus.select("bucket", F.col("n").alias("s")), "bucket", "left").join(target.select("bucket", F.col("n").alias("t")), "bucket", "left").na.fill(0, ["s", "t"])
    total = h.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    d = lambda c, more: F.col(c).cast("double") + F.lit(float(more))
    ratio = (d("t", 1) * d("all_s", buckets)) / (d("s", 1) * d("all_t", buckets))
    return h.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.log(ratio) * 1000).alias("gain"))


def weighted(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """Features with `weight`, the floored mean of the gains of a document's features, 0 where it has none. `gains` has an entry for each bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = _unpacked(batch.column(3))
            sums = np.concatenate([[0], np.cumsum(gains[found])])
            weight = (sums[at[1:]] - sums[at[:-1]]) // np.maximum(np.diff(at), 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], [*batch.schema.names[:3], "weight"])

    kind = features.schema["doc_id"].dataType.simpleString()
    return features.select("doc_id", "n_words", "n_features", "_buckets").mapInArrow(each, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED,
    most: int = WORDS, buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_features, weight, score and rank.

    Of the N rows with `least_words` words or more, floor(share * N / 100) of the highest
    scores are drawn and ranked from 1; the rest, and shorter ones, have a null rank. Ties
    go to the smaller id, a null id last (its noise is that of an empty id); rows that are
    equal in all of this may swap ranks. Repeated rows are rows of their own. Without a
    target all buckets have its smoothed share; an empty table gives no rows. Other columns
    of docs are not read.
    """
    features = stored(featurised(docs, id_col, text_col, most, buckets), "features")
    aims = featurised(target.withColumn("_none", F.lit(0)), "_none", target_text, most, buckets)
    gains = np.zeros(buckets, np.int64)
    for r in bucket_gains(histogram(features, buckets), histogram(aims, buckets), buckets).collect():  # one row a bucket
        gains[r["bucket"]] = r["gain"]
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stored(weighted(features, gains).withColumn("score", F.col("weight") + noise), "scored")
    release(features)
    long = F.col("n_words") >= least_words
    ranked = with_ordinals(scored.where(long), [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features")], "_at", "_n")
    ranked = ranked.withColumn("rank", F.when(F.col("_at") < F.expr(f"{share} * _n div 100"), F.col("_at") + 1)).drop("_at", "_n")
    return ranked.unionByName(scored.where(~long).withColumn("rank", F.lit(None).cast("long")))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return r.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


#: CRC-32 in SQL: a table of 256 entries from the polynomial, folded over the bytes of each distinct feature.
OP11_SQL = r"""
WITH crc AS (SELECT list(e ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e
        FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
d AS (SELECT doc_id, row_number() OVER () AS rw, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
df AS (SELECT rw, f, count(*) AS n FROM (SELECT rw, unnest(w) AS f FROM d UNION ALL SELECT rw, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d) GROUP BY ALL),
bf AS (SELECT f, count(*) AS n FROM (SELECT unnest(w) AS f FROM b UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b) GROUP BY ALL),
u AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
uh AS (SELECT f, hex(encode(f)) AS x FROM u),
ub AS (SELECT f, list_transform(range(0, len(x) // 2), lambda i: CAST((instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1 AS BIGINT)) AS bytes FROM uh),
k AS (SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda c, x: xor(c >> 8, tab[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM ub, crc),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN k USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bf JOIN k USING (f) GROUP BY bucket),
al AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), al),
w AS (SELECT rw, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY rw),
r AS (SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
        CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w ON d.rw = w.rw),
sc AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
rk AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place, count(*) FILTER (n_words >= 20) OVER () AS eligible FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (25 * eligible) // 100 THEN place END AS rank, n_words FROM rk
"""
