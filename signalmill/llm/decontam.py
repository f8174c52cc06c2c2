"""Benchmark decontamination. SQL and DataFrame functions only.

Windows of a document as long as a benchmark item are fingerprinted with SimHash over their
word shingles. Fingerprints are cut into blocks: two within the radius differ in one block
by at most the radius divided by the blocks, so with every value of a block that few bits
away, half of them probed from either side, a join on (length, block, value) finds them all.
Candidates are verified by the exact weighted Jaccard similarity of their shingles, weights
being counts.

A window reaches a similarity only if it holds so many shingles of the item, so windows
are laid at every start from which that many lie within the item's length, and nowhere else.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import boxed, row_key, stored, table

WORDS = r"[^\x20\x09-\x0D]+"
SHINGLE, LEAST = 5, 0.8
#: Longs of a fingerprint, blocks of each long, and the radius in bits. At a similarity of 0.8
#: about 39 of the 256 bits differ, with a deviation of 6.
LONGS, CUTS, RADIUS = 4, 5, 59
#: Shingle rows of a benchmark up to which it is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000

#: Fingerprint of an array of shingle hashes: bit b of long j is the majority of that bit in the j-th hash of every shingle.
_SIMHASH = (
    f"transform(sequence(0, {LONGS - 1}), j -> transform(array(transform({{g}}, h -> xxhash64(h, j))), x -> aggregate(sequence(0, 63), 0L, (f, b) -> f | "
    "CASE WHEN aggregate(x, 0, (s, h) -> s + 2 * CAST(bit_get(h, b) AS INT) - 1) > 0 THEN shiftleft(1L, b) ELSE 0L END))[0])"
)


_WORD_LIST = r"regexp_extract_all(lower({text}), '[^\\x20\\x09-\\x0D]+', 0)"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates `value` once and uses it as `name` in `body`; a column would be put in its every use."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _grams(words: str, k: str | int) -> str:
    """SQL of the hashes of `k`-word shingles (k from 1 to 5) of an array, null if it is shorter."""
    at = lambda j: f"{words}[i + {j}]"
    if isinstance(k, int):
        return f"CASE WHEN size({words}) >= {k} THEN transform(sequence(0, size({words}) - {k}), i -> xxhash64({', '.join(map(at, range(k)))})) END"
    return "CASE " + " ".join(f"WHEN {k} = {n} THEN {_grams(words, n)}" for n in range(1, SHINGLE + 1)) + " END"


def items_of(benchmark: DataFrame, id_col="item_id", text_col="text") -> DataFrame:
    """item_id, s: n words and shingles g of an item; one of fewer words than a shingle is one shingle."""
    k = f"least(size(w), {SHINGLE})"
    body = f"struct(size(w) AS n, {k} AS k, {_grams('w', k)} AS g)"
    return benchmark.select(F.col(id_col).alias("item_id"), F.expr(_let("w", _WORD_LIST.format(text=f"`{text_col}`"), body)).alias("s"))


def _placed(docs: DataFrame, k: int) -> DataFrame:
    """A row per shingle of `docs` (with `text`): gram, pos, words of the text."""
    grams = _let("g", _grams("w", k), "CASE WHEN g IS NOT NULL THEN transform(g, (h, p) -> struct(h AS gram, p AS pos, size(w) AS words)) END")
    return docs.select("doc_id", "_k1", "_k2", F.expr(f"inline({_let('w', _WORD_LIST.format(text='text'), grams)})"))


def _probes(fp: str, errors: int) -> Column:
    """Array of (block, value) of a fingerprint: the bits of each block, and all values up to `errors` bits from them."""
    out = []
    for j in range(LONGS):
        for c in range(CUTS):
            a, b = c * 64 // CUTS, (c + 1) * 64 // CUTS
            masks = [sum(1 << i for i in some) for k in range(errors + 1) for some in combinations(range(b - a), k)]
            own = f"shiftrightunsigned({fp}[{j}], {a}) & {(1 << (b - a)) - 1}L"
            out.append(F.expr(f"transform(array({', '.join(f'{m}L' for m in masks)}), m -> struct({j * CUTS + c} AS block, ({own}) ^ m AS value))"))
    return F.concat(*out)


def _distance(a: str, b: str) -> Column:
    return F.expr(" + ".join(f"bit_count({a}[{j}] ^ {b}[{j}])" for j in range(LONGS)))


def candidates(windows: DataFrame, items: DataFrame, radius: int = RADIUS, small=lambda x: x) -> DataFrame:
    """Rows of windows (n, fp, ...) with items (item_id, n, fp) of their length within the radius, by the multi-index; `small` marks the items for the join."""
    share = radius // (LONGS * CUTS)
    left = windows.withColumn("_b", F.explode(_probes("fp", share // 2))).select("*", "_b.block", "_b.value").drop("_b")
    right = items.select("item_id", "n", F.col("fp").alias("_f"), F.explode(_probes("fp", share - share // 2)).alias("_b")).select("item_id", "n", "_f", "_b.block", "_b.value")
    met = left.join(small(right), ["n", "block", "value"]).where(_distance("fp", "_f") <= radius)
    return met.drop("block", "value", "_f").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, radius: int = RADIUS, id_col="doc_id", text_col="text", **item_cols) -> DataFrame:
    """(doc_id, _k1, _k2, item_id, start, similarity): the best window of each document and item at or above `least`.

    start counts words from 0; ties go to the first window. Null and empty texts and items
    match nothing. Repeated document rows give one row, repeated items each their own.
    """
    items = stored(items_of(benchmark, **item_cols), "items").where("s.n > 0")
    items = items.select("item_id", "s.n", "s.k", "s.g")
    held = items.select("item_id", "n", "k", F.posexplode("g").alias("at", "gram"))
    few = held.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda x: x)
    lengths = [r["k"] for r in items.select("k").distinct().collect()] or [SHINGLE]  # at most five values
    keyed = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("text"))
    hits = None
    for k in lengths:
        found = _placed(keyed, k).join(small(held.where(F.col("k") == k)), "gram")
        hits = found if hits is None else hits.unionByName(found)
    hits = hits.select("doc_id", "_k1", "_k2", "words", "item_id", "n", "k", "at", "pos", "gram")
    # Equal shingles of two texts of a and b shingles are least * (a + b) / (1 + least) or more. Counted by the places
    # of the document that hold a shingle of the item: with `need` places p1 <= p2 ... in a window, it starts
    # between the last place less its length and the first.
    reach = F.least("n", "words") - F.col("k")
    need = F.ceil(F.lit(least) * (reach + 1 + F.col("n") - F.col("k") + 1) / (1 + least) - 1e-9).cast("int")
    places = hits.groupBy("doc_id", "_k1", "_k2", "words", "item_id", "n", "k", "pos").agg(F.count("*").alias("_c")).drop("_c").withColumn("reach", reach).withColumn("need", need)
    some = places.groupBy("_k1", "_k2", "item_id", "n", "k", "words", "reach", "need").agg(F.sort_array(F.collect_list("pos")).alias("p")).where(F.size("p") >= F.col("need"))  # places of one item in one text
    spans = some.select("_k1", "_k2", "n", "k", "words", "reach", F.explode(F.arrays_zip(F.slice("p", F.lit(1), F.size("p") - F.col("need") + 1).alias("a"), F.slice("p", F.col("need"), F.size("p") - F.col("need") + 1).alias("b"))).alias("x"))
    low, high = F.greatest(F.col("x.b") - F.col("reach"), F.lit(0)), F.least(F.col("x.a"), F.greatest(F.col("words") - F.col("n"), F.lit(0)))
    starts = spans.where(low <= high).select("_k1", "_k2", "n", "k", F.explode(F.sequence(low, high)).alias("start"))
    spots = stored(starts.distinct().groupBy("_k1", "_k2").agg(F.collect_list(F.struct("n", "k", "start")).alias("spots")), "spots")
    near = keyed.join(spots, ["_k1", "_k2"]).dropDuplicates(["_k1", "_k2"]).select("doc_id", "_k1", "_k2", "text", F.explode("spots").alias("at"))
    prints = f"CASE WHEN g IS NOT NULL THEN struct(g, {_SIMHASH.format(g='g')} AS fp) END"
    prints = _let("v", f"slice({_WORD_LIST.format(text='text')}, at.start + 1, at.n)", _let("g", _grams("v", "least(at.k, size(v))"), prints))
    near = stored(near.select("doc_id", "_k1", "_k2", "at.n", "at.start", F.expr(prints).alias("s")), "windows")
    near = near.where("s is not null").select("doc_id", "_k1", "_k2", "n", "start", "s.g", "s.fp")
    prints = stored(items.withColumn("fp", F.expr(_SIMHASH.format(g="g"))), "prints")
    pairs = candidates(near.select("_k1", "_k2", "n", "start", "fp"), prints.select("item_id", "n", "fp"), radius, small).drop("fp")
    own = near.select("doc_id", "_k1", "_k2", "n", "start", F.size("g").alias("size"), F.explode("g").alias("gram"))
    own = own.groupBy("doc_id", "_k1", "_k2", "n", "start", "size", "gram").agg(F.count("*").alias("c"))
    theirs = held.groupBy("item_id", "gram").agg(F.count("*").alias("d"))
    sizes = items.select("item_id", F.size("g").alias("total"))
    both = pairs.join(own, ["_k1", "_k2", "n", "start"]).join(small(theirs), ["item_id", "gram"])
    both = both.groupBy("doc_id", "_k1", "_k2", "n", "start", "size", "item_id").agg(F.sum(F.least("c", "d")).alias("same")).join(small(sizes), "item_id")
    similarity = F.col("same") / (F.col("size") + F.col("total") - F.col("same"))
    both = both.withColumn("similarity", similarity).where(F.col("similarity") >= least - 1e-12)
    best = F.min(F.struct((-F.col("similarity")).alias("m"), "start")).alias("best")
    return both.groupBy("doc_id", "_k1", "_k2", "item_id").agg(best).select("doc_id", "_k1", "_k2", "item_id", F.col("best.start").cast("long").alias("start"), F.round(-F.col("best.m"), 6).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **params) -> DataFrame:
    """The rows of `docs` that hold no item of the benchmark, all columns as they were."""
    bad = stored(matches(docs, benchmark, id_col=id_col, text_col=text_col, **params).select("_k1", "_k2").distinct(), "leaks")
    return boxed(docs, *row_key(id_col, text_col)).join(bad, ["_k1", "_k2"], "left_anti").select("_row.*")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "start", "similarity")


OP6_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
i AS (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
ig AS (SELECT item_id, n, k, unnest(list_transform(range(0, n - k + 1), lambda p: array_to_string(w[p + 1:p + k], ' '))) AS gram,
              unnest(range(0, n - k + 1)) AS pos FROM i),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, k, len(w) AS words, unnest(list_transform(range(0, len(w) - k + 1), lambda p: array_to_string(w[p + 1:p + k], ' '))) AS gram,
              unnest(range(0, len(w) - k + 1)) AS pos
       FROM dw, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
hit AS (SELECT doc_id, words, item_id, n, ig.k, dg.pos, dg.gram FROM dg JOIN ig ON dg.gram = ig.gram AND dg.k = ig.k),
wg AS (SELECT doc_id, item_id, n, k, least(words, n) - k + 1 AS size, gram, unnest(range(greatest(pos - (least(words, n) - k), 0), least(pos, greatest(words - n, 0)) + 1)) AS start
       FROM (SELECT DISTINCT doc_id, words, item_id, n, hit.k, pos, gram FROM hit)),
wc AS (SELECT doc_id, item_id, n, start, size, gram, count(*) AS c FROM wg GROUP BY ALL),
t AS (SELECT item_id, n, n - k + 1 AS total, gram, count(*) AS d FROM ig GROUP BY ALL),
b AS (SELECT doc_id, wc.item_id, start, CAST(sum(least(c, d)) AS DOUBLE) AS same, size, total
      FROM wc JOIN t ON wc.gram = t.gram AND wc.item_id = t.item_id GROUP BY ALL),
r AS (SELECT *, same / (size + total - same) AS sim FROM b)
SELECT doc_id, item_id, arg_min(start, (-sim, start)) AS start, round(max(sim), 6) AS similarity
FROM r WHERE sim >= 0.8 - 1e-12 GROUP BY doc_id, item_id
"""
