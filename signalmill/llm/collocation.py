"""Phrase collocation mining on a weighted de Bruijn graph of words.

A node is a run of three words and an edge a run of four, so an edge joins two nodes that
overlap in two words. Only edges are counted in the text, with the shorter runs that end a
piece; a task counts its texts before anything is shuffled. The count of a node is its flow
out (the edges that leave it) plus the pieces that end in it, and counts of pairs and words
follow from those of nodes in the same way. Unary paths of heavy edges, on which one weight
flows through nodes with a single way in and out, become one row each before candidates are
held against the longer ones around them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmill.llm.common import release, stored, table
from signalmill.llm.textbytes import mixed

#: Words of an edge, counts of a candidate at least, percent of its count at which a longer candidate drops it, rows of a language.
ORDER, LEAST, INSIDE, TOP = 4, 30, 80, 2000
SCALE = 2_000_000
#: Bytes of texts that a task counts at a time; a longer text is counted alone.
SLICE = 3 << 20
#: Share of documents whose edges show which words and pairs begin so many edges that their edges are dealt by more words. It steers the shuffle; no result depends on it.
LOOK = 0.01
#: Routes that edges are dealt by, for each shuffle partition.
ROUTES = 2

_PIECE = np.zeros(256, bool)
_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = np.zeros(256, bool)
_GAP[[32, 9]] = True


def _joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in lower-case A-Z as bytes, a line feed after each, and where each starts."""
    low = b"".join((t or b"").lower() + b"\n" for t in texts)
    return np.frombuffer(low, np.uint8), np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])


def _pairs(a: np.ndarray, b: np.ndarray, nb: int) -> tuple[np.ndarray, int]:
    """Small numbers for pairs of numbers, and how many there are."""
    code, found = pd.factorize(a * np.int64(nb) + b)
    return code.astype(np.int64), len(found)


def edge_codes(texts: list[bytes | None], langs: np.ndarray, order: int = ORDER) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(names, language, codes, count) of the distinct runs of `order` words, or fewer where a piece ends, that start at each word.

    codes has a row for each place of a run: the number of its word in names, from 1, and 0
    beyond its end. langs has a number for each text. Every word starts one run, so counts
    add up to the words.
    """
    raw, at = _joined(texts)
    word = ~(_PIECE[raw] | _GAP[raw])
    change = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
    start, end = change[::2], change[1::2]
    n = len(start)
    if not n:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros((order, 0), np.int64), np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(end - start)])
    names = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw[word])]).dictionary_encode()
    ids, names = names.indices.to_numpy().astype(np.int64) + 1, names.dictionary
    piece = np.cumsum(_PIECE[raw])[start]
    lang = langs[np.searchsorted(at, start, "right") - 1].astype(np.int64)
    columns = [ids]
    for k in range(1, order):
        nxt = np.zeros(n, np.int64)
        nxt[: n - k] = np.where(piece[k:] == piece[: n - k], ids[k:], 0)
        columns.append(nxt)
    code, many = lang, int(lang.max()) + 1
    for c in columns:
        code, many = _pairs(code, c, len(names) + 1)
    first = np.full(many, n, np.int64)
    first[code[::-1]] = np.arange(n - 1, -1, -1)
    return names, lang[first], np.stack([c[first] for c in columns]), np.bincount(code, minlength=many)


def _phrases(names: pa.Array, codes: np.ndarray) -> pa.Array:
    """Words of codes, joined by a space; 0 is no word."""
    parts = [pc.take(names, pa.array(c - 1, mask=c == 0)) for c in codes]
    return pc.binary_join_element_wise(*parts, pa.scalar(b" ", names.type), null_handling="skip").cast(pa.large_string())


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
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


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))


def _coded(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple]:
    """(languages, names, language, codes, count) of edges, slice by slice of the texts."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        numbers = langs.indices.to_numpy()
        for first, texts in _slices(batch.column(1)):
            yield langs.dictionary, *edge_codes(texts, numbers[first : first + len(texts)], order)


def edges(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER) -> DataFrame:
    """(lang, edge, words, n): weighted edges and ends of pieces, not yet added up over tasks. A null language is `und`; null texts have no words."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, names, lang, codes, n in _coded(batches, order):
            yield pa.RecordBatch.from_arrays([pc.take(langs, pa.array(lang)), _phrases(names, codes).cast(pa.string()), pa.array((codes > 0).sum(0).astype(np.int32)), pa.array(n)], ["lang", "edge", "words", "n"])

    return _texts(docs, text_col, lang_col).mapInArrow(each, "lang string, edge string, words int, n bigint")


def _prefix(column: str, words: int | str) -> Column:
    return F.expr(f"substring_index({column}, ' ', {words})")


def busy_heads(look: DataFrame, words: int, share: float) -> set[tuple[str, str]]:
    """(lang, first words) that more than `share` of the edges begin with; at most 1 / share of them."""
    heads = look.where(F.col("words") >= words).groupBy("lang", _prefix("edge", words).alias("head")).agg(F.count("*").alias("c"))
    total = F.broadcast(look.agg((F.count("*") * share).alias("least")))
    return {(r["lang"], r["head"]) for r in heads.crossJoin(total).where("c > least").select("lang", "head").collect()}


def _hash(texts: pa.Array) -> np.ndarray:
    return pd.util.hash_array(texts.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def edge_depths(langs: pa.Array, names: pa.Array, lang: np.ndarray, codes: np.ndarray, one: set, two: set) -> tuple[np.ndarray, np.ndarray]:
    """(depth, hash) of edges: the number of first words that they are dealt by (one; two after a frequent word, all after a frequent pair), and the hash of those and the language."""
    order, size = len(codes), len(names) + 1
    by_lang = _hash(langs)[lang]
    words = _hash(names.cast(pa.large_string()))
    depth = np.ones(len(lang), np.int64)
    code = words[codes[0] - 1]
    places = {w.decode(): i + 1 for i, w in enumerate(names.to_pylist())} if one else {}
    number = {x: i for i, x in enumerate(langs.to_pylist())}
    often = [number[g] * size + places[w] for g, w in one if g in number and w in places]
    deep = np.flatnonzero(np.isin(lang * size + codes[0], often))
    if len(deep):
        depth[deep] = 2
        pairs = [(number[g], *(places.get(w) for w in p.split(" "))) for g, p in two if g in number]
        often = [(g * size + a) * size + b for g, a, b in pairs if a and b]
        depth[deep[np.isin((lang[deep] * size + codes[0][deep]) * size + codes[1][deep], often)]] = order
        for k in range(1, order):
            on = deep[depth[deep] > k]
            code[on] = mixed(code[on] * np.uint64(31) + np.where(codes[k][on] > 0, words[codes[k][on] - 1], np.uint64(k)))
    return depth, mixed(code ^ by_lang)


_BLOCK = "route int, langs array<string>, size int, edges binary, length int, names binary"


def packed_edges(docs: DataFrame, text_col: str, lang_col: str, order: int, routes: int, one: set, two: set) -> DataFrame:
    """Edges as one row for each route and slice of texts: its languages, the numbers of language, depth, count and words of its edges, and the words' names, both packed."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, names, lang, codes, n in _coded(batches, order):
            depth, code = edge_depths(langs, names, lang, codes, one, two)
            route = (code % np.uint64(routes)).astype(np.int64)
            by = np.argsort(route * (len(names) + 1) + codes[0], kind="stable")
            cuts = np.flatnonzero(np.diff(np.concatenate([[-1], route[by], [routes]])))
            columns = [[] for _ in range(5)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = by[a:b]
                used, small = np.unique(codes[:, part], return_inverse=True)
                numbers = np.concatenate([[lang[part], depth[part], n[part]], small.reshape(order, -1) + (used[0] > 0)]).astype("<i4")
                words = names.take(pa.array(used[used > 0] - 1))
                words = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar(b" ", names.type))[0].as_py()
                for column, x in zip(columns, (int(route[part[0]]), b - a, pa.compress(numbers.tobytes(), "zstd", asbytes=True), len(words), pa.compress(words, "zstd", asbytes=True))):
                    column.append(x)
            at, size, packed, length, words = (pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary())))
            every = pa.array([langs.to_pylist()] * len(at), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([at, every, size, packed, length, words], ["route", "langs", "size", "edges", "length", "names"])

    return _texts(docs, text_col, lang_col).mapInArrow(each, _BLOCK)


def _flows(blocks: list[tuple], order: int, least: int) -> pa.RecordBatch:
    """Sums over all edges of a route: (lang, phrase, words, n) of phrases that occur `least` times, and of all that edges elsewhere may begin with as well, (lang, '', 0, all words) among them."""
    langs = pa.concat_arrays([x[0].cast(pa.large_binary()) for x in blocks]).dictionary_encode()
    words = [pa.array(pa.decompress(x[4], x[3], "zstd", asbytes=True).split(b" "), pa.large_binary()) for x in blocks]
    names = pa.concat_arrays(words).dictionary_encode()
    lang_at, name_at = (np.concatenate([[0], np.cumsum([len(x) for x in y])]) for y in ([x[0] for x in blocks], words))
    lang_of, name_of = langs.indices.to_numpy(), np.concatenate([np.zeros(1, np.int32), names.indices.to_numpy() + np.int32(1)])
    edges = sum(x[1] for x in blocks)
    lang, depth, n, codes = np.empty(edges, np.int64), np.empty(edges, np.int8), np.empty(edges, np.int64), np.empty((order, edges), np.int32)
    at = 0
    for i, x in enumerate(blocks):
        part = np.frombuffer(pa.decompress(x[2], (3 + order) * 4 * x[1], "zstd"), "<i4").reshape(3 + order, -1)
        here = slice(at, at + x[1])
        lang[here], depth[here], n[here] = lang_of[lang_at[i] + part[0]], part[1], part[2]
        codes[:, here] = name_of[np.where(part[3:] > 0, part[3:] + name_at[i], 0)]
        at += x[1]
    del words
    names, langs = names.dictionary, langs.dictionary
    out, code, many, left = [], lang, len(langs), np.arange(len(lang))
    for k in range(order + 1):
        if k:  # the flow out of a phrase of k words, and the pieces that end in it: all runs that begin with it
            on = codes[k - 1][left] > 0
            left = left[on]
            code, many = _pairs(code[on], codes[k - 1][left], len(names) + 1)
        total = np.bincount(code, n[left], many).astype(np.int64)
        first = np.zeros(many, np.int64)
        first[code] = left
        keep = np.flatnonzero((total > 0) & ((total >= least) | (depth[first] > k)))
        phrase = _phrases(names, codes[:k, first[keep]]) if k else pa.array([""] * len(keep), pa.large_string())
        out.append([pc.take(langs, pa.array(lang[first[keep]])).cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(keep), k, np.int32)), pa.array(total[keep])])
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out)], ["lang", "phrase", "words", "n"])


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n) of all phrases of 1 to `order` words that occur `least` times, and (lang, '', 0, all words).

    Edges are dealt by their first word, so all edges that leave a node, and all nodes that
    begin with a pair, meet in one route and their flows add up there. What frequent words
    and pairs begin is dealt by more words, and only those sums are added up again. A task
    holds one route at a time, one of ROUTES for each shuffle partition.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routes = ROUTES * parts
    look = stored(edges(docs.sample(LOOK, 7), text_col, lang_col, order), "edges-look")
    one, two = (busy_heads(look, k, 1 / (4 * routes)) for k in (1, 2))
    release(look)
    blocks = packed_edges(docs, text_col, lang_col, order, routes, one, two).repartition(parts, "route").sortWithinPartitions("route")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for i, route in enumerate(batch.column(0).to_pylist()):
                if held and route != at:
                    yield _flows(held, order, least)
                    held = []
                at = route
                held.append((batch.column(1)[i].values, *[batch.column(c)[i].as_py() for c in range(2, 6)]))
        if held:
            yield _flows(held, order, least)

    here = blocks.mapInArrow(each, "lang string, phrase string, words int, n bigint")
    whole = here.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("words") == 0))
    return stored(whole, "phrases")


def _after_first(column: str) -> Column:
    """A phrase without its first word."""
    return F.expr(f"substring({column}, instr({column}, ' ') + 1)")


def unary_paths(heavy: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, path, n): edges (lang, phrase, n) compacted into maximal unary paths, as arrays of words.

    Two edges that meet in a node are one path if no other edge enters or leaves the node and
    both have one weight. Every edge looks up the edge before it and doubles its jump each
    round, so a path of m edges takes log2(m) rounds; edges on a closed ring stay as they are.
    """
    e = heavy.select("lang", F.col("phrase").alias("edge"), "n", _prefix("phrase", order - 1).alias("tail"), _after_first("phrase").alias("head"))
    into = e.groupBy("lang", F.col("head").alias("node")).agg(F.count("*").alias("_c"), F.max("edge").alias("before"), F.max("n").alias("_w")).where("_c = 1")
    out = e.groupBy("lang", F.col("tail").alias("node")).agg(F.count("*").alias("_c"), F.max("edge").alias("edge"), F.max("n").alias("_w")).where("_c = 1")
    step = into.join(out, ["lang", "node", "_w"]).select("lang", "edge", "before")
    jumps = stored(e.join(step, ["lang", "edge"], "left").select("lang", "edge", "n", F.col("before").alias("jump"), F.when(F.col("before").isNull(), 0).otherwise(1).cast("bigint").alias("far")), "paths")
    left = None
    while (now := jumps.where("jump is not null").count()) != left and now:
        # An edge whose jump has none itself has reached the start of its path; that start stays in `edge_0`.
        back = jumps.select("lang", F.col("edge").alias("jump"), F.col("jump").alias("_next"), F.col("far").alias("_far"), *([F.col("edge_0").alias("_start")] if left is not None else []))
        start = F.coalesce("_start", "jump") if left is not None else F.col("jump")
        kept = F.col("edge_0") if left is not None else F.lit(None).cast("string")
        nxt = jumps.join(back, ["lang", "jump"], "left").select(
            "lang", "edge", "n", F.col("_next").alias("jump"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"), F.when(F.col("jump").isNull(), kept).when(F.col("_next").isNull(), start).otherwise(kept).alias("edge_0")
        )
        done, left = stored(nxt, "paths"), now
        release(jumps)
        jumps = done
    start = F.coalesce("edge_0", "edge") if left is not None else F.col("edge")
    ring = F.col("jump").isNotNull()
    marked = jumps.select("lang", "n", "edge", F.when(ring, F.col("edge")).otherwise(start).alias("_start"), F.when(ring, 0).otherwise(F.col("far")).alias("far"))
    joined = marked.groupBy("lang", "_start", "n").agg(F.array_sort(F.collect_list(F.struct("far", F.substring_index("edge", " ", -1).alias("w")))).alias("_on"))
    return joined.select("lang", F.concat(F.split("_start", " "), F.transform(F.slice("_on", F.lit(2), F.size("_on")), lambda x: x["w"])).alias("path"), "n")


def _windows(words: Column, size: int) -> Column:
    """All runs of `size` words of an array, joined."""
    n = F.size(words)
    return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.concat_ws(" ", F.slice(words, i, size)))).otherwise(F.array().cast("array<string>"))


def dominated(candidates: DataFrame, order: int = ORDER, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase) of candidates whose words lie in a longer candidate with `inside` percent of their count or more.

    Candidates of `order` words are compacted into unary paths first: a run of words on a
    path lies in an edge of the path's weight, so a path speaks for all its edges at once.
    """
    paths = unary_paths(candidates.where(F.col("words") == order), order)
    words = F.col("path")
    held = [paths.select("lang", "n", F.explode(_windows(words, k)).alias("phrase")) for k in range(2, order)]
    for longer in range(3, order):
        rows = candidates.where(F.col("words") == longer).select("lang", "n", F.split("phrase", " ").alias("path"))
        held += [rows.select("lang", "n", F.explode(_windows(words, k)).alias("phrase")) for k in range(2, longer)]
    around = held[0]
    for h in held[1:]:
        around = around.unionByName(h)
    most = around.groupBy("lang", "phrase").agg(F.max("n").alias("_most"))
    return candidates.join(most, ["lang", "phrase"]).where(100 * F.col("_most") >= inside * F.col("n")).select("lang", "phrase")


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, words, n) with a, l, r and score of their lowest-scoring cut; ties go to the shortest first part."""
    cuts = candidates.select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", _prefix("phrase", "k").alias("_first"), _prefix("phrase", "k - words").alias("_rest"))
    of = lambda part, n: counts.where("words > 0").select("lang", F.col("phrase").alias(part), F.col("n").alias(n))
    cuts = cuts.join(of("_first", "l"), ["lang", "_first"]).join(of("_rest", "r"), ["lang", "_rest"])
    score = F.expr(f"(cast({SCALE} as decimal(7, 0)) * cast(a as decimal(19, 0))) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("_c")
    return cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, least: int = LEAST, inside: int = INSIDE, top: int = TOP
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of 2 to `order` words of each language.

    Counts are of all occurrences within pieces, repeated rows count each time, a null
    language is `und`, null and empty texts hold nothing. Ties in score and count go by the
    bytes of the phrase. A language without candidates, and an empty table, give no rows.
    Other columns of docs are not read.
    """
    if order < 3:
        raise ValueError("edges of three words or more")
    counts = phrase_counts(docs, text_col, lang_col, order, least)
    candidates = counts.where("words >= 2")
    rest = candidates.join(dominated(candidates, order, inside), ["lang", "phrase"], "left_anti")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored(rest, counts).withColumn("rank", place.cast("bigint")).where(F.col("rank") <= top)  # each task keeps `top` rows of a language before they are shuffled
    words = F.broadcast(counts.where("words = 0").select("lang", "n"))  # one row a language
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE k >= 2),
sub AS (SELECT lang, c, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k),
mx AS (SELECT lang, phrase, max(c) AS most FROM sub GROUP BY ALL),
keep AS (SELECT c.* FROM c LEFT JOIN mx ON c.lang = mx.lang AND c.phrase = mx.phrase WHERE most IS NULL OR 100 * most < 80 * c.c),
cut AS (SELECT keep.lang, keep.phrase, keep.c AS a, j, l.c AS l, r.c AS r, CAST(CAST(2000000 AS HUGEINT) * keep.c // (l.c + r.c) AS BIGINT) AS score
        FROM keep JOIN (SELECT unnest([1, 2, 3]) AS j) ON j < k
        JOIN f l ON l.lang = keep.lang AND l.phrase = array_to_string(string_split(keep.phrase, ' ')[1:j], ' ')
        JOIN f r ON r.lang = keep.lang AND r.phrase = array_to_string(string_split(keep.phrase, ' ')[j + 1:], ' ')),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT rk.lang, rank, phrase, a, l, r, n, score FROM rk JOIN n ON rk.lang = n.lang WHERE rank <= 2000
"""
