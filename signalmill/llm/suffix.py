"""Suffix-array dedup: longest-previous-factor arrays over the places where texts can repeat.

Every window of SPAN bytes owns an anchor, the smallest hash of the K-byte strings in it, so
equal windows have equal anchors and windows of one anchor form segments. Anchors that stand
in one place only are done. Of the other segments the distinct contents are suffix-sorted in
groups of one anchor; the nearest smaller positions before and after a suffix in suffix
order give its longest previous factor, and with it whether its window has an earlier copy
(the nearest larger positions: a later one). A group too large for one suffix array is dealt
out by finer anchors, in the end the windows themselves, whose groups hold one content each.
Lengths are bytes, or words where a caller asks for words: then the string is that of the
words' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmill.llm.common import boxed, map_texts, release, row_key, stored, table
from signalmill.llm.lattice import cell_batches
from signalmill.llm.textbytes import Rolling, words_of

SPAN, K = 400, 300
#: Distinct contents of an anchor that one suffix array takes; windows of larger groups are anchors of their own.
GROUP = 4096
#: Bytes (or words) that one suffix array sorts, but for a group that is larger.
ARRAY = 500_000


def symbols(text: str, words: bool) -> np.ndarray:
    """The string whose windows are compared: the bytes of a text, or the hashes of its words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return words_of(raw)[0] if words else raw


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """(suffix order, [(length, rank by so many first places)]) of an array of bytes or word hashes, by prefix doubling.

    Ranks start from eight bytes or one word; ranks of doubled length come from sorting pairs
    of ranks, and the last pair overlaps, so the order is exact to `depth` places and equal
    prefixes share a rank. Suffixes of equal prefixes stand in order of position.
    """
    n = len(text)
    value, length = text, 1
    if text.dtype == np.uint8:
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        value, length = np.zeros(n, np.uint64), 8
        for i in range(8):
            value = (value << np.uint64(8)) | padded[i : n + i]
    ranks = []
    while True:
        order = np.argsort(value)
        rank = np.empty(n, np.int64)
        moved = value[order]
        rank[order] = np.cumsum(np.concatenate([[1], moved[1:] != moved[:-1]])) if n else order
        ranks.append((length, rank.astype(np.int32)))
        if length >= depth or n == 0:
            return np.argsort(rank, kind="stable"), ranks
        step = min(length, depth - length)
        value = rank * (n + 1)
        value[: max(n - step, 0)] += rank[step:]
        length += step


def common_prefix(ranks: list[tuple[int, np.ndarray]], i: np.ndarray, j: np.ndarray, depth: int) -> np.ndarray:
    """Places that the suffixes i and j share, as far as the ranks show it: exact at `depth` or more, where it stops, and a lower bound below."""
    got = np.zeros(len(i), np.int64)
    full = ranks[-1][1][i] == ranks[-1][1][j]
    n = len(ranks[-1][1])
    for length, rank in reversed(ranks[:-1]):
        a, b = i + got, j + got
        inside = (a < n) & (b < n) & ~full
        same = inside.copy()
        same[inside] = rank[a[inside]] == rank[b[inside]]
        got[same] += length
    return np.where(full, depth, np.minimum(got, depth - 1))


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place before it that holds a smaller value, -1 for none; by pointer jumping over all places at once."""
    near = np.arange(-1, len(values) - 1)
    live = np.flatnonzero(near >= 0)
    while len(live):
        live = live[values[near[live]] > values[live]]
        near[live] = near[near[live]]
        live = live[near[live] >= 0]
    return near


def previous_factors(order: np.ndarray, ranks: list[tuple[int, np.ndarray]], depth: int) -> np.ndarray:
    """Longest previous factor, up to `depth`, of the suffixes in `order`, in that order.

    It is the longer of the matches with the nearest suffixes of smaller position before and
    after in suffix order.
    """
    before = nearest_smaller(order)
    after = len(order) - 1 - nearest_smaller(order[::-1])[::-1]
    best = np.zeros(len(order), np.int64)
    for near, some in ((before, before >= 0), (after, after < len(order))):
        at = np.flatnonzero(some)
        best[at] = np.maximum(best[at], common_prefix(ranks, order[at], order[near[at]], depth))
    return best


def next_factors(order: np.ndarray, ranks: list[tuple[int, np.ndarray]], depth: int) -> np.ndarray:
    """The same for matches at larger positions."""
    before = nearest_smaller(-order)
    after = len(order) - 1 - nearest_smaller(-order[::-1])[::-1]
    best = np.zeros(len(order), np.int64)
    for near, some in ((before, before >= 0), (after, after < len(order))):
        at = np.flatnonzero(some)
        best[at] = np.maximum(best[at], common_prefix(ranks, order[at], order[near[at]], depth))
    return best


def anchors(raw: np.ndarray, span: int = SPAN, k: int = K) -> tuple[np.ndarray, ...]:
    """Segments of a string of `span` bytes or words or more: anchor hash, first window, windows, hash of the content, and
    whether the anchor stands in the segment more than once (only then can its windows repeat each other)."""
    n = len(raw) - span + 1
    roll = Rolling(raw)
    h = roll.windows(k)
    w = span - k + 1
    # Sliding minimum by blocks of w: the smaller of a suffix minimum and a prefix minimum.
    full = np.full(-(-len(h) // w) * w, np.iinfo(np.uint64).max)
    full[: len(h)] = h
    full = full.reshape(-1, w)
    ahead = np.minimum.accumulate(full, 1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    low = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    # Runs of equal minima; one longer than w spans anchors of equal strings and is cut.
    start = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    end = np.append(start[1:], n)
    long = np.flatnonzero(end - start > w)
    if len(long):
        start = np.sort(np.concatenate([start, *[np.arange(start[i] + w, end[i], w) for i in long]]))
        end = np.append(start[1:], n)
    value = low[start]
    views = np.lib.stride_tricks.sliding_window_view(h, w)
    first = start + (views[start] == value[:, None]).argmax(1)
    last = end - 1 + w - 1 - (views[end - 1] == value[:, None])[:, ::-1].argmax(1)
    # The content's hash is of other random values than the anchor's, so the two name it by 128 bits.
    return value, start, end - start, Rolling(raw, 1).of(start, end - 1 + span), first != last


def _pieces_marked(pdf: pd.DataFrame, span: int, keep_first: bool, kind=np.uint8) -> list[np.ndarray]:
    """Of each piece in whole anchor groups, which windows stand elsewhere (keep_first: earlier) among the pieces."""
    joined = np.frombuffer(b"".join(pdf["piece"]), kind)
    lengths, number = pdf["piece"].map(len).to_numpy() // joined.itemsize, pdf["n"].to_numpy()
    order, ranks = suffix_order(joined, span)
    first = np.cumsum(lengths) - lengths
    # Windows end inside their piece, so only suffixes that start a window count.
    starts = np.zeros(len(joined), bool)
    for a, n in zip(first, number):
        starts[a : a + n] = True
    order = order[starts[order]]
    found = previous_factors(order, ranks, span) >= span
    if not keep_first:
        found |= next_factors(order, ranks, span) >= span
    flags = np.zeros(len(joined), bool)
    flags[order[found]] = True
    return [flags[a : a + n] for a, n in zip(first, number)]


def _runs(flags: np.ndarray) -> list[int]:
    """Starts and ends of the runs of true flags, in turn."""
    return np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8))).tolist()


SEGMENT = "_k1 long, _k2 long, ord long, a long, start int, n int, c long, twice boolean"


def segments_of(docs: DataFrame, span: int = SPAN, k: int = K, words: bool = False) -> DataFrame:
    """Segments of rows (_k1, _k2, ord, text) whose anchor stands elsewhere too.

    Adds copies (segments of the same content), head (whether it is the first of them; those
    of equal rows are all first) and kinds (contents of the anchor). Anchors are counted with
    partial aggregates before any segment moves, and segments meet the counts in joins that
    adaptive execution can split, so no task takes all segments of one anchor. Only counts
    and hashes are shuffled, no text.
    """

    def cut(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        names = ["a", "start", "n", "c", "twice"]

        def frame(rows):
            times = [len(x[3]) for x in rows]
            out = {key: np.repeat(np.array([x[i] for x in rows], np.int64), times) for i, key in enumerate(("_k1", "_k2", "ord"))}
            out |= {name: np.concatenate([x[3 + i] for x in rows]) for i, name in enumerate(names)}
            out |= {"a": out["a"].view(np.int64), "c": out["c"].view(np.int64), "start": out["start"].astype(np.int32), "n": out["n"].astype(np.int32)}
            return pd.DataFrame(out)

        rows, held = [], 0
        for k1, k2, order, text in zip(batch["_k1"], batch["_k2"], batch["ord"], batch["text"]):
            raw = symbols(text, words)
            if len(raw) >= span:
                rows.append((k1, k2, order, *anchors(raw, span, k)))
                held += len(rows[-1][3])
            if held > 50_000:
                yield frame(rows)
                rows, held = [], 0
        if rows:
            yield frame(rows)

    every = map_texts(docs.select("_k1", "_k2", "ord", "text"), cut, SEGMENT)
    shared = every.groupBy("a").agg(F.count("*").alias("places"), F.max("twice").alias("again")).where("places > 1 or again")
    shared = stored(shared.select("a"), "anchors")
    found = stored(every.join(shared.hint("shuffle_hash"), "a", "left_semi"), "shared")
    place = F.struct("ord", "_k1", "_k2", "start")
    contents = found.groupBy("a", "c").agg(F.count("*").alias("copies"), F.min(place).alias("top"))
    contents = stored(contents, "contents")
    kinds = stored(contents.groupBy("a").agg(F.count("*").alias("kinds"), F.max("copies").alias("most")), "kinds")
    counts = contents.join(kinds, "a").where("copies > 1 or kinds > 1")
    marked = found.join(counts, ["a", "c"], "left").where("twice or copies is not null")
    marked = marked.withColumns({"copies": F.coalesce("copies", F.lit(1)), "kinds": F.coalesce("kinds", F.lit(1)), "head": F.coalesce(F.col("top") == place, F.lit(True))})
    out = stored(marked.select("_k1", "_k2", "ord", "a", "start", "n", "twice", "copies", "kinds", "head"), "segments")
    release(shared, found, contents, kinds)
    return out


def repeated(docs: DataFrame, span: int = SPAN, k: int = K, id_col="doc_id", text_col="text", keep_first: bool = False, words: bool = False) -> DataFrame:
    """Rows (_row, _k1, _k2, _text, _found): _row holds the columns of docs, and spans_of(_found) the byte ranges covered by a
    `span`-byte string that stands anywhere else too; with keep_first, earlier in the order of ids (nulls last) and places.

    Texts are UTF-8 bytes, null ones empty; matches never cross rows, and count within a row
    too. Strings are judged on the input. Rows shorter than `span` have none. A row repeated
    as a whole (same id and text) is its own copy, so all its bytes are covered if it has
    `span` of them; with keep_first equal rows all get the ranges of the first of them. With
    words, span, k and the ranges count the words of words_of(). An empty table gives no rows.
    """
    last = F.lit(2**63 - 1)
    full = boxed(docs, *row_key(id_col, text_col), F.coalesce(F.col(id_col).cast("long"), last).alias("_ord"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    keyed = full.select("_k1", "_k2", F.col("_ord").alias("ord"), F.col("_text").alias("text"))
    marked = segments_of(keyed, span, k, words)
    kind = np.uint64 if words else np.uint8
    whole = marked.where("copies > 1" + (" and not head" if keep_first else "")).select("_k1", "_k2", "start", F.col("n").alias("windows"), F.lit(None).cast("array<int>").alias("runs"))
    # A copied content is covered already, unless its first copy stays.
    wanted = marked.where("(kinds > 1 or twice) and (copies = 1 or head)")
    asked = stored(wanted.groupBy("_k1", "_k2", "ord").agg(F.collect_set(F.struct("a", "start", "n", "copies", "kinds")).alias("asks")), "asks")

    def pieces(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        names = ["_k1", "_k2", "ord", "a", "start", "n", "copies", "kinds", "piece"]
        rows, held = [], 0
        for k1, k2, order, text, asks in zip(batch["_k1"], batch["_k2"], batch["ord"], batch["text"], batch["asks"]):
            raw = symbols(text, words)
            for x in asks:
                rows.append((k1, k2, order, x["a"], x["start"], x["n"], x["copies"], x["kinds"], raw[x["start"] : x["start"] + x["n"] - 1 + span].tobytes()))
                held += len(rows[-1][-1])
                if held > 1_000_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    cut = map_texts(keyed.select("_k1", "_k2", "text").join(asked, ["_k1", "_k2"]), pieces, "_k1 long, _k2 long, ord long, a long, start int, n int, copies long, kinds long, piece binary", 100)
    cut = stored(cut, "pieces")

    def single_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Without the pieces of equal rows but one, which would be earlier copies of themselves."""
        key, last = ["a", "_k1", "_k2", "start"], None
        for batch in batches:
            new = ~batch.duplicated(key).to_numpy()
            if len(batch):
                new &= (batch[key] != last).any(axis=1).to_numpy() if last is not None else True
                last = batch[key].iloc[-1]
            yield batch[new]

    def sorted_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in cell_batches(single_rows(batches), ["a"]):
            # Whole groups to a suffix array.
            size = batch["piece"].map(len).groupby(batch["a"]).sum().cumsum() // ARRAY
            for _, part in batch.groupby(batch["a"].map(size), sort=False):
                runs = [_runs(f) for f in _pieces_marked(part, span, keep_first, kind)]
                use = np.array([bool(r) and (c == 1 or keep_first) for r, c in zip(runs, part["copies"])])
                out = part[["_k1", "_k2", "start"]].assign(windows=part["n"], runs=runs)
                yield out[use]

    found = "_k1 long, _k2 long, start int, windows int, runs array<int>"
    small = cut.where(F.col("kinds") <= GROUP).repartition("a").sortWithinPartitions("a", "ord", "_k1", "_k2", "start").mapInPandas(sorted_groups, found)

    def windows_of(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for k1, k2, order, start, n, piece, copies in zip(*(batch[c] for c in ("_k1", "_k2", "ord", "start", "n", "piece", "copies"))):
            raw = np.frombuffer(piece, kind)
            h, g = (Rolling(raw, w).windows(span).view(np.int64) for w in (0, 1))
            yield pd.DataFrame({"_k1": k1, "_k2": k2, "ord": order, "start": np.int32(start), "at": np.arange(n, dtype=np.int32), "copies": copies, "h": h, "g": g})

    windows = map_texts(cut.where(F.col("kinds") > GROUP), windows_of, "_k1 long, _k2 long, ord long, start int, at int, copies long, h long, g long")
    windows = stored(windows, "windows")
    place = F.struct("ord", "_k1", "_k2", (F.col("start") + F.col("at")).alias("p"))
    often = stored(windows.groupBy("h", "g").agg(F.count("*").alias("m"), F.min(place).alias("top")).where("m > 1"), "often")
    large = windows.join(often, ["h", "g"]).where(place > F.col("top") if keep_first else F.col("copies") == 1)
    large = large.groupBy("_k1", "_k2", "start").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    each = F.flatten(F.transform("ats", lambda x: F.array(x, x + 1)))
    large = large.select("_k1", "_k2", "start", F.lit(0).alias("windows"), each.alias("runs"))
    every = whole.unionByName(small).unionByName(large)
    spans = stored(every.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "windows", "runs")).alias("_found")), "found")
    release(marked, asked, cut, windows, often)
    return full.join(spans, ["_k1", "_k2"], "left").drop("_ord")


def spans_of(found, span: int) -> np.ndarray:
    """Merged ranges of a row's duplicate windows, in bytes or words as they were found."""
    ranges = []
    for x in found if found is not None else ():
        if x["runs"] is None:
            ranges.append((x["start"], x["start"] + x["windows"] - 1 + span))
        else:
            r = np.asarray(x["runs"]).reshape(-1, 2) + x["start"]
            ranges += [(s, e - 1 + span) for s, e in r]
    if not ranges:
        return np.zeros((0, 2), np.int64)
    r = np.array(sorted(ranges), np.int64)
    top = np.maximum.accumulate(r[:, 1])
    new = np.r_[True, r[1:, 0] > top[:-1]]
    return np.stack([r[new, 0], top[np.r_[np.flatnonzero(new)[1:] - 1, len(r) - 1]]], 1)


def without_spans(raw: bytes, spans: np.ndarray) -> str:
    """The text left when ranges are cut out; they shrink to whole characters."""
    out, at = [], 0
    for s, e in spans.tolist():
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        out.append(raw[at:s])
        at = e
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def drop_later_copies(docs: DataFrame, span: int = SPAN, k: int = K, id_col="doc_id", text_col="text", words: bool = False) -> DataFrame:
    """The rows of docs, with bytes cut from `text_col` that a `span`-byte string covers which stands earlier (in id order, then place).

    With words, span and k count words instead, and what goes is every run of `span` words that
    stands earlier. n_chars, where there is such a column, follows the text. Rows of which
    nothing (no word) is left are dropped, so of equal rows of `span` or more one stays.
    """
    found = repeated(docs, span, k, id_col, text_col, keep_first=True, words=words)
    # Of equal rows the first stays, as it may be cut.
    found = found.withColumn("_later", F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy(F.lit(0))) > 1)

    def cut(text, runs, later):
        if text is None:
            return None
        if later and len(symbols(text, words)) >= span:
            return ""
        if runs is None:
            return text
        raw, spans = text.encode("utf-8", "surrogatepass"), spans_of(runs, span)
        if words:
            _, start, end = words_of(np.frombuffer(raw, np.uint8))
            if (spans[:, 1] - spans[:, 0]).sum() == len(start):
                return ""
            spans = np.stack([start[spans[:, 0]], end[spans[:, 1] - 1]], 1)
        return without_spans(raw, spans)

    @F.arrow_udf("string")
    def kept(text: pa.Array, runs: pa.Array, later: pa.Array) -> pa.Array:
        def part(at: int) -> pa.Array:
            rows = zip(text.slice(at, 100), runs.slice(at, 100), later.slice(at, 100))
            return pa.array([cut(t.as_py(), r.as_py(), x.as_py()) for t, r, x in rows], pa.string())

        return pa.concat_arrays([part(at) for at in range(0, max(len(text), 1), 100)])

    # Only texts that may be cut travel to Python, and the row carries its text once; one that needs no cut stays as it is, null or empty.
    text = F.col("_row").getField(text_col)
    may = F.expr("_found is not null or _later") & (text != "")
    found = found.withColumn("_kept", kept(F.when(may, text), F.when(may, F.col("_found")), F.col("_later")))
    new = {text_col: F.coalesce("_kept", text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("_kept").cast(docs.schema["n_chars"].dataType), F.col("_row").getField("n_chars"))
    return found.where("_kept is null or _kept <> ''").select([new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are of the remaining bytes; `text` is what remains as text, where a character that is cut in part stays whole; `duplicated` says whether any byte went."""

    def each(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        rows = []
        for key, text, found in zip(batch["doc_id"], batch["text"], batch["found"]):
            raw = text.encode("utf-8", "surrogatepass")
            spans, at, digest, gone = spans_of(found, SPAN), 0, hashlib.sha256(), 0
            for s, e in spans:
                digest.update(raw[at:s])
                gone, at = gone + int(e - s), int(e)
            digest.update(raw[at:])
            rows.append((key, len(raw), gone, len(spans), digest.hexdigest(), without_spans(raw, spans) if len(spans) else text, gone > 0))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "duplicated"])

    found = repeated(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("_row.doc_id").cast("string").alias("doc_id"), F.col("_text").alias("text"), F.col("_found").alias("found"))
    # Ids travel as text: a batch with a null would turn them into doubles.
    return map_texts(found, each, "doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, duplicated boolean").withColumn("doc_id", F.col("doc_id").cast("long"))
