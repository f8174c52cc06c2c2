"""N-gram Jaccard join by signature trees.

Documents with equal shingle sets are one class. Two classes whose similarity reaches the
threshold differ in a bounded share of their shingles, so when shingles are dealt into more
parts than that bound, the classes agree on some whole parts: the parts' hashes are the
groups in which pairs are sought, and no pair is lost. In a group, a signature tree (bitmaps
of the shingles; nodes over nodes, with OR-combined bitmaps and size ranges) is descended
against itself from the root, or against the tree of another slice of a large group. Node
pairs whose largest possible overlap is too small are pruned, and the surviving pairs leave
the task as a spanning forest. The classes a forest connects are then compared by their
exact shingle sets, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmill.llm.common import boxed, broadcast_if_small, map_texts, release, row_key, stored, table
from signalmill.llm.components import connected_components, local_forest
from signalmill.llm.lattice import cell_batches
from signalmill.llm.textbytes import U, mixed, shingle_sets

BITS, MOST_BITS, FAN = 2048, 1 << 17, 8
#: Node pairs of a tree that are looked at in one go.
CHUNK = 2048
#: Classes of a group that one task takes on; larger groups are dealt to tasks of pairs of slices.
GROUP = 2048
#: Classes and shingles of a block in the exact comparison.
BLOCK_DOCS, BLOCK_SHINGLES = 64, 60_000


class Rule:
    """similar: p * union <= q * intersection, as integers, e.g. 90 and 100."""

    def __init__(self, least: int, of: int = 100):
        self.p, self.q = least, of

    def linked(self, same, a, b):
        return self.q * same >= self.p * (a + b - same)

    def overlap(self, a, b):
        """Least intersection of linked sets of sizes a and b."""
        return -(-self.p * (a + b) // (self.p + self.q))

    def level(self, size: np.ndarray) -> np.ndarray:
        """Size class: sizes that can link lie in one class or two that follow each other."""
        return np.floor(np.log(np.maximum(size, 1)) / math.log(self.q / self.p) + 1e-9).astype(np.int64)

    def parts(self, level: int) -> int:
        """Parts for pairs whose smaller set is of this class; 0 if only equal sets can link."""
        top = math.floor((self.q / self.p) ** (level + 1) + 1e-6)
        differ = top * (self.q - self.p) // self.p
        return differ + 1 + self.spare(differ) if differ else 0

    @staticmethod
    def spare(differ: int) -> int:
        """More parts than needed, so that as many must agree and empty ones can be passed over."""
        return differ // 8

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Group keys of one sorted set.

        A set emits the hashes of its parts at its own level and at the level below. Linked
        sets agree on more parts than there are spare ones, so empty parts count only for sets
        that have more empty parts than that.
        """
        own = int(self.level(np.array([len(shingles)]))[0])
        out = []
        for level in (own, own - 1):
            n = self.parts(level) if level >= 0 else 0
            if not n:
                continue
            part = ((shingles >> U(33)) % U(n)).astype(np.int64)
            sums = np.zeros(n, np.uint64)
            np.add.at(sums, part, mixed(shingles))
            full = np.bincount(part, minlength=n) > 0
            use = np.flatnonzero(full) if n - full.sum() <= self._spare_of(level) else np.arange(n)
            out.append(mixed(sums[use] + mixed(use.astype(np.uint64) * U(1_000_003) + U(level))))
        return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)

    def _spare_of(self, level: int) -> int:
        top = math.floor((self.q / self.p) ** (level + 1) + 1e-6)
        return self.spare(top * (self.q - self.p) // self.p)


def bitmap(shingles: np.ndarray) -> bytes:
    """Bits of the shingles' hashes: four per shingle or more, a power of two from BITS to MOST_BITS."""
    n = BITS
    while n < 4 * len(shingles) and n < MOST_BITS:
        n *= 2
    bits = np.zeros(n, bool)
    bits[(shingles % U(n)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def aligned(bitmaps: list[bytes]) -> np.ndarray:
    """Rows of uint64 words; longer bitmaps fold to the shortest, as their lengths are powers of two."""
    least = min(map(len, bitmaps))
    return np.stack([np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, least // 8), axis=0) for b in bitmaps])


def _ones(a: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a).sum(-1, dtype=np.int64)


class Tree:
    """Levels of nodes over the members of a group, the members first and the root last.

    FAN nodes that follow each other in order of size have one parent. A node holds the OR
    of its members' bitmaps, their range of sizes, their most bits and the largest excess
    of a size over its bits. bits: rows of uint64 words.
    """

    def __init__(self, size: np.ndarray, bits: np.ndarray):
        self.order = np.lexsort((bits[:, 0], size))
        size, bits = size[self.order], bits[self.order]
        ones = _ones(bits)
        self.levels = [(bits, size, size, ones, size - ones)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, most, excess = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(most, at), np.maximum.reduceat(excess, at)))

    def node(self, level: int) -> tuple[np.ndarray, ...]:
        """Nodes of a level; above the root there is the root alone."""
        return self.levels[min(level, len(self.levels) - 1)]

    def children(self, level: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child of nodes x of a level, and how many there are."""
        if level >= len(self.levels):
            return x, np.ones(len(x), np.int64)
        return x * FAN, np.minimum(len(self.levels[level - 1][1]) - x * FAN, FAN)


def _may_link(rule: Rule, a: tuple, b: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether members of nodes x and y can reach the least overlap: at most shared bits and what bits do not show are shared."""
    (bits_a, low_a, high_a, most_a, over_a), (bits_b, low_b, high_b, most_b, over_b) = a, b
    shared = _ones(bits_a[x] & bits_b[y])
    top = np.minimum(over_a[x] + np.minimum(shared, most_a[x]), over_b[y] + np.minimum(shared, most_b[y]))
    sizes = (rule.p * low_a[x] <= rule.q * high_b[y]) & (rule.p * low_b[y] <= rule.q * high_a[x])
    return sizes & (top >= rule.overlap(low_a[x], low_b[y]))


class _Sets:
    """Members that are known to be connected, and per level of a tree the label all members of a node share (-1: none)."""

    def __init__(self, n: int):
        self.label, self.shared = np.arange(n), {}

    def union(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Join pairs; which of them were needed."""
        need = np.flatnonzero(self.label[x] != self.label[y])
        _, first = np.unique(np.minimum(self.label[x[need]], self.label[y[need]]) * len(self.label) + np.maximum(self.label[x[need]], self.label[y[need]]), return_index=True)
        root: dict[int, int] = {}

        def find(i):
            while root.get(i, i) != i:
                i = root[i]
            return i

        used = []
        for k in need[first].tolist():
            i, j = find(int(self.label[x[k]])), find(int(self.label[y[k]]))
            if i != j:
                root[max(i, j)] = min(i, j)
                used.append(k)
        if used:
            ends = {i: find(i) for i in root}
            table = np.arange(len(self.label))
            table[list(ends)] = list(ends.values())
            self.label, self.shared = table[self.label], {}
        return np.array(used, np.int64)

    def of(self, side: int, level: int, members: np.ndarray) -> np.ndarray:
        """members: members of the side's tree in its order."""
        key = (side, level)
        if key not in self.shared:
            at = np.arange(0, len(members), FAN**level)
            low, high = np.minimum.reduceat(self.label[members], at), np.maximum.reduceat(self.label[members], at)
            self.shared[key] = np.where(low == high, low, -1)
        return self.shared[key]


def tree_forest(size: np.ndarray, bits: np.ndarray, rule: Rule, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs that may link, as indexes, by dual traversal. bits: rows of uint64 words.

    Without `side` a tree of all is descended against itself; with it, the trees of the two
    sides against each other. Node pairs whose members are all connected already are passed
    over, which keeps groups of near copies from being looked at pair by pair.
    """
    parts = [np.arange(len(size))] if side is None else [np.flatnonzero(side == s) for s in np.unique(side)]
    none = np.zeros(0, np.int64)
    if side is not None and len(parts) < 2 or len(size) < 2:
        return none, none
    trees = [Tree(size[p], bits[p]) for p in parts]
    a, b = trees[0], trees[-1]
    members = [p[t.order] for p, t in zip(parts, trees)]
    sets, same = _Sets(len(size)), a is b
    top = max(len(a.levels), len(b.levels)) - 1
    stack, out = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))], []
    while stack:
        level, x, y = stack.pop()
        la, lb = min(level, len(a.levels) - 1), min(level, len(b.levels) - 1)
        known = sets.of(0, la, members[0])[x]
        live = np.flatnonzero((known < 0) | (known != sets.of(len(parts) - 1, lb, members[-1])[y]))
        x, y = x[live], y[live]
        good = _may_link(rule, a.node(level), b.node(level), x, y)
        if same and level:
            good |= x == y
        x, y = x[good], y[good]
        if not len(x):
            continue
        if level == 0:
            x, y = members[0][x], members[-1][y]
            used = sets.union(x, y)
            out.append((x[used], y[used]))
            continue
        (xa, xn), (ya, yn) = a.children(level, x), b.children(level, y)
        count = xn * yn
        k = np.repeat(np.arange(len(x)), count)
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        x, y = xa[k] + at // yn[k], ya[k] + at % yn[k]
        if same:
            use = x < y if level == 1 else x <= y
            x, y = x[use], y[use]
        # Pairs of near nodes last, so that they come off the stack first.
        nearest = np.argsort(-np.abs(x - y), kind="stable")
        x, y = x[nearest], y[nearest]
        stack += [(level - 1, x[s : s + CHUNK], y[s : s + CHUNK]) for s in range(0, len(x), CHUNK)]
    return (np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])) if out else (none, none)


def name_of(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit name of a shingle set; equal sets share it."""
    total = lambda h: h.sum(keepdims=True)
    first = total(mixed(shingles)) * U(0x9E3779B97F4A7C15) ^ total(mixed(shingles ^ U(0x5851F42D4C957F2D))) + U(len(shingles))
    second = total(mixed(mixed(shingles + U(0xD6E8FEB86659FD93)) * U(0x9E3779B97F4A7C15))) + U(len(shingles))
    return int(first.view(np.int64)[0]), int(second.view(np.int64)[0])


#: Words of the bitset that tells which sets may need signatures: 1 MB, whatever the input.
BITSET_WORDS = 1 << 17


def bitset(nodes: DataFrame) -> np.ndarray:
    """Bounded set of names: bits by hash. A full one lets all names through, which costs work and loses nothing."""
    place = F.pmod(F.col("node"), F.lit(BITSET_WORDS * 64))
    words = nodes.select(F.floor(place / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(node, {BITSET_WORDS * 64}), 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(BITSET_WORDS, np.int64)
    for w, b in words.collect():  # at most BITSET_WORDS rows
        out[w] = b
    return out


def in_bitset(words: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    place = nodes % (BITSET_WORDS * 64)
    return (words[place // 64].view(np.uint64) >> (place % 64).astype(np.uint64)) & U(1) == U(1)


def _chunks(frame: pd.DataFrame, text: str, chars: int = 400_000) -> Iterator[pd.DataFrame]:
    """Rows of about so many characters at a time."""
    at = frame[text].str.len().cumsum().to_numpy() // chars
    for _, part in frame.groupby(at, sort=False):
        yield part


def shingled(docs: DataFrame, k: int, make, schema: str) -> DataFrame:
    """docs (text, ...): make(rows, sets) for chunks of rows."""

    def each(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for part in _chunks(batch, "text"):
            yield make(part, shingle_sets(part["text"].tolist(), k))

    return map_texts(docs, each, schema)


def _verified(pdf: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    """Forest edges (a, b) of the linked classes of one block, or between two."""
    sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
    node, size, block = pdf["cid"].to_numpy(), np.array([len(s) for s in sets]), pdf["side"].to_numpy()
    flat = np.concatenate(sets)
    values, at = np.unique(flat, return_inverse=True)
    counts = np.bincount(at)
    shared = counts[at] > 1  # shingles of one set only change no intersection
    rank = np.cumsum(counts > 1) - 1
    m = np.zeros((len(sets), max(int((counts > 1).sum()), 1)), np.float32)
    m[np.repeat(np.arange(len(sets)), size)[shared], rank[at[shared]]] = 1
    same = np.rint(m @ m.T).astype(np.int64)
    i, j = np.nonzero(np.triu(rule.linked(same, size[:, None], size[None, :]), 1))
    if (block != block[0]).any():
        cross = block[i] != block[j]
        i, j = i[cross], j[cross]
    a, b = local_forest(node[i], node[j]) if len(i) else (np.zeros(0, np.int64),) * 2
    return pd.DataFrame({"a": a, "b": b})


def _compared(cells: DataFrame, signed: DataFrame, rule: Rule) -> DataFrame:
    """Forest edges of the linked pairs of cells (cell columns c1 to c4, side, cid), by exact sets."""
    key = ["c1", "c2", "c3", "c4"]
    rows = cells.join(signed.select("cid", "shingles"), "cid").repartition(*key).sortWithinPartitions(*key)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in cell_batches(batches, key):
            for _, same in batch.groupby(key):
                yield _verified(same, rule)

    return rows.mapInPandas(each, "a long, b long")


def _blocks(near: DataFrame, by: list[str]) -> DataFrame:
    """Adds `block` to rows (cid, n, level, ...): members of a group `by` are dealt to blocks of a bounded number of classes and shingles, by hash."""
    sizes = near.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    return near.join(sizes, by).withColumn("block", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("blocks"))).drop("blocks")


def _links(near: DataFrame, signed: DataFrame, rule: Rule) -> DataFrame:
    """(node, component) of classes linked by exact similarity. near: cid, n, component of the candidates.

    First every block of a candidate component is compared in itself, together with one
    class of the component's size level that all its blocks hold, so that near copies of
    one text become one label with about as many rows as there are classes. What a
    component's main label leaves over is then compared, in blocks of one label, with all
    blocks of other labels that its sizes can reach.
    """
    level = F.floor(F.log(F.col("n").cast("double")) / math.log(rule.q / rule.p) + 1e-9).cast("long").alias("level")
    near = _blocks(near.select("cid", "n", "component", level), ["component", "level"])
    spokes = near.groupBy("component", "level").agg(F.min("cid").alias("cid"))
    held = near.select("component", "level", "block").distinct().join(spokes, ["component", "level"])
    own = near.select("component", "level", "block", "cid").unionByName(held).distinct()
    own = own.select(F.col("component").alias("c1"), F.col("level").alias("c2"), F.col("block").alias("c3"), F.lit(0).cast("long").alias("c4"), F.lit(0).cast("long").alias("side"), "cid")
    own = stored(_compared(own, signed, rule), "within")
    labels = stored(connected_components(own), "labels")
    marked = near.drop("block").join(labels.select(F.col("node").alias("cid"), F.col("component").alias("label")), "cid", "left")
    marked = stored(_blocks(marked.withColumn("label", F.coalesce("label", "cid")), ["component", "label", "level"]), "marked")
    groups = marked.groupBy("component", "label").agg(F.count("*").alias("m"))
    main = groups.groupBy("component").agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("labels")).where("labels > 1")
    cells = marked.select("component", "label", "level", "block").distinct().join(main.select("component", F.col("top.label").alias("main")), "component")
    x, y = cells.where("label <> main").alias("x"), cells.alias("y")
    apart = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.label") < F.col("y.label")))
    near_sizes = F.abs(F.col("x.level") - F.col("y.level")) <= 1
    pairs = x.join(y, (F.col("x.component") == F.col("y.component")) & apart & near_sizes)
    place = lambda t: F.struct(F.col(f"{t}.component").alias("component"), F.col(f"{t}.label").alias("label"), F.col(f"{t}.level").alias("level"), F.col(f"{t}.block").alias("block"))
    pairs = stored(pairs.select(place("x").alias("p"), place("y").alias("q")), "pairs")
    if pairs.isEmpty():  # every component is one label
        release(own, marked, pairs)
        return labels
    names = [F.xxhash64("p"), F.xxhash64("q"), F.xxhash64("p", "q"), F.lit(1).cast("long")]
    sides = pairs.select(*[c.alias(f"c{i + 1}") for i, c in enumerate(names)], F.posexplode(F.array("p", "q")).alias("side", "at"))
    cells = sides.select("c1", "c2", "c3", "c4", F.col("side").cast("long").alias("side"), "at.*").join(marked, ["component", "label", "level", "block"])
    across = stored(_compared(cells.select("c1", "c2", "c3", "c4", "side", "cid"), signed, rule), "across")
    links = stored(connected_components(own.unionByName(across)), "links")
    release(own, labels, marked, pairs, across)
    return links


def similar_groups(docs: DataFrame, k: int = 5, rule: Rule = Rule(80), id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, _k1, _k2, n_shingles, component_id) per distinct document row; component_id is the smallest doc_id reachable by links.

    Null, empty and word-free texts have no shingles and link with nothing. Repeated rows
    (same id and text) give one row; rows of one id with different texts are one node. A null
    id gets no links and a null component. An empty table gives no rows.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def sized(part: pd.DataFrame, sets: list[np.ndarray]) -> pd.DataFrame:
        names = [name_of(s) for s in sets]
        return part[["doc_id", "_k1", "_k2"]].assign(n=[len(s) for s in sets], node=[a for a, _ in names], more=[b for _, b in names])

    # Ids travel as text: a batch with a null would turn them into doubles.
    found = shingled(keyed.withColumn("doc_id", F.col("doc_id").cast("string")), k, sized, "doc_id string, _k1 long, _k2 long, n long, node long, more long")
    found = stored(found.withColumn("doc_id", F.col("doc_id").cast("long")).distinct(), "sets")
    classes = stored(found.where("n > 0 and doc_id is not null").groupBy("node", "more").agg(F.min("doc_id").alias("cid"), F.min("n").alias("n")), "classes")

    def keyed_sets(part: pd.DataFrame, sets: list[np.ndarray]) -> pd.DataFrame:
        nodes, first = np.unique(np.array([name_of(s)[0] for s in sets], np.int64), return_index=True)  # copies of a batch once
        keys = [rule.keys(sets[i]) for i in first]
        return pd.DataFrame({"node": np.repeat(nodes, [len(x) for x in keys]), "key": np.concatenate(keys) if keys else np.zeros(0, np.int64)})

    # Keys that the same sets share are one group: it is named by the sum of its members' hashes.
    by_key = Window.partitionBy("key")
    texts = keyed.where("doc_id is not null").select("text")
    met = shingled(texts, k, keyed_sets, "node long, key long").withColumn("low", F.min("node").over(by_key)).withColumn("high", F.max("node").over(by_key))
    met = met.withColumn("group", F.sum(F.xxhash64("node").cast("decimal(20,0)")).over(by_key)).where("low <> high")
    met = stored(met.select("node", F.xxhash64("group", "low", "high").alias("key")).distinct(), "met")

    def of_classes(nodes: DataFrame, make, schema: str) -> DataFrame:
        """One row (node, more, ...) per class that `nodes` may hold: make(sets) gives the other columns."""
        wanted = bitset(nodes)

        def each(part: pd.DataFrame, sets: list[np.ndarray]) -> pd.DataFrame:
            names = [name_of(s) for s in sets]
            use = np.flatnonzero(in_bitset(wanted, np.array([a for a, _ in names], np.int64)))
            first = {names[i]: i for i in use[::-1].tolist()}  # copies of a batch once
            return pd.DataFrame({"node": [a for a, _ in first], "more": [b for _, b in first], **make([sets[i] for i in first.values()])})

        return shingled(texts, k, each, f"node long, more long, {schema}").dropDuplicates(["node", "more"])

    signed = of_classes(met.select("node"), lambda sets: {"n": [len(s) for s in sets], "bits": [bitmap(s) for s in sets]}, "n long, bits binary")
    signed = stored(signed.join(classes.select("node", "more", "cid"), ["node", "more"]), "signatures")
    sizes = stored(met.groupBy("key").agg(F.count("*").alias("count")), "sizes")
    dealt = met.join(sizes, "key").withColumn("slices", F.ceil(F.col("count") / GROUP).cast("int"))
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.select("node", "key", "slice", F.least("slice", "other").alias("b1"), F.greatest("slice", "other").alias("b2"))
    ready = dealt.join(signed.select("node", "cid", "n", "bits"), "node").repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")

    def traversed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in cell_batches(batches, ["key", "b1", "b2"]):
            bits = batch["bits"].tolist()
            size, node, side = batch["n"].to_numpy(), batch["cid"].to_numpy(), batch["slice"].to_numpy()
            cell = batch[["key", "b1", "b2"]].to_numpy()
            edges = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1), True])
            a, b = [], []
            for s, e in zip(edges[:-1], edges[1:]):
                if e - s > 1:
                    x, y = tree_forest(size[s:e], aligned(bits[s:e]), rule, side[s:e] if cell[s, 1] != cell[s, 2] else None)
                    a.append(node[s:e][x])
                    b.append(node[s:e][y])
            if a:
                x, y = local_forest(np.concatenate(a), np.concatenate(b))
                yield pd.DataFrame({"a": x, "b": y})

    forest = stored(ready.mapInPandas(traversed, "a long, b long"), "forest")
    near = connected_components(forest).withColumnRenamed("node", "cid")
    near = stored(near.join(signed.select("cid", "node", "more", "n"), "cid"), "near")
    # Only classes that the trees connect are compared, so their sets alone are gathered.
    exact = of_classes(near.select("node"), lambda sets: {"shingles": [s.tobytes() for s in sets]}, "shingles binary")
    exact = stored(exact.join(near.select("node", "more", "cid"), ["node", "more"]).select("cid", "shingles"), "exact")
    links = _links(near.select("cid", "n", "component"), exact, rule)
    answer = classes.join(links.withColumnRenamed("node", "cid"), "cid", "left").select("node", "more", F.coalesce("component", "cid").alias("component_id"))
    answer = stored(answer, "answer")
    release(met, sizes, signed, classes, forest, near, exact, links)
    out = found.join(answer, ["node", "more"], "left")
    single = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "_k1", "_k2", F.col("n").alias("n_shingles"), single.alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, rule: Rule = Rule(80), id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of `docs` less those of a group that is not headed by their id; all columns as they were. Rows with a null id stay."""
    groups = similar_groups(docs, k, rule, id_col, text_col)
    drop = stored(groups.where("component_id <> doc_id").select("_k1", "_k2").distinct(), "copies")
    return boxed(docs, *row_key(id_col, text_col)).join(broadcast_if_small(drop), ["_k1", "_k2"], "left_anti").select("_row.*")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), 3, Rule(90)).select("doc_id", "n_shingles", "component_id")
