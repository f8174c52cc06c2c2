"""Embedding near-duplicates by lattice hashing.

Every table projects a vector to a few groups of eight numbers and decodes each group to its
nearest point of the E8 lattice; the points together are the vector's cell. A vector also
probes the neighbouring cells it lies closest to. Vectors that meet in a cell are compared
by exact cosine.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import stored, table
from signalmill.llm.components import connected_components, local_forest


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(v) / 2 for v in itertools.product((1, -1), repeat=8) if np.prod(v) > 0]
    return np.array(out)


ROOTS = _roots()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    worst = np.abs(x[odd] - r[odd]).argmax(1)
    r[odd, worst] += np.where(x[odd, worst] >= r[odd, worst], 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest lattice point of each row: the closer of the nearest in D8 and in D8 + 1/2."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@dataclass(frozen=True)
class Lattice:
    """tables: hash tables; groups: lattice points per cell; width: lattice spacing in standard
    deviations of a projected unit difference. More groups suit more vectors, more tables raise recall."""

    tables: int = 14
    groups: int = 2
    width: float = 2.0
    seed: int = 11

    def keys(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home keys, probe keys) of unit rows v: n x tables, n x tables x probes."""
        n, dim = v.shape
        t, g = self.tables, self.groups
        rng = np.random.default_rng([self.seed, dim])
        x = (v @ rng.normal(size=(dim, t * g * 8)) / self.width).reshape(-1, 8)
        points = nearest_e8(x)
        next_ = points + ROOTS[((x - points) @ ROOTS.T).argmax(1)]
        mix = rng.integers(1, 2**62, size=(g, 8), dtype=np.int64) * 2 + 1
        salt = rng.integers(1, 2**62, size=t, dtype=np.int64)
        part = lambda p: ((2 * p).astype(np.int64).reshape(n, t, g, 8) * mix).sum(3)
        near, far = part(points), part(next_)
        home = self._mixed(near.sum(2) + salt)
        probes = [self._mixed(near.sum(2) - near[..., i] + far[..., i] + salt) for i in range(g)]
        if g > 1:
            probes.append(self._mixed(far.sum(2) + salt))
        return home, np.stack(probes, 2)

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        u = h.view(np.uint64)
        u = (u ^ (u >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (u ^ (u >> np.uint64(29))).view(np.int64)


def _first_meeting(ki, qi, kj, qj) -> np.ndarray:
    """Number of the first table and way in which pairs of vectors meet (i is the lower of a pair): both at home, i probes j, j probes i."""
    ways = np.stack([ki == kj, (qi == kj[..., None]).any(2), (qj == ki[..., None]).any(2)], 2)
    return ways.reshape(len(ki), -1).argmax(1)


def _compare(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of the cells in `pdf` (sorted by cell): rows (k, links) and forest edges (a, b)."""
    emb = np.array(pdf["unit"].tolist(), np.float64)
    home = np.array(pdf["home"].tolist(), np.int64)
    probe = np.array(pdf["probe"].tolist(), np.int64).reshape(len(pdf), home.shape[1], -1)
    k, cid, cnt = pdf["k"].to_numpy(), pdf["cid"].to_numpy(), pdf["cnt"].to_numpy()
    at_home, block, tab = pdf["at_home"].to_numpy(), pdf["block"].to_numpy(), pdf["t"].to_numpy()
    cell = pdf[["t", "key", "b1", "b2"]].to_numpy()
    edges = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1), True])
    one = (pdf["b1"] == pdf["b2"]).to_numpy()
    found_i, found_j = [], []
    for s, e in zip(edges[:-1], edges[1:]):
        if e - s < 2:
            continue
        i, j = np.nonzero(np.triu(emb[s:e] @ emb[s:e].T >= least, 1))
        i, j = i + s, j + s
        good = (at_home[i] | at_home[j]) & (one[i] | (block[i] != block[j]))
        found_i.append(i[good])
        found_j.append(j[good])
    i = np.concatenate(found_i) if found_i else np.zeros(0, np.int64)
    j = np.concatenate(found_j) if found_j else np.zeros(0, np.int64)
    swap = k[i] > k[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    way = np.where(at_home[i] & at_home[j], 0, np.where(at_home[j], 1, 2))
    own = np.zeros(len(i), bool)
    for s in range(0, len(i), 20000):
        c = slice(s, s + 20000)
        own[c] = _first_meeting(home[i[c]], probe[i[c]], home[j[c]], probe[j[c]]) == tab[i[c]] * 3 + way[c]
    i, j = i[own], j[own]
    keys, where = np.unique(np.concatenate([k[i], k[j]]), return_inverse=True)
    links = np.bincount(where, np.concatenate([cnt[j], cnt[i]]), len(keys)).astype(np.int64)
    a, b = local_forest(cid[i], cid[j]) if len(i) else (np.zeros(0, np.int64),) * 2
    none = lambda n: pd.array([None] * n, dtype="Int64")
    return pd.concat([
        pd.DataFrame({"k": pd.array(keys, "Int64"), "links": pd.array(links, "Int64"), "a": none(len(keys)), "b": none(len(keys))}),
        pd.DataFrame({"k": none(len(a)), "links": none(len(a)), "a": pd.array(a, "Int64"), "b": pd.array(b, "Int64")}),
    ])


def cell_batches(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of sorted rows cut so that the rows of a key stay together."""
    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(batch):
            continue
        last = (batch[key] == batch[key].iloc[-1]).all(axis=1).to_numpy()
        cut = len(batch) - int(last[::-1].argmin()) if not last.all() else 0
        held = batch.iloc[cut:].reset_index(drop=True)
        if cut:
            yield batch.iloc[:cut].reset_index(drop=True)
    if held is not None and len(held):
        yield held


def near_duplicates(df: DataFrame, least: float = 0.9, lattice: Lattice = Lattice(), id_col="vec_id", vec_col="embedding", block: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Equal vectors are one class from the start, so copies are counted, not paired. A cell of
    more than `block` classes is cut into blocks whose pairs are compared in tasks of their
    own. A pair that meets in several cells counts in the first; only counts and forest edges
    leave a task. Rows with a null id, or whose vector is null, empty, zero or holds a null or
    non-finite component, have no links and are their own component (null id: null component,
    not kept). Vectors of different lengths do not link. Rows of one id are one node: they
    share its component. An empty table gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("e").isNotNull() & ~bad & F.exists("e", lambda x: x != 0) & F.col("vec_id").isNotNull()
    rows = stored(rows.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), F.col("e")).alias("e")), "vectors").withColumn("k", F.when(F.col("e").isNotNull(), F.xxhash64("e")))
    classes = rows.where("e is not null").groupBy("k", "e").agg(F.min("vec_id").alias("cid"), F.count("*").alias("cnt"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, same in batch.groupby(batch["e"].map(len)):
                v = np.array(same["e"].tolist(), np.float64)
                v /= np.abs(v).max(1, keepdims=True)  # squares of what is left neither overflow nor vanish
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                home, probe = lattice.keys(v)
                yield pd.DataFrame({"k": same["k"], "cid": same["cid"], "cnt": same["cnt"], "unit": list(v), "home": list(home), "probe": list(probe.reshape(len(v), -1))})

    classes = stored(classes.mapInPandas(hashed, "k long, cid long, cnt long, unit array<double>, home array<long>, probe array<long>"), "classes")
    probes = lattice.groups + (lattice.groups > 1)
    at = classes.select("k", F.size("unit").alias("dim"), F.posexplode(F.concat("home", "probe")).alias("pos", "key"))
    n = lattice.tables
    t = F.when(F.col("pos") < n, F.col("pos")).otherwise(F.floor((F.col("pos") - n) / probes))
    at = stored(at.select("k", "dim", "key", t.cast("int").alias("t"), (F.col("pos") < n).alias("at_home")), "cells")
    full = at.groupBy("t", "key", "dim").agg(F.count("*").alias("n"), F.max("at_home").alias("h")).where("n > 1 and h")
    full = stored(full.select("t", "key", "dim", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "full")
    met = at.join(full, ["t", "key", "dim"]).withColumn("block", F.pmod(F.xxhash64("k", F.lit(3)), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("k", "t", "key", "dim", "at_home", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))
    ready = met.join(classes, "k").repartition("t", "key", "b1", "b2").sortWithinPartitions("t", "key", "b1", "b2", "dim")

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in cell_batches(batches, ["t", "key", "b1", "b2", "dim"]):
            for _, same in batch.groupby("dim"):
                yield _compare(same.reset_index(drop=True), least)

    found = stored(ready.mapInPandas(compared, "k long, links long, a long, b long"), "links")
    links = stored(found.where("k is not null").groupBy("k").agg(F.sum("links").alias("links")), "sums")
    parts = stored(connected_components(found.where("a is not null").select("a", "b")), "parts")
    own = classes.select("k", "cid", "cnt").join(links, "k", "left").join(parts, classes["cid"] == parts["node"], "left")
    own = stored(own.select("k", (F.col("cnt") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cid").alias("component_id")), "own")
    out = rows.select("vec_id", "k").join(own, "k", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept")
    )


def op3_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
