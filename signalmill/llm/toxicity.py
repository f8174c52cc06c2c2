"""Toxicity: a bidirectional GRU with attention pooling over windows of words.

A word enters as a hashed word vector plus the mean of the hashed vectors of all its
character 3- and 4-grams, ends marked. Windows of WINDOW words overlap by half; both
directions of the network read a window, attention pools the states, and a document's
score is the logistic of what all its windows say together. The network is trained in numpy
on whole texts of a bounded sample of labelled rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import remainder, small_batches, table

WINDOW, STRIDE = 16, 8
#: Hash buckets of words and of character n-grams, vector and state sizes.
WORD_BUCKETS, GRAM_BUCKETS, SIZE, STATE = 1 << 15, 1 << 15, 8, 8
#: Bounds of the training sample: rows of label 0 and of label 1, whole texts of each.
SAMPLE = (4500, 1500)
#: Characters from which an unbroken run is cut into pieces that overlap by half and are words.
PIECE = 24
#: Windows that are traced back at a time; the gradients of a step are added up over all its windows.
TRACED = 4096
_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def words_of(text: str) -> list[str]:
    """Lower-case words; long runs as overlapping pieces."""
    out = []
    for w in _WORD.findall(text.lower()):
        if len(w) <= PIECE:
            out.append(w)
        else:
            out += [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)]
    return out


class Vocabulary:
    """Buckets of distinct words: one of the whole word each, and the buckets of all n-grams, word after word."""

    def __init__(self, words: list[str], chunk: int = 10_000):
        parts = [self._part(words[s : s + chunk]) for s in range(0, len(words), chunk)] or [self._part([])]
        self.word, self.gram = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        self.first = np.concatenate([[0], np.cumsum(np.concatenate([p[2] for p in parts]))])

    @staticmethod
    def _part(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word buckets, n-gram buckets, n-grams of each word), in small integers."""
        codes = np.frombuffer("".join(f"\x01{w}\x02" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        sizes = np.array([len(w) + 2 for w in words], np.int64)
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(words)), sizes)
        at = (np.arange(len(codes)) - begin[owner]).astype(np.uint64)
        # The sum of hashes of every character with its place names the whole word.
        whole = np.add.reduceat(_mixed(_mixed(codes + np.uint64(1)) * _MIX + at), begin) if words else np.zeros(0, np.uint64)
        ids, owners = [], []
        for n in (3, 4):
            h = np.full(max(len(codes) - n + 1, 0), n, np.uint64)
            for i in range(n):
                h = _mixed(h * _MIX + codes[i : len(codes) - n + 1 + i] + np.uint64(1))
            inside = owner[: len(h)] == owner[n - 1 :][: len(h)]
            ids.append((h[inside] % np.uint64(GRAM_BUCKETS)).astype(np.uint16))
            owners.append(owner[: len(h)][inside])
        owners = np.concatenate(owners)
        grams = np.concatenate(ids)[np.argsort(owners, kind="stable")]
        return (_mixed(whole) % np.uint64(WORD_BUCKETS)).astype(np.uint16), grams, np.bincount(owners, minlength=len(words))

    def grams(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-gram buckets of the words `some`, word after word, and how many each has (one or more)."""
        count = self.first[some + 1] - self.first[some]
        at = np.arange(count.sum()) + np.repeat(self.first[some] - (np.cumsum(count) - count), count)
        return self.gram[at], count


def windows(n: int) -> np.ndarray:
    """Starts of the windows over n words: every STRIDE words, all words covered, one window at least."""
    return np.arange(0, max(n - WINDOW, 0) + STRIDE, STRIDE)[: max(1, -(-max(n - WINDOW, 0) // STRIDE) + 1)]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """Parameters and the forward and backward passes."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = np.float32
        d, h = SIZE, STATE
        self.p = {
            "word": (rng.normal(size=(WORD_BUCKETS, d)) * 0.01).astype(f),
            "gram": (rng.normal(size=(GRAM_BUCKETS, d)) * 0.01).astype(f),
            "att": (rng.normal(size=2 * h) * 0.3).astype(f),
            "out": (rng.normal(size=2 * h) * 0.5).astype(f),
            "bias": np.array([-4.0], f),
        }
        for way in ("f", "b"):
            self.p["w" + way] = (rng.normal(size=(d, 3 * h)) / np.sqrt(d)).astype(f)
            self.p["u" + way] = (rng.normal(size=(h, 3 * h)) / np.sqrt(h)).astype(f)
            self.p["c" + way] = np.zeros(3 * h, f)

    def vectors(self, vocabulary: Vocabulary, some: np.ndarray) -> np.ndarray:
        """Vectors of the words `some` (one at least)."""
        ids, count = vocabulary.grams(some)
        total = np.add.reduceat(self.p["gram"][ids], np.cumsum(count) - count, axis=0)
        return self.p["word"][vocabulary.word[some]] + total / count[:, None].astype(np.float32)

    def _way(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool):
        """States of one direction. x: time, batch, 3h projections; mask: time, batch, 1."""
        u, h = self.p["u" + way], STATE
        steps = range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape[:2], h), np.float32)
        tape = {}
        for t in steps:
            su = state @ u
            zr = _sigmoid(x[t, :, : 2 * h] + su[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            c = np.tanh(x[t, :, 2 * h :] + r * su[:, 2 * h :])
            new = state + mask[t] * (z * (c - state))
            if keep:
                tape[t] = (state, z, r, c, su[:, 2 * h :])
            state = out[t] = new
        return out, tape, list(steps)

    def forward(self, ids: np.ndarray, table: np.ndarray, keep: bool = False):
        """Logit of each window. ids: batch, time places in `table`, -1 where there is no word."""
        at = ids.T
        mask = (at >= 0)[..., None].astype(np.float32)
        safe = np.maximum(at, 0)
        ways = {}
        for way in ("f", "b"):
            proj = table @ self.p["w" + way] + self.p["c" + way]
            ways[way] = self._way(proj[safe], mask, way, keep)
        states = np.concatenate([ways["f"][0], ways["b"][0]], 2)
        a = np.tanh(states) @ self.p["att"] + np.where(mask[..., 0] > 0, 0, -1e9)
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        pooled = (a[..., None] * states).sum(0)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return logit, (mask, safe, ways, states, a, pooled)

    def backward(self, tape, table: np.ndarray, dlogit: np.ndarray):
        """Gradients of the parameters but the vectors, and of `table`."""
        mask, safe, ways, states, a, pooled = tape
        g = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * self.p["out"]
        da = (states * dpool).sum(2)
        da = a * (da - (a * da).sum(0))
        th = np.tanh(states)
        g["att"] = np.einsum("tb,tbh->h", da, th)
        ds = a[..., None] * dpool + da[..., None] * self.p["att"] * (1 - th * th)
        dtable = np.zeros_like(table)
        h = STATE
        for way, part in (("f", ds[..., :h]), ("b", ds[..., h:])):
            _, steps_tape, steps = ways[way]
            u = self.p["u" + way]
            gu = np.zeros_like(u)
            dx = np.zeros((*part.shape[:2], 3 * h), np.float32)
            carry = np.zeros_like(part[0])
            for t in reversed(steps):
                state, z, r, c, sc = steps_tape[t]
                d = part[t] + carry
                dm = d * mask[t]
                dz = dm * (c - state) * z * (1 - z)
                dc = dm * z * (1 - c * c)
                dr = dc * sc * r * (1 - r)
                dx[t] = np.concatenate([dz, dr, dc], 1)
                dsu = np.concatenate([dz, dr, dc * r], 1)
                gu += state.T @ dsu
                carry = d - dm * z + dsu @ u.T
            g["u" + way] = gu
            g["c" + way] = dx.sum((0, 1))
            flat, places = dx.reshape(-1, 3 * h), safe.ravel()
            dproj = np.zeros((len(table), 3 * h), np.float32)
            for j in range(3 * h):
                dproj[:, j] = np.bincount(places, flat[:, j], len(table))
            g["w" + way] = table.T @ dproj
            dtable += dproj @ self.p["w" + way].T
        return g, dtable


def prepared(texts: list[str]) -> tuple[list[np.ndarray], Vocabulary]:
    """Places of each text's words among the distinct words, and those words."""
    place: dict[str, int] = {}
    docs = [np.fromiter((place.setdefault(w, len(place)) for w in words_of(t)), np.int32) for t in texts]
    return docs, Vocabulary(list(place))


def cut(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(window ids, document of each window) of all windows; documents without words have one empty window."""
    ids, owner = [], []
    for k, d in enumerate(docs):
        starts = windows(len(d))
        padded = np.full(starts[-1] + WINDOW, -1, np.int64)
        padded[: len(d)] = d
        ids.append(padded[starts[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(starts), k))
    return np.concatenate(ids), np.concatenate(owner)


def doc_logits(window_logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Log odds that any window is toxic, windows taken as independent (noisy or), kept in logs."""
    none = np.bincount(owner, -np.logaddexp(0, window_logits), n)
    return np.log(-np.expm1(np.minimum(none, -1e-12))) - none


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of their values."""
    order = np.argsort(rows, kind="stable")
    rows, first = np.unique(rows[order], return_index=True)
    return rows, np.add.reduceat(values[order], first, axis=0)


def train(texts: list[str], labels: np.ndarray, epochs: int = 4, batch: int = 32, rate: float = 0.02, seed: int = 5) -> Net:
    """Adam on the cross entropy of the documents' noisy-or scores over all their windows. Without rows of both labels the untrained net."""
    net = Net(seed)
    if len(set(labels.tolist())) < 2:
        return net
    docs, vocabulary = prepared(texts)
    rng = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for s in range(0, len(order), batch):
            some = order[s : s + batch]
            ids, owner = cut([docs[i] for i in some])
            used, back = np.unique(ids, return_inverse=True)
            back = back.reshape(ids.shape) - (used[0] < 0)
            used = used[used >= 0]
            if not len(used):
                continue
            tab = net.vectors(vocabulary, used)
            slices = [slice(at, at + TRACED) for at in range(0, len(owner), TRACED)]
            logit = np.concatenate([net.forward(back[x], tab)[0] for x in slices])
            total = doc_logits(logit.astype(np.float64), owner, len(some))
            err = _sigmoid(total) - labels[some]
            # d total / d window logit = sigmoid(window) / P(any)
            dlogit = err[owner] * _sigmoid(logit) / np.maximum(_sigmoid(total), 1e-9)[owner]
            g, dtab = {}, np.zeros_like(tab)
            for x in slices:
                _, tape = net.forward(back[x], tab, keep=True)
                part, more = net.backward(tape, tab, (dlogit[x] / len(some)).astype(np.float32))
                g = {k: g[k] + v if g else v for k, v in part.items()}
                dtab += more
            grams, count = vocabulary.grams(used)
            sparse = {"word": _summed(vocabulary.word[used], dtab), "gram": _summed(grams, np.repeat(dtab / count[:, None], count, 0))}
            step += 1
            for k, (rows, grad) in ({k: (slice(None), x) for k, x in g.items()} | sparse).items():
                m[k][rows] = 0.9 * m[k][rows] + 0.1 * grad
                v2[k][rows] = 0.99 * v2[k][rows] + 0.01 * grad * grad
                net.p[k][rows] -= rate * (m[k][rows] / (1 - 0.9**step)) / (np.sqrt(v2[k][rows] / (1 - 0.99**step)) + 1e-6)
    return net


def score_texts(net: Net, texts: list[str]) -> np.ndarray:
    """Score of each whole text."""
    if not texts:
        return np.zeros(0)
    docs, vocabulary = prepared(texts)
    ids, owner = cut(docs)
    n = len(vocabulary.word)
    tab = net.vectors(vocabulary, np.arange(n)) if n else np.zeros((1, SIZE), np.float32)
    logit = np.concatenate([net.forward(ids[s : s + 8192], tab)[0] for s in range(0, len(ids), 8192)])
    return _sigmoid(doc_logits(logit.astype(np.float64), owner, len(docs)))


def sample(docs: DataFrame, labels: DataFrame, folds: int, held: int, rows: tuple[int, int], label_col: str) -> tuple[list[str], np.ndarray]:
    """Up to `rows` labelled rows of label 0 and of label 1 outside the held-out fold, chosen by hash, with their whole texts.

    The labels are cut down before they meet the texts, so few texts move. An id that is
    repeated on either side gives a row for each pair; null ids and labels give none.
    """
    known = labels.where((remainder("doc_id", folds) != held) & F.col(label_col).isin(0, 1)).select("doc_id", F.col(label_col).alias("label"))
    pick = F.xxhash64("doc_id", F.lit(17))
    few = [known.where(F.col("label") == k).orderBy(pick).limit(rows[k]) for k in (0, 1)]
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(few[0].union(few[1]), "doc_id")
    got = found.orderBy(pick, "text").select("text", "label").collect()
    return [r["text"] for r in got], np.array([r["label"] for r in got], np.float64)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, label_col="toxic") -> Net:
    """The network trained on the sample; without labelled rows, or on an empty table, the untrained one."""
    return train(*sample(docs, labels, folds, held, SAMPLE, label_col))


def score(docs: DataFrame, net: Net, name: str = "score", text_col: str = "text") -> DataFrame:
    """docs with the column `name` (one of that name is replaced), a score from 0 to 1 of every row's whole text.

    Null texts count as empty; equal texts, repeated rows among them, score the same but for
    the rounding of single precision, which depends on the texts worked on together; an empty
    table gives no rows. Only the text goes through Python.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        # About 300,000 characters at a time.
        out, held, size = [], [], 0
        for t in texts:
            held.append(t.as_py())
            size += len(held[-1])
            if size > 300_000:
                out.append(score_texts(shared.value, held))
                held, size = [], 0
        return pa.array(np.concatenate([*out, score_texts(shared.value, held)] if held or not out else out))

    return docs.withColumn(name, scores(F.coalesce(F.col(text_col), F.lit(""))))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
