"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Class means and covariances come from all labelled training rows, gathered as sums and outer
products per task. Covariances shrink towards the pooled diagonal; a score is the logistic of
the difference of Mahalanobis log densities, softened by a temperature that fits the training
rows best. The Cholesky factors are inverted once and shipped with the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmill.llm.common import remainder, stored, table

#: Order of the statistics that statistics() gives.
NAMES = ("log_bytes", "log_words", "word_length", "upper", "digit", "symbol", "bang", "bar", "stop", "comma", "line", "high", "types", "line_types", "long_words", "case_words")
SHRINK, FLOOR = 0.1, 1e-3
#: Temperatures to choose from.
TEMPERATURES = (1.0, 2.0, 4.0, 8.0, 16.0)


def _classes() -> np.ndarray:
    """0/1 rows over byte values: upper, digit, symbol, bang, bar, stop, comma, line, high."""
    m = np.zeros((9, 256))
    m[0, 65:91] = m[1, 48:58] = m[8, 128:] = 1
    m[2, [ord(c) for c in "#$%&*@^~<>{}[]_=+\\/"]] = 1
    for row, chars in ((3, "!?"), (4, "|"), (5, "."), (6, ",;:"), (7, "\n")):
        m[row, [ord(c) for c in chars]] = 1
    return m


_CLASSES = _classes()


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of one whole text; a null or empty text gives those of nothing."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words, lines = raw.split(), raw.split(b"\n")
    n, k = max(len(raw), 1), max(len(words), 1)
    shares = _CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    kinds = len(set(words))
    cased = sum(map(bytes.isupper, words))
    rest = (kinds / k**0.9, len(set(lines)) / len(lines), sum(len(w) > 14 for w in words) / k, cased / k)
    return np.concatenate([[np.log1p(len(raw)), np.log1p(len(words)), np.log(n / k)], np.sqrt(shares), np.sqrt(rest)])


@dataclass
class Model:
    """Class means, inverted Cholesky factors of the shrunk covariances, their log determinants, and the log prior odds."""

    means: np.ndarray
    inverses: list
    logdets: list
    odds: float
    center: np.ndarray
    scale: np.ndarray
    temperature: float = 1.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = np.clip((x - self.center) / self.scale, -8, 8)
        density = []
        for mean, inverse, logdet in zip(self.means, self.inverses, self.logdets):
            y = inverse @ (z - mean).T
            density.append(-0.5 * (y * y).sum(0) - 0.5 * logdet)
        return density[1] - density[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x) / self.temperature + self.odds, -40, 40)))


def with_statistics(docs: DataFrame, text_col="text") -> DataFrame:
    """docs with `x`, the statistics of each row's text; only the text goes through Python."""

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return docs.withColumn("x", measured(text_col))


def fit(rows: DataFrame, shrink: float = SHRINK) -> Model:
    """From rows (label, x). One row of sums per task and class reaches the driver.

    Labels other than 0 and 1 are ignored. A class without rows takes the mean and
    covariance of all rows, so scores fall back to the prior.
    """
    p = len(NAMES)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + p + p * p))
        for batch in batches:
            x, y = np.array(batch["x"].tolist()).reshape(-1, p), batch["label"].to_numpy()
            for k in (0, 1):
                z = x[y == k]
                total[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        yield pd.DataFrame({"k": [0, 1], "s": [t.tolist() for t in total]})

    sums = rows.where("label in (0, 1)").select("label", "x").mapInPandas(each, "k int, s array<double>")
    at = sums.select("k", F.posexplode("s")).groupBy("k", "pos").agg(F.sum("col").alias("v")).collect()
    total = np.zeros((2, 1 + p + p * p))
    for k, pos, v in at:
        total[k, pos] = v
    n, every = total[:, 0], total.sum(0)
    center = every[1 : 1 + p] / max(every[0], 1)
    spread = every[1 + p :].reshape(p, p) / max(every[0], 1) - np.outer(center, center)
    scale = np.sqrt(np.maximum(np.diag(spread), 1e-8))
    pooled = spread / np.outer(scale, scale)
    means, inverses, logdets = [], [], []
    for k in (0, 1):
        if n[k] < 2:
            mean, cov = np.zeros(p), pooled
        else:
            m = total[k, 1 : 1 + p] / n[k]
            mean = (m - center) / scale
            cov = (total[k, 1 + p :].reshape(p, p) / n[k] - np.outer(m, m)) / np.outer(scale, scale)
        cov = (1 - shrink) * cov + shrink * np.diag(np.diag(pooled)) + FLOOR * np.eye(p)
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        inverses.append(np.linalg.inv(factor))
        logdets.append(2 * np.log(np.diag(factor)).sum())
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    model = Model(np.array(means), inverses, logdets, odds, center, scale)

    def losses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(TEMPERATURES))
        for batch in batches:
            margin, sign = model.margins(np.array(batch["x"].tolist()).reshape(-1, p)), 2 * batch["label"].to_numpy() - 1
            total += [np.logaddexp(0, -sign * (margin / t + odds)).sum() for t in TEMPERATURES]
        yield pd.DataFrame({"k": range(len(TEMPERATURES)), "s": total})

    loss = rows.where("label in (0, 1)").select("label", "x").mapInPandas(losses, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    model.temperature = TEMPERATURES[min((round(s, 6), k) for k, s in loss)[1]] if loss else TEMPERATURES[0]
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """Add `score` to rows with statistics `x`."""

    @F.arrow_udf("double")
    def scores(x: pa.Array) -> pa.Array:
        return pa.array(model.scores(np.asarray(x.flatten()).reshape(-1, len(NAMES))))

    return stats.withColumn("score", scores("x"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = 0.3, label_col="quality") -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Labels of rows whose crc32(doc_id) mod `folds` is `held` are never read. Texts are read
    once; the statistics are stored. Null texts count as empty, equal texts score the same,
    repeated rows and null ids are kept, and an empty table gives no rows.
    """
    stats = stored(with_statistics(docs.select("doc_id", "text")).select("doc_id", "x"), "statistics")
    known = labels.where(remainder("doc_id", folds) != held).select("doc_id", F.col(label_col).alias("label"))
    model = fit(stats.join(known, "doc_id"))
    return score(stats, model).select(
        "doc_id", (remainder("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
