"""Quality classifier: regularised quadratic discriminant on document statistics.

Each text becomes a vector of transformed statistics (logs of lengths, square roots
of shares, repetition measures). Each class has a mean and a covariance shrunk
towards its diagonal; a score is the difference of the two classes' log densities,
from Mahalanobis distances by cached Cholesky factors, mapped to 0..1 by a logistic
curve fitted on the same labelled rows.

Defined results: a null text counts as an empty one; an empty text has a score like
any other; a row with a null id is scored and never used for fitting; repeated rows
are scored one by one, equal texts alike; a score of exactly the bound is accepted. Texts
of any length are measured whole. Labels without a document and null labels are left
out. With no labelled rows of one class, the score is the share of label 1 (0.5 if there
are no labels); an empty table gives an empty one. Only the id and the text are read, so
other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import held_out, pieces_of, with_labels

#: At most so many labelled rows are used for fitting.
MOST_LABELLED = 12_000

_CLASS = np.zeros(256, np.int64)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(97, 123)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[[ord(c) for c in ".,;:'\"-?()"]] = 6
_CLASS[[*range(128, 256)]] = 7
N_STATS = 21


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one whole text."""
    data = (text or "").encode("utf-8", "replace")
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    by = np.bincount(_CLASS, weights=counts, minlength=8)
    share = by / max(n, 1)
    words = data.split()
    n_words = len(words)
    often = Counter(words)
    lines = [x.strip() for x in data.split(b"\n")]
    kinds = len(set(lines))
    lengths = np.fromiter(map(len, words), np.int64, n_words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    p = counts[counts > 0] / max(n, 1)
    top = max(often.values(), default=0)
    single = sum(1 for v in often.values() if v == 1)
    return np.array([
        np.log1p(n_words), np.log1p(n), np.log1p(lengths.mean() if n_words else 0), np.log1p(lengths.std() if n_words else 0),
        np.sqrt(share[0]), np.sqrt(share[1]), np.sqrt(share[2]), np.sqrt(share[3]), np.sqrt(share[4]), np.sqrt(share[5]), np.sqrt(share[6]), np.sqrt(share[7]),
        np.log((len(often) + 1) / (n_words + 1)), np.log((single + 1) / (n_words + 1)), np.log((pairs + 1) / (n_words + 1)), np.sqrt(top / max(n_words, 1)),
        np.log(kinds / len(lines)), np.log1p(n / len(lines)), np.sqrt((lengths <= 3).mean() if n_words else 0),
        -(p * np.log2(p)).sum() if n else 0.0, np.log((len(zlib.compress(data, 1)) + 1) / (n + 20)),
    ])


class Discriminant:
    """A fitted pair of class densities with a logistic calibration."""

    def __init__(self, x: np.ndarray, y: np.ndarray, shrink: float = 0.1):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.classes = []
        if not len(y) or not 0 < self.prior < 1:
            return
        self.mid, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mid) / self.scale
        for k in (0, 1):
            own = z[y == k]
            centre = own.mean(0)
            cov = (own - centre).T @ (own - centre) / max(1, len(own) - 1)
            a = max(shrink, min(1.0, x.shape[1] / len(own)))
            cov = (1 - a) * cov + a * np.diag(np.diag(cov)) + 0.05 * np.eye(len(centre))
            factor = np.linalg.cholesky(cov)
            self.classes.append((centre, np.linalg.inv(factor), -np.log(np.diag(factor)).sum()))
        self.curve = self._logistic(self._squash(self.difference(x)), y)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        z = (x - self.mid) / self.scale
        out = []
        for centre, inverse, log_det in self.classes:
            d = (z - centre) @ inverse.T
            out.append(log_det - 0.5 * (d * d).sum(1))
        return out[1] - out[0]

    @staticmethod
    def _squash(d: np.ndarray) -> np.ndarray:
        return np.sign(d) * np.log1p(np.abs(d))

    @staticmethod
    def _logistic(v: np.ndarray, y: np.ndarray) -> np.ndarray:
        a = np.column_stack([np.ones(len(v)), v])
        w = np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
            w = w + np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
        return w

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * self._squash(self.difference(x)), -30, 30)))


def _stats_of(batch) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in batch.column("text")]).reshape(-1, N_STATS)


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Discriminant:
    """Fit on at most ``most`` labelled rows outside the held-out part. Statistics are
    computed by the executors; the driver gets ``most`` x 21 numbers at most."""

    def rows(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(_stats_of(batch)), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = with_labels(docs, labels, "quality", most).mapInArrow(rows, "doc_id long, y int, x array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x = np.array(got["x"].tolist()).reshape(-1, N_STATS)
    return Discriminant(x, got["y"].to_numpy(float))


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of every row."""

    def rows(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(_stats_of(batch)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rows, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Discriminant, least: float = 0.7) -> DataFrame:
    """The rows of docs, all columns unchanged, whose score is at least ``least``."""

    def rows(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                yield batch.filter(pa.array(model.scores(_stats_of(batch)) >= least))

    return docs.mapInArrow(rows, docs.schema)


def judged(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
