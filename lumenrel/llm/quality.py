"""Document quality by regularised quadratic discriminant analysis.

Method: statistics of each whole text, transformed to be roughly normal; a mean and a covariance a class from all labelled rows
(sums and cross products, aggregated by Spark); covariances shrunk towards the pooled one and its diagonal; the score is the logistic of
the difference of Gaussian log densities plus the log prior odds, by Mahalanobis distances through Cholesky factors that are
computed once and kept in the model.

Defined results: null text counts as empty and is scored like any other; without labels the score is 0.5, with one class only it
is that class (0 or 1); labels other than 0 and 1 are left out; a doc_id with several rows or labels counts each pair; extra
columns are ignored or, in ``keep_good``, kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise

_CLASS = np.zeros(256, np.int64)
for _k, _set in enumerate([b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",;:", b"!?", b"'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~"], 1):
    for _c in _set:
        _CLASS[_c] = _k
_CLASS[128:] = 11
#: Words or characters of usual shares that each document is taken to have besides its own.
PRIOR = 30
NAMES = ["words", "word_length", "upper", "digits", "line_share", "stops", "commas", "shouts", "quotes", "symbols", "beyond_ascii", "distinct_words", "repeated_lines", "short_words"]


def statistics(texts: list[str | None]) -> np.ndarray:
    """Transformed statistics [documents, NAMES] of whole texts."""
    out = np.empty((len(texts), len(NAMES)))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        n = np.bincount(_CLASS, np.bincount(np.frombuffer(raw, np.uint8), minlength=256), 12)
        words = raw.split()
        lines = raw.split(b"\n")
        w, letters = len(words), n[1] + n[2] + n[11]
        kinds = len(set(words))
        short = sum(map((4).__gt__, map(len, words)))
        # few words say little: PRIOR words or characters of usual shares come to each document's own
        odds = lambda a, b, usual: np.log((a + PRIOR * usual) / (b + PRIOR * (1 - usual)))
        out[i] = (
            np.log(w + PRIOR), np.log((len(raw) - n[4] - n[5] + 5 * PRIOR) / (w + PRIOR)), odds(n[1], n[2] + n[11], 0.03), odds(n[3], letters, 0.01), odds(len(lines) - 1, w, 0.03), odds(n[6], w, 0.1),
            odds(n[7], w, 0.05), odds(n[8], w, 0.01), odds(n[9], w, 0.01), odds(n[10], w, 0.01), odds(n[11], n[1] + n[2], 0.03), odds(kinds, w - kinds, 0.8), odds(len(lines) - len(set(lines)), len(lines), 0.03),
            odds(short, w - short, 0.4),
        )
    return out


@dataclass
class Discriminant:
    """means, inverse Cholesky factors and log determinants of the classes 0 and 1; constant when a class is missing."""

    constant: float | None = None
    means: np.ndarray | None = None
    factors: np.ndarray | None = None
    log_det: np.ndarray | None = None
    log_prior: np.ndarray | None = None

    @classmethod
    def fit(cls, n: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float = 0.1, ridge: float = 0.05) -> "Discriminant":
        """n [2], sums [2, p], products [2, p, p]."""
        if not n.sum():
            return cls(constant=0.5)
        if not n.min() > 0:
            return cls(constant=float(n[1] > 0))
        means = sums / n[:, None]
        scatter = products - n[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(axis=0) / n.sum()
        diagonal = np.diag(np.maximum(np.diag(pooled), 1e-6))
        factors, log_det = [], []
        for k in (0, 1):
            own = scatter[k] / max(n[k], 1)
            w = n[k] / (n[k] + 10 * len(pooled))  # a class of few rows leans on both
            cov = (1 - ridge) * ((1 - shrink) * w * own + (1 - (1 - shrink) * w) * pooled) + ridge * diagonal
            low = np.linalg.cholesky(cov)
            factors.append(np.linalg.inv(low))
            log_det.append(2 * np.log(np.diag(low)).sum())
        return cls(None, means, np.array(factors), np.array(log_det), np.log(n / n.sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        log = [-0.5 * ((((x - self.means[k]) @ self.factors[k].T) ** 2).sum(axis=1) + self.log_det[k]) + self.log_prior[k] for k in (0, 1)]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 3 == 1, F.lit(False))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics f0, f1, ... of each row, written to the shared folder."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([np.empty((0, len(NAMES))), *(statistics(b.column(1).slice(i, 1000).to_pylist()) for i in range(0, b.num_rows, 1000))])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(c)) for c in x.T)], names=["doc_id", *(f"f{i}" for i in range(len(NAMES)))])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string"))
    return materialise(rows.mapInArrow(work, "doc_id long, " + ", ".join(f"f{i} double" for i in range(len(NAMES)))), "statistics")


def train(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", **parameters) -> Discriminant:
    """From every labelled row that isn't held out. The driver gets two rows of sums."""
    p = len(NAMES)
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out())
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = [F.sum(f"f{i}").alias(f"s{i}") for i in range(p)] + [F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"q{i}_{j}") for i, j in pairs]
    n, s, q = np.zeros(2), np.zeros((2, p)), np.zeros((2, p, p))
    for row in measured.join(known, "doc_id").groupBy("y").agg(F.count("*").alias("n"), *sums).collect():
        k = row["y"]
        n[k], s[k] = row["n"], [row[f"s{i}"] for i in range(p)]
        for i, j in pairs:
            q[k, i, j] = q[k, j, i] = row[f"q{i}_{j}"]
    return Discriminant.fit(n, s, q, **parameters)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted. Texts are read once; the model scores their statistics."""
    measured = measure(docs)
    model = train(measured, labels)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(i).to_numpy() for i in range(2, b.num_columns)], axis=1)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    columns = [f"f{i}" for i in range(len(NAMES))]
    return measured.select("doc_id", held_out().alias("held_out"), *columns).mapInArrow(work, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs whose score reaches the threshold; columns as they were."""
    model = train(measure(docs), labels)
    at = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                yield part.filter(pa.array(model.score(statistics(part.column(at).to_pylist())) >= threshold))

    return docs.mapInArrow(work, docs.schema)
