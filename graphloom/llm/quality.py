"""Quality score by regularised quadratic discriminant analysis.

Each text becomes a few statistics (lengths, character classes, repetition,
shape of lines), transformed to near-symmetric scales. For each of the two
classes a mean and a covariance are fitted; the covariance is shrunk towards
the pooled one and towards its diagonal. A document's margin is the difference
of its Mahalanobis log-densities, taken with Cholesky factors that are made
once; a logistic map of the margin, fitted on the same rows, gives the score.

The fit uses at most ``FIT_ROWS`` labelled rows, those of the smallest hash of
doc_id, so that what reaches the driver has a bound; statistics are of whole
texts and every document is scored.

Defined results: a null text counts as empty and gets the score of the empty
text; rows that repeat each get their row; labels of null doc_id or quality are
left out, and a doc_id with both labels counts as both; of documents that share an
id, one is learnt from, that of the smallest hash of the text; without labelled rows
of both classes every score is the share of class 1 among them (0.5 if none);
an empty table gives an empty table; ``score`` ignores other columns, ``keep``
returns them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import lean

FIT_ROWS = 20_000

_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:'\"-()?", b"!", b"#$%&*+/<=>@[\\]^_`{|}~", b" \t", b"\n"]
_CLASS_OF = np.zeros((256, 9), np.float32)
for _k, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars), _k] = 1
_CLASS_OF[128:, 8] = 1
N_STATISTICS = 24


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    out = np.zeros(N_STATISTICS)
    if n == 0:
        return out
    share = (np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float32) @ _CLASS_OF) / n
    w = data.split()
    nw = max(1, len(w))
    lines = [x for x in data.split(b"\n") if x.strip()] or [b""]
    nl = len(lines)
    lengths = np.fromiter(map(len, w), np.float64, len(w)) if w else np.zeros(1)
    distinct = len(set(w))
    pairs = len(set(zip(w, w[1:]))) if len(w) > 1 else 1
    line_lengths = np.fromiter(map(len, lines), np.float64, nl)
    ends = sum(x[-1:] in b".!?" for x in lines)
    odd_ends = sum(not (x[-1:].isalnum() or x[-1:] in b".,;:'\")" or x[-1] >= 128) for x in w)
    upper = sum(x.isupper() and len(x) > 1 for x in w)
    alone = sum(len(x) == 1 and not x.isalnum() for x in w)
    packed = len(zlib.compress(data, 1)) / n
    lo = 1e-3
    out[:9] = np.log(share + lo) - np.log(lo)
    out[9:] = [
        np.log1p(len(w)),
        np.log1p(lengths.mean()),
        np.log1p(lengths.std()),
        np.log1p(nl),
        np.log1p(line_lengths.mean()),
        np.log1p(line_lengths.std()),
        np.log(distinct / nw) * np.log1p(nw) / 5,
        np.log(pairs / max(1, nw - 1)),
        np.log(len(set(lines)) / nl),
        ends / nl,
        np.log(odd_ends / nw + lo) - np.log(lo),
        np.log(upper / nw + lo) - np.log(lo),
        np.log(alone / nw + lo) - np.log(lo),
        np.log(min(packed, 2.0)),
        np.log1p(lengths.max()),
    ]
    return out


@dataclass
class Discriminant:
    """Class means and Cholesky factors, with the logistic map of the margin."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]  # inverse Cholesky factors of the class covariances
    log_dets: list[float]
    slope: float
    offset: float
    share: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-density of class 1 less that of class 0."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        dens = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - 0.5 * d for m, f, d in zip(self.means, self.factors, self.log_dets)]
        return dens[1] - dens[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, to_pooled: float = 0.1, to_diagonal: float = 0.1) -> Discriminant:
    """Fit on rows of statistics and 0/1 labels."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or min((y == 0).sum(), (y == 1).sum()) < 2:
        return Discriminant(np.zeros(1), np.ones(1), [], [], [], 1.0, 0.0, share)
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.clip((x - centre) / scale, -8, 8)
    groups = [z[y == c] for c in (0, 1)]
    means = [g.mean(0) for g in groups]
    covs = [np.cov(g.T) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, covs)) / len(z)
    factors, log_dets = [], []
    for g, c in zip(groups, covs):
        c = (1 - to_pooled) * c + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(c)) + 1e-2 * np.eye(len(c))
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        log_dets.append(2 * float(np.log(np.diag(low)).sum()))
    model = Discriminant(centre, scale, means, factors, log_dets, 1.0, 0.0, share)
    m = np.clip(model.margin(x), -60, 60)
    a, b = 0.1, 0.0
    for _ in range(50):  # Newton steps of the logistic map
        p = 1 / (1 + np.exp(-(a * m + b)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - y) * m).sum() + 1e-3 * a, (p - y).sum()])
        h = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.offset = float(max(a, 1e-4)), float(b)
    return model


def learn(docs: DataFrame, labels: DataFrame, training: Column, rows: int = FIT_ROWS) -> Discriminant:
    """Fit on labelled documents of ``training`` rows, at most ``rows`` of them."""
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    marked = marked.where(training).distinct().orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id", "label").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = [statistics(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "x": x})

    # Documents that repeat would add rows: of each id and label, that of the smallest hash of the text.
    texts = texts.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    got = texts.mapInPandas(lean(measure), "doc_id bigint, label int, x array<double>").toPandas().sort_values(["doc_id", "label"])
    x = np.array(got["x"].tolist(), float).reshape(-1, N_STATISTICS)
    return fit(x, got["label"].to_numpy(float))


def score(docs: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id and score of every document."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array([statistics(t) for t in b["text"]]).reshape(-1, N_STATISTICS)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": model.score(x)})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(lean(apply), "doc_id bigint, score double")


def keep(docs: DataFrame, model: Discriminant, least: float = 0.7) -> DataFrame:
    """The documents with a score of ``least`` or more, all columns kept; no row is moved."""
    at = docs.columns.index("text")

    def apply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(at)]).reshape(-1, N_STATISTICS)
            yield b.filter(pa.array(model.score(x) >= least, pa.bool_()))

    return docs.mapInArrow(lean(apply), docs.schema)
