"""Quality by a sparse ensemble of rules over text statistics.

Shallow trees are grown on a bounded sample of labelled rows (training fold only), each on the residuals
of those before it. Every path from a root is a conjunction of comparisons. A logistic model with a lasso
penalty on the indicator of each path keeps few of them. The rules that remain are compiled into Spark
column expressions over the statistics, so scoring is a projection.

Defined cases: null and wordless texts have all statistics zero and a score like any other; labels that
are null or neither 0 nor 1 are ignored; of repeated label rows the larger label holds; without training
labels the score is 0.5, with labels of one class only it is that class's smoothed share; of documents that
repeat an id one is learned from, that with the least statistics, and all are scored; equal splits go to the first
statistic and cut. Long texts count whole; further columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textstats as S
from .common import Cut, kind_of, map_arrow
from .toxicity import sampled_labels

#: About so many labelled rows are learned from, at most.
MAX_TRAIN = 12_000
TREES, DEPTH, LEAST_LEAF, CUTS = 24, 3, 8, 32
LASSO = 0.002

#: A path: comparisons (feature, is_less, threshold), all of which must hold.
Path = tuple[tuple[int, bool, float], ...]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, one double for each of textstats.FEATURES)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def make(batch: pa.RecordBatch) -> list:
        x = np.array([S.features(t.as_py()) for t in batch.column(1)])
        return [batch.column(0), *(pa.array(c) for c in x.T)]

    return map_arrow(rows, f"doc_id {kind_of(docs, id_col)}, " + ", ".join(f"{n} double" for n in S.FEATURES), make)


def _split(x: np.ndarray, r: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], usable: np.ndarray) -> tuple[int, float] | None:
    """The comparison with the largest drop of squared residuals; ties go to the first feature and cut."""
    best, found = 1e-9, None
    total, n = r[rows].sum(), len(rows)
    for f in np.flatnonzero(usable):
        at = np.searchsorted(cuts[f], x[rows, f], side="right")
        count = np.cumsum(np.bincount(at, minlength=len(cuts[f]) + 1))[:-1]
        sums = np.cumsum(np.bincount(at, weights=r[rows], minlength=len(cuts[f]) + 1))[:-1]
        ok = (count >= LEAST_LEAF) & (n - count >= LEAST_LEAF)
        if not ok.any():
            continue
        gain = np.where(ok, sums**2 / np.maximum(1, count) + (total - sums) ** 2 / np.maximum(1, n - count), -1) - total**2 / n
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = gain[k], (int(f), float(cuts[f][k]))
    return found


def grow_paths(x: np.ndarray, y: np.ndarray, seed: int = 11) -> list[Path]:
    """All paths of TREES boosted trees, in order and without repeats."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    z = np.zeros(len(y))
    paths: dict[Path, None] = {}
    for _ in range(TREES):
        r = y - 1 / (1 + np.exp(-z))
        usable = rng.random(x.shape[1]) < 0.7
        stack: list[tuple[Path, np.ndarray]] = [((), np.arange(len(y)))]
        while stack:
            path, rows = stack.pop()
            cut = _split(x, r, rows, cuts, usable) if len(path) < DEPTH and len(rows) >= 2 * LEAST_LEAF else None
            if path:
                paths[tuple(sorted(path))] = None
            if cut is None:
                p = 1 / (1 + np.exp(-z[rows]))
                z[rows] += 0.3 * np.clip(r[rows].sum() / max(1e-3, (p * (1 - p)).sum()), -4, 4)
                continue
            f, c = cut
            less = x[rows, f] < c
            stack.append(((*path, (f, True, c)), rows[less]))
            stack.append(((*path, (f, False, c)), rows[~less]))
    return list(paths)


def holds(x: np.ndarray, path: Path) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, less, c in path:
        out &= (x[:, f] < c) == less
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float = LASSO, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic model, by accelerated proximal gradient steps."""
    n = len(y)
    a1 = np.hstack([np.ones((n, 1)), a])
    v = np.ones(a1.shape[1])
    for _ in range(30):
        v = a1.T @ (a1 @ v)
        norm = np.linalg.norm(v)
        v /= max(norm, 1e-12)
    step = 1 / (0.25 * norm / n * 1.05 + 1e-9)
    w = np.zeros(a1.shape[1])
    ahead, t = w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a1 @ ahead, -30, 30)))
        moved = ahead - step * (a1.T @ (p - y)) / n
        after = np.sign(moved) * np.maximum(0, np.abs(moved) - step * penalty)
        after[0] = moved[0]
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = after + (t - 1) / t1 * (after - w)
        done = np.abs(after - w).max() < 1e-7
        w, t = after, t1
        if done:
            break
    return float(w[0]), w[1:]


class Model:
    """intercept and (path, weight) of the rules that the lasso kept."""

    def __init__(self, intercept: float, rules: list[tuple[Path, float]]):
        self.intercept, self.rules = intercept, rules

    def describe(self) -> list[str]:
        return [f"{w:+.3f} if " + " and ".join(f"{S.FEATURES[f]} {'<' if less else '>='} {c:.4g}" for f, less, c in path) for path, w in self.rules]

    def score(self) -> Column:
        """The rules as one expression over the columns of statistics()."""
        total = F.lit(float(self.intercept))
        for path, w in self.rules:
            test = F.lit(True)
            for f, less, c in path:
                column = F.col(S.FEATURES[f])
                test = test & ((column < c) if less else (column >= c))
            total = total + F.when(test, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model(0.0, [])
    share = (y.sum() + 0.5) / (len(y) + 1)
    if y.min() == y.max():
        return Model(float(np.log(share / (1 - share))), [])
    paths = grow_paths(x, y)
    if not paths:
        return Model(float(np.log(share / (1 - share))), [])
    b, w = lasso(np.column_stack([holds(x, p) for p in paths]).astype(float), y)
    return Model(b, [(p, float(v)) for p, v in zip(paths, w) if v])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> Model:
    known, _ = sampled_labels(labels, "quality", max_train, 3, 1)
    # The sample's bound is what makes this broadcast safe, and what bounds the rows of statistics gathered here.
    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("__gs_id"), "left_semi")
    stats = Cut(statistics(chosen))
    # One row an id, so the bound holds where documents repeat one.
    single = stats.df.groupBy("doc_id").agg(F.min(F.struct(*S.FEATURES)).alias("x")).select("doc_id", "x.*")
    rows = single.join(F.broadcast(known), F.col("doc_id") == F.col("__gs_id")).select("__gs_y", *S.FEATURES)
    got = np.array(sorted(tuple(r) for r in rows.collect()), float).reshape(-1, 1 + len(S.FEATURES))
    stats.drop()
    return fit(got[:, 1:], got[:, 0])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) for every row."""
    return statistics(docs, id_col, text_col).select("doc_id", model.score().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
