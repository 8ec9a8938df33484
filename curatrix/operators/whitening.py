"""Embedding whitening: partial Gram matrices on the workers, one eigendecomposition on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curatrix.functions.vectors import dot


@dataclass
class Whitening:
    """x becomes (x - mean) @ w, of length 1 again; as small as the dimensions squared, whatever the corpus."""

    mean: np.ndarray
    w: np.ndarray

    @property
    def dim(self) -> int:
        return self.w.shape[1]

    def apply(self, df: DataFrame, vec: str = "vec") -> DataFrame:
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                have = s.notna().to_numpy()
                y = (np.array([np.asarray(v, float) for v in s[have]]).reshape(-1, len(self.mean)) - self.mean) @ self.w
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-8)
                rows = iter(y)
                yield pd.Series([next(rows) if h else None for h in have], dtype=object)

        return df.withColumn(vec, F.pandas_udf(run, "array<double>")(F.col(vec).cast("array<double>")))


def moments(df: DataFrame, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, population covariance); each task sends one matrix."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, gram = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = np.array([np.asarray(v, float) for v in pdf.v])
                if total is None:
                    total, gram = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
                n, total, gram = n + len(x), total + x.sum(0), gram + x.T @ x
        if n:
            yield pd.DataFrame({"g": [0], "n": [n], "total": [total.tobytes()], "gram": [gram.tobytes()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        add = lambda c: np.sum([np.frombuffer(b) for b in c], 0).tobytes()
        return pd.DataFrame({"g": [0], "n": [int(pdf.n.sum())], "total": [add(pdf.total)], "gram": [add(pdf.gram)]})

    schema = "g int, n bigint, total binary, gram binary"
    parts = df.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v")).mapInPandas(run, schema)
    # Two steps of merging keep the last task's input small on many partitions.
    parts = parts.groupBy(F.pmod(F.xxhash64("total"), F.lit(32)).alias("h")).applyInPandas(merge, schema).groupBy("g").applyInPandas(merge, schema)
    row = parts.first()
    if row is None:
        raise ValueError("no vectors to fit on")
    mean = np.frombuffer(row.total) / row.n
    return row.n, mean, np.frombuffer(row.gram).reshape(len(mean), -1) / row.n - np.outer(mean, mean)


def fit(df: DataFrame, vec: str = "vec", dim: int | None = None, epsilon: float | None = None, remove: int | None = None) -> Whitening:
    """remove: drop that many leading components; else epsilon: soft ZCA; else PCA to dim components."""
    _, mean, cov = moments(df, vec)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    if remove is not None:
        lead = vectors[:, :remove]
        w = np.eye(len(mean)) - lead @ lead.T
    elif epsilon is not None:
        w = (vectors / np.sqrt(values + epsilon)) @ vectors.T
    else:
        k = dim or len(mean)
        w = vectors[:, :k] / np.sqrt(values[:k] + 1e-8)
    return Whitening(mean, w)


def subspace(df: DataFrame, low: int, high: int, vec: str = "vec") -> Whitening:
    """Projection on the principal components low (from 0) to high, the last not included; unscaled."""
    _, mean, cov = moments(df, vec)
    return Whitening(mean, np.linalg.eigh(cov)[1][:, ::-1][:, low:high])


def extremes(df: DataFrame, component: int, n: int = 5, vec: str = "vec") -> DataFrame:
    """(id, projection, side): the n rows that lie furthest out on either side of a component; its sign makes the largest loading positive."""
    _, mean, cov = moments(df, vec)
    axis = np.linalg.eigh(cov)[1][:, ::-1][:, component]
    axis = axis * np.sign(axis[np.abs(axis).argmax()])
    to = F.array(*[F.lit(float(a)) for a in axis])
    shift = float(mean @ axis)
    rows = df.where(F.col(vec).isNotNull()).select("id", (dot(F.col(vec), to) - shift).alias("projection"))
    high = rows.orderBy(F.desc("projection"), "id").limit(n).withColumn("side", F.lit("high"))
    return high.unionByName(rows.orderBy("projection", "id").limit(n).withColumn("side", F.lit("low")))


def spectrum(df: DataFrame, vec: str = "vec") -> DataFrame:
    """(component, variance, share, cumulative, effective_rank): the explained variances, largest first."""
    _, _, cov = moments(df, vec)
    values = np.maximum(np.linalg.eigvalsh(cov)[::-1], 0)
    total = values.sum() or 1.0
    rank = float(values.sum() / values[0]) if values[0] else 0.0
    rows = [(i + 1, float(v), float(v / total), float(c), rank) for i, (v, c) in enumerate(zip(values, np.cumsum(values) / total, strict=True))]
    return df.sparkSession.createDataFrame(rows, "component int, variance double, share double, cumulative double, effective_rank double")
