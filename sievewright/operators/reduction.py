"""Randomised singular value decomposition of a column of vectors, in a few passes that each move only small matrices.

A range finder multiplies the rows' Gram matrix with a random block: every task adds up A'(A Q) over its rows, the driver orthonormalises the sum (columns by
``k`` and ``extra``) against the blocks before it. All blocks together are kept (a block Krylov space), which finds close singular values in few passes and is everything once it is as wide as the vectors.
A last pass factorises A Q: every task keeps only the triangle of a QR decomposition of its rows, triangles are stacked and factorised again on their way to the driver, and the last one's singular values and vectors are the result. No squares are taken of what is
returned, so small singular values keep their digits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups in which tasks' matrices meet before the driver.
GROUPS = 32


@dataclass
class Svd:
    """Singular values, right vectors (columns by components), and what was subtracted from rows and divided by."""

    values: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def reduced(self, vector: Column) -> Column:
        """A row's coordinates, array<double>."""
        mean, scale, vectors = self.mean, self.scale, self.vectors

        @F.pandas_udf("array<double>")
        def kernel(v):
            import pandas as pd

            return pd.Series(list((np.stack(v.to_numpy()) - mean) / scale @ vectors)) if len(v) else pd.Series([], dtype=object)

        return kernel(vector)


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    v = batch.column("v")
    return np.asarray(v.flatten().to_numpy(zero_copy_only=False), float).reshape(len(v), width)


def _gathered(df: DataFrame, each: Callable[[np.ndarray, np.ndarray | None], np.ndarray], join: Callable[[list[np.ndarray]], np.ndarray], width: int, shape: tuple[int, int]) -> np.ndarray:
    """``each`` (rows, what the task has so far) over all rows; tasks' results are joined in groups, then on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                held = each(_rows(batch, width), held)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.astype(float).tobytes()], pa.binary())], ["m"])

    def met(t: pa.Table) -> pa.Table:
        return pa.table({"g": t.column("g")[:1], "m": pa.array([join([np.frombuffer(x).reshape(-1, shape[1]) for x in t.column("m").to_pylist()]).tobytes()], pa.binary())})

    tasks = df.mapInArrow(run, "m binary").select((F.spark_partition_id() % GROUPS).alias("g"), "m")
    found = tasks.groupBy("g").applyInArrow(met, "g int, m binary").collect()
    return join([np.frombuffer(r["m"]).reshape(-1, shape[1]) for r in found]) if found else np.zeros(shape)


def _triangle(parts: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(parts), mode="r")


def svd(df: DataFrame, vector: str, k: int, extra: int = 10, passes: int = 4, standardise: bool = False, seed: int = 0) -> Svd:
    """The ``k`` largest singular values of the rows of ``vector`` (all of one length; null ones are left out), less their mean and by their deviation if asked for."""
    rows = df.select(F.col(vector).cast("array<double>").alias("v")).filter("v IS NOT NULL")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    mean, scale = np.zeros(width), np.ones(width)
    if standardise and width:
        sums = _gathered(rows, lambda x, held: np.stack([x.sum(0), (x * 0 + 1).sum(0)]) + (0 if held is None else held), sum, width, (2, width))
        mean = sums[0] / sums[1]
        square = _gathered(rows, lambda x, held: ((x - mean) ** 2).sum(0)[None] + (0 if held is None else held), sum, width, (1, width))
        deviation = np.sqrt(square[0] / sums[1])
        scale = np.where(deviation > 0, deviation, 1.0)
    block = min(width, k + extra)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, block)))[0] if width else np.zeros((0, 0))
    last = q
    for _ in range(passes):
        if q.shape[1] == width:
            break
        basis = last
        new = _gathered(rows, lambda x, held: (z := (x - mean) / scale).T @ (z @ basis) + (0 if held is None else held), sum, width, (width, basis.shape[1]))  # noqa: B023
        # Twice, as once leaves rounding errors along the blocks before.
        for _ in range(2):
            new = np.linalg.qr(new - q @ (q.T @ new))[0]
        last = new[:, : width - q.shape[1]]
        q = np.linalg.qr(np.concatenate([q, last], 1))[0]
    block = q.shape[1]
    r = _gathered(rows, lambda x, held: _triangle([(x - mean) / scale @ q] + ([] if held is None else [held])), _triangle, width, (block, block))
    _, values, right = np.linalg.svd(r, full_matrices=False) if r.size else (None, np.zeros(0), np.zeros((0, block)))
    vectors = q @ right.T
    # The largest entry of a vector is positive.
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]) if vectors.size else 1
    return Svd(values[:k], (vectors * signs)[:, :k], mean, scale)
