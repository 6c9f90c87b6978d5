"""Singular values by passes over a table, against numpy on the whole matrix."""

import numpy as np
import pytest

from sievewright.operators import reduction


@pytest.mark.parametrize(("standardise", "width"), [(False, 40), (True, 40), (True, 12)])
def test_equals_numpy(spark, standardise, width):
    g = np.random.default_rng(1)
    x = g.normal(size=(700, width)) @ np.diag(np.exp(-np.arange(width) / 4)) + 3
    x[:, 3] = 1.5
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(-1, None)], "id long, v array<double>").repartition(5)
    got = reduction.svd(df, "v", 6, standardise=standardise)
    z = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1) if standardise else x
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.abs(got.values / s[:6] - 1).max() < 1e-6
    row = df.filter("id = 5").select(got.reduced(df["v"]).alias("r")).first()["r"]
    assert np.allclose(np.abs(row), np.abs(z[5] @ vt[:6].T), rtol=1e-3, atol=1e-3)


def test_no_rows(spark):
    assert len(reduction.svd(spark.createDataFrame([], "v array<double>"), "v", 3).values) == 0
