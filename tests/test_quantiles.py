"""Exact quantiles of all groups at once against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from posetrail.operators import numbers as N


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 0.75, 0.9, 1.0])
@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_grouped_quantiles(spark, share, accuracy):
    """A group of a third of the rows, heavy ties, two values, one value, far outliers and nulls."""
    rng = np.random.default_rng(1)
    groups = {0: rng.lognormal(0, 3, 3000), 1: rng.integers(0, 4, 2500).astype(float), 2: np.array([1.0, 2.0]), 3: np.array([7.5]), 4: np.append(rng.normal(size=900), [1e300, -1e300]), 5: np.repeat(3.0, 700)}
    groups |= {k: rng.normal(size=int(rng.integers(1, 60))) for k in range(6, 40)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [(0, None), (99, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    got = {r.k: r.quantile for r in N.grouped_quantile(df, ["k"], F.col("v"), share, accuracy).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert np.isclose(got[k], np.percentile(vs, 100 * share), rtol=1e-12, atol=1e-12), k
