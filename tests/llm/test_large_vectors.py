"""Exact top-k with components past 2^28 once scaled."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bitsliced_topk


def test_large_components_take_part(spark):
    x = np.random.default_rng(6).normal(size=(120, 8))
    x[::7] *= 1.2e6
    x[50] = x[56] = x[0]  # ties among large ones
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = [[math.floor(256 * v) for v in r] for _, r in rows]
    want = []
    for i in range(0, 120, 10):
        s = sorted((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in range(120) if j != i)[:5]
        want += [(i, k + 1, j, -v) for k, (v, j) in enumerate(s)]
    got = sorted(map(tuple, bitsliced_topk.top_k(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == want
    with pytest.raises(Exception, match="leaves 64 bits"):
        bitsliced_topk.top_k(df.withColumn("embedding", F.array(F.lit(1e12))), F.col("vec_id") == 0).collect()
