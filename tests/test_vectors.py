from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from codeweave.operators import vectors


def brute(x, ids, asks, k, tables=12, bits=5, seed=4):
    """The k nearest of those that agree in four bits of some table, by plain loops."""
    planes = np.random.RandomState(seed).randn(tables, bits, x.shape[1])
    dot = lambda a, b: reduce(lambda s, c: s + c[0] * c[1], zip(a.tolist(), b.tolist()), 0.0)
    side = [[[dot(v, planes[t, i]) >= 0 for i in range(bits)] for t in range(tables)] for v in x]
    out = []
    for q in asks:
        met = [(-dot(x[q], x[j]), ids[j]) for j in range(len(ids)) if j != q and any(sum(a != b for a, b in zip(*c)) <= 1 for c in zip(side[q], side[j]))]
        out += [(ids[q], i, -s) for s, i in sorted(met)[:k]]
    return sorted(out)


def test_neighbours_equal_plain_loops_in_blocks_of_any_size(spark):
    rng = np.random.RandomState(1)
    x = np.repeat(rng.randn(60, 8), 2, axis=0).astype(np.float32).astype(float)  # every vector twice: ties go to the smallest id
    ids = [f"v{i}" for i in range(120)]
    v = spark.createDataFrame(list(zip(ids, x.tolist())), "id string, embedding array<double>")
    want = brute(x, ids, [i for i in range(120) if i % 9 == 0], 3)
    asks = v.where(F.substring("id", 2, 9).cast("int") % 9 == 0)
    odd = spark.createDataFrame([("n", None), ("s", [1.0]), ("nan", [float("nan")] * 8), ("h", [1.0, None] * 4)], v.schema)
    for block in (4, 2048):
        got = vectors.hashed_neighbours(v.unionAll(odd), asks, 3, block=block)
        assert sorted(tuple(r) for r in got.select("query", "id", "score").collect()) == want
    assert vectors.hashed_neighbours(odd.where("id = 'n'"), asks, 3).count() == 0


def test_neighbours_make_no_row_a_pair(spark):
    n = 1500
    v = spark.range(n).withColumn("embedding", F.array(*(F.randn(s) for s in range(8))))
    v = spark.createDataFrame(v.collect(), v.schema)
    plan = vectors.hashed_neighbours(v, v.where("id % 2 = 0"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
