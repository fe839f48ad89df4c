import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cooframe.llm import topk


def brute(rows, k, every):
    fine = {i: [math.floor(64 * float(np.float32(x))) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q, a in fine.items():
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in fine.items() if j != q and len(a) == len(b))
            out |= {(q, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("blocks", [(8192, 16384), (50, 4)])
def test_exact_with_ties(spark, blocks):
    rng = np.random.default_rng(2)
    rows = [(i, rng.choice([-0.5, 0.0, 0.25, 0.5], 6).tolist()) for i in range(400)]
    rows += [(400, None), (401, [None] * 6), (402, [math.nan] * 6), (403, [math.inf] * 6), (420, []), (None, [0.5] * 6), (440, [1.0, 2.0]), (441, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 7, data_block=blocks[0], query_block=blocks[1]).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute(rows, 7, 20)


def test_few_candidates_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).collect() == []
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 20 == 0).collect() == []
    got = topk.top_k(spark.createDataFrame([(0, [1.0]), (0, [1.0]), (3, [2.0])], schema), F.col("vec_id") % 20 == 0).collect()
    assert all(r.vec_id == 3 for r in got)


def test_values_beyond_floats_are_exact(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**20, 3.0]), (2, [2.0**20, 4.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2**62 + 64 * 256), (1, 2**62 + 64 * 192)]


@pytest.mark.parametrize("block", [8192, 40])
def test_great_values_and_those_beyond_64_bits(spark, block):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.standard_normal(4) * rng.choice([1.0, 5000.0, 2.0**24])).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 7, data_block=block, query_block=3).collect()
    want = set()
    exact = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    for q in range(0, 200, 20):
        scored = sorted((-sum(x * y for x, y in zip(exact[q], b)), j) for j, b in exact.items() if j != q)
        want |= {(q, r, j, -s) for r, (s, j) in enumerate(scored[:7], 1)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [1e200, 0.0]), (3, [-1e300, 5.0]), (4, [1.0, 1.0]), (5, [1e308, 1.0])], "vec_id long, embedding array<double>")
    got = topk.top_k(huge, F.col("vec_id") == 0, 20, data_block=block if block > 100 else 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, 2**63 - 1), (4, 2**63 - 1), (3, -(2**63))]


def test_cells_out_of_reach_are_not_searched(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(k, (rng.standard_normal(5) * 0.01 + np.eye(5)[k % 5] * 3).tolist()) for k in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sent, plain = [], topk._pass
    monkeypatch.setattr(topk, "_pass", lambda data, sizes, routed, *a: sent.append(routed.count()) or plain(data, sizes, routed, *a))
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, 7, data_block=100).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == brute(rows, 7, 20)
    assert sent[0] == 50 and sent[1] < 50 * 9 / 2


def test_tree_covers_its_rows():
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.standard_normal((600, 3)), rng.standard_normal((600, 3)) + 30, np.zeros((300, 3))])
    root, order = topk.cover_tree(points, 20)
    assert sorted(order) == list(range(1500))
    stack = [root]
    while stack:
        n = stack.pop()
        assert np.linalg.norm(points[order[n.lo : n.hi]] - n.centre, axis=1).max() <= n.radius + 1e-9
        if n.children:
            assert [c.lo for c in n.children][1:] == [c.hi for c in n.children][:-1] and (n.children[0].lo, n.children[-1].hi) == (n.lo, n.hi)
        stack += n.children
