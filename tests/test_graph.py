import numpy as np
import pytest
from pyspark.sql import functions as F

from cooframe import Matrix
from cooframe.operators import partition


def labels(a, n):
    out = [None] * n
    for r in a.connected_components().collect():
        out[r["i"]] = r["label"]
    return out


def union_find(edges, n):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    roots = [find(i) for i in range(n)]
    rank = {x: k for k, x in enumerate(sorted(set(roots)))}
    return [rank[x] for x in roots]


@pytest.mark.parametrize("n, edges", [(4, [(0, 1), (1, 2), (2, 3)]), (5, [(0, 1)]), (6, []), (5, [(0, 0), (3, 3)]), (30, [(i, i + 1) for i in range(29)])])
def test_components(spark, n, edges):
    a = Matrix.from_arrays(spark, [1.0] * len(edges), [x for x, _ in edges], [y for _, y in edges], (n, n))
    assert labels(a, n) == union_find(edges, n)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_components(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(20, 60))
    edges = rng.integers(0, n, (n // 2, 2)).tolist()
    a = Matrix.from_arrays(spark, [1.0] * len(edges), [x for x, _ in edges], [y for _, y in edges], (n, n))
    assert labels(a, n) == union_find(edges, n)
    parts = a.to_connected_components()
    assert parts.sizes.agg(F.sum("m")).first()[0] == n
    assert a.n_components() == len(set(union_find(edges, n))) and a.has_isolated_components()


def test_only_square_patterns_have_components(spark):
    with pytest.raises(ValueError):
        Matrix.from_arrays(spark, [1.0], [0], [0], (2, 3)).connected_components()


def test_rcb_matches_recursion(spark):
    rng = np.random.default_rng(3)
    pts = rng.random((41, 2))

    def rcb(idx, parts, first, out):
        if parts == 1:
            out.update(dict.fromkeys(idx, first))
            return
        p = pts[idx]
        axis = int(np.argmax(p.max(0) - p.min(0)))
        median = np.sort(p[:, axis])[(len(idx) - 1) // 2]
        left = [i for i in idx if pts[i, axis] <= median]
        rcb(left, parts // 2, first, out)
        rcb([i for i in idx if pts[i, axis] > median], parts - parts // 2, first + parts // 2, out)

    want = {}
    rcb(list(range(41)), 3, 0, want)
    coords = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "node long, x double, y double")
    got = {r["node"]: r["part_id"] for r in partition.partition_rcb(coords, 3).collect()}
    assert got == want


def test_hilbert_in_three_dimensions_visits_neighbours(spark):
    cells = spark.range(512).select(F.floor(F.col("id") / 64).alias("x"), F.floor(F.col("id") / 8 % 8).alias("y"), (F.col("id") % 8).alias("z"))
    got = cells.select("x", "y", "z", partition.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3).alias("h")).collect()
    by = {r["h"]: np.array([r["x"], r["y"], r["z"]]) for r in got}
    assert sorted(by) == list(range(512))
    assert all(np.abs(by[h] - by[h + 1]).sum() == 1 for h in range(511))


def test_extract_and_methods(spark):
    rng = np.random.default_rng(0)
    d = (rng.random((9, 9)) < 0.3) * 1.0
    a = Matrix.from_dense(spark, d)
    parts = a.resolve_partition(3)
    local = a.local_numbers(parts)
    own = a.extract(local, 1)
    assert own.m == 3 and own.df.count() == int(d[3:6].sum())
    with pytest.warns(UserWarning):
        a.resolve_partition(3, "metis")
    with pytest.raises(ValueError):
        a.resolve_partition(3, "nothing")
    with pytest.raises(ValueError):
        a.resolve_partition(3, "rcb")


def test_tie_queries_by_brute_force(spark):
    """The two queries that have no SQL, over whole tables, against a union-find."""
    import datetime

    from cooframe import queries

    sf = "/root/testdata/sf0.001"
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_shipdate").collect()
    m = spark.read.parquet(f"{sf}/orders.parquet").agg({"o_orderkey": "max"}).first()[0] + 1
    days = [(r.l_shipdate.date() - datetime.date(1992, 1, 1)).days for r in li]
    n = m + max(days) + 1
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for r, day in zip(li, days):
        a, b = find(r.l_orderkey), find(m + day)
        root[max(a, b)] = min(a, b)
    least = [find(i) for i in range(n)]
    number = {x: k for k, x in enumerate(sorted(set(least)))}
    assert {r.i: r.label for r in queries.connected_components(spark, sf).collect()} == {i: number[x] for i, x in enumerate(least)}
    sizes = [least.count(x) for x in number]
    assert {r.nodes: r.components for r in queries.component_sizes(spark, sf).collect()} == {k: sizes.count(k) for k in set(sizes)}
