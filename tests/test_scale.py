"""Work and memory that grow no faster than the input: each test failed before the step was mended."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cooframe import Matrix, sizes
from cooframe.kernels import components
from cooframe.kernels import products as kernel
from cooframe.operators import blocks, graph, partition
from cooframe.sources import mtx, store


def shuffled_rows(spark, run) -> int:
    """Rows that the exchanges of ``run`` write."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = written()
    run()
    return written() - before


def sparse(spark, rng, m, n, share, path):
    """A matrix read from a table, and its dense array."""
    d = np.where(rng.random((m, n)) < share, rng.integers(-4, 5, (m, n)) + 0.5, 0.0)
    r, c = np.nonzero(d)
    spark.createDataFrame([(int(i), int(j), float(d[i, j])) for i, j in zip(r, c)], "row long, col long, val double").write.parquet(path)
    return Matrix(spark.read.parquet(path), m, n, coalesced=True), d


def test_hilbert_index_costs_a_step_a_bit(spark):
    """A row took about a millisecond at 8 bits and far more at 16, when each bit of the place worked out the whole turn again."""
    points = spark.range(200_000).select((F.col("id") * 7919 % 65536).alias("x"), (F.col("id") * 104729 % 65536).alias("y"))
    began = time.perf_counter()
    assert points.select(partition.hilbert_index([F.col("x"), F.col("y")]).alias("h")).agg(F.max("h")).first()[0] < 1 << 32
    assert time.perf_counter() - began < 40


def test_hilbert_curve_of_one_bit(spark):
    """Four cells, each next to the one before; a single bit failed."""
    cells = spark.range(4).select(F.floor(F.col("id") / 2).alias("x"), (F.col("id") % 2).alias("y"))
    by = {r.h: (r.x, r.y) for r in cells.select("x", "y", partition.hilbert_index([F.col("x"), F.col("y")], 1).alias("h")).collect()}
    assert sorted(by) == [0, 1, 2, 3] and all(abs(by[h][0] - by[h + 1][0]) + abs(by[h][1] - by[h + 1][1]) == 1 for h in range(3))


@pytest.fixture
def by_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "LARGE", 1)
    monkeypatch.setattr(blocks, "TERMS", 400)
    monkeypatch.setattr(blocks, "RANGES", 6)


def test_products_by_blocks(spark, tmp_path, by_blocks):
    rng = np.random.default_rng(5)
    a, d = sparse(spark, rng, 40, 30, 0.3, str(tmp_path / "a"))
    b, e = sparse(spark, rng, 30, 25, 0.2, str(tmp_path / "b"))
    assert blocks.fit(a, b)
    assert np.array_equal((a @ b).to_numpy(), d @ e) and np.array_equal(a.gram().to_numpy(), d @ d.T)
    places = spark.createDataFrame([(i, j) for i in range(40) for j in range(25) if (i + j) % 3], "row long, col long")
    for by in ("right", "left"):
        got = {(r.row, r.col): r.v for r in a.matmul_at(b, places, by=by).collect()}
        assert got == {(i, j): (d @ e)[i, j] for i in range(40) for j in range(25) if (i + j) % 3}
    g, f = sparse(spark, rng, 40, 25, 0.5, str(tmp_path / "g"))
    left, right = a.matmul_vjp(b, g)
    assert {(r.row, r.col): r.v for r in left.collect()} == {(i, j): (f @ e.T)[i, j] for i, j in zip(*map(np.ndarray.tolist, np.nonzero(d)))}
    assert {(r.row, r.col): r.v for r in right.collect()} == {(i, j): (d.T @ f)[i, j] for i, j in zip(*map(np.ndarray.tolist, np.nonzero(e)))}
    assert a.matmul_vjp(b, g, needs=(False, True))[0] is None


def test_products_by_blocks_keep_unknown_values_and_places(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(0, 0, 2.0), (0, 1, None), (1, 1, None), (None, 0, 3.0), (2, None, 9.0)], "row long, col long, val double").write.parquet(str(tmp_path / "a"))
    a = Matrix(spark.read.parquet(str(tmp_path / "a")), 3, 2, coalesced=True)
    rows = lambda: sorted(map(tuple, a.gram().df.collect()), key=str)
    want = rows()
    monkeypatch.setattr(blocks, "LARGE", 1)
    assert rows() == want and (1, 1, None) in want


def test_block_kernels_with_few_terms_at_once(monkeypatch):
    monkeypatch.setattr(kernel, "TERMS", 5)
    rng = np.random.default_rng(2)
    d, e = (np.where(rng.random(s) < 0.4, rng.standard_normal(s), 0.0) for s in ((9, 7), (7, 8)))
    parts = lambda m: (*np.nonzero(m), m[np.nonzero(m)], np.ones(np.count_nonzero(m), bool))
    out = np.zeros((9, 8))
    for r, c, v, known in kernel.multiply(parts(d), parts(e)):
        assert known.all()
        out[r, c] = v
    assert np.allclose(out, d @ e)
    e[:, 3] = np.inf
    r, c, v = (np.concatenate(x) for x in zip(*kernel.multiply_at(*np.nonzero(np.ones((9, 8))), parts(d), parts(e))))
    out[r, c] = v
    assert np.allclose(np.delete(out, 3, 1), np.delete(d @ e, 3, 1)) and not np.isnan(out[(d >= 0).all(1)]).any()


def test_terms_of_large_products_stay_in_their_task(spark, tmp_path, by_blocks):
    """One column that 400 rows share has 160,000 terms; all went through an exchange."""
    spark.range(400).select(F.col("id").alias("row"), F.lit(0).cast("long").alias("col"), F.lit(1.0).alias("val")).repartition(7).write.parquet(str(tmp_path / "a"))
    a = Matrix(spark.read.parquet(str(tmp_path / "a")), 400, 1, coalesced=True)
    b = Matrix(a.df.select("row", (F.col("row") % 2).alias("col"), "val"), 400, 2, coalesced=True)
    blocks.TERMS = 40_000
    c = a @ a.T
    assert shuffled_rows(spark, lambda: c.df.write.format("noop").mode("overwrite").save()) < 20_000
    assert c.df.count() == 160_000
    left, _ = b.matmul_vjp(b.T, b.gram().map(lambda v: F.lit(1.0)), needs=(True, False))
    assert left.agg(F.sum("v")).first()[0] == 2 * 200 * 200


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_of_one_matrix_meet_without_a_join(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, -2.0), (1, 1, 3.0), (1, 1, 4.0)], "row long, col long, val double")
    a = Matrix(df, 2, 2).coalesce()
    for got, want in (
        (a.sign() + a.abs(), {(0, 0): 2.0, (0, 1): 1.0, (1, 1): 8.0}),
        ((a > 0.0).logical_and(a < 5.0).cast("int") + (a * 2.0).cast("int"), {(0, 0): 3, (0, 1): -4, (1, 1): 14}),
        (a + a * 1j, {(0, 0): (1.0, 1.0), (0, 1): (-2.0, -2.0), (1, 1): (7.0, 7.0)}),
    ):
        assert "Join" not in planned(got.df)
        assert {(r.row, r.col): tuple(r.val) if isinstance(r.val, tuple) else r.val for r in got.df.collect()} == want
    out = a
    for _ in range(24):
        out = out.relu() + out  # a value that two steps take is worked out once
    assert len(planned(out.df)) < 50_000 and out.df.where("row = 0 and col = 0").first().val == 2.0**24
    raw = Matrix(df, 2, 2)
    assert sorted(tuple(r) for r in (raw.abs() + raw).df.collect()) == [(0, 0, 2.0), (0, 1, 0.0), (1, 1, 14.0)]


def test_large_tables_are_spread_before_they_are_grouped(spark, tmp_path, monkeypatch):
    """Adding up before the exchange filled tasks that read large files; parts now follow the bytes."""
    spark.range(30_000).select(F.col("id").alias("r"), (F.col("id") % 7).alias("c"), F.lit(1.0).alias("v")).coalesce(1).write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(sizes, "SMALL", 1000)
    monkeypatch.setattr(sizes, "SHARE", sizes.read_bytes(t) // 9)
    a = Matrix.of(t, "r", "c", "v", 30_000, 7)
    assert a.df.rdd.getNumPartitions() == 10 and a.df.count() == 30_000
    assert Matrix(a.df, 30_000, 7).coalesce().df.agg(F.sum("val")).first()[0] == 30_000


def busiest(spark, run) -> float:
    """Rows that a task of the stages of ``run`` takes from exchanges, at most, evenly shared in its stage."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty(30_000)
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleReadRecords() / max(1, s.numTasks()) for s in map(found.apply, range(found.size()))}

    before = stages()
    run()
    return max(n for k, n in stages().items() if k not in before)


@pytest.fixture
def tall(spark, tmp_path, monkeypatch):
    """30,000 entries read from a table that counts as large, of ten shares."""
    places = spark.range(30_000).select((F.col("id") * 7919 % 30_000).alias("row"), (F.col("id") % 7).alias("col"), (F.col("id") / 8).alias("val"))
    places.write.parquet(str(tmp_path / "tall"))
    df = spark.read.parquet(str(tmp_path / "tall"))
    monkeypatch.setattr(sizes, "SMALL", 1000)
    monkeypatch.setattr(sizes, "SHARE", sizes.read_bytes(df) // 10)
    return Matrix(df, 30_000, 7, coalesced=True)


def test_matrix_market_is_sorted_by_ranges(spark, tmp_path, tall):
    """One task sorted and wrote all lines; there is still one file, in order."""
    path = tmp_path / "out"
    assert busiest(spark, lambda: mtx.write(tall, str(path), "two\nlines")) < 10_000
    (file,) = [f for f in path.iterdir() if not f.name.startswith((".", "_"))]
    lines = file.read_text().splitlines()
    assert lines[:4] == ["%%MatrixMarket matrix coordinate real general", "% two", "% lines", "30000 7 30000"]
    places = [tuple(map(int, x.split()[:2])) for x in lines[4:]]
    assert len(places) == 30_000 and places == sorted(places)
    back = mtx.read(spark, str(path)).df
    assert back.exceptAll(tall.df).isEmpty() and back.count() == 30_000
    with pytest.raises(FileExistsError):
        mtx.write(tall, str(path))


def test_parts_of_a_large_matrix_are_written_by_several_tasks(spark, tmp_path, tall):
    """Two parts were two tasks, however large the matrix."""
    store.write(tall, str(tmp_path / "out"), parts=tall.resolve_partition(2))
    files = [f for f in (tmp_path / "out" / "entries").rglob("*.parquet")]
    rows = [spark.read.parquet(str(f)).count() for f in files]
    assert len(files) >= 10 and max(rows) < 6_000 and sum(rows) == 30_000
    one = store.read(spark, str(tmp_path / "out"), part=1)
    assert one.shape == (30_000, 7) and one.df.exceptAll(tall.df.where("row >= 15000")).isEmpty() and one.df.count() == 15_000


def test_one_vector_a_side_needs_no_grouping_of_places(spark):
    """Each place has one term; values that a vector repeats add up as before."""
    a = Matrix.from_dense(spark, np.array([[1.0, 2.0], [0.0, 3.0]]))
    x = spark.createDataFrame([(0, 5.0), (1, 7.0), (1, 1.0)], "i long, v double")
    g = spark.createDataFrame([(0, 2.0), (1, 3.0)], "i long, v double")
    got = a.matvec_vjp(x, g)[0]
    assert got._jdf.queryExecution().optimizedPlan().nodeName() != "Aggregate"
    assert {(r.row, r.col): r.v for r in got.collect()} == {(0, 0): 10.0, (0, 1): 16.0, (1, 1): 24.0}


def least_reached(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("held", [1 << 21, 64, 8])
def test_components_by_tasks_then_roots(spark, monkeypatch, held):
    """Settled in one task, by contraction again, or by rounds, as few edges as a task may hold."""
    monkeypatch.setattr(components, "EDGES", held)
    rng = np.random.default_rng(held)
    edges = np.concatenate([rng.integers(0, 300, (180, 2)), [[300 + i, 301 + i] for i in rng.permutation(99)], [[400, 400 + i] for i in range(90)]]).tolist()
    df = spark.createDataFrame([(a, b) for a, b in edges], "row long, col long").repartition(5)
    nodes = spark.range(500).select(F.col("id").alias("i"))
    got = {r.node: r.root for r in graph.component_roots(df, nodes).collect()}
    assert got == dict(enumerate(least_reached(500, edges)))


@pytest.mark.parametrize("held", [2, 10, 1000])
def test_kernel_joins_a_stream_of_edges(monkeypatch, held):
    monkeypatch.setattr(components, "EDGES", held)
    rng = np.random.default_rng(held)
    edges = rng.integers(0, 80, (60, 2))
    tied = [pair for a, b in components.joined((e[:, 0], e[:, 1]) for e in np.array_split(edges, 12)) for pair in zip(a.tolist(), b.tolist())]
    assert {a for a, _ in tied} == set(edges.ravel().tolist()) and all(b <= a for a, b in tied)
    assert least_reached(80, tied) == least_reached(80, edges.tolist())
    node, root = components.stars(edges[:, 0], edges[:, 1])
    assert dict(zip(node.tolist(), root.tolist())) == {i: least_reached(80, edges.tolist())[i] for i in set(edges.ravel().tolist())}


def test_a_component_is_joined_where_its_ties_are_read(spark, tmp_path):
    """Every round sent each tie across the network, and all nodes of a component to one task."""
    spark.range(30_000).select(F.col("id").alias("row"), (F.col("id") % 40 + 30_000).alias("col"), F.lit(1.0).alias("val")).repartition(3).write.parquet(str(tmp_path / "t"))
    a = Matrix(spark.read.parquet(str(tmp_path / "t")), 30_040, 30_040)
    got = []
    assert shuffled_rows(spark, lambda: got.extend(a.connected_components().collect())) < 120_000
    assert {r.i: r.label for r in got} == {i: (i if i < 30_000 else i - 30_000) % 40 for i in range(30_040)}


def test_nodes_of_a_component_are_numbered_in_stretches(spark, monkeypatch):
    """One window held a whole component."""
    monkeypatch.setattr(graph, "STRETCH", 4)
    a = Matrix.from_arrays(spark, [1.0] * 20, list(range(0, 40, 2)), [(i + 4) % 40 for i in range(0, 40, 2)], (40, 40))
    split = a.to_connected_components()
    assert {r.matrix_id: r.m for r in split.sizes.collect()} == {k: 10 if k in (0, 2) else 1 for k in range(22)}
    want = sorted((i // 4, ((i + 4) % 40) // 4) for i in range(0, 40, 4))
    first = sorted((r.row, r.col) for r in split.df.where("matrix_id = 0").collect())
    assert first == want
