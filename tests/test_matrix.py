import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cooframe import Matrix
from cooframe.functions import ieee
from cooframe.operators import products
from cooframe.operators.krylov import to_driver, to_frame
from cooframe.operators.reshape import unflatten_blocks


def random(spark, m, n, seed=0, repeats=True):
    rng = np.random.default_rng(seed)
    k = m * n // 2
    row, col, val = rng.integers(0, m, k), rng.integers(0, n, k), rng.standard_normal(k)
    a = Matrix.from_arrays(spark, val, row, col, (m, n))
    dense = np.zeros((m, n))
    np.add.at(dense, (row, col), val)
    return a, dense


def column(df, n, name="v"):
    out = np.zeros(n)
    for r in df.collect():
        out[r["i"]] = r[name]
    return out


def test_products_with_repeated_entries(spark):
    a, d = random(spark, 7, 5)
    x = np.arange(5.0)
    assert np.allclose(column(a @ to_frame(spark, x), 7), d @ x)
    assert np.allclose(column(a.rmatvec(to_frame(spark, np.ones(7))), 5), d.T @ np.ones(7))
    assert np.allclose((a @ a.T).to_numpy(), d @ d.T)
    b, e = random(spark, 2, 3, 5)
    assert np.allclose(products.kron(a, b).to_numpy(), np.kron(d, e))


def test_matvec_is_dense_and_empty_matrices_work(spark):
    a = Matrix.from_arrays(spark, [], [], [], (3, 4))
    assert column(a.matvec(to_frame(spark, np.ones(4))), 3).tolist() == [0, 0, 0]
    assert a.matvec(to_frame(spark, np.ones(4))).count() == 3
    assert a.matrix_type().first()["kind"] == "general"
    assert a.sum(0).count() == 4


def test_patterns_must_match(spark):
    a = Matrix.from_arrays(spark, [1.0], [0], [0], (2, 2))
    b = Matrix.from_arrays(spark, [1.0], [0], [1], (2, 2))
    with pytest.raises(Exception, match="patterns differ"):
        (a + b).df.collect()
    with pytest.raises(ValueError):
        a + Matrix.from_arrays(spark, [1.0], [0], [0], (3, 2))
    with pytest.raises(ValueError):
        a @ Matrix.from_arrays(spark, [1.0], [0], [0], (3, 2))


def test_elementwise_is_on_stored_values(spark):
    a = Matrix.from_arrays(spark, [0.0, -1.0, 4.0], [0, 0, 1], [0, 1, 1], (2, 2))
    got = {(r["row"], r["col"]): r["val"] for r in a.log().df.collect()}
    assert got[0, 0] == -math.inf and math.isnan(got[0, 1]) and got[1, 1] == math.log(4) and len(got) == 3
    got = {(r["row"], r["col"]): r["val"] for r in (1.0 / a).df.collect()}
    assert got[0, 0] == math.inf and got[0, 1] == -1
    assert a.exp().df.count() == 3


SPECIAL = [0.0, -0.0, 1.0, -2.5, 2.5, 3.5, math.inf, -math.inf, math.nan, 1e300]


def test_ieee_functions_against_numpy(spark):
    df = spark.createDataFrame([(a, b) for a in SPECIAL for b in SPECIAL], "a double, b double")
    got = df.select("a", "b", ieee.div(F.col("a"), F.col("b")).alias("q"), ieee.round_even(F.col("a")).alias("r"), ieee.floor(F.col("a")).alias("f"), ieee.ln(F.col("a")).alias("l"), ieee.lt(F.col("a"), F.col("b")).alias("lt"), ieee.eq(F.col("a"), F.col("b")).alias("eq"), ieee.ge(F.col("a"), F.col("b")).alias("ge"), ieee.clamp(F.col("a"), -1, 1).alias("c")).collect()
    with np.errstate(all="ignore"):
        for r in got:
            a, b = np.float64(r["a"]), np.float64(r["b"])
            for mine, theirs in ((r["q"], a / b), (r["r"], np.rint(a)), (r["f"], np.floor(a)), (r["l"], np.log(a)), (r["c"], np.clip(a, -1, 1))):
                assert mine == theirs or (math.isnan(mine) and np.isnan(theirs)), (a, b, mine, theirs)
            assert (r["lt"], r["eq"], r["ge"]) == (a < b, a == b, a >= b)


def test_reductions(spark):
    a, d = random(spark, 6, 4, 2)
    a = a.coalesce()
    assert np.allclose(column(a.sum(1), 6), d.sum(1)) and np.allclose(column(a.sum(0), 4), d.sum(0))
    assert np.allclose(column(a.max(1), 6), d.max(1)) and np.allclose(column(a.min(0), 4), d.min(0))
    assert np.allclose(column(a.prod(1), 6), d.prod(1))
    for ord_ in ("fro", 1, -1, 2, -2, math.inf, -math.inf):
        assert math.isclose(a.norm(ord_).first()["v"], np.linalg.norm(d, ord_), rel_tol=1e-9, abs_tol=1e-12), ord_
    assert np.allclose(column(a.diagonal(), 4), np.diag(d)[:4])
    with pytest.raises(ValueError):
        a.norm("nuc")


def test_nan_wins_extremes(spark):
    a = Matrix.from_arrays(spark, [1.0, math.nan], [0, 0], [0, 1], (1, 2))
    assert math.isnan(a.max().first()["v"]) and math.isnan(a.min().first()["v"])


def test_blocks_and_lists(spark):
    a, d = random(spark, 4, 6, 3)
    full = Matrix.from_dense(spark, d + 10)
    assert np.allclose(unflatten_blocks(full, (2, 3)).flatten_blocks().to_numpy(), d + 10)
    with pytest.raises(Exception, match="not whole"):
        unflatten_blocks(Matrix.from_arrays(spark, [1.0], [0], [0], (2, 2)), (2, 2)).df.collect()
    b, e = random(spark, 2, 3, 4)
    both = Matrix.list_of([a, b])
    diag = both.to_block_diagonal()
    want = np.zeros((6, 9))
    want[:4, :6], want[4:, 6:] = d, e
    assert np.allclose(diag.to_numpy(), want)
    split = Matrix.from_block_diagonal(diag, [(4, 6), (2, 3)])
    assert np.allclose(split.element(1).to_numpy(), e) and np.allclose(split.element(-2).to_numpy(), d)


def test_batches_from_dense_keep_every_pattern(spark):
    d = np.zeros((2, 2, 2))
    d[0, 0, 0], d[1, 1, 1] = 1, 2
    a = Matrix.from_dense(spark, d)
    assert a.shape == (2, 2, 2) and a.nnz() == 2 and np.allclose(a.to_numpy(), d)
    assert np.allclose(a.sum_batch().to_numpy(), d.sum(0))


def test_complex(spark):
    a = Matrix.from_arrays(spark, [1 + 2j, 3j], [0, 1], [1, 0], (2, 2))
    d = np.array([[0, 1 + 2j], [3j, 0]])
    assert np.allclose(a.to_numpy(), d) and np.allclose(a.H.to_numpy(), d.conj().T) and np.allclose((a @ a).to_numpy(), d @ d)
    assert np.allclose(a.abs().to_numpy(), np.abs(d)) and np.allclose((a * 2j).to_numpy(), d * 2j) and np.allclose((a / a).to_numpy(), d != 0)
    assert a.slogdet().first()["logabs"] == pytest.approx(np.linalg.slogdet(d)[1])


def test_predicates(spark):
    a, d = random(spark, 5, 5, 6)
    sym = Matrix.from_dense(spark, d + d.T)
    assert sym.is_symmetric().first()["holds"] and not a.is_symmetric().first()["holds"]
    assert not Matrix.from_dense(spark, np.ones((2, 3))).is_symmetric().first()["holds"]
    spd = Matrix.from_dense(spark, d @ d.T + np.eye(5))
    assert spd.is_positive_definite("cholesky").first()["holds"] and spd.is_positive_definite("eigenvalue").first()["holds"]
    assert not Matrix.from_dense(spark, -np.eye(3)).is_positive_definite().first()["holds"]


def test_shapes_are_checked(spark):
    df = spark.createDataFrame([(0, 0, 1.0)], "row long, col long, val double")
    for bad in (dict(), dict(m=1, n=1, keys=("batch_id",)), dict(keys=("matrix_id",)), dict(m=1, n=1, keys=("k",))):
        with pytest.raises(ValueError):
            Matrix(df, **bad)
    with pytest.raises(ValueError):
        Matrix(df, 1, 1).cast("half")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(-5, 5)), max_size=12))
def test_coalesce_adds_up(spark, entries):
    d = np.zeros((4, 4))
    for r, c, v in entries:
        d[r, c] += v
    a = Matrix.from_arrays(spark, [v for *_, v in entries], [r for r, *_ in entries], [c for _, c, _ in entries], (4, 4))
    assert np.allclose(a.coalesce().to_numpy(), d) and np.allclose(a.T.to_numpy(), d.T)
    assert a.coalesce().df.count() == len({(r, c) for r, c, _ in entries})
    assert to_driver(a.sum(1), 4).tolist() == d.sum(1).tolist()


def test_coercion_and_csr(spark):
    a, d = random(spark, 4, 5, 9)
    assert np.allclose(Matrix.from_csr(a.to_csr(), 4, 5).to_numpy(), d)
    for x in (a, d, ([1.0], [0], [1], (2, 2)), lambda v: d @ v):
        want = np.array([[0, 1.0], [0, 0]]) if isinstance(x, tuple) else d
        assert np.allclose(Matrix.coerce(spark, x, (4, 5)).to_numpy(), want)
    assert np.allclose(Matrix.coerce(spark, a.df, (4, 5)).to_numpy(), d)
    u, s, v = a.svd_distributed(2)
    assert np.allclose(s, np.linalg.svd(d)[1][:2], rtol=1e-6) and np.allclose(d @ v, u * s, atol=1e-4)
