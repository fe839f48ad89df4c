import numpy as np
import pytest
from pyspark.sql import functions as F

from cooframe import Matrix
from cooframe.kernels import krylov as K
from cooframe.kernels import sparse
from cooframe.operators import gradients, nonlinear
from cooframe.operators.krylov import Operator, residual_norm, solve_distributed, to_driver, to_frame
from cooframe.plans import planner
from cooframe.sources import generators


def entries(d):
    r, c = np.nonzero(d)
    return sparse.Entries(r, c, d[r, c], *d.shape)


def laplacian(m):
    t = 2 * np.eye(m) - np.eye(m, k=1) - np.eye(m, k=-1)
    return np.kron(np.eye(m), t) + np.kron(t, np.eye(m))


@pytest.mark.parametrize("method", sorted(K.METHODS))
@pytest.mark.parametrize("pre", [None, *sorted(sparse.PRECONDITIONERS)])
def test_kernels_with_preconditioners(method, pre):
    d = laplacian(8)
    e, x = entries(d), np.sin(np.arange(64.0))
    got, _, _, fine, _ = sparse.solve(e, d @ x, method, pre, rtol=1e-9, maxiter=2000)
    assert np.abs(got - x).max() < (1e-5 if not (method == "cg" and pre == "polynomial") else 1e-4), (method, pre, fine)


def test_general_and_indefinite():
    rng = np.random.default_rng(0)
    d = rng.standard_normal((30, 30)) + 10 * np.eye(30)
    x = rng.standard_normal(30)
    for method in ("bicgstab", "gmres", "fgmres"):
        assert np.allclose(sparse.solve(entries(d), d @ x, method, "ilu0", rtol=1e-11)[0], x, atol=1e-6)
    s = rng.standard_normal((20, 20))
    s = s + s.T
    assert np.allclose(sparse.solve(entries(s), s @ x[:20], "minres", rtol=1e-12, maxiter=500)[0], x[:20], atol=1e-5)


def test_least_squares_and_damping():
    rng = np.random.default_rng(1)
    d, b = rng.standard_normal((40, 12)), rng.standard_normal(40)
    for method in ("lsqr", "lsmr"):
        x = sparse.solve(entries(d), b, method, atol=1e-12, btol=1e-12)[0]
        assert np.allclose(x, np.linalg.lstsq(d, b, rcond=None)[0], atol=1e-8)
        x = sparse.solve(entries(d), b, method, atol=1e-13, btol=1e-13, damp=0.7)[0]
        assert np.allclose(x, np.linalg.solve(d.T @ d + 0.49 * np.eye(12), d.T @ b), atol=1e-6)


def test_rectangular_systems_are_refused(spark):
    a = Matrix.from_dense(spark, np.ones((3, 2)))
    with pytest.raises(ValueError):
        a.solve(to_frame(spark, np.ones(3)))


def test_no_convergence_fails_loudly(spark):
    a = generators.laplacian_1d(spark, 50)
    b = to_frame(spark, np.ones(50))
    with pytest.raises(Exception, match="no convergence"):
        a.solve(b, "cg", maxiter=2).collect()
    assert not a.solve_info(b, "cg", maxiter=2).first()["converged"]


def test_distributed_operator_and_methods(spark):
    a = generators.laplacian_2d(spark, 6)
    d = laplacian(6)
    op = Operator(a, 5)
    x = np.random.default_rng(0).standard_normal((36, 3))
    assert np.allclose(op(x), d @ x) and np.allclose(op.transposed(x[:, 0]), d.T @ x[:, 0])
    b = a.matvec(to_frame(spark, x[:, 0]))
    for method, pre in (("cg", "jacobi"), ("bicgstab", "jacobi_l1"), ("gmres", "polynomial"), ("minres", "none")):
        s = solve_distributed(a, b, method, pre, rtol=1e-9)
        assert s.converged and np.allclose(to_driver(s.x, 36), x[:, 0], atol=1e-6), method
        assert residual_norm(a, s.x, b) < 1e-6
    s = solve_distributed(a, b, "lsqr", atol=1e-12, btol=1e-12)
    assert np.allclose(to_driver(s.x, 36), x[:, 0], atol=1e-6)


def test_planner_scopes(spark):
    a = generators.tridiagonal(spark, 30, 4.0)
    b = a.matvec(to_frame(spark, np.ones(30)))
    x, info = planner.solve(a, b)
    assert info.method == "cholesky" and np.allclose(to_driver(x, 30), 1)
    with planner.SolverConfig(tier="gather", method="cg", rtol=1e-3):
        with planner.SolverConfig(rtol=1e-12):
            _, info = planner.solve(a, b)
            assert info.method == "cg" and info.residual < 1e-9
        assert planner.solve(a, b, method="lu")[1].method == "lu"

    @planner.SolverConfig(tier="gather", method="gmres")
    def inside():
        return planner.solve(a, b)[1].method

    assert inside() == "gmres" and planner.solve(a, b)[1].method == "cholesky"
    with pytest.raises(ValueError):
        planner.solve(a, b, tier="frames", method="lu")
    assert planner.auto(a) == planner.preset("spd", "direct")
    cache = planner.Cache(2)
    assert [cache.get_or_build(k, lambda k=k: k * 2) for k in (1, 2, 1, 3)] == [2, 4, 2, 6] and list(cache.held) == [1, 3]
    assert planner.fingerprint(a) == planner.fingerprint(generators.tridiagonal(spark, 30, 4.0))


def differences(f, d, h=1e-6):
    out = np.zeros_like(d)
    for i, j in zip(*np.nonzero(d)):
        e = np.zeros_like(d)
        e[i, j] = h
        out[i, j] = (f(d + e) - f(d - e)) / (2 * h)
    return out


def placed(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["row"], r["col"]] = r["v"]
    return out


def test_gradients_against_differences(spark):
    rng = np.random.default_rng(4)
    d = (rng.random((5, 5)) < 0.6) * rng.standard_normal((5, 5)) + 4 * np.eye(5)
    a = Matrix.from_dense(spark, d)
    b, g = rng.standard_normal(5), rng.standard_normal(5)
    da, db = gradients.solve_vjp(a, to_frame(spark, b), to_frame(spark, g))
    assert np.allclose(placed(da, d.shape), differences(lambda m: g @ np.linalg.solve(m, b), d), atol=1e-6)
    assert np.allclose(to_driver(db, 5), np.linalg.solve(d.T, g))
    assert np.allclose(placed(gradients.det_vjp(a), d.shape), differences(np.linalg.det, d), rtol=1e-4, atol=1e-4)
    assert np.allclose(placed(gradients.logdet_vjp(a), d.shape), differences(lambda m: np.linalg.slogdet(m)[1], d), atol=1e-5)
    assert np.allclose(placed(gradients.svd_vjp(a, [1.0, 0.5]), d.shape), differences(lambda m: np.linalg.svd(m)[1][:2] @ [1, 0.5], d), atol=1e-5)
    s = Matrix.from_dense(spark, d + d.T)
    got = placed(gradients.eigsh_vjp(s, [1.0], "LA"), d.shape)
    assert np.allclose(got + got.T, 2 * differences(lambda m: np.linalg.eigvalsh((m + m.T) / 2)[-1], d + d.T), atol=1e-5)
    c = rng.standard_normal((5, 5))
    left, right = gradients.matmul_vjp(a, a, Matrix.from_dense(spark, c))
    assert np.allclose(placed(left, d.shape), (c @ d.T) * (d != 0)) and np.allclose(placed(right, d.shape), (d.T @ c) * (d != 0))


def test_spectra(spark):
    a = generators.laplacian_1d(spark, 30)
    want = np.sort(2 - 2 * np.cos(np.arange(1, 31) * np.pi / 31))
    assert np.allclose([r["lambda"] for r in a.eigsh(3, "SA").orderBy("k").collect()], want[:3])
    assert np.allclose([r["lambda"] for r in a.lobpcg(3, largest=True).orderBy("k").collect()], want[::-1][:3], atol=1e-6)
    assert a.det().first()["v"] == pytest.approx(31) and a.det("cholesky").first()["v"] == pytest.approx(31)
    assert a.condition_number().first()["v"] == pytest.approx(want[-1] / want[0])
    assert Matrix.from_dense(spark, np.ones((3, 3))).det().first()["v"] == pytest.approx(0, abs=1e-12)
    assert np.allclose([r["lambda"] for r in a.eigsh(2, sigma=1.0).orderBy("k").collect()], want[np.argsort(np.abs(want - 1))[:2]])


def test_nonlinear(spark):
    a = generators.tridiagonal(spark, 20, 4.0)
    u, root = nonlinear.newton_distributed(a, lambda u: u**3, lambda u: 3 * u**2, rhs=to_frame(spark, np.ones(20)))
    assert root.converged
    x = root.u
    d = 4 * np.eye(20) - np.eye(20, k=1) - np.eye(20, k=-1)
    assert np.abs(d @ x + x**3 - 1).max() < 1e-8
    _, w, _ = nonlinear.newton_distributed(a, lambda u: u**3, lambda u: 3 * u**2, rhs=to_frame(spark, np.ones(20)), adjoint=to_frame(spark, np.ones(20)))
    assert np.allclose((d + np.diag(3 * x**2)).T @ to_driver(w, 20), 1, atol=1e-6)
    assert nonlinear.jacobian_free(lambda u: u + u**3 - 1, np.zeros(3)).converged


def test_poisson_is_second_order(spark):
    errors = []
    for m in (7, 15):
        a, b, exact = generators.poisson_2d(spark, m)
        x = a.solve(b, "cholesky")
        errors.append(x.withColumnRenamed("v", "x").join(exact, "i").agg(F.max(F.abs(F.col("x") - F.col("v")))).first()[0])
    assert 3 < errors[0] / errors[1] < 5


def test_levels_against_dense_factors():
    import numpy as np

    from cooframe.kernels.sparse import Entries, LevelLU, pieces, whole

    rng = np.random.default_rng(0)
    for n, extra, is_complex in ((1, 0, False), (60, 30, False), (300, 250, False), (200, 500, True)):
        r, c = rng.integers(0, n, extra), rng.integers(0, n, extra)
        v = rng.standard_normal(extra) + (1j * rng.standard_normal(extra) if is_complex else 0)
        e = Entries(np.concatenate([r, np.arange(n)]), np.concatenate([c, np.arange(n)]), np.concatenate([v, np.full(n, 20.0)]), n, n)
        x, f = rng.standard_normal((n, 2)), LevelLU.of(e)
        for g in (f, whole(pieces(f)["payload"])):
            assert np.allclose(g.solve(e.dense() @ x), x) and np.allclose(g.solve(e.dense().T @ x, True), x)
            sign, log = np.linalg.slogdet(e.dense())
            assert np.allclose(g.slogdet()[1], log) and np.allclose(g.slogdet()[0], sign)


def test_kept_factors_and_shifts(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from cooframe.sources import generators

    a = generators.laplacian_2d(spark, 48)  # 2,304 unknowns
    x = spark.range(a.m).select(F.col("id").alias("i"), F.sin("id").alias("v"))
    lu = a.lu()
    got = lu.solve(a.matvec(x)).join(x.withColumnRenamed("v", "w"), "i").agg(F.max(F.abs(F.col("v") - F.col("w"))), F.count("*")).first()
    assert got[0] < 1e-10 and got[1] == a.m
    lu.drop()
    one = 2 - 2 * np.cos(np.arange(1, 49) * np.pi / 49)
    want = np.sort((one[:, None] + one).ravel())
    values = [r["lambda"] for r in a.eigsh(3, sigma=0.0).orderBy("k").collect()]
    assert np.allclose(values, want[:3])
    small = generators.laplacian_1d(spark, 30)
    exact = 2 - 2 * np.cos(np.arange(1, 31) * np.pi / 31)
    assert np.allclose([r["lambda"] for r in small.eigsh(2, sigma=1.0).orderBy("k").collect()], exact[np.argsort(np.abs(exact - 1))[:2]])
