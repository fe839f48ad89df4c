import numpy as np
import pytest

from cooframe import Matrix
from cooframe.plans import harness
from cooframe.sources import generators, mtx, store


def text(tmp_path, lines):
    p = tmp_path / "a.mtx"
    p.write_text("\n".join(lines) + "\n")
    return str(p)


def test_mtx_kinds(spark, tmp_path):
    a = mtx.read(spark, text(tmp_path, ["%%MatrixMarket matrix coordinate real symmetric", "% note", "", "3 3 3", "1 1 2.5", "2 1 -1", "3 3 4"]))
    assert a.to_numpy().tolist() == [[2.5, -1, 0], [-1, 0, 0], [0, 0, 4]]
    a = mtx.read(spark, text(tmp_path, ["%%MatrixMarket matrix coordinate pattern general", "2 3 2", "1 3", "2 1"]))
    assert a.to_numpy().tolist() == [[0, 0, 1], [1, 0, 0]]
    a = mtx.read(spark, text(tmp_path, ["%%MatrixMarket matrix coordinate integer skew-symmetric", "2 2 1", "2 1 3"]))
    assert a.to_numpy().tolist() == [[0, -3], [3, 0]]
    a = mtx.read(spark, text(tmp_path, ["%%MatrixMarket matrix coordinate complex hermitian", "2 2 2", "1 1 1 0", "2 1 3 4"]))
    assert np.allclose(a.to_numpy(), [[1, 3 - 4j], [3 + 4j, 0]])
    a = mtx.read(spark, text(tmp_path, ["%%MatrixMarket matrix coordinate integer general", "2 2 2", "2 2 2", "1 1 5"]))
    assert a.to_numpy().tolist() == [[5, 0], [0, 2]]


def test_mtx_is_checked(spark, tmp_path):
    with pytest.raises(ValueError, match="says 2"):
        mtx.read(spark, text(tmp_path, ["%%MatrixMarket matrix coordinate real general", "2 2 2", "1 1 5"]))
    with pytest.raises(ValueError):
        mtx.read(spark, text(tmp_path, ["%%MatrixMarket matrix array real general", "2 2", "1"]))


def test_symmetric_round_trip_keeps_values(spark, tmp_path):
    d = np.array([[2.0, 1, 0], [1, 3, 1e-17], [0, 1e-17, 1 / 3]])
    mtx.write(Matrix.from_dense(spark, d), str(tmp_path / "out"), "two\nlines", "symmetric")
    assert mtx.read(spark, str(tmp_path / "out")).to_numpy().tolist() == d.tolist()


def test_store_keeps_the_full_shape(spark, tmp_path):
    a = Matrix.from_dense(spark, np.arange(12.0).reshape(2, 2, 3))
    store.write(a, str(tmp_path / "a"), {"k": 1})
    b = store.read(spark, str(tmp_path / "a"))
    assert b.shape == (2, 2, 3) and np.allclose(b.to_numpy(), a.to_numpy()) and store.read_metadata(spark, str(tmp_path / "a")) == {"k": 1}
    c = Matrix.list_of([generators.eye(spark, 2), generators.eye(spark, 3)])
    store.write(c, str(tmp_path / "c"))
    assert store.read(spark, str(tmp_path / "c")).total_shape() == (5, 5)


def test_problems_by_name(spark):
    for name, (_, sizes) in generators.PROBLEMS.items():
        assert generators.default_sizes(name) == sizes
    with pytest.raises(KeyError):
        generators.get(spark, "nothing")
    assert np.allclose(generators.kron_poisson_3d(spark, 4).to_numpy(), generators.laplacian_3d(spark, 4).to_numpy())


def test_harness(spark):
    found = list(harness.benchmarks(spark, ("general",)))
    assert [b.name for b in found] == ["advection_diffusion_2d"]
    assert max(found[0].evaluate(lambda a, b: a.solve(b, "lu"), "max_abs")) < 1e-8
