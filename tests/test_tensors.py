import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattice.functions import elementwise, vectors
from lattice.operators import linalg
from lattice.operators.matrix import Matrix, ShapeError, Vector, chain


@pytest.fixture(scope="module")
def m(spark):
    return lambda rows: Matrix.build(spark, rows)


@pytest.fixture(scope="module")
def v(spark):
    return lambda values, column=False: Vector.build(spark, values, column)


def rows(matrix):
    return matrix.local().tolist()


OWN = np.random.default_rng(17).normal(0, 5, (4, 3)).round(2)


def test_shape_and_scalars(m):
    a = m(OWN.tolist())
    assert a.shape() == OWN.shape and a.shape_string() == "4 x 3" and a.size() == OWN.size and a.ndim() == 2 and not a.is_square()
    for name, own in (("add", np.add), ("subtract", np.subtract), ("multiply", np.multiply), ("divide", np.divide)):
        assert np.allclose(a.binary(name, 7).local(), own(OWN, 7))
        assert a.binary(name, 7).sum() == pytest.approx(own(OWN, 7).sum())


def test_factories(spark, m):
    for made, own in ((Matrix.zeros(spark, 5, 4), np.zeros((5, 4))), (Matrix.ones(spark, 4, 7), np.ones((4, 7))), (Matrix.fill(spark, -2.5, 3, 6), np.full((3, 6), -2.5)), (Matrix.eye(spark, 4), np.eye(4)), (Matrix.from_diagonal(spark, [9, -4, 0.5]), np.diag([9, -4, 0.5]))):
        assert made.shape() == own.shape and np.array_equal(made.local(), own)
    square = OWN[:3]
    assert np.allclose(m(square.tolist()).binary("add", Matrix.eye(spark, 3)).local(), square + np.eye(3))
    assert Matrix.eye(spark, 6).trace() == 6 and linalg.det(Matrix.eye(spark, 5).local()) == pytest.approx(1)
    for made in (Matrix.uniform(spark, 4, 3, 2, 5, 1), Matrix.rand(spark, 4, 3, 1)):
        assert made.shape() == (4, 3) and len(np.unique(made.local())) == 12
    assert Matrix.poisson(spark, 200, 5, 3.0, 1).mean() == pytest.approx(3, abs=0.4) and Matrix.gaussian(spark, 400, 5, 2).variance() == pytest.approx(1, abs=0.2)
    assert Vector.zeros(spark, 3).sum() == 0 and Vector.ones(spark, 3).sum() == 3 and Vector.uniform(spark, 5, seed=1).n == 5 and Vector.gaussian(spark, 5).n == 5 and Vector.rand(spark, 5).min() >= 0
    with pytest.raises(ShapeError):
        Matrix.zeros(spark, 0, 2)


def test_element_functions(m):
    a = m(OWN.tolist())
    for name, own in (("square", np.square), ("negate", np.negative), ("abs", np.abs), ("floor", np.floor), ("ceil", np.ceil), ("as_int", np.trunc), ("sign", np.sign)):
        assert np.allclose(a.apply(name).local(), own(OWN)), name
    assert np.allclose(m(np.abs(OWN).tolist()).apply("sqrt").local(), np.sqrt(np.abs(OWN))) and np.allclose(a.clip(-3, 4).local(), OWN.clip(-3, 4))
    assert rows(m([[6.5, -6.5, -0.2]]).apply("round")) == [[7, -7, 0]]


def test_floor_and_ceil_of_every_double(m):
    odd = [1e300, -1e300, float("inf"), float("-inf"), 2.0**53, -(2.0**53) - 2, 0.5, -0.5, 2.0**52 + 0.5]
    for name, own in (("floor", np.floor), ("ceil", np.ceil)):
        assert rows(m([odd]).apply(name)) == [own(odd).tolist()]
        assert np.isnan(rows(m([[float("nan")]]).apply(name))[0][0])


def test_ieee_results(m):
    odd = m([[0.0, -1.0, 1.0]])
    assert rows(odd.apply("log"))[0][0] == -np.inf and np.isnan(rows(odd.apply("log"))[0][1])
    assert rows(odd.apply("log1p"))[0][1] == -np.inf and np.isnan(rows(odd.binary("mod", 0))[0]).all()
    assert rows(m([[-7.5]]).binary("mod", 2)) == [[-1.5]]
    nan = m([[float("nan"), 1.0]])
    assert rows(nan.compare("equal", nan)) == [[0, 1]] and rows(nan.compare("not_equal", nan)) == [[1, 0]] and rows(nan.compare("greater", 0)) == [[0, 1]] and rows(nan.compare("less_equal", nan)) == [[0, 1]]


def test_reductions(m):
    a = m([[1, 2, 3], [4, 5, 6]])
    assert a.row_sums().values() == [6, 15] and a.column_sums().values() == [5, 7, 9] and a.row_means().values() == [2, 5] and a.column_means().values() == [2.5, 3.5, 4.5]
    assert a.row_maxima().values() == [3, 6] and a.row_minima().values() == [1, 4] and a.column_maxima().values() == [4, 5, 6] and a.column_minima().values() == [1, 2, 3]
    assert (a.product(), a.min(), a.max(), a.mean(), a.median()) == (720, 1, 6, 3.5, 3.5) and a.variance() == pytest.approx(35 / 12) and a.variance(0.0) == pytest.approx(91 / 6)
    assert a.row_norms(1).values() == [6, 15] and a.row_norms(float("inf")).values() == [3, 6] and a.column_norms(float("inf")).values() == [4, 5, 6]
    assert a.column_norms(2).values() == pytest.approx(np.linalg.norm(a.local(), axis=0)) and a.column_norms(3).values() == pytest.approx(np.linalg.norm(a.local(), 3, axis=0)) and a.quantile(0.2) == 2
    assert a.reduce(lambda s, x: s * 2 + x, 0) == 120
    assert a.as_text().splitlines()[0] == "[1, 2, 3]"


def test_structure(m):
    a = m([[1, 2, 3], [4, 5, 6]])
    assert rows(a.transpose()) == [[1, 4], [2, 5], [3, 6]] and a.transpose().shape() == (3, 2)
    assert a.row(1).values() == [4, 5, 6] and a.column(2).values() == [3, 6] and a.diagonal().values() == [1, 5] and a.flatten().values() == [1, 2, 3, 4, 5, 6]
    assert rows(a.drop_row(0)) == [[4, 5, 6]] and rows(a.drop_column(1)) == [[1, 3], [4, 6]]
    assert rows(a.stack(a)) == [[1, 2, 3], [4, 5, 6]] * 2 and rows(a.augment(a))[0] == [1, 2, 3] * 2 and rows(a.repeat(2, 2)) == [[1, 2, 3] * 2, [4, 5, 6] * 2] * 2 and rows(a.repeat(1, 2))[1] == [4, 5, 6] * 2
    for bad in (lambda: a.row(2), lambda: a.column(3), lambda: a.drop_row(-1), lambda: a.drop_column(9)):
        with pytest.raises(IndexError):
            bad()
    for bad in (lambda: a.trace(), lambda: a.stack(a.transpose()), lambda: a.augment(a.transpose()), lambda: a.matmul(a), lambda: a.binary("add", a.transpose())):
        with pytest.raises(ShapeError):
            bad()


def test_broadcast(m, v):
    a = m([[1, 2, 3], [4, 5, 6]])
    assert rows(a.binary("add", v([10, 20, 30]))) == [[11, 22, 33], [14, 25, 36]] and rows(a.binary("multiply", v([1, 2], True))) == [[1, 2, 3], [8, 10, 12]]
    with pytest.raises(ShapeError):
        a.binary("divide", v([1, 2, 3]))
    with pytest.raises(ShapeError):
        a.binary("add", v([1, 2]))


def test_products(m, v, spark):
    a, b = m([[1, 2], [3, 4]]), m([[5, 6], [7, 8]])
    assert rows(a.matmul(b)) == [[19, 22], [43, 50]] and a.dot(v([1, 1])).values() == [3, 7] and rows(a.gram()) == [[10, 14], [14, 20]]
    big = Matrix.uniform(spark, 128, 128, seed=2)
    x = big.local()
    assert np.allclose(big.matmul(big).local(), x @ x) and np.allclose(big.gram().local(), x.T @ x)
    assert np.allclose(chain(m([[1, 2]]), a, b).local(), np.array([[1, 2]]) @ a.local() @ b.local())
    assert m([[2, 1], [1, 3]]).symmetric() and not a.symmetric() and not m([[1, 2, 3]]).symmetric()


def test_vectors(v):
    assert v([3, 4]).norm() == 5 and v([3, 4]).norm(1) == 7 and v([3, 4]).norm(float("inf")) == 4 and v([3, 4]).dot(v([1, 0])) == 3 and v([3, 4]).normalize().norm() == pytest.approx(1)
    assert v([0, 0]).normalize().values() == [0, 0]
    assert v([1, 0, 0]).cross(v([0, 1, 0])).values() == [0, 0, 1] and v([1, 0, 0]).outer(v([0, 1, 0])).count() == 9
    assert v([1, 2, 3]).as_column_matrix().shape() == (3, 1) and v([1, 2, 3]).as_row_matrix().shape() == (1, 3) and v([1, 2, 3], True).shape() == (3, 1)
    assert v([1, 2, 3, 4, 5]).compare("greater", 3).values() == [0, 0, 0, 1, 1] and v([1, 2, 3, 4, 5]).compare("less_equal", 3).values() == [1, 1, 1, 0, 0]
    assert v([3, 4]).project(v([1, 0])).values() == [3, 0] and v([3, 4]).reflect(v([1, 0])).values() == [-3, 4]
    assert v([2, 1, 1, 3, 3]).argmin() == 1 and v([2, 1, 1, 3, 3]).argmax() == 3 and v([4, 1, 3]).median() == 3 and v([1, 2, 3, 4]).quantile(0.5) == 2.5
    assert v([1, 2, 3, 4, 5]).convolve([1, 0, -1]).values() == [-2, -2, -2] and v([1, 2, 3, 4, 5]).convolve([1, 1], 2).values() == [3, 7] and v([1]).convolve([1, 1]).n == 0
    assert v([1, 2]).reduce(lambda a, x: a * 10 + x, 0) == 12
    with pytest.raises(ZeroDivisionError):
        v([1, 2]).project(v([0, 0]))
    with pytest.raises(ShapeError):
        v([1, 2], True).binary("add", v([1, 2]))


def test_array_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([0.0, 0.0, 0.0],)], "v array<double>")
    got = df.select(vectors.softmax(F.col("v")).alias("s"), vectors.argmax(F.col("v")).alias("a"), vectors.median(F.col("v")).alias("m"), vectors.convolve(F.col("v"), [1.0] * 4).alias("c")).collect()
    assert sum(got[0].s) == pytest.approx(1, abs=1e-12) and (got[0].a, got[0].m, got[0].c) == (2, 2, [])
    assert set(elementwise.UNARY) >= {"sign", "deg2rad", "rad2deg", "log1p"}


def test_convolve_two_dimensions(m):
    a = m([[1, 2, 3], [4, 5, 6], [7, 8, 9]])
    assert rows(a.convolve([[1, 0], [0, -1]])) == [[-4, -4], [-4, -4]] and rows(a.convolve([[1]], 2)) == [[1, 3], [7, 9]]


def test_decompositions():
    a = np.array([[2.0, 1, 1], [4, 3, 3], [8, 7, 9]])
    x = linalg.lu(a)
    assert np.allclose(x["P"] @ a, x["L"] @ x["U"], atol=1e-8)
    b = np.array([[2.0, 1], [5, 3]])
    assert np.allclose(b @ linalg.inverse(b), np.eye(2), atol=1e-9) and linalg.det(np.array([[3.0, 8], [4, 6]])) == pytest.approx(-14)
    assert np.allclose(linalg.solve(np.array([[2.0, 1], [-1, 3]]), np.array([5.0, 0])), [15 / 7, 5 / 7])
    c = linalg.cholesky(np.array([[4.0, 2], [2, 3]]))
    assert np.allclose(c @ c.T, [[4, 2], [2, 3]]) and np.allclose(linalg.svd(np.diag([1.0, 2, 3]))["s"], [3, 2, 1]) and np.allclose(linalg.svd(np.array([[1.0, 2], [3, 4]]))["s"], [5.4649857, 0.36596619])
    assert np.allclose(linalg.eig(np.array([[2.0, -1], [-1, 2]]), True)["values"], [1, 3])
    d = np.array([[1.0, 2, 3], [4, 5, 6], [7, 8, 9]])
    assert linalg.rank(d) == 2 and linalg.rref(d)[0, 0] == pytest.approx(1)
    for bad in (lambda: linalg.det(np.ones((2, 3))), lambda: linalg.inverse(np.ones((2, 2))), lambda: linalg.cholesky(-np.eye(2))):
        with pytest.raises((ShapeError, np.linalg.LinAlgError)):
            bad()
    assert linalg.positive_definite(np.eye(2)) and not linalg.positive_definite(np.ones((2, 2))) and linalg.positive_semidefinite(np.ones((2, 2))) and not linalg.positive_semidefinite(-np.eye(2))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10**6))
def test_residuals(m_, n_, seed):
    a = np.random.default_rng(seed).normal(size=(m_, n_))
    p = linalg.pseudoinverse(a)
    assert np.allclose(a @ p @ a, a) and np.allclose(p @ a @ p, p)
    s = linalg.svd(a)
    k = len(s["s"])
    assert np.allclose(s["U"][:, :k] * s["s"] @ s["VT"][:k], a)
    u, _ = linalg.ref(a)
    assert linalg.rank(a) == np.linalg.matrix_rank(a) and np.allclose(np.tril(u, -1), 0)
    if m_ >= n_:
        q, r = linalg.qr(a)
        assert np.allclose(q @ r, a) and (np.diag(r) >= 0).all()
    sq = a[: min(m_, n_), : min(m_, n_)]
    x = linalg.lu(sq)
    assert np.allclose(x["P"] @ sq, x["L"] @ x["U"]) and linalg.eig(sq)["values"].sum() == pytest.approx(np.trace(sq))


def test_least_squares_and_truncated_svd(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2, 0.5]
    df = spark.createDataFrame([(i, float(t)) for i, t in enumerate(y)], "row_id long, y double")
    assert np.allclose(linalg.least_squares(Matrix.build(spark, x.tolist()), df), [1, -2, 0.5])
    s, _ = linalg.truncated_svd(Matrix.build(spark, x.tolist()), 2)
    assert np.allclose(s, np.linalg.svd(x)[1][:2])


def test_gram_is_added_alike_in_both_ways(spark, monkeypatch):
    from lattice.operators import matrix

    x = np.random.default_rng(8).normal(size=(50, 7))
    m = matrix.Matrix(spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "row_id long, v array<double>").repartition(6))
    assert np.allclose(m.gram().local(), x.T @ x)
    monkeypatch.setattr(matrix, "GRAM_CELLS", 10)
    assert np.allclose(m.gram().local(), x.T @ x)
