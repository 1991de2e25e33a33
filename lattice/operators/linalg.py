"""Decompositions of small matrices, on the driver or one matrix a group.

Large inputs come here as their Gram matrix or other n x n summaries; the work is O(n^3) in the number of
columns, not of rows. Vectors with a free sign get their largest component positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_arrow
from .matrix import Matrix, ShapeError

PIVOT, ECHELON, RANK = 1e-15, 1e-14, 1e-10


def _square(a: np.ndarray) -> np.ndarray:
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ShapeError(f"{a.shape} is not square")
    return np.array(a, float)


def lu(a: np.ndarray) -> dict[str, np.ndarray]:
    """P A = L U with partial pivoting; columns whose pivot is under 1e-15 are passed over."""
    u = _square(a)
    n = len(u)
    low, perm = np.eye(n), np.arange(n)
    for k in range(n):
        p = k + int(np.argmax(np.abs(u[k:, k])))
        if p != k:
            u[[k, p]] = u[[p, k]]
            perm[[k, p]] = perm[[p, k]]
            low[[k, p], :k] = low[[p, k], :k]
        if abs(u[k, k]) < PIVOT:
            continue
        low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
        u[k + 1 :, k] = 0
    return {"L": low, "U": u, "P": np.eye(n)[perm]}


def det(a: np.ndarray) -> float:
    return float(np.linalg.det(_square(a)))


def inverse(a: np.ndarray) -> np.ndarray:
    return np.linalg.inv(_square(a))


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.solve(_square(a), np.asarray(b, float))


def cholesky(a: np.ndarray) -> np.ndarray:
    """Lower L with L L' = A, from A's lower triangle; raises where a pivot is not positive."""
    a = _square(a)
    return np.linalg.cholesky(np.tril(a) + np.tril(a, -1).T)


def _signed(vectors: np.ndarray) -> np.ndarray:
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return np.where(top < 0, -1.0, 1.0)


def svd(a: np.ndarray) -> dict[str, np.ndarray]:
    """Full U, singular values in falling order, V'."""
    u, s, vt = np.linalg.svd(np.asarray(a, float), full_matrices=True)
    k = len(s)
    sign = _signed(u[:, :k])
    u[:, :k] *= sign
    vt[:k] *= sign[:, None]
    return {"U": u, "s": s, "VT": vt}


def eig(a: np.ndarray, symmetric: bool = False) -> dict[str, np.ndarray]:
    """Symmetric: rising values. General: real and imaginary parts apart."""
    a = _square(a)
    if symmetric:
        values, vectors = np.linalg.eigh(a)
        return {"values": values, "vectors": vectors * _signed(vectors)}
    values, vectors = np.linalg.eig(a)
    return {"values": values.real, "values_imag": values.imag, "vectors": vectors.real}


def qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Thin Q R with a diagonal of R that is not negative."""
    q, r = np.linalg.qr(np.asarray(a, float))
    sign = np.where(np.diag(r) < 0, -1.0, 1.0)
    return q * sign, r * sign[:, None]


def ref(a: np.ndarray) -> tuple[np.ndarray, int]:
    """(row echelon form, row swaps), by partial pivoting."""
    u = np.array(a, float)
    row = swaps = 0
    for col in range(u.shape[1]):
        if row == len(u):
            break
        p = row + int(np.argmax(np.abs(u[row:, col])))
        if abs(u[p, col]) < ECHELON:
            u[row:, col] = 0
            continue
        if p != row:
            u[[row, p]] = u[[p, row]]
            swaps += 1
        u[row + 1 :] -= np.outer(u[row + 1 :, col] / u[row, col], u[row])
        u[row + 1 :, col] = 0
        row += 1
    return u, swaps


def rref(a: np.ndarray) -> np.ndarray:
    """Reduced row echelon form."""
    u, _ = ref(a)
    for row in range(len(u) - 1, -1, -1):
        lead = np.flatnonzero(np.abs(u[row]) > ECHELON)
        if len(lead):
            u[row] /= u[row, lead[0]]
            u[:row] -= np.outer(u[:row, lead[0]], u[row])
    return u


def rank(a: np.ndarray) -> int:
    return int((np.abs(ref(a)[0]) > RANK).any(axis=1).sum())


def pseudoinverse(a: np.ndarray) -> np.ndarray:
    a = np.asarray(a, float)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    cut = RANK * max(a.shape) * s.max(initial=0)
    return (vt.T * np.where(s > cut, 1 / np.where(s > cut, s, 1), 0)) @ u.T


def positive_definite(a: np.ndarray) -> bool:
    a = np.asarray(a, float)
    if a.shape[0] != a.shape[1] or (np.abs(a - a.T) > 1e-10).any():
        return False
    try:
        cholesky(a)
    except np.linalg.LinAlgError:
        return False
    return True


def positive_semidefinite(a: np.ndarray) -> bool:
    a = np.asarray(a, float)
    return bool(a.shape[0] == a.shape[1] and not (np.abs(a - a.T) > 1e-10).any() and np.linalg.eigvalsh(a).min() >= -1e-10)


def least_squares(x: Matrix, y: DataFrame) -> np.ndarray:
    """Coefficients of y (row_id, y) on x, from the normal equations: one pass over the rows."""
    both = x.df.join(y, "row_id").select("row_id", F.concat("v", F.array(F.col("y").cast("double"))).alias("v"))
    g = Matrix(both, n=x.n + 1).gram().local()
    return pseudoinverse(g[:-1, :-1]) @ g[:-1, -1]


def truncated_svd(x: Matrix, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(k singular values, their right vectors in columns) of a tall matrix, from its Gram matrix."""
    found = eig(x.gram().local(), True)
    values = found["values"][::-1][:k]
    return np.sqrt(np.maximum(values, 0)), found["vectors"][:, ::-1][:, :k]


def batched(df: DataFrame, function, schema: str) -> DataFrame:
    """function(id, matrix) -> rows, for a table (id, m array<array<double>>) of many small matrices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in function(i, np.array(m, float))]
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out]) if out else pa.RecordBatch.from_pylist([], schema=pa.schema([(n, pa.null()) for n in names]))

    return map_arrow(df, run, schema)
