"""Projections of whole embeddings against numpy."""

import os

import numpy as np
import pytest

from lattice.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])


def projected(spark, name, columns):
    return np.array([[r[c] for c in columns] for r in registry.queries()[name](spark, SF).orderBy("row_idx").collect()])


def alike(got, want):
    return all(min(np.abs(g - w).max(), np.abs(g + w).max()) < 1e-6 for g, w in zip(got.T, want.T, strict=True))


def test_svd_projection(spark, table):
    x, _ = table
    assert x.shape[1] == 64
    assert alike(projected(spark, "svd_projection", ["pc0", "pc1"]), x @ np.linalg.svd(x, full_matrices=False)[2][:2].T)


def test_linear_discriminants(spark, table):
    x, y = table
    z = x - x.mean(axis=0)
    total = z.T @ z / len(z)
    between = sum((y == c).mean() * np.outer(m, m) for c in np.unique(y) for m in [z[y == c].mean(axis=0)])
    values, vectors = np.linalg.eig(np.linalg.solve(total - between + 1e-9 * np.eye(64), between))
    best = np.real(vectors[:, np.argsort(-np.real(values))[:2]])
    assert alike(projected(spark, "linear_discriminants", ["ld0", "ld1"]), z @ (best / np.linalg.norm(best, axis=0)))
