import numpy as np

import pytest

from lattice.llm.packing import Capacity, best_fit


def test_documents_and_attention_refuse_a_bin():
    lengths = np.array([3, 3, 3, 3])
    for capacity in (Capacity(tokens=100, documents=2), Capacity(tokens=100, attention=20)):
        assert sorted(np.bincount(best_fit(lengths, capacity)[0]).tolist()) == [2, 2]
    assert np.bincount(best_fit(lengths, Capacity(tokens=100))[0]).tolist() == [4]


def plain(lengths, capacity):
    """Best fit by its definition: each piece, by falling length, over all bins that admit it."""
    full, bins = capacity.vector(), []
    where = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        item = np.array([lengths[i], 1, lengths[i] ** 2], float)
        found = []
        for b, residual in enumerate(bins):
            if (residual >= item).all():
                left, weights = (residual - item) / full, np.array(capacity.weights)
                found.append((float((weights * left**2).sum()) if capacity.choose == "norm" else -float((weights * residual / full * item / full).sum()), b))
        if found:
            lowest = min(x for x, _ in found)
            where[i] = [b for x, b in found if x <= lowest + 1e-12]
            bins[where[i][0]] -= item
        else:
            bins.append(full - item)
            where[i] = [len(bins) - 1]
    return where, len(bins)


@pytest.mark.parametrize("choose", ["norm", "dot"])
def test_bins_are_those_of_the_definition(choose):
    rng = np.random.default_rng(5)
    for capacity in (Capacity(choose=choose), Capacity(100, 4, 6_000, (1.0, 0.5, 0.7), choose)):
        lengths = rng.permutation(np.arange(1, min(2000, capacity.tokens) // 2 + 1))[:150]  # no ties
        where, n = plain(lengths.tolist(), capacity)
        bins, _ = best_fit(lengths, capacity)
        assert bins.max() + 1 == n
        if all(len(w) == 1 for w in where):
            assert bins.tolist() == [w[0] for w in where]


def test_vector_rule_is_not_the_scalar_rule_and_costs_nothing():
    rng = np.random.default_rng(6)
    lengths = np.minimum(rng.lognormal(6, 1, 3000).astype(int) + 1, 2047)
    vector, scalar = (best_fit(lengths, Capacity(weights=w))[0] for w in ((1.0, 1.0, 1.0), (1.0, 0.0, 0.0)))
    pairs = lambda bins: {(int(i), int(j)) for b in range(bins.max() + 1) for own in [np.flatnonzero(bins == b)] for i in own for j in own}
    assert pairs(vector) != pairs(scalar)
    least = -(-int(lengths.sum()) // 2048)
    assert vector.max() + 1 <= max(scalar.max() + 1, least + 3)
