"""Nearest vectors by products of single precision first, against all products."""

from __future__ import annotations

import numpy as np
import pytest

from kavram.operators import similarity as S


def _vectors(rng: np.random.Generator, n: int, width: int) -> np.ndarray:
    """With copies, and with vectors that single precision can't tell apart."""
    m = rng.standard_normal((n, width))
    m[n // 2 : n // 2 + 50] = m[:50]
    m[n // 3 : n // 3 + 50] = m[:50] * (1 + 1e-9 * rng.standard_normal((50, width)))
    m[-40:] = m[0] + 1e-6 * rng.standard_normal((40, width))
    m[5] = 0
    return S._unit(m)


@pytest.mark.parametrize("n, width, k", [(3000, 8, 5), (901, 64, 3), (60, 4, 5), (3, 2, 5), (1, 2, 1)])
def test_like_all_products(n, width, k):
    rng = np.random.default_rng(n)
    m = _vectors(rng, max(n, 200), width)[:n]
    own = rng.permutation(n) * 7
    got = S._nearest(own[: n // 2 + 1], m[: n // 2 + 1], own, m, k, "vec_id")
    want = []
    for q, row in zip(own[: n // 2 + 1], np.round(m[: n // 2 + 1] @ m.T, 9)):
        best = sorted((-s, v) for s, v in zip(row, own) if v != q)[:k]
        want += [(q, v, -s) for s, v in best]
    assert [tuple(x) for x in got.sort_values(["query", "similarity", "vec_id"], ascending=[True, False, True])[["query", "vec_id"]].values] == [x[:2] for x in sorted(want, key=lambda x: (x[0], -x[2], x[1]))]
    assert len(got) == len(want) and np.allclose(sorted(got.similarity), sorted(x[2] for x in want), atol=2e-9)


def test_few_products_are_compared():
    """Of thousands of vectors some dozens for each query, not all of them."""
    m = S._unit(np.random.default_rng(1).standard_normal((20_000, 64)))
    q, v = S._close(m[:300], m, 6)
    assert len(q) < 300 * 60 and set(q) == set(range(300)) and len(v) == len(q)
