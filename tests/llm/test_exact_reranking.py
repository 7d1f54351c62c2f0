"""Reranking sums in order only what may be among the best, and finds the same rows."""

import numpy as np
import pyarrow as pa

from auditloom.llm import ann

K = 20


def _found(queries, vectors, ids):
    rows = pa.table({"asks": [True] * len(queries) + [False] * len(vectors), "vec_id": np.r_[-1 - np.arange(len(queries)), ids], "embedding": pa.array([*queries, *vectors])})
    got = ann._cell(K)((None,), rows)
    return [tuple(r.values()) for r in got.to_pylist()]


def _plain(queries, vectors, ids):
    out = []
    for i, q in enumerate(queries):
        scores = (vectors * q).cumsum(1)[:, -1]
        out += [(-1 - i, ids[j].item(), scores[j].item()) for j in np.lexsort((ids, -scores))[:K]]
    return out


def test_few_products_are_summed_in_order(monkeypatch):
    draw = np.random.default_rng(3)
    queries, vectors = draw.standard_normal((300, 64)), draw.standard_normal((3000, 64))
    summed, lexsort = [], np.lexsort
    monkeypatch.setattr(ann.np, "lexsort", lambda keys: summed.append(len(keys[0])) or lexsort(keys))
    got = _found(queries, vectors, draw.permutation(3000))
    assert len(got) == 300 * K and sum(summed) < 25 * 300


def test_copies_and_odd_sizes_are_ranked_as_a_plain_search_does():
    draw = np.random.default_rng(4)
    base = draw.standard_normal((30, 16))
    vectors = np.concatenate([base[draw.integers(0, 30, 2000)], base * 1e-9, base * 1e9, base + draw.standard_normal(base.shape) * 1e-16])
    ids = draw.permutation(len(vectors))
    for queries in (base[:5], base[:5] * 1e-150, base[:5] * 1e140):
        assert _found(queries, vectors, ids) == _plain(queries, vectors, ids)
    for n in (1, K - 1, K, K + 1):
        assert _found(base[:3], vectors[:n], ids[:n]) == _plain(base[:3], vectors[:n], ids[:n])
