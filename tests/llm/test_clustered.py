"""Graphs over vectors in tight groups that are larger than the search beam."""

import numpy as np

from corvine.llm import ann


def test_recall_on_clustered_vectors():
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(30, 64)), 100, axis=0) + 0.02 * rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y, graph, start = ann.build(x)
    ids, _ = ann.greedy(y, graph, start, y[::10], ann.BEAM)
    best = np.argsort(-(x[::10] @ x.T), axis=1, kind="stable")[:, :20]
    assert np.mean([len(set(a[:20].tolist()) & set(b.tolist())) / 20 for a, b in zip(ids, best, strict=True)]) >= 0.95
