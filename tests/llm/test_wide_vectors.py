"""Bounds in bytes: wide vectors make smaller blocks and samples, with the same links."""

import numpy as np
from heatgrid.llm import pivots


def test_wide_vectors_against_brute_force(spark, monkeypatch):
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 700))
    x = np.concatenate([base, base + 0.25 * r.normal(size=base.shape), base[:20] + 0.4 * r.normal(size=(20, 700))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(pivots, "BLOCK_BYTES", 700 * 8 * 25)  # 25 vectors a block
    monkeypatch.setattr(pivots, "SAMPLE_BYTES", 700 * 8 * 40)
    got = {q.vec_id: (q.n_links, q.component_id) for q in pivots.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    assert [got[i][0] for i in range(len(x))] == near.sum(1).tolist()
    for i in range(len(x)):
        seen, front = {i}, [i]
        while front:
            front = [int(j) for f in front for j in np.flatnonzero(near[f]) if j not in seen and not seen.add(int(j))]
        assert got[i][1] == min(seen)
