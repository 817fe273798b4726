import numpy as np
import pytest

from heatgrid.llm import pivots

ROWS = "vec_id long, embedding array<float>, N_Links string"


def brute(rows, threshold=0.9):
    units = []
    size = max(len(e or ()) for _, e in rows)
    for _, e in rows:
        ok = e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)
        v = np.zeros(size)
        if ok:
            v[: len(e)] = np.array(e, np.float32).astype(float)
            units.append(v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()))
        else:
            units.append(None)
    n, label = len(rows), list(range(len(rows)))
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if units[i] is not None and units[j] is not None and units[i] @ units[j] >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    ids = {}
    for (v, _), c in zip(rows, label, strict=True):
        ids.setdefault(c, []).append(v)
    return {v: (k, min(x for x in ids[c] if x is not None)) for (v, _), k, c in zip(rows, links, label, strict=True) if v is not None}


def made(n=500, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 5, dim))
    near = base[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.12
    rows = [(i * 2, v.tolist()) for i, v in enumerate(np.vstack([base, near]).astype(np.float32))]
    return rows + [(5001 + 2 * i, rows[3][1]) for i in range(30)]


ODD = [(1, None), (3, [0.0] * 16), (7, [float("nan")] * 16), (9, [float("inf")] + [1.0] * 15), (11, [None] + [1.0] * 15), (13, [1e-30] * 16), (15, [1e30] * 16), (17, [1.0, 1.0]), (19, []), (21, [2.0, 2.0] + [0.0] * 14)]


@pytest.mark.parametrize(("list_rows", "block_rows"), [(pivots.LIST_ROWS, pivots.BLOCK_ROWS), (20, 60), (3, 20)])
def test_links_and_components_against_brute_force(spark, monkeypatch, list_rows, block_rows):
    monkeypatch.setattr(pivots.links, "__defaults__", (list_rows, block_rows))
    rows = made() + ODD
    frame = spark.createDataFrame([(*r, "x") for r in rows], ROWS).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.similar_vectors(frame).collect()}
    want = brute(rows)
    assert all(got[v][0] <= want[v][0] for v in want)  # none below the threshold, none twice
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert np.mean([got[v] == want[v] for v in want]) >= 0.9
    assert got[13] == want[13] and got[17] == want[17] and got[3] == (0, 3)


def test_recall_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    x = np.array([e for _, e in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = ((x @ x.T >= 0.9).sum(1) - 1).tolist()
    got = {r.vec_id: r.n_links for r in pivots.similar_vectors(frame).collect()}
    assert sum(got.values()) >= 0.9 * sum(links) and all(got[v] <= n for (v, _), n in zip(rows, links, strict=True))


@pytest.mark.parametrize("n_pivots", [200, 2000, 4096])
def test_pairs_at_the_threshold_share_two_near_pivots(n_pivots):
    rng = np.random.default_rng(11)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    u, w = unit(rng.normal(size=(500, 64))), rng.normal(size=(500, 64))
    v = 0.9 * u + np.sqrt(0.19) * unit(w - (w * u).sum(1)[:, None] * u)
    reference = unit(rng.normal(size=(n_pivots, 64)))
    k = pivots.n_nearest(n_pivots)
    a, b = (pivots.nearest_pivots(x, reference, k) for x in (u, v))
    assert np.mean([len({*x} & {*y}) >= 2 for x, y in zip(a.tolist(), b.tolist(), strict=True)]) >= 0.985


def test_few_rows(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], ""), (2, [1.0, 0.0], ""), (None, [1.0, 0.0], ""), (2, [1.0, 0.0], "")], ROWS)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in pivots.similar_vectors(frame).collect()), key=str)
    assert got == sorted([(1, 3, 1), (2, 3, 1), (2, 3, 1), (None, 3, 1)], key=str)
    assert pivots.similar_vectors(frame.limit(0)).count() == 0


def test_vectors_of_one_cluster(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=16)
    for n in (2, 3, 300):
        rows = [(i, (base + rng.normal(size=16) * 0.35).astype(np.float32).tolist()) for i in range(n)]
        want = brute(rows)
        got = {r.vec_id: r.n_links for r in pivots.similar_vectors(spark.createDataFrame([(*r, "") for r in rows], ROWS)).collect()}
        assert all(got[v] <= want[v][0] for v in want) and sum(got.values()) >= 0.9 * sum(k for k, _ in want.values())
