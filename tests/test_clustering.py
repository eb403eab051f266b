"""Mixture and mean shift against plain versions."""

import math

import numpy as np
import pytest

from caseloom.operators import clustering as K
from caseloom.operators import embed as E


def blobs(n=500, d=2, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 6, (5, d))
    x = centres[r.integers(0, 5, n)] + r.normal(0, 1, (n, d))
    return [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, vec array<double>")


def plain_mean_shift(rows, h):
    x = np.array([v for _, v in rows])
    seeds = {tuple(np.round(v / h) * h): None for v in x}
    rest = {}
    for s in seeds:
        at = np.array(s)
        near = np.linalg.norm(x - at, axis=1) <= h
        if not near.any():  # the least point of the cell
            at = np.array(min(tuple(v) for v in x if tuple(np.round(v / h) * h) == s))
        while True:
            near = np.linalg.norm(x - at, axis=1) <= h
            new = x[near].mean(axis=0)
            done, at = np.linalg.norm(new - at) <= 1e-3 * h, new
            if done:
                break
        spot = tuple(np.round(at / (h / 100)))
        rest[spot] = max(rest.get(spot, (0, ())), (int(near.sum()), tuple(at)))
    kept = []
    for n, at in sorted(rest.values(), key=lambda m: (-m[0], m[1])):
        if all(math.dist(at, k) > h for k in kept):
            kept.append(at)
    return {i: int(np.argmin([math.dist(v, k) for k in kept])) for i, v in rows}


@pytest.mark.parametrize("d, h, tile", [(2, 2.0, 1024), (2, 1.0, 16), (5, 2.5, 1024)])
def test_mean_shift(spark, monkeypatch, d, h, tile):
    monkeypatch.setattr(K, "TILE", tile)
    rows = blobs(500 if tile > 16 else 200, d)
    rows += [(9000 + k, rows[0][1]) for k in range(30)]  # equal vectors
    got = {r["id"]: r["cluster"] for r in E.clusters(frame(spark, rows), "mean_shift", bandwidth=h).collect()}
    assert got == plain_mean_shift(rows, h)


def test_spherical_mixture(spark):
    r = np.random.default_rng(8)
    parts = [((0, 0), 0.3, 300), ((10, 0), 2.0, 300), ((0, 12), 1.0, 150)]
    x = np.vstack([r.normal(c, s, (n, 2)) for c, s, n in parts]) + 1e4
    df = frame(spark, [(int(i), [float(v) for v in row]) for i, row in enumerate(x)])
    model = K.fit_mixture(K._points(df), 3)
    assert all(b >= a - 1e-9 for a, b in zip(model.gains, model.gains[1:]))
    order = np.argsort(model.variances)
    assert np.allclose(np.sqrt(model.variances[order]), [0.3, 1.0, 2.0], rtol=0.12)
    assert np.allclose(model.weights[order], [0.4, 0.2, 0.4], atol=0.03)
    assert np.allclose(model.means[order] - 1e4, [(0, 0), (0, 12), (10, 0)], atol=0.4)
    # a step of plain expectation-maximisation from there changes next to nothing
    p = np.exp(model.log_chances(x))
    p /= p.sum(axis=1, keepdims=True)
    means = (p.T @ x) / p.sum(axis=0)[:, None]
    assert np.allclose(means, model.means, atol=0.05)
    got = {q["id"]: q["cluster"] for q in E.clusters(df, "gmm", k=3).collect()}
    assert len(got) == 750 and [len({got[i] for i in part}) for part in (range(300), range(600, 750))] == [1, 1]


def test_clusters_of_nothing_and_of_one_point(spark):
    for method in ("gmm", "mean_shift"):
        assert E.clusters(frame(spark, []), method, bandwidth=1.0).count() == 0
        got = E.clusters(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)]), method, k=1, bandwidth=1.0).collect()
        assert [(r["id"], r["cluster"]) for r in sorted(got)] == [(1, 0), (2, 0)]


def test_truncated_decomposition(spark):
    x = np.random.default_rng(2).normal(1, 2, (200, 7)) * np.arange(1, 8)
    df = frame(spark, [(int(i), [float(v) for v in row]) for i, row in enumerate(x)])
    got = np.array([r["vec"] for r in sorted(E.decompose(df, "svd", k=3).collect())])
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    want = u[:, :3] * s[:3]
    assert np.allclose(np.abs(got), np.abs(want), rtol=1e-6, atol=1e-6)
    v = vt[:3].T
    assert np.allclose(got, x @ (v * np.sign(v[np.abs(v).argmax(axis=0), range(3)])), rtol=1e-6, atol=1e-6)
    assert E.decompose(frame(spark, []), "svd").count() == 0
