"""Spectral clusters and their scores against dense computations."""

import numpy as np
import pytest

from tandem.operators import clusters as cl, spectral


def dense_embedding(w, k):
    root = np.sqrt(w.sum(axis=1))
    value, vector = np.linalg.eigh(w / root[:, None] / root[None, :])
    return vector[:, ::-1][:, :k] / root[:, None]


def dense_clusters(points):
    """Farthest points as seeds, then Lloyd's steps; points in the order of their names."""
    k = points.shape[1]
    far = lambda centres: ((points[:, None] - np.array(centres)[None]) ** 2).sum(axis=2).min(axis=1)
    last = lambda d: max(range(len(d)), key=lambda i: (d[i], i))
    centres = [points[last(far([points.mean(axis=0)]))]]
    while len(centres) < k:
        centres.append(points[last(far(centres))])
    for _ in range(100):
        own = ((points[:, None] - np.array(centres)[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = [points[own == i].mean(axis=0) if (own == i).any() else c for i, c in enumerate(centres)]
    return own


def groups(names, clusters):
    out = {}
    for n, c in zip(names, clusters):
        out.setdefault(c, set()).add(n)
    return sorted(map(sorted, out.values()))


def affinities(n, blobs, seed, spread):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(blobs, 3))[np.arange(n) % blobs] * 3 + rng.normal(size=(n, 3)) * spread
    return np.exp(-0.3 * ((at[:, None] - at[None]) ** 2).sum(axis=2))


def weights_of(spark, w):
    rows = [(f"S{i:03d}", f"S{j:03d}", float(w[i, j])) for i in range(len(w)) for j in range(i + 1, len(w))]
    return spark.createDataFrame(rows, "a string, b string, weight double")


def test_assignments_equal_a_dense_computation(spark):
    w = affinities(30, 5, 1, 0.3)
    got = spectral.spectral_clusters(weights_of(spark, w), [2, 3, 5, 8]).toPandas()
    assert sorted(set(got.asked_k)) == [2, 3, 5, 8] and len(got) == 120
    names = [f"S{i:03d}" for i in range(30)]
    for k in (2, 3, 5):
        mine = got[got.asked_k == k].sort_values("symbol")
        assert groups(mine.symbol, mine.cluster) == groups(names, dense_clusters(dense_embedding(w, k))), k
    assert got[got.asked_k == 8].cluster.nunique() == 8


def test_block_narrower_than_the_universe(spark, monkeypatch):
    monkeypatch.setattr(spectral, "EXTRA", 4)
    w = affinities(40, 4, 2, 0.4)
    got = spectral.embedding(weights_of(spark, w), 4).toPandas().sort_values("symbol")
    v, want = np.array(got.v.tolist()), dense_embedding(w, 4)
    sign = np.sign((v * want).sum(axis=0))
    assert v * sign == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("width", [4, 24])
def test_a_block_as_wide_as_the_universe_takes_one_product(spark, monkeypatch, width):
    names, written = [], spectral.written
    monkeypatch.setattr(spectral, "written", lambda df, name: names.append(name) or written(df, name))
    w = affinities(25, 25, 1, 0.3)
    got = spectral.embedding(weights_of(spark, w), width, rounds=3).toPandas().sort_values("symbol")
    v, want = np.array(got.v.tolist()), dense_embedding(w, width)
    assert v * np.sign((v * want).sum(axis=0)) == pytest.approx(want, abs=1e-6)
    assert names.count("block") == 1


def test_more_clusters_than_points_and_nothing(spark):
    rows = [("A", "B", 1.0), ("A", "C", 1e-9), ("B", "C", 1e-9)]
    df = spark.createDataFrame(rows, "a string, b string, weight double")
    got = spectral.spectral_clusters(df, [2, 6]).toPandas()
    assert len(got) == 6 and groups(*[got[got.asked_k == 2][c] for c in ("symbol", "cluster")]) == [["A", "B"], ["C"]]
    assert spectral.spectral_clusters(df.where("false"), [2]).count() == 0


def test_scores_of_many_k_are_those_of_each(spark):
    from datetime import datetime
    rng = np.random.default_rng(3)
    rows = [(f"S{i}", datetime(2024, 1, 1 + t), *map(float, rng.normal(size=4) + 3 * (i % 3))) for i in range(9) for t in range(5)]
    f = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, r_open double, r_high double, r_low double, r_close double")
    d = cl.squared_distances(f)
    all_k = {r.asked_k: r for r in cl.best_k(f, d, [2, 3], 0.05).collect()}
    assert set(all_k) == {2, 3}
    x = np.array([r[2:] for r in rows]).reshape(9, -1)
    own = np.arange(9) % 3
    mean = x.mean(axis=0)
    centre = np.array([x[own == c].mean(axis=0) for c in range(3)])
    b = sum(3 * ((centre[c] - mean) ** 2).sum() for c in range(3)) / 2
    within = ((x - centre[own]) ** 2).sum() / 6
    assert all_k[3].k == 3 and all_k[3].calinski_harabasz == pytest.approx(b / within) and all_k[3].size_ratio == 1
