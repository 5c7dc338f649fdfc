"""Euclidean silhouette: exact against brute force, sampled within its own standard error."""

import numpy as np
import pytest

from basketry.operators.silhouette import silhouette_euclidean


def brute(x, lab):
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab.tolist()) if c != lab[i])
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def frames(spark, x, lab):
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "user_id long, latent array<double>")
    return rows.repartition(3), spark.createDataFrame([(i, int(c)) for i, c in enumerate(lab)], "user_id long, cluster int")


def data(n, seed):
    rng = np.random.default_rng(seed)
    lab = rng.choice(4, size=n, p=[0.7, 0.2, 0.09, 0.01])
    x = rng.normal(size=(n, 6)) + 2.0 * rng.normal(size=(4, 6))[lab]
    x[::50] *= 8  # far rows
    return x, lab


def test_exact_for_small_clusters(spark):
    x, lab = data(120, 1)
    lab[5] = 9  # alone in its cluster
    x[7] = x[8]
    r = silhouette_euclidean(*frames(spark, x, lab)).first()
    assert r.exact and r.standard_error == 0 and r.sampled == r.users == 120
    assert r.silhouette == pytest.approx(brute(x, lab), abs=1e-9)


def test_sampled_is_within_its_error(spark):
    x, lab = data(1500, 2)
    want = brute(x, lab)
    got = [silhouette_euclidean(*frames(spark, x, lab), sample=60, seed=s).first() for s in range(4)]
    assert all(not r.exact and r.sampled < 600 and 0 < r.standard_error < 0.1 for r in got)
    assert all(abs(r.silhouette - want) < 4 * r.standard_error + 1e-3 for r in got)
    larger = silhouette_euclidean(*frames(spark, x, lab), sample=400, seed=1).first()
    assert larger.standard_error < np.mean([r.standard_error for r in got])


def test_sparse_rows_and_one_cluster(spark):
    rows = spark.createDataFrame([(1, [0], [1.0]), (2, [0, 2], [1.0, 2.0]), (3, [], []), (4, [1], [3.0])],
                                 "user_id long, indices array<int>, values array<double>")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "user_id long, cluster int")
    x = np.array([[1, 0, 0], [1, 0, 2], [0, 0, 0], [0, 3, 0]], dtype=float)
    assert silhouette_euclidean(rows, labels, d=3).first().silhouette == pytest.approx(brute(x, np.array([0, 0, 1, 1])))
    with pytest.raises(ValueError):
        silhouette_euclidean(rows, labels.where("cluster = 0"), d=3)
