"""Packed rows: the same rows in the same order, without an object per row, and the same results from them."""

import numpy as np
import pandas as pd

from basketry.operators import autoencoder as ae
from basketry.operators import kmeans as km
from basketry.operators import packed as pk
from basketry.operators import silhouette as sil


def _sparse(n=50, d=7, seed=3):
    rng = np.random.default_rng(seed)
    idx = [np.sort(rng.choice(d, size=rng.integers(0, 5), replace=False)) for _ in range(n)]
    return pd.DataFrame({"user_id": np.arange(n) + 2 ** 60, "indices": idx, "values": [rng.random(len(i)) for i in idx],
                         "split": np.where(np.arange(n) % 5 == 0, "validation", "train")})


def _dense(pdf, d):
    x = np.zeros((len(pdf), d))
    for i, (at, v) in enumerate(zip(pdf["indices"], pdf["values"])):
        x[i, at] = v
    return x


def test_chunks_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(pk, "CHUNK_ROWS", 6)
    monkeypatch.setattr(pk, "CHUNK_CELLS", 9)
    pdf = _sparse()
    chunks = list(pk.unpack(pk.pack(iter([pdf.iloc[:20], pdf.iloc[20:20], pdf.iloc[20:]]))))
    for train, name in ((True, "train"), (False, "validation")):
        own = [c for c in chunks if c.train == train]
        want = pdf[pdf["split"] == name]
        assert np.concatenate([c.keys for c in own]).tolist() == want["user_id"].tolist()
        assert np.array_equal(np.vstack([c.dense(7) for c in own]), _dense(want, 7))
        assert max(map(len, own)) <= 6
    batches = list(pk.minibatches((c for c in chunks if c.train), 16))
    assert [len(b) for b in batches] == [16, 16, 8]
    assert np.array_equal(np.vstack([b.dense(7) for b in batches]), _dense(pdf[pdf["split"] == "train"], 7))


def test_loops_read_chunks_not_rows(spark, monkeypatch):
    monkeypatch.setattr(pk, "CHUNK_ROWS", 16)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r], i) for i, r in enumerate(x)],
                               "user_id long, latent array<double>, deal long")
    rows = ae.dealt_rows(df, ["deal"], "packed_test")
    assert rows.columns == pk.COLUMNS and rows.count() < 30
    models = [x[:3].copy(), x[5:7].copy()]
    for (a, n, c), (a2, n2, c2) in zip(km.lloyd_sums(df, models), km.lloyd_sums(rows, models)):
        assert np.allclose(a, a2) and np.array_equal(n, n2) and np.isclose(c, c2)


def test_silhouette_passes_compute_distances_inside_clusters_only():
    where, where0 = np.array([0, 1, 0, 2]), np.array([1, 0, 1])
    pairs = {(int(i), int(j)) for at, cols in sil._own(where, where0) for i in at for j in cols}
    assert pairs == {(0, 1), (2, 1), (1, 0), (1, 2)}
