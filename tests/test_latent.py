"""Latent diagnostics, clustering math and the autoencoder gradient."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import autoencoder as ae
from basketry.operators import latent as lt
from basketry.operators import segments as seg
from basketry.operators.autoencoder import batch_loss_and_grads, init_layers


def points(spark, n=60, d=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    lab = rng.integers(0, 3, size=n)
    rows = [(i, [float(v) for v in x[i]], int(lab[i])) for i in range(n)]
    return spark.createDataFrame(rows, "user_id long, latent array<double>, label int"), x, lab


def test_q_and_p_rows_sum_to_one(spark):
    df, _, _ = points(spark)
    cents = seg.label_centroids(df, [0, 1, 2])
    scored = seg.target_distribution(seg.soft_assignment(df, cents), 3)
    sums = scored.select(F.aggregate("q", F.lit(0.0), lambda a, b: a + b).alias("sq"),
                         F.aggregate("p", F.lit(0.0), lambda a, b: a + b).alias("sp")).collect()
    for r in sums:
        assert r.sq == pytest.approx(1.0) and r.sp == pytest.approx(1.0)


def test_churn_of_equal_labels_is_zero(spark):
    df, _, _ = points(spark)
    lab = df.select("user_id", F.col("label").alias("cluster"))
    assert seg.label_churn(lab, lab).first().delta_label == 0.0


def test_silhouette_matches_brute_force(spark):
    df, x, lab = points(spark, n=40)
    lab[0] = 7  # a singleton cluster scores 0
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(lab)], "user_id long, cluster int")
    got = seg.silhouette_from_triples(seg.dense_triples(df), labels).first().silhouette
    d2 = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d2[i, own].sum() / (own.sum() - 1)
        b = min(d2[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(s))


def test_histogram_of_constant_values_is_one_bin(spark):
    vals = spark.createDataFrame([("m", 0.3)] * 10, "model string, value double")
    h = lt.histogram(vals, 5).collect()
    assert sum(r["count"] for r in h) == 10 and [r.bin for r in h if r["count"]] == [0]
    assert lt.latent_variance(vals).first().variance == 0.0


def test_histogram_skips_nulls_and_non_finite_values(spark):
    vals = spark.createDataFrame([("m", v) for v in (None, 1.0, 3.0, float("nan"), float("inf"))], "model string, value double")
    h = {r.bin: (r["count"], r.lo, r.hi) for r in lt.histogram(vals, 4).collect()}
    assert [h[b][0] for b in range(4)] == [1, 0, 0, 1] and h[3][2] == 3.0


def test_autoencoder_gradient_matches_finite_differences():
    rng = np.random.default_rng(1)
    x = rng.random((5, 6))
    layers = init_layers([(6, 6), (6, 3), (3, 6)], seed=2)
    r = 1e-3
    _, _, grads = batch_loss_and_grads(x, layers, r)
    w = layers[1][0]
    i, j, eps = 2, 1, 1e-6
    w[i, j] += eps
    up = batch_loss_and_grads(x, layers, r)[0]
    w[i, j] -= 2 * eps
    down = batch_loss_and_grads(x, layers, r)[0]
    w[i, j] += eps
    assert grads[1][0][i, j] == pytest.approx((up - down) / (2 * eps), rel=1e-4)


def test_dec_step_moves_against_gradient(spark):
    df, _, _ = points(spark)
    cents = seg.label_centroids(df, [0, 1, 2])
    scored = seg.target_distribution(seg.soft_assignment(df, cents), 3)
    grad = seg.centroid_gradient(scored, cents)
    new, _ = seg.dec_step(scored, cents)
    assert np.allclose(new, cents - seg.LEARNING_RATE * grad)


def test_dec_encoder_gradient_matches_finite_differences():
    from basketry.operators.autoencoder import dec_loss_and_grads
    rng = np.random.default_rng(4)
    x = rng.random((6, 5))
    enc = init_layers([(5, 4), (4, 3)], seed=3)
    mu = rng.random((2, 3))
    p = rng.random((6, 2))
    p /= p.sum(axis=1, keepdims=True)
    _, grads, dmu = dec_loss_and_grads(x, p, enc, mu, 1e-3)
    eps = 1e-6
    w = enc[0][0]
    w[1, 2] += eps
    up = dec_loss_and_grads(x, p, enc, mu, 1e-3)[0]
    w[1, 2] -= 2 * eps
    down = dec_loss_and_grads(x, p, enc, mu, 1e-3)[0]
    w[1, 2] += eps
    assert grads[0][0][1, 2] == pytest.approx((up - down) / (2 * eps), rel=1e-4)
    mu[1, 0] += eps
    up = dec_loss_and_grads(x, p, enc, mu, 1e-3)[0]
    mu[1, 0] -= 2 * eps
    down = dec_loss_and_grads(x, p, enc, mu, 1e-3)[0]
    mu[1, 0] += eps
    assert dmu[1, 0] == pytest.approx((up - down) / (2 * eps), rel=1e-4)


def test_silhouette_matches_mllib_squared_euclidean(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    df, _, lab = points(spark, n=80, d=5, seed=9)
    labels = df.select("user_id", F.col("label").alias("cluster"))
    ours = seg.silhouette_from_triples(seg.dense_triples(df), labels).first().silhouette
    vec = df.select(array_to_vector("latent").alias("features"), F.col("label").cast("double").alias("prediction"))
    mllib = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(vec)
    assert ours == pytest.approx(mllib, rel=1e-9)


def sparse_rows(spark, n=300, d=6, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        idx = sorted(rng.choice(d, size=3, replace=False).tolist())
        rows.append((i, idx, rng.random(3).tolist(), "validation" if i % 5 == 0 else "train"))
    return spark.createDataFrame(rows, "user_id long, indices array<int>, values array<double>, split string"), rows


def test_autoencoder_stops_by_patience_and_returns_the_best_weights(spark):
    from basketry.operators.autoencoder import fit_autoencoder, loss_and_gradient
    df, _ = sparse_rows(spark)
    res = fit_autoencoder(df, 6, [(6, 5), (5, 2), (2, 6)], 0.5, epochs=60, patience=2, batch_rows=32)
    val = [h[2] for h in res.history]
    assert res.best_epoch == int(np.argmin(val))
    assert len(res.history) == min(60, res.best_epoch + 3)
    n, loss, _, _ = loss_and_gradient(df.where("split = 'validation'"), res.layers, 6, 0.5)
    assert loss / n == pytest.approx(val[res.best_epoch])


def test_training_averages_tasks_by_rows(spark, monkeypatch):
    df, _ = sparse_rows(spark)
    monkeypatch.setattr(ae, "TASK_ROWS", 100)  # three tasks
    res = ae.fit_autoencoder(df, 6, [(6, 5), (5, 2), (2, 6)], 1e-4, epochs=8, batch_rows=32)
    assert len(res.history) == 8 and res.history[-1][1] < res.history[0][1]


def test_dec_loop_runs_to_its_stop_rule(spark):
    df, x, _ = points(spark, n=120, d=3)
    mu = x[:3].copy()
    centroids, labels, history = seg.dec_refine(df.select("user_id", "latent"), mu)
    assert history and history[-1][1] < 4e-5 and labels.count() == 120 and not np.allclose(centroids, mu)
    _, _, short = seg.dec_refine(df.select("user_id", "latent"), mu, max_steps=50)
    assert short == []


@pytest.mark.parametrize("tasks", [1, 3])
def test_dec_in_one_barrier_stage_takes_the_same_steps(spark, monkeypatch, tasks):
    df, x, _ = points(spark, n=300, d=3)
    df = df.select("user_id", "latent")
    monkeypatch.setattr(ae, "TASK_ROWS", -(-300 // tasks))
    status, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    done, jobs = {}, {}
    for barrier in (False, True):
        group = f"dec-{tasks}-{barrier}"
        sc.setJobGroup(group, group)
        done[barrier] = ae.dec_train(df, [], x[:3].copy(), 3, max_steps=300, tol=0.0, barrier=barrier)
        jobs[barrier] = len(status.getJobIdsForGroup(group))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert done[True].history == done[False].history and len(done[True].history) == 3
    np.testing.assert_allclose(done[True].centroids, done[False].centroids, rtol=0, atol=1e-12)
    assert jobs[True] <= 6 and jobs[False] >= 24  # two a round without a barrier
    empty = ae.dec_train(df.limit(0), [], x[:3].copy(), 3, barrier=True)
    assert empty.history == [] and np.array_equal(empty.centroids, x[:3])


def test_dec_with_too_many_tasks_for_one_stage_still_runs(spark, monkeypatch):
    df, x, _ = points(spark, n=120, d=3)
    monkeypatch.setattr(ae, "BARRIER_VALUES", 1)
    monkeypatch.setattr(ae, "_one_stage", None)
    done = ae.dec_train(df.select("user_id", "latent"), [], x[:3].copy(), 3, max_steps=50, barrier=True)
    assert done.centroids.shape == (3, 3)


def test_dense_silhouette_equals_the_sparse_one(spark):
    df, _, lab = points(spark, n=50, d=3, seed=2)
    labels = df.select("user_id", F.col("label").alias("cluster"))
    a = seg.silhouette_of_vectors(df, labels).first()[0]
    assert a == pytest.approx(seg.silhouette_from_triples(seg.dense_triples(df), labels).first()[0])


# ------------------------------------------- models that stay on executors --

def wide_rows(spark, n=300, d=11, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        idx = sorted(int(j) for j in rng.choice(d, size=rng.integers(0, 5), replace=False))
        rows.append((i, idx, [float(v) for v in rng.random(len(idx))], "validation" if i % 5 == 0 else "train"))
    return spark.createDataFrame(rows, "user_id long, indices array<int>, values array<double>, split string"), d


@pytest.fixture
def small_blocks(monkeypatch):
    """Blocks and tasks so small that layers, rows and centroids lie across several."""
    from basketry.operators import sharded as sh
    for module in (ae, sh):
        monkeypatch.setattr(module, "BLOCK", 16)
        monkeypatch.setattr(module, "TASK_ROWS", 120)
    return ae, sh


def test_glorot_blocks_are_the_sequential_draws(small_blocks):
    ae, sh = small_blocks
    shapes = [(5, 7), (7, 3), (3, 5)]
    want = ae._flatten(ae.init_layers(shapes, seed=3))
    assert sh.parameter_count(shapes) == want.size
    got = [sh.glorot_values(shapes, 3, lo, min(lo + 16, want.size)) for lo in range(0, want.size, 16)]
    assert (np.concatenate(got) == want).all()


def test_block_model_trains_as_the_driver_model(spark, small_blocks):
    """Several tasks, blocks across layers: the same history and weights to 1e-9, and the same weight table."""
    ae, sh = small_blocks
    rows, d = wide_rows(spark)
    shapes = [(d, d), (d, 4), (4, d)]
    args = dict(epochs=4, patience=3, seed=1, batch_rows=32)
    here = ae.fit_autoencoder(rows, d, shapes, 1e-4, **args)
    there = ae.fit_autoencoder(rows, d, shapes, 1e-4, driver_values=0, **args)
    assert here.layers is not None and there.layers is None and len(here.history) == len(there.history) == 4
    assert np.allclose(here.history, there.history, rtol=1e-9, atol=1e-12)
    layers, _ = lt.layers_from_table(ae.fitted_weights(spark, there))
    for (w, b), (w2, b2) in zip(here.layers, layers):
        assert np.allclose(w, w2, rtol=1e-9, atol=1e-12) and np.allclose(b, b2, rtol=1e-9, atol=1e-12)
    z1 = {r.user_id: r.latent for r in ae.encode_fitted(rows, here, d).collect()}
    z2 = {r.user_id: r.latent for r in ae.encode_fitted(rows, there, d).collect()}
    assert z1.keys() == z2.keys() and all(np.allclose(z1[u], z2[u], rtol=1e-9) for u in z1)


def test_block_model_runs_dec_as_the_driver_model(spark, small_blocks):
    ae, _ = small_blocks
    rows, d = wide_rows(spark)
    shapes = [(d, d), (d, 4), (4, d)]
    here = ae.fit_autoencoder(rows, d, shapes, 1e-4, epochs=2, batch_rows=32)
    there = ae.fit_autoencoder(rows, d, shapes, 1e-4, epochs=2, batch_rows=32, driver_values=0)
    mu = np.random.default_rng(0).random((3, 4))
    args = dict(max_steps=50, interval=25, check=25, batch_rows=32, lr=0.05, tol=-1.0)
    a, b = ae.dec_train(rows, here, mu, d, **args), ae.dec_train(rows, there, mu, d, **args)
    assert b.encoder is None and np.allclose(a.centroids, b.centroids, rtol=1e-9)
    assert len(a.history) == 2 and np.allclose(a.history, b.history)
    labels = [{r.user_id: r.cluster for r in ae.dec_labels(rows, x, d).collect()} for x in (a, b)]
    assert labels[0] == labels[1] and len(labels[0]) == 300


def test_early_stop_returns_the_best_epoch(spark, small_blocks):
    ae, _ = small_blocks
    rows, d = wide_rows(spark)
    fit = ae.fit_autoencoder(rows, d, [(d, d), (d, 3), (3, d)], 1e-3, epochs=6, patience=2, batch_rows=32, driver_values=0)
    assert fit.best_epoch == int(np.argmin([h[2] for h in fit.history]))


def test_dec_labels_of_the_round_before_only_where_a_check_looks(spark, monkeypatch):
    """A round's refresh reads the parameters of the round before at a check only, and the checks tell the same churn."""
    x = np.random.default_rng(3).normal(size=(60, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "user_id long, latent array<double>")
    values = []
    real = ae.student_t

    def here(rows, columns, value, size, work):
        values.append(0)
        return work(value, iter([rows.select(*columns).toPandas()]))

    def counted(*args):
        values[-1] += 1
        return real(*args)

    whole = ae.dec_train(df, [], x[:3].copy(), 4, max_steps=4, interval=1, check=2, tol=-1.0, lr=5.0)
    monkeypatch.setattr(ae, "summed", here)
    monkeypatch.setattr(ae, "student_t", counted)
    done = ae.dec_train(df, [], x[:3].copy(), 4, max_steps=4, interval=1, check=2, tol=-1.0, lr=5.0)
    assert values[::2] == [1, 1, 2, 1, 2]  # refreshes of steps 0 to 4; those of 2 and 4 are checks
    assert done.history == whole.history and [s for s, _ in done.history] == [2, 4]
    assert np.allclose(done.centroids, whole.centroids)
