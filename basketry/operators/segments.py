"""Clustering of latent user vectors as Spark jobs.

Data stays on the executors; the driver holds model parameters only
(k centroids of d values, k cluster totals), the way MLlib's iterative
estimators do.

* Soft assignment (Student-t kernel, alpha = 1), target distribution,
  KL objective, hard labels and label churn are column expressions over a
  per-user ``array<double>``; the centroids enter as literals.
* One DEC step is one full-data gradient pass; the loop runs one job per
  round of mini-batches (``autoencoder.dec_train``).
* k-means (``kmeans``) advances all k and restarts (sklearn ``n_init``)
  together: one pass over the rows per iteration.
* The silhouette is the squared-Euclidean form, linear in the number of
  users: with per-cluster n, sum vector S and sum of squared norms Q, the
  total squared distance of x to cluster c is ``n_c |x|^2 - 2 x.S_c + Q_c``.
  The Euclidean (non-squared) silhouette needs every pair of users and is
  not built (README).
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import squared_distance
from ..sources.storage import materialize
from .autoencoder import dec_loss_and_grads, dec_train, summed
from .joins import broadcast_if_within
from .kmeans import best_of, fit_many

ALPHA = 1.0                   # fixed value: Student-t degrees of freedom
KLD_EPSILON = 1e-7            # fixed value: Keras clips p and q to [1e-7, 1] in 'kld'
LEARNING_RATE = 1e-4          # fixed values of the DEC optimiser (SGD with momentum)
MOMENTUM = 0.1
UPDATE_INTERVAL = 25
CHURN_CHECK_INTERVAL = 100
TOLERANCE = 4e-5
N_CLUSTERS = 3
ELBOW_KS = tuple(range(1, 15))
N_INIT = 10
KMEANS_ITERATIONS = 300       # fixed value: the library's own limit, which the reference leaves in force
SUMS_ROWS = 5_000_000         # per-cluster sum vectors, k × d


def _lit_vec(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


# ------------------------------------------------------------- centroids --

def label_centroids(points: DataFrame, labels: list[int], label_col: str = "label") -> np.ndarray:
    """Mean vector of the rows of each label (fixture centroids); k × d parameters."""
    d = points.select(F.size(F.col("latent")).alias("d")).first()["d"]
    agg = points.where(F.col(label_col).isin(labels)).groupBy(label_col).agg(
        *[F.avg(F.col("latent")[i]).alias(f"c{i}") for i in range(d)]).collect()
    by_label = {r[label_col]: [r[f"c{i}"] for i in range(d)] for r in agg}
    return np.array([by_label[lab] for lab in labels], dtype=float)


# ------------------------------------------------------ soft assignment --

def soft_assignment(points: DataFrame, centroids: np.ndarray, alpha: float = ALPHA) -> DataFrame:
    """Adds ``q array<double>``: Student-t similarity to each centroid, rows sum to 1."""
    kernels = []
    for c in centroids:
        d2 = squared_distance(F.col("latent"), _lit_vec(c))
        kernels.append(F.pow(F.lit(1.0) / (F.lit(1.0) + d2 / F.lit(alpha)), F.lit((alpha + 1.0) / 2.0)))
    raw = F.array(*kernels)
    return points.withColumn("__k", raw).withColumn(
        "q", F.transform("__k", lambda v: v / F.aggregate("__k", F.lit(0.0), lambda a, b: a + b))
    ).drop("__k")


def cluster_totals(assigned: DataFrame, k: int, col: str = "q") -> np.ndarray:
    """``f_j = sum_i q_ij`` — k numbers."""
    row = assigned.agg(*[F.sum(F.col(col)[j]).alias(f"f{j}") for j in range(k)]).first()
    return np.array([row[f"f{j}"] for j in range(k)], dtype=float)


def target_distribution(assigned: DataFrame, k: int) -> DataFrame:
    """Adds ``p``: ``(q^2 / f_j) / sum_j' (q^2 / f_j')``."""
    f = cluster_totals(assigned, k)
    w = F.array(*[F.col("q")[j] * F.col("q")[j] / F.lit(float(f[j])) for j in range(k)])
    return assigned.withColumn("__w", w).withColumn(
        "p", F.transform("__w", lambda v: v / F.aggregate("__w", F.lit(0.0), lambda a, b: a + b))
    ).drop("__w")


def kl_terms(p: Column, q: Column, eps: float = KLD_EPSILON) -> Column:
    """``sum_j p ln(p / q)`` with Keras' clipping of both to [eps, 1]."""
    clip = lambda c: F.least(F.greatest(c, F.lit(eps)), F.lit(1.0))
    return F.aggregate(F.zip_with(p, q, lambda a, b: clip(a) * F.log(clip(a) / clip(b))),
                       F.lit(0.0), lambda acc, v: acc + v)


def kl_loss(scored: DataFrame) -> DataFrame:
    """Mean KL(P || Q) over users, one row."""
    return scored.agg(F.avg(kl_terms(F.col("p"), F.col("q"))).alias("kl_loss"))


def hard_labels(assigned: DataFrame, col: str = "q") -> DataFrame:
    """``argmax`` per row, lowest index on ties."""
    return assigned.withColumn(
        "cluster", (F.array_position(F.col(col), F.array_max(F.col(col))) - 1).cast("int"))


def label_churn(before: DataFrame, after: DataFrame) -> DataFrame:
    """Share of users whose label changed."""
    joined = before.select("user_id", F.col("cluster").alias("a")).join(
        after.select("user_id", F.col("cluster").alias("b")), "user_id")
    return joined.agg(F.avg((F.col("a") != F.col("b")).cast("double")).alias("delta_label"))


def long_assignments(scored: DataFrame, cols=("q", "p")) -> DataFrame:
    """``(user_id, cluster, q[, p])`` — one row per user and cluster."""
    present = [c for c in cols if c in scored.columns]
    z = F.arrays_zip(*[F.col(c) for c in present])
    return scored.select("user_id", F.posexplode(z).alias("cluster", "s")).select(
        "user_id", F.col("cluster").cast("int").alias("cluster"), *[F.col(f"s.{c}").alias(c) for c in present])


def mean_assignment(scored: DataFrame) -> DataFrame:
    """``np.mean(q, axis=0)`` and the same for p, per cluster."""
    return long_assignments(scored).groupBy("cluster").agg(F.avg("q").alias("mean_q"), F.avg("p").alias("mean_p"))


# ------------------------------------------------------------------ DEC --

def centroid_gradient(scored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """``dL/dmu_j`` of the mean KL loss over the rows of ``scored`` (needs ``latent``, ``p``).

    ``-((a+1)/a) (1/n) sum_i (1 + |z_i - mu_j|^2 / a)^-1 (p_ij - q_ij) (z_i - mu_j)``, a = 1
    (Xie, Girshick and Farhadi, 2016), with q recomputed from the current
    centroids. One full-data pass; the tasks' k × d sums are added up on the
    executors.
    """
    def work(mu, batches):
        acc = np.zeros(1 + mu.size)
        for pdf in batches:
            if len(pdf):
                _, _, grad = dec_loss_and_grads(np.stack(pdf["latent"].to_numpy()), np.stack(pdf["p"].to_numpy()),
                                                [], mu, 0.0)
                acc[0] += len(pdf)
                acc[1:] += grad.ravel()
        return acc if acc[0] else None

    centroids = np.asarray(centroids, dtype=float)
    total = summed(scored, ["latent", "p"], centroids, 1 + centroids.size, work)
    return total[1:].reshape(centroids.shape) / max(total[0], 1.0)


def dec_step(scored: DataFrame, centroids: np.ndarray, velocity: np.ndarray | None = None,
             lr: float = LEARNING_RATE, momentum: float = MOMENTUM):
    """One SGD-with-momentum update of the centroids (Keras ``SGD``)."""
    grad = centroid_gradient(scored, centroids)
    v = (momentum * velocity if velocity is not None else 0.0) - lr * grad
    return centroids + v, v


def centroid_frame(spark, centroids: np.ndarray) -> DataFrame:
    rows = [(int(j), int(i), float(centroids[j, i])) for j in range(centroids.shape[0])
            for i in range(centroids.shape[1])]
    return spark.createDataFrame(rows, "cluster int, dim int, value double")


def dec_refine(points: DataFrame, centroids: np.ndarray, **limits) -> tuple[np.ndarray, DataFrame, list]:
    """DEC on fixed latent vectors ``(user_id, latent)``: ``dec_train`` without an encoder.

    ``limits`` are those of ``dec_train``. Returns ``(centroids, labels, history)``.
    """
    done = dec_train(points, [], np.asarray(centroids, dtype=float), centroids.shape[1], **limits)
    labels = hard_labels(soft_assignment(points, done.centroids)).select("user_id", "cluster")
    return done.centroids, labels, done.history


# --------------------------------------------------------------- k-means --

def as_vectors(points: DataFrame) -> DataFrame:
    return points.select("user_id", array_to_vector("latent").alias("features"))


def inertia_k1(points: DataFrame) -> DataFrame:
    """k = 1 cost ``sum |x - mean|^2`` as a one-row frame (MLlib rejects k = 1).

    The d means are model parameters: collected once, then used as literals.
    """
    d = points.select(F.size("latent")).first()[0]
    means = points.agg(*[F.avg(F.col("latent")[i]).alias(f"m{i}") for i in range(d)]).first()
    center = _lit_vec([means[f"m{i}"] for i in range(d)])
    return points.agg(F.sum(squared_distance(F.col("latent"), center)).alias("inertia"))


def total_sum_of_squares(points: DataFrame) -> float:
    return float(inertia_k1(points).first()["inertia"])


def elbow(points: DataFrame, ks=ELBOW_KS, n_init: int = N_INIT, max_iter: int = KMEANS_ITERATIONS) -> DataFrame:
    """Within-cluster sum of squares for each k, best of ``n_init`` restarts (C1); all models in one pass an iteration.

    One centre has no restarts: its k-means is the mean.
    """
    best = best_of(fit_many(points, [(k, s) for k in ks for s in range(n_init if k > 1 else 1)], max_iter))
    return points.sparkSession.createDataFrame([(int(k), float(best[k].cost)) for k in ks], "k int, inertia double")


def kmeans_segments(points: DataFrame, k: int = N_CLUSTERS, n_init: int = N_INIT,
                    max_iter: int = KMEANS_ITERATIONS) -> tuple[DataFrame, np.ndarray]:
    """``KMeans(k, n_init).fit_predict``: labels and centroids of the cheapest restart."""
    centers = best_of(fit_many(points, [(k, s) for s in range(n_init)], max_iter))[k].centres
    labels = hard_labels(soft_assignment(points, centers)).select("user_id", "cluster")
    return labels, centers


# ------------------------------------------------------------ silhouette --

def silhouette_of_vectors(points: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean squared-Euclidean silhouette of dense rows ``(user_id, latent)``.

    Per cluster the size, the sum vector and the sum of squared norms (k × d
    numbers) come from one array pass; a second pass scores every user against
    the clusters. Singleton clusters score 0.
    """
    rows = materialize(points.select("user_id", "latent").join(labels, "user_id"), "silhouette_rows")

    def norm(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x)

    d = rows.select(F.max(F.size("latent"))).first()[0] or 0
    stats = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(norm(F.col("latent"))).alias("q"),
        F.array(*(F.sum(F.get("latent", F.lit(i))) for i in range(d))).alias("s")).collect()
    own_n = own_total = F.lit(None).cast("double")
    others = []
    for r in stats:  # k clusters of d sums, the size of the centroids
        dot = F.aggregate(F.zip_with("latent", _lit_vec(r["s"]), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        total = F.lit(float(r["n"])) * norm(F.col("latent")) - 2 * dot + F.lit(float(r["q"]))
        own = F.col("cluster") == r["cluster"]
        own_n = F.when(own, F.lit(float(r["n"]))).otherwise(own_n)
        own_total = F.when(own, total).otherwise(own_total)
        others.append(F.when(~own, total / F.lit(float(r["n"]))))
    a = own_total / (own_n - 1)
    b = F.array_min(F.array(*others))
    score = F.when(own_n <= 1, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    return rows.agg(F.avg(score).alias("silhouette"))


def silhouette_from_triples(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """Mean squared-Euclidean silhouette of sparse rows ``(user_id, idx, value)``.

    Singleton clusters score 0. Linear time: per-cluster sums are a k × d
    table (broadcast), every user meets its own k clusters only.
    """
    t = triples.join(labels, "user_id")
    sums = t.groupBy("cluster", "idx").agg(F.sum("value").alias("s"))
    norms = t.groupBy("user_id", "cluster").agg(F.sum(F.col("value") * F.col("value")).alias("nx"))
    sizes = norms.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_c"), F.sum("nx").alias("q_c"))
    clusters = sorted(r[0] for r in labels.select("cluster").distinct().collect())  # k labels
    dots = triples.join(broadcast_if_within(sums.withColumnRenamed("cluster", "other"), SUMS_ROWS), "idx") \
        .groupBy("user_id", "other").agg(F.sum(F.col("value") * F.col("s")).alias("xs"))
    pairs = norms.select("user_id", "cluster", "nx",
                         F.explode(F.array(*[F.lit(c) for c in clusters])).alias("other"))
    dist = pairs.join(dots, ["user_id", "other"], "left") \
        .join(F.broadcast(sizes.withColumnRenamed("cluster", "other")), "other") \
        .select("user_id", "cluster", "other", "n_c",
                (F.col("n_c") * F.col("nx") - 2 * F.coalesce(F.col("xs"), F.lit(0.0)) + F.col("q_c"))
                .alias("total"))
    per_user = dist.groupBy("user_id", "cluster").agg(
        F.max(F.when(F.col("other") == F.col("cluster"), F.col("n_c"))).alias("own_n"),
        F.max(F.when(F.col("other") == F.col("cluster"), F.col("total"))).alias("own_total"),
        F.min(F.when(F.col("other") != F.col("cluster"), F.col("total") / F.col("n_c"))).alias("b"))
    a = F.col("own_total") / (F.col("own_n") - 1)
    s = F.when(F.col("own_n") <= 1, F.lit(0.0)).otherwise(
        (F.col("b") - a) / F.greatest(a, F.col("b")))
    return per_user.agg(F.avg(s).alias("silhouette"))


def dense_triples(points: DataFrame) -> DataFrame:
    return points.select("user_id", F.posexplode("latent").alias("idx", "value"))


# ------------------------------------------------------------------- map --

def latent_map_2d(points: DataFrame, labels: DataFrame) -> DataFrame:
    """2-D map of users with their label: PCA (re-aimed from t-SNE).

    Sign convention: each component's largest-magnitude loading is positive.
    """
    vectors = as_vectors(points)
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(vectors)
    pcs = model.pc.toArray()
    signs = [1.0 if pcs[np.argmax(np.abs(pcs[:, c])), c] >= 0 else -1.0 for c in range(2)]
    proj = model.transform(vectors).select("user_id", vector_to_array("pc").alias("pc"))
    return proj.join(labels, "user_id").select(
        "user_id", (F.col("pc")[0] * F.lit(signs[0])).alias("dim1"),
        (F.col("pc")[1] * F.lit(signs[1])).alias("dim2"), "cluster")


__all__ = [n for n in dir() if not n.startswith("_")]
