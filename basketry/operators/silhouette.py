"""Euclidean silhouette with a standard error, linear in the number of rows (C14).

The silhouette needs, for every row and cluster, the sum of its distances to
the cluster's rows. A cluster of more than ``sample`` rows answers from a
sample drawn with probability proportional to size (Altieri et al., 2021):
rows are first drawn evenly; then every row is drawn with probability
``sample * max(1 / n, its largest share in a first-drawn row's distance sum)``, so that far rows,
which carry the sums, are in, and counts with the inverse of its probability.
Smaller clusters are taken whole. If all are, the result is exact.

The standard error is that of the draw: the sum over sampled rows of
``(1 - p) (y / p)^2``, ``y`` being the derivative of the mean silhouette by the
row's weight (Horvitz-Thompson estimate, linearised).

Four passes over the rows (sizes, first draw, distance sums, second draw) and
one that scores; the driver and the tasks hold about two samples per cluster,
whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import drop_written, materialize
from .autoencoder import summed
from .kmeans import uniform
from .latent import _dense_batch

SAMPLE = 1024                 # expected sampled rows of a larger cluster, about
CELLS = 1 << 19               # cells of one block of distances (4 MB, which a core's cache holds)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    own = (x * x).sum(axis=1)[:, None]
    d2 = x @ y.T
    d2 *= -2.0
    d2 += own
    d2 += (y * y).sum(axis=1)[None, :]
    d2[d2 < 1e-13 * own] = 0.0  # the same vector, up to rounding
    return np.sqrt(np.maximum(d2, 0.0, out=d2), out=d2)


def _own(where: np.ndarray, where0: np.ndarray):
    """(rows, sampled rows) of each cluster that has both: only their distances are wanted."""
    for c in np.unique(where):
        cols = np.flatnonzero(where0 == c)
        if len(cols):
            yield np.flatnonzero(where == c), cols


def _blocks(batches: Iterator[pd.DataFrame], width: int, d: int | None):
    """(user ids, clusters, dense rows) in blocks of bounded distance matrices."""
    step = max(1, CELLS // max(width, d or 1))
    for pdf in batches:
        for lo in range(0, len(pdf), step):
            part = pdf.iloc[lo:lo + step]
            x = np.stack(part["latent"].to_numpy()) if d is None else _dense_batch(part, d)
            yield part["user_id"].to_numpy(), part["place"].to_numpy(), x


def silhouette_euclidean(rows: DataFrame, labels: DataFrame, d: int | None = None, sample: int = SAMPLE,
                         seed: int = 0) -> DataFrame:
    """Mean Euclidean silhouette of ``rows`` by ``labels`` (user_id, cluster), with its standard error.

    ``rows``: (user_id, latent), or sparse (user_id, indices, values) of width
    ``d``. One row: silhouette, standard_error, users, sampled, exact. Rows
    alone in their cluster score 0; fewer than two clusters are an error, as in
    the reference's library; rows without a label do not count.
    """
    columns = ["latent"] if d is None else ["indices", "values"]
    spark = rows.sparkSession
    joined = rows.select("user_id", *columns).join(labels.select("user_id", "cluster"), "user_id")
    sizes = {r["cluster"]: r["n"] for r in joined.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        raise ValueError("a silhouette needs at least two clusters")
    names = sorted(sizes)
    n = np.array([sizes[c] for c in names], dtype=float)
    place = F.create_map(*(F.lit(x) for i, c in enumerate(names) for x in (c, i)))[F.col("cluster")]
    data = materialize(joined.select("user_id", *columns, place.cast("int").alias("place")), "silhouette_rows")
    read = ["user_id", "place", *columns]

    def drawn(chance, draw: int):
        """Rows that ``chance(user ids, places, rows)`` (a probability each) draws: places, probabilities, vectors."""
        def run(batches):
            for ids, where, x in _blocks(batches, 4 * sample, d):
                p = chance(ids, where, x)
                take = np.flatnonzero(uniform(ids, seed, draw) < p)
                if len(take):
                    yield pd.DataFrame({"user_id": ids[take], "place": where[take], "p": p[take],
                                        "x": list(x[take])})
        got = data.select(*read).mapInPandas(run, "user_id long, place int, p double, x array<double>") \
            .orderBy("user_id").collect()
        return (np.array([r["place"] for r in got], dtype=int), np.array([r["p"] for r in got]),
                np.array([r["x"] for r in got]))

    even = np.minimum(1.0, sample / n)
    share = None
    if (even < 1.0).any():
        first_place, _, first_x = drawn(lambda ids, where, x: np.where(even[where] < 1.0, even[where], 0.0), 0)

        def sums(value, batches):
            where0, x0 = value
            out, seen = np.zeros(len(where0)), False
            for _, where, x in _blocks(batches, len(where0), d):
                seen = True
                for at, cols in _own(where, where0):
                    out[cols] += _distances(x[at], x0[cols]).sum(axis=0)
            return out if seen else None

        share = (first_place, first_x, summed(data, read, (first_place, first_x), len(first_place), sums))

    def chance(ids, where, x):
        p = np.ones(len(ids))
        if share is not None:
            where0, x0, total = share
            part = np.zeros(len(ids))
            for at, cols in _own(where, where0):
                part[at] = (_distances(x[at], x0[cols]) / np.maximum(total[cols], 1e-300)).max(axis=1)
            p = np.where(even[where] < 1.0, np.minimum(1.0, sample * np.maximum(part, 1.0 / n[where])), 1.0)
        return p

    s_place, s_p, s_x = drawn(chance, 1)
    k = len(names)
    member = np.zeros((len(s_place), k))
    member[np.arange(len(s_place)), s_place] = 1.0 / s_p

    def score(value, batches):
        where_s, weight, xs = value
        out, seen = np.zeros(2 + len(where_s)), False
        for _, where, x in _blocks(batches, len(where_s), d):
            seen = True
            dist = _distances(x, xs)
            total = dist @ weight                                   # estimated distance sums per cluster
            at = np.arange(len(x))
            own = n[where]
            a = total[at, where] / np.maximum(own - 1, 1)
            mean = total / n
            mean[at, where] = np.inf
            other = mean.argmin(axis=1)
            b = mean[at, other]
            top = np.maximum(a, b)
            live = (own > 1) & (top > 0)
            s = np.where(live, (b - a) / np.where(live, top, 1.0), 0.0)
            safe = np.where(live, top, 1.0) ** 2
            by_a = np.where(live, -np.where(a >= b, b, top) / safe, 0.0)  # derivatives of s by a and by b
            by_b = np.where(live, np.where(a >= b, top, a) / safe, 0.0)
            slope = np.zeros((len(x), k))
            slope[at, where] = by_a / np.maximum(own - 1, 1)
            slope[at, other] += by_b / n[other]
            out[0] += s.sum()
            out[1] += len(x)
            out[2:] += (slope.T @ dist)[where_s, np.arange(len(where_s))]
        return out if seen else None

    got = summed(data, read, (s_place, member, s_x), 2 + len(s_place), score)
    drop_written(data)
    users = got[1]
    error = float(np.sqrt(((1 - s_p) * (got[2:] / users / s_p) ** 2).sum()))
    exact = bool((s_p >= 1.0).all()) and len(s_p) == int(n.sum())
    return spark.createDataFrame([(float(got[0] / users), error, int(users), len(s_p), exact)],
                                 "silhouette double, standard_error double, users long, sampled long, exact boolean")
