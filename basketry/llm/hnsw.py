"""Embedding near-dedup over hierarchical navigable small-world graphs.

Vectors link when their labels are equal and their cosine (double precision)
reaches a threshold.

*Shards.* Equal vectors of a label fold to one representative with a count, so
a large group of copies is one vector. Representatives are dealt by hash to
shards of at most ``SHARD_VECTORS`` per label and dimension; each shard builds
one graph (layers by a hash of the vector, neighbours chosen for diversity), kept
as one row.

*Search.* Every vector queries every shard of its label; a task holds two
shards and queries each by the other's vectors. A beam that is full of links
is widened until it holds something below the threshold; past ``MAX_BEAM``
the widest beam, the whole shard, is used. Each task audits its recall on a
sample of its queries against brute force and widens all beams until the
audit passes. Found pairs are verified by their cosine.

*Results.* A task adds up links per vector and reduces its links to a spanning
forest, so no pair leaves it; components are joined by grouped star steps.

Vectors that are null, empty, zero, or hold null or non-finite components, and
vectors with a null label, link with nothing: a row of their own, with
component_id = vec_id and no links. Rows are told apart by their vector, not
their id: rows that share an id, or have none, are linked only by what they
hold, and copies count as links of each other. The component of a class whose
ids are all null is null; its rows are kept. An empty table gives an empty
table. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .exchange import stored

SHARD_VECTORS = 8192
DEGREE = 16  # neighbours of a layer; twice as many on the ground layer
BUILD_BEAM = 48
BEAM = 32
MAX_BEAM = 256
#: audited queries of a search, and the recall they must reach
AUDIT = 64
RECALL = 0.99
_BATCH = 256


class Graph:
    """A navigable small-world graph over the rows of ``vecs`` (unit vectors)."""

    def __init__(self, vecs: np.ndarray, levels: np.ndarray):
        self.vecs, self.levels = vecs, levels
        n, top = len(vecs), int(levels.max()) if len(levels) else 0
        self.width = [3 * DEGREE] + [3 * DEGREE // 2] * top  # room for half as many again before pruning
        self.adj = [np.full((n, w), -1, dtype=np.int32) for w in self.width]
        self.degree = [np.zeros(n, dtype=np.int32) for _ in self.width]
        self.entry = -1

    # -- search
    def _greedy(self, q: np.ndarray, at: np.ndarray, layer: int) -> np.ndarray:
        sim = np.einsum("qd,qd->q", q, self.vecs[at])
        live = np.arange(len(q))
        while len(live):
            nbr = self.adj[layer][at[live]]
            s = np.einsum("qd,qwd->qw", q[live], self.vecs[nbr])
            s[nbr < 0] = -2.0
            best = s.argmax(axis=1)
            got = s[np.arange(len(live)), best]
            better = got > sim[live]
            rows = live[better]
            at[rows] = nbr[np.flatnonzero(better), best[better]]
            sim[rows] = got[better]
            live = rows
        return at

    def beam(self, q: np.ndarray, ef: int, layer: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the ``ef`` nearest found on a layer; -1 where fewer were."""
        m, n = len(q), len(self.vecs)
        row = np.arange(m)
        ids = np.full((m, ef), -1, dtype=np.int32)
        sims = np.full((m, ef), -2.0)
        todo = np.zeros((m, ef), dtype=bool)
        ids[:, 0], sims[:, 0], todo[:, 0] = start, np.einsum("qd,qd->q", q, self.vecs[start]), True
        seen = np.zeros((m, n + 1), dtype=bool)
        seen[row, start] = True
        live = row
        while len(live):
            open_ = np.where(todo[live], sims[live], -3.0)
            best = open_.argmax(axis=1)
            go = open_[np.arange(len(live)), best] > -3.0
            live, best = live[go], best[go]
            if not len(live):
                break
            todo[live, best] = False
            nbr = self.adj[layer][ids[live, best]]
            fresh = (nbr >= 0) & ~seen[live[:, None], nbr]
            seen[live[:, None], nbr] = True  # column n (index -1) takes the padding
            s = np.einsum("qd,qwd->qw", q[live], self.vecs[nbr])
            s[~fresh] = -2.0
            all_s = np.concatenate((sims[live], s), axis=1)
            all_i = np.concatenate((ids[live], nbr), axis=1)
            all_t = np.concatenate((todo[live], fresh), axis=1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            r = np.arange(len(live))[:, None]
            sims[live], ids[live], todo[live] = all_s[r, top], all_i[r, top], all_t[r, top]
            ids[live] = np.where(sims[live] > -2.0, ids[live], -1)
            todo[live] &= ids[live] >= 0
        return ids, sims

    def descend(self, q: np.ndarray, to: int) -> np.ndarray:
        at = np.full(len(q), self.entry, dtype=np.int64)
        for layer in range(int(self.levels[self.entry]), to, -1):
            at = self._greedy(q, at, layer)
        return at

    # -- construction
    def _diverse(self, node: int, cand: np.ndarray, limit: int) -> np.ndarray:
        """Up to ``limit`` of ``cand``: each nearer to the node than to those chosen before, then the nearest."""
        v = self.vecs[cand]
        sim = v @ self.vecs[node]
        order = np.argsort(-sim, kind="stable")
        cand, sim, v = cand[order], sim[order], v[order]
        among = v @ v.T
        chosen: list[int] = []
        nearest = np.full(len(cand), -2.0)
        for i in range(len(cand)):
            if nearest[i] < sim[i]:
                chosen.append(i)
                if len(chosen) == limit:
                    break
                nearest = np.maximum(nearest, among[i])
        if len(chosen) < limit:
            chosen += [i for i in range(len(cand)) if i not in set(chosen)][:limit - len(chosen)]
        return cand[chosen]

    def _link(self, node: int, near: np.ndarray, layer: int) -> None:
        keep = 2 * DEGREE if layer == 0 else DEGREE
        near = self._diverse(node, near, DEGREE)
        adj, degree = self.adj[layer], self.degree[layer]
        adj[node, :len(near)] = near
        degree[node] = len(near)
        for other in near:
            if degree[other] == self.width[layer]:
                kept = self._diverse(other, adj[other].astype(np.int64), keep)
                adj[other] = -1
                adj[other, :len(kept)] = kept
                degree[other] = len(kept)
            adj[other, degree[other]] = node
            degree[other] += 1

    def build(self) -> "Graph":
        n = len(self.vecs)
        if not n:
            return self
        order = np.argsort(-self.levels, kind="stable")  # upper layers first
        self.entry = int(order[0])
        done = 1
        while done < n:
            wave = order[done:done + max(1, min(_BATCH, done // 4))]
            q = self.vecs[wave]
            among = q @ q.T
            for layer in range(int(self.levels[wave[0]]), -1, -1):
                rows = np.flatnonzero(self.levels[wave] >= layer)
                before = order[:done][self.levels[order[:done]] >= layer]
                if len(before):
                    start = self.descend(q[rows], layer)
                    ids, sims = self.beam(q[rows], BUILD_BEAM, layer, start)
                for j, r in enumerate(rows):
                    cand = ids[j][ids[j] >= 0].astype(np.int64) if len(before) else np.zeros(0, dtype=np.int64)
                    mates = rows[:j]  # of the same wave, linked before this one
                    if len(mates):
                        mates = mates[np.argsort(-among[r, mates], kind="stable")[:DEGREE]]
                        cand = np.concatenate((cand, wave[mates]))
                    if len(cand):
                        self._link(int(wave[r]), cand, layer)
            done += len(wave)
        return self

    def found(self, q: np.ndarray, threshold: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, id) of the vectors at or over the threshold, beams widened while they are full of them."""
        out_q, out_i = [], []
        n = len(self.vecs)
        for lo in range(0, len(q), _BATCH):
            rows, width = np.arange(lo, min(lo + _BATCH, len(q))), ef
            while len(rows):
                if width > MAX_BEAM or width >= n:
                    r, i = np.nonzero(q[rows] @ self.vecs.T >= threshold)  # the whole shard
                    out_q.append(rows[r])
                    out_i.append(i)
                    break
                ids, sims = self.beam(q[rows], width, 0, self.descend(q[rows], 0))
                hit = (sims >= threshold) & (ids >= 0)
                full = hit.all(axis=1)
                r, c = np.nonzero(hit & ~full[:, None])
                out_q.append(rows[r])
                out_i.append(ids[r, c].astype(np.int64))
                rows, width = rows[full], width * 2
        if not out_q:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(out_q), np.concatenate(out_i)


def layer_of(ids: np.ndarray) -> np.ndarray:
    """Top layer of each vector: a geometric draw from a hash of its number or key."""
    from .text import U64, mix
    u = (mix(ids.astype(U64) + U64(0x9E3779B97F4A7C15)) >> U64(11)).astype(np.float64) / 2**53
    return np.minimum(np.floor(-np.log(np.maximum(u, 1e-16)) / np.log(DEGREE)), 6).astype(np.int64)


def links_between(a: Graph, b: Graph, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Linked (row of a, row of b); each graph is queried by the other's vectors, recall audited."""
    def searched(g: Graph, q: np.ndarray) -> np.ndarray:
        ef = BEAM
        sample = np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(np.int64))
        truth = q[sample] @ g.vecs.T >= threshold
        while True:
            r, i = g.found(q, threshold, ef)
            if ef > MAX_BEAM:
                break
            hit = np.zeros((len(q), 1), dtype=np.int64)
            np.add.at(hit, (r, 0), 1)
            if hit[sample, 0].sum() >= RECALL * truth.sum():
                break
            ef *= 4
        return r * len(g.vecs) + i

    if not len(a.vecs) or not len(b.vecs):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    codes = searched(b, a.vecs)
    if same:
        x, y = np.divmod(codes, len(b.vecs))
        codes = np.unique(np.minimum(x, y) * len(b.vecs) + np.maximum(x, y))
    else:
        y, x = np.divmod(searched(a, b.vecs), len(a.vecs))
        codes = np.unique(np.concatenate((codes, x * len(b.vecs) + y)))
    x, y = np.divmod(codes, len(b.vecs))
    ok = np.einsum("qd,qd->q", a.vecs[x], b.vecs[y]) >= threshold
    if same:
        ok &= x != y
    return x[ok], y[ok]


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the links."""
    nodes, inv = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = inv[:len(u)], inv[len(u):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = 0.98,
                    shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"),
                          F.col(label_col).cast("string").alias("label"))

    def unit(batches):
        import pyarrow as pa
        for batch in batches:
            keys, data, dims = [], [], []
            for v, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = None
                if v and label is not None and None not in v:
                    x = np.array(v, dtype=np.float64) + 0.0
                    scale = np.abs(x).max()
                    x = x / scale if np.isfinite(x).all() and scale > 0 else None
                if x is None:
                    keys.append(None)
                    data.append(None)
                    dims.append(None)
                    continue
                keys.append(hashlib.blake2b(np.array(v, dtype=np.float64).tobytes(), digest_size=16).digest())
                data.append((x / np.sqrt((x * x).sum())).tobytes())
                dims.append(len(v))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(dims, pa.int32()),
                pa.array(keys, pa.binary()), pa.array(data, pa.binary())],
                names=["doc", "label", "dim", "key", "unit"])

    units = stored(rows.mapInArrow(unit, "doc long, label string, dim int, key binary, unit binary"), "hnsw-units")
    kinds = ["label", "dim"]
    reps = (units.where("key is not null").groupBy(*kinds, "key")
            .agg(F.min("doc").alias("low"), F.count("*").alias("copies"), F.first("unit").alias("unit")))
    # a number of its own for every vector, fixed by writing it; ids come back in the last step
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "hnsw-representatives")
    sizes = reps.groupBy(*kinds).agg((F.ceil(F.count("*") / F.lit(shard_vectors))).cast("int").alias("shards"))
    dealt = reps.join(sizes, kinds).withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))

    def build(table):
        import pickle

        import pyarrow as pa
        ids = table.column("rep").to_numpy()
        keys = np.frombuffer(b"".join(table.column("key").to_pylist()), dtype="<i8")[::2]
        order = np.argsort(keys, kind="stable")
        ids, keys, copies = ids[order], keys[order], table.column("copies").to_numpy()[order]
        dim = table.column("dim")[0].as_py()
        data = table.column("unit").to_pylist()
        vecs = np.frombuffer(b"".join(data[i] for i in order), dtype=np.float64).reshape(len(ids), dim)
        g = Graph(vecs, layer_of(keys)).build()
        graph = pickle.dumps({"ids": ids, "copies": copies, "levels": g.levels, "adj": g.adj, "entry": g.entry})
        return pa.table({"label": table.column("label").slice(0, 1), "dim": table.column("dim").slice(0, 1),
                         "shard": table.column("shard").slice(0, 1), "graph": pa.array([graph], pa.binary()),
                         "vecs": pa.array([vecs.tobytes()], pa.binary())})

    graphs = stored(dealt.groupBy(*kinds, "shard").applyInArrow(
        build, "label string, dim int, shard int, graph binary, vecs binary"), "hnsw-graphs")
    other = graphs.select(*kinds, F.col("shard").alias("shard2"), F.col("graph").alias("graph2"),
                          F.col("vecs").alias("vecs2"))
    # every shard meets every shard of its label, each pair of shards in one task
    pairs = graphs.select(*kinds, "shard").join(other.select(*kinds, "shard2"), kinds).where("shard <= shard2")
    tasks = (pairs.repartition(F.col("label"), F.col("shard"), F.col("shard2"))
             .join(graphs, [*kinds, "shard"]).join(other, [*kinds, "shard2"])
             .select("shard", "shard2", "dim", "graph", "vecs", "graph2", "vecs2"))

    def search(batches):
        import pickle

        import pyarrow as pa

        def opened(graph, vecs, dim):
            x = pickle.loads(graph)
            g = Graph.__new__(Graph)
            g.vecs = np.frombuffer(vecs, dtype=np.float64).reshape(-1, dim)
            g.levels, g.adj, g.entry = x["levels"], x["adj"], x["entry"]
            return g, x["ids"], x["copies"]

        for batch in batches:
            for s, s2, dim, *four in zip(*(c.to_pylist() for c in batch.columns)):
                a, ids, copies = opened(four[0], four[1], dim)
                b, ids2, copies2 = (a, ids, copies) if s == s2 else opened(four[2], four[3], dim)
                x, y = links_between(a, b, threshold, s == s2)
                n = np.zeros(len(ids), dtype=np.int64)
                n2 = n if s == s2 else np.zeros(len(ids2), dtype=np.int64)
                np.add.at(n, x, copies2[y])
                np.add.at(n2, y, copies[x])
                node, root = _forest(ids[x], ids2[y])
                root_of = dict(zip(node.tolist(), root.tolist()))
                out = [(i, c, root_of.get(i, i)) for i, c in zip(ids.tolist(), n.tolist()) if c]
                if s != s2:
                    out += [(i, c, root_of.get(i, i)) for i, c in zip(ids2.tolist(), n2.tolist()) if c]
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)],
                                                 names=["rep", "n", "root"])

    found = stored(tasks.mapInArrow(search, "rep long, n long, root long"), "hnsw-links")
    linked = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), "hnsw-components")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    lowest = (reps.select("rep", "low").join(linked.withColumnRenamed("node", "rep"), "rep")
              .groupBy("component").agg(F.min("low").alias("lowest")))
    told = (reps.select(*kinds, "key", "rep", "copies", "low")
            .join(counts, "rep", "left").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
            .join(lowest, "component", "left")
            .select(*kinds, "key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"),
                    F.coalesce("lowest", "low").alias("low")))
    out = (units.where("key is not null").select("doc", *kinds, "key").join(told, [*kinds, "key"])
           .select("doc", "n", "low")
           .union(units.where("key is null").select("doc", F.lit(0), "doc")))
    return out.select(F.col("doc").alias("vec_id"), F.col("n").cast("long").alias("n_links"),
                      F.col("low").alias("component_id"), F.col("doc").eqNullSafe(F.col("low")).alias("kept"))
