"""Data-parallel training of the autoencoder and of DEC with its encoder.

Autoencoder objective (Keras conventions): mean over rows of
``mean_j (xhat_j - x_j)^2 + r * sum|h1| + r * sum|h2|`` (L1 activity penalty
on the first two layers), Adam, mini-batches, early stopping on the
validation loss with the best weights restored.

*One Spark job per epoch.* Rows are dealt once, by user, to tasks of about
``TASK_ROWS`` rows. In an epoch every task runs its own mini-batches from the
shared parameters; the parameters (and Adam's moments) that come back are
averaged with the tasks' row counts. With one task this is plain mini-batch
Adam. The averages are added up in blocks on the executors, and tasks without
rows send nothing. Only a small model (``DRIVER_VALUES``) passes through the
driver; a larger one stays on the executors as a table of blocks, and the driver
sees sums of losses and counts (``sharded``).

Inputs are sparse ``(indices, values)`` rows, so a wide catalogue never
becomes a wide schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import drop_written, materialize
from .latent import _dense_batch, _sigmoid, encode, row_chunks, weight_table
from .packed import COLUMNS, PACKED, Rows, minibatches, pack, rows_of, split_rows, unpack
from .sharded import BLOCK, TASK_ROWS, BlockModel, applied, extended, glorot_model, model_of, parameter_count, \
    round_of, task_of, tasks_for, weights_of

EPOCHS = 200                  # fixed values of the reference's training call
BATCH_ROWS = 256
PATIENCE = 10
ADAM = dict(lr=1e-3, beta1=0.9, beta2=0.999, eps=1e-7)   # Keras Adam defaults
DEC_MAX_STEPS = 5000          # fixed values of the DEC loop
DEC_INTERVAL = 25
DEC_CHECK = 100
DEC_TOLERANCE = 4e-5
DEC_LR, DEC_MOMENTUM = 1e-4, 0.1
SUM_BLOCK = 1 << 16           # values that are added up in one executor row
DRIVER_VALUES = 1 << 20       # parameters (8 MB) of a model that may pass through the driver
BARRIER_VALUES = 1 << 22      # numbers of one round that all tasks of a barrier stage may get (tasks x tasks x parameters)


def init_layers(shapes, seed: int = 0):
    """Glorot-uniform kernels, zero biases."""
    rng = np.random.default_rng(seed)
    layers = []
    for rows, cols in shapes:
        lim = np.sqrt(6.0 / (rows + cols))
        layers.append((rng.uniform(-lim, lim, size=(rows, cols)), np.zeros(cols)))
    return layers


def batch_loss_and_grads(x: np.ndarray, layers, r: float, with_grads: bool = True):
    """Sums over the rows of ``x``: (penalised loss, squared error, gradients of the summed loss)."""
    (w0, b0), (w1, b1), (w2, b2) = layers
    d = x.shape[1]
    h1 = _sigmoid(x @ w0 + b0)
    h2 = _sigmoid(h1 @ w1 + b1)
    y = _sigmoid(h2 @ w2 + b2)
    off = y - x
    err = (off ** 2).mean(axis=1)
    loss = err + r * h1.sum(axis=1) + r * h2.sum(axis=1)  # activations are never below 0
    if not with_grads:
        return float(loss.sum()), float(err.sum()), None
    off *= 2.0 / d
    off *= y
    dz3 = np.multiply(off, 1 - y, out=off)
    dh2 = dz3 @ w2.T + r * np.sign(h2)
    dz2 = dh2 * h2 * (1 - h2)
    dh1 = dz2 @ w1.T + r * np.sign(h1)
    dz1 = dh1 * h1 * (1 - h1)
    grads = [(x.T @ dz1, dz1.sum(0)), (h1.T @ dz2, dz2.sum(0)), (h2.T @ dz3, dz3.sum(0))]
    return float(loss.sum()), float(err.sum()), grads


def _flatten(layers) -> np.ndarray:
    return np.concatenate([np.concatenate([w.ravel(), b.ravel()]) for w, b in layers])


def _unflatten(vec: np.ndarray, shapes):
    out, pos = [], 0
    for rows, cols in shapes:
        w = vec[pos:pos + rows * cols].reshape(rows, cols)
        pos += rows * cols
        b = vec[pos:pos + cols]
        pos += cols
        out.append((w, b))
    return out


# ------------------------------------------------------------ distribution --

def dealt_rows(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` dealt by user to tasks of about ``TASK_ROWS`` rows, in a fixed order, written once as packed chunks."""
    parts = max(1, -(-rows.count() // TASK_ROWS))
    dealt = rows.repartition(parts, "user_id").sortWithinPartitions(*order, "user_id")
    return materialize(dealt.mapInPandas(pack, PACKED), label)


def summed(rows: DataFrame, columns: list[str], value: object, size: int,
           work: Callable[[object, Iterator[pd.DataFrame]], np.ndarray | None]) -> np.ndarray:
    """Sum over tasks of ``work(value, batches)`` (an array of ``size``), added up in blocks on executors.

    One Spark job. ``value`` is broadcast for this job only.
    """
    bc = rows.sparkSession.sparkContext.broadcast(value)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = work(bc.value, batches)
        if out is not None:  # tasks without rows send nothing
            for lo in range(0, size, SUM_BLOCK):
                yield pd.DataFrame({"block": [lo // SUM_BLOCK], "data": [out[lo:lo + SUM_BLOCK].tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for block, data in zip(pdf["block"], pdf["data"]):
                x = np.frombuffer(data)
                total[block] = total[block] + x if block in total else x
        yield pd.DataFrame({"block": list(total), "data": [x.tobytes() for x in total.values()]})

    schema = "block int, data binary"
    got = (rows.select(*columns).mapInPandas(part, schema).repartition(-(-size // SUM_BLOCK), "block")
           .mapInPandas(add, schema).collect())
    bc.destroy()
    out = np.zeros(size)
    for r in got:
        x = np.frombuffer(r["data"])
        out[r["block"] * SUM_BLOCK:r["block"] * SUM_BLOCK + len(x)] = x
    return out


def _chunk_sums(rows: Rows, d: int, fn):
    """(rows, loss, error, flat gradient) of a mini-batch, its dense blocks bounded."""
    n, loss, err, grad = 0, 0.0, 0.0, 0.0
    for x in rows.blocks(d):
        a, b, g = fn(x)
        n, loss, err = n + len(x), loss + a, err + b
        if g is not None:
            grad = grad + g
    return n, loss, err, grad


# ------------------------------------------------------------- autoencoder --

def loss_and_gradient(vectors: DataFrame, layers, d: int, r: float) -> tuple[float, float, float, list]:
    """(rows, loss sum, error sum, gradient sums by layer) over all rows: one full-data pass."""
    shapes = [w.shape for w, _ in layers]
    size = 3 + _flatten(layers).size

    def work(params, batches):
        acc = None
        for pdf in batches:
            n, loss, err, grad = _chunk_sums(rows_of(pdf), d, lambda x: _flat(batch_loss_and_grads(x, params, r)))
            if n:
                got = np.concatenate(([n, loss, err], grad))
                acc = got if acc is None else acc + got
        return acc

    total = summed(vectors, ["indices", "values"], layers, size, work)
    return total[0], total[1], total[2], _unflatten(total[3:], shapes)


def _flat(result):
    loss, err, grads = result
    return loss, err, None if grads is None else _flatten(grads)


@dataclass
class FitResult:
    """A fitted autoencoder: ``layers`` if it is small, else ``model``, its table of blocks on the executors."""

    layers: list | None
    history: list          # (epoch, loss, val_loss, mse, val_mse)
    best_epoch: int
    shapes: list
    model: BlockModel | None = None


def _epoch(state, training: bool, chunks, shapes, d: int, r: float, batch_rows: int):
    """A task's mini-batches of one epoch from (theta, m, v, t).

    Returns (rows, loss, error of the training rows; the same of the validation
    rows under the parameters at the start), and the state after it.
    """
    start, m, v, t = state
    theta, m, v = start.copy(), m.copy(), v.copy()
    sums = np.zeros(6)

    def measured():
        for rows in chunks:
            if rows.train:
                yield rows
                continue
            layers = _unflatten(start, shapes)
            n, loss, err, _ = _chunk_sums(rows, d, lambda x: _flat(batch_loss_and_grads(x, layers, r, False)))
            sums[3:] += (n, loss, err)

    for rows in minibatches(measured(), batch_rows):
        if not training:
            continue
        layers = _unflatten(theta, shapes)
        n, loss, err, grad = _chunk_sums(rows, d, lambda x: _flat(batch_loss_and_grads(x, layers, r)))
        sums[:3] += (n, loss, err)
        grad = grad / n
        t += 1
        m = ADAM["beta1"] * m + (1 - ADAM["beta1"]) * grad
        v = ADAM["beta2"] * v + (1 - ADAM["beta2"]) * grad * grad
        lr_t = ADAM["lr"] * np.sqrt(1 - ADAM["beta2"] ** t) / (1 - ADAM["beta1"] ** t)
        theta = theta - lr_t * m / (np.sqrt(v) + ADAM["eps"])
    return sums, (theta, m, v, t)


def fit_autoencoder(vectors: DataFrame, d: int, shapes, r: float, epochs: int = EPOCHS,
                    patience: int = PATIENCE, seed: int = 0, batch_rows: int = BATCH_ROWS,
                    driver_values: int = DRIVER_VALUES, start: np.ndarray | None = None,
                    keep: str = "best") -> FitResult:
    """Train on ``vectors`` = ``(user_id, indices, values, split)``; ``split`` is 'train' / 'validation' (R7).

    Returns the weights of the best validation loss and the epoch history. The
    job of an epoch also measures the validation loss of the parameters it
    starts from, so it closes the epoch before. A model of at most
    ``driver_values`` parameters passes through the driver, one job an epoch;
    a larger one stays on the executors as a table of blocks (``sharded``). Both
    do the same steps on the same rows. ``start`` (a small flat vector) replaces
    the Glorot-uniform start; ``keep="last"`` returns the last epoch's weights.
    """
    shapes, size = list(shapes), parameter_count(shapes)
    spark = vectors.sparkSession
    own = vectors.select("user_id", "indices", "values", "split", F.xxhash64("user_id").alias("deal"))
    columns = ["indices", "values", "split"]
    local = size <= driver_values
    if local:
        rows = dealt_rows(own, ["deal"], "autoencoder_rows")
        theta = _flatten(init_layers(shapes, seed)) if start is None else start
        state = (theta, np.zeros(size), np.zeros(size), 0.0)
    else:
        tasks = tasks_for(own.count(), size, TASK_ROWS)
        rows = materialize(own.withColumn("task", task_of("user_id", tasks)), "autoencoder_rows")
        state = (glorot_model(spark, shapes, seed, block=BLOCK) if start is None else model_of(spark, start, block=BLOCK), 0.0)

    def run_local(state, training):
        def work(now, batches):
            sums, after = _epoch(now, training, unpack(batches), shapes, d, r, batch_rows)
            if not sums[0] and not sums[3]:
                return None
            return np.concatenate((sums, *(sums[0] * x for x in after[:3]), [sums[0] * after[3]]))

        got = summed(rows, COLUMNS, state, 7 + 3 * size, work)
        n = got[0] or 1.0
        return got[:6], (*(got[6 + k * size:6 + (k + 1) * size] / n for k in range(3)), got[-1] / n)

    def run_blocks(state, training):
        model, t = state

        def work(now, batches):
            chunks = (rows for pdf in batches for rows in split_rows(pdf))
            sums, after = _epoch((*now, t), training, chunks, shapes, d, r, batch_rows)
            return np.append(sums, sums[0] * after[3]), sums[0], after[:3]

        got, after = round_of(rows, model, tasks, columns, ["deal", "user_id"], work, 7)
        return got[:6], (after, got[6] / (got[0] or 1.0))

    best, best_epoch, since, best_state = np.inf, 0, 0, state
    history, before = [], None
    for epoch in range(epochs + 1):
        (n, loss, err, val_n, val_loss, val_err), after = (run_local if local else run_blocks)(state, epoch < epochs)
        if before is not None:
            shown = (val_loss / val_n, val_err / val_n) if val_n else (before[1], before[2])
            history.append((epoch - 1, before[1], shown[0], before[2], shown[1]))
            if shown[0] < best:
                if not local and best_state[0] is not state[0]:
                    best_state[0].drop()
                best, best_epoch, since, best_state = shown[0], epoch - 1, 0, state
            else:
                since += 1
                if since >= patience:
                    break
        if not n:
            break
        before = (n, loss / n, err / n)
        if not local and state is not best_state and epoch < epochs:
            state[0].drop()
        if epoch < epochs:
            state = after
    drop_written(rows)
    if keep == "last":
        best_state = state
    if local:
        return FitResult(_unflatten(best_state[0], shapes), history, best_epoch, shapes)
    return FitResult(None, history, best_epoch, shapes, best_state[0])


def encode_fitted(vectors: DataFrame, fit: FitResult, d: int) -> DataFrame:
    """Latent vectors ``(user_id, latent)`` of a fitted autoencoder (C10), wherever its parameters are."""
    if fit.layers is not None:
        return encode(vectors, fit.layers, d)
    return _encoded(vectors, fit.model, fit.shapes[:2], d, None)


def _encoded(vectors: DataFrame, model: BlockModel, shapes, d: int, centroids: int | None) -> DataFrame:
    """Rows through the first layers of a block model; with ``centroids``, their nearest one (by q) too."""
    n_enc = parameter_count(shapes)

    def work(state, batches):
        layers = _unflatten(state[0], shapes)
        mu = state[0][n_enc:].reshape(centroids, -1) if centroids else None
        for batch in batches:
            for pdf in row_chunks(batch, d):
                z = _dense_batch(pdf, d)
                for w, b in layers:
                    z = _sigmoid(z @ w + b)
                out = {"user_id": pdf["user_id"].to_numpy(), "latent": list(z)}
                if centroids:
                    out["cluster"] = student_t(z, mu)[0].argmax(axis=1)
                yield pd.DataFrame(out)

    schema = "user_id long, latent array<double>" + (", cluster int" if centroids else "")
    return applied(vectors, model, "user_id", ["user_id", "indices", "values"], vectors.count(), work, schema)


def fitted_weights(spark, fit: FitResult) -> DataFrame:
    """The weight table (S-5) of a fitted autoencoder."""
    return weight_table(spark, fit.layers) if fit.layers is not None else weights_of(fit.model, fit.shapes)


# ----------------------------------------------------------- DEC with encoder --

def dec_loss_and_grads(x: np.ndarray, p: np.ndarray, encoder, mu: np.ndarray, r: float,
                       alpha: float = 1.0):
    """Sums over the rows of ``x`` of the DEC objective and its gradients.

    Objective per row: ``sum_j p_ij ln(p_ij / q_ij) + r |h1|_1 + r |z|_1`` with
    ``z = encoder(x)`` and Student-t ``q``. Returns (loss, [(dW0, db0), (dW1, db1)], dmu).
    An empty encoder means that ``x`` is ``z`` itself.
    """
    acts = [x]
    for w, b in encoder:
        acts.append(_sigmoid(acts[-1] @ w + b))
    z = acts[-1]
    q, base, diff = student_t(z, mu, alpha)
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log(p / q), 0.0).sum(axis=1)
    loss = kl + sum(r * np.abs(a).sum(axis=1) for a in acts[1:])
    coef = ((alpha + 1.0) / alpha) * (p - q) / base           # n × k
    pull = coef[:, :, None] * diff
    dmu, back = -pull.sum(axis=0), pull.sum(axis=1)
    grads = []
    for (w, _), below, here in zip(reversed(encoder), reversed(acts[:-1]), reversed(acts[1:])):
        delta = (back + r * np.sign(here)) * here * (1 - here)
        grads.insert(0, (below.T @ delta, delta.sum(0)))
        back = delta @ w.T
    return float(np.sum(loss)), grads, dmu


def student_t(z: np.ndarray, mu: np.ndarray, alpha: float = 1.0):
    """(q, 1 + d2 / alpha, z - mu) of latent rows against centroids."""
    diff = z[:, None, :] - mu[None, :, :]
    base = 1.0 + (diff ** 2).sum(axis=2) / alpha
    kern = base ** (-(alpha + 1.0) / 2.0)
    return kern / kern.sum(axis=1, keepdims=True), base, diff


@dataclass
class DecResult:
    """``encoder`` (layers) if the model is small, else ``model``: encoder and centroids in blocks."""

    encoder: list | None
    centroids: np.ndarray
    history: list          # (step, label churn)
    shapes: list
    model: BlockModel | None = None


def dec_train(rows: DataFrame, encoder, centroids: np.ndarray, d: int, r: float = 1e-7,
              max_steps: int = DEC_MAX_STEPS, interval: int = DEC_INTERVAL, tol: float = DEC_TOLERANCE,
              check: int = DEC_CHECK, lr: float = DEC_LR, momentum: float = DEC_MOMENTUM,
              batch_rows: int = BATCH_ROWS, driver_values: int = DRIVER_VALUES, barrier: bool = False) -> DecResult:
    """DEC: mini-batch SGD with momentum on the encoder (if any) and the centroids.

    ``rows``: ``(user_id, indices, values)`` for an encoder, else ``(user_id,
    latent)``. ``encoder``: its layers, or a ``FitResult``. A round refreshes
    the target p and the labels (one job: the cluster totals and the share of
    changed labels, both against the round before), then every task runs its
    mini-batches from the shared parameters (one job), which are averaged by row
    counts. A round is ``interval`` steps, or all mini-batches of a task where it
    has more; every row takes part in turn, because a task resumes where its
    last round ended. The loop ends when the label churn at a check (every
    ``check`` steps) is below ``tol``, or after ``max_steps``. No per-row state
    is kept between rounds: labels of the round before follow from its
    parameters. Up to ``driver_values`` parameters pass through the driver;
    larger models stay on the executors (``sharded``).

    ``barrier``: all rounds run inside one barrier stage (``_one_stage``), one
    job instead of two a round. All tasks must run at once and hold their rows
    (a scan partition each), so this path is taken only where the tasks fit the
    session's cores and what a round exchanges is at most ``BARRIER_VALUES``;
    otherwise the loop above runs. Both take the same steps.
    """
    k = centroids.shape[0]
    fit = encoder if isinstance(encoder, FitResult) else None
    if fit is not None and fit.layers is not None:
        encoder, fit = fit.layers[:2], None
    shapes = fit.shapes[:2] if fit is not None else [w.shape for w, _ in encoder]
    n_enc = parameter_count(shapes)
    size = n_enc + centroids.size
    local = fit is None and size <= driver_values
    columns = ["indices", "values"] if shapes else ["latent"]
    spark = rows.sparkSession
    own = rows.select("user_id", *columns, F.xxhash64("user_id").alias("deal"))
    if fit is None:
        flat = np.concatenate(([_flatten(encoder)] if shapes else []) + [centroids.ravel()])
    if local:
        data = dealt_rows(own, ["deal"], "dec_rows")
        state = (flat, np.zeros(size), None)  # parameters, velocity, parameters of the round before
    else:
        tasks = tasks_for(own.count(), size, TASK_ROWS)
        data = materialize(own.withColumn("task", task_of("user_id", tasks)), "dec_rows")
        state = model_of(spark, flat, block=BLOCK) if fit is None else extended(fit.model, n_enc, centroids.ravel(), 3)

    def parts(vec):
        return _unflatten(vec[:n_enc], shapes), vec[n_enc:].reshape(centroids.shape)

    def inputs(rows):
        return rows.blocks(d) if shapes else [rows.dense(d)]

    def soft(x, vec):
        enc, mu = parts(vec)
        for w, b in enc:
            x = _sigmoid(x @ w + b)
        return student_t(x, mu)[0]

    def refresh(now, last, chunks):
        acc = np.zeros(k + 2)
        for rows in chunks:
            for x in inputs(rows):
                q = soft(x, now)
                acc[:k] += q.sum(axis=0)
                acc[k] += len(x)
                if last is not None:
                    acc[k + 1] += (q.argmax(axis=1) != soft(x, last).argmax(axis=1)).sum()
        return acc

    def steps(start, vel, totals, first, chunks):
        vec, n_rows, taken = start.copy(), 0, 0
        held = list(minibatches(chunks, batch_rows))
        for j in range(max(interval, 1) if len(held) < interval else len(held)):
            if not held:
                break
            enc, mu = parts(vec)
            n, grad = 0, 0.0
            for x in inputs(held[(first + j) % len(held)]):
                q = soft(x, start)  # the target stays that of the round's start
                p = q * q / totals
                p /= p.sum(axis=1, keepdims=True)
                _, g, dmu = dec_loss_and_grads(x, p, enc, mu, r)
                grad = grad + np.concatenate(([_flatten(g)] if enc else []) + [dmu.ravel()])
                n += len(x)
            vel = momentum * vel - lr * grad / n
            vec = vec + vel
            n_rows, taken = n_rows + n, taken + 1
        return n_rows, taken, vec, vel

    def chunks_of(batches):
        return (rows_of(pdf) for pdf in batches if len(pdf))

    def refresh_round(state, counts):
        """The cluster totals and, where ``counts``, the rows whose label is another than a round ago."""
        if local:
            def work(now, batches):
                acc = refresh(now[0], now[2] if counts else None, unpack(batches))
                return acc if acc[k] else None
            return summed(data, COLUMNS, state, k + 2, work)
        seen, unused = round_of(data, state, tasks, columns, ["deal", "user_id"],
                                lambda now, batches: (refresh(now[0], now[2] if counts else None, chunks_of(batches)), 0, None),
                                k + 2)
        unused.drop()
        return seen

    def step_round(state, totals):
        if local:
            def work(now, batches):
                n_rows, taken, vec, vel = steps(now[0], now[1], totals, step, unpack(batches))
                return None if not n_rows else np.concatenate(([n_rows, taken], n_rows * vec, n_rows * vel))
            got = summed(data, COLUMNS, state, 2 + 2 * size, work)
            return got[2:2 + size] / got[0], got[2 + size:] / got[0], state[0]

        def block_work(now, batches):
            n_rows, taken, vec, vel = steps(now[0], now[1], totals, step, chunks_of(batches))
            return np.array([n_rows, taken], dtype=float), n_rows, (vec, vel, now[0])
        return round_of(data, state, tasks, columns, ["deal", "user_id"], block_work, 2)[1]

    def stops(seen, step, next_check, history):
        """(does the loop end here, the next step with a check); a check is added to ``history``."""
        if not seen[k]:
            return True, next_check
        if step >= next_check:
            churn = float(seen[k + 1] / seen[k])
            history.append((step, churn))
            next_check += check * max(1, -(-(step - next_check + 1) // check))
            if churn < tol:
                return True, next_check
        return step >= max_steps, next_check

    def all_rounds(exchange, batches):
        """The whole loop inside one task: its sums are exchanged with those of the others."""
        held, now, step, next_check, history = list(unpack(batches)), (flat, np.zeros(size), None), 0, check, []
        while True:
            seen = exchange(refresh(now[0], now[2] if step >= next_check else None, iter(held)))
            end, next_check = stops(seen, step, next_check, history)
            if end:
                return now[0], history
            n_rows, taken, vec, vel = steps(now[0], now[1], seen[:k], step, iter(held))
            got = exchange(np.concatenate(([n_rows, taken], n_rows * vec, n_rows * vel)))
            now = got[2:2 + size] / got[0], got[2 + size:] / got[0], now[0]
            step += max(interval, 1)

    if barrier and local and _fits_one_stage(data, size):
        vec, history = _one_stage(data.select(*COLUMNS), all_rounds)
        drop_written(data)
        enc, mu = parts(vec)
        return DecResult(enc, mu, history, shapes)
    step, next_check, history = 0, check, []
    while True:
        seen = refresh_round(state, step >= next_check)  # only a check looks at the labels of the round before
        end, next_check = stops(seen, step, next_check, history)
        if end:
            break
        after = step_round(state, seen[:k])
        if not local:
            state.drop()
        state = after
        step += max(interval, 1)
    drop_written(data)
    if local:
        enc, mu = parts(state[0])
        return DecResult(enc, mu, history, shapes)
    low = n_enc // state.block  # the blocks that hold the centroids
    end = [np.frombuffer(b["data"]).reshape(3, -1)[0] for b in
           state.table.where(F.col("block") >= low).orderBy("block").collect()]
    return DecResult(None, np.concatenate(end)[n_enc - low * state.block:].reshape(centroids.shape), history, shapes, state)


def _fits_one_stage(data: DataFrame, size: int) -> bool:
    """Can all tasks of ``data`` run at once, and is what they exchange in a round bounded?"""
    tasks = data.rdd.getNumPartitions()  # of the written table's scan; no job runs
    cores = data.sparkSession.sparkContext.defaultParallelism
    return 0 < tasks <= cores and tasks * tasks * (2 + 2 * size) <= BARRIER_VALUES


def _one_stage(data: DataFrame, all_rounds: Callable) -> tuple[np.ndarray, list]:
    """``all_rounds`` in every task of one barrier stage, its sums added up over the tasks at each exchange.

    Every task adds up the same arrays in the order of the tasks, so all come
    to the same parameters and end in the same round; the first one returns
    them. A lost executor fails the stage, and Spark runs it again as a whole
    from the written rows.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from base64 import b64decode, b64encode
        from pyspark import BarrierTaskContext
        context = BarrierTaskContext.get()

        def exchange(own: np.ndarray) -> np.ndarray:
            told = context.allGather(b64encode(own.tobytes()).decode())
            return sum(np.frombuffer(b64decode(t)) for t in told)

        vec, history = all_rounds(exchange, batches)
        if context.partitionId() == 0:
            yield pd.DataFrame({"vec": [vec.tobytes()], "steps": [[int(n) for n, _ in history]],
                                "churn": [[float(c) for _, c in history]]})

    row = data.mapInPandas(work, "vec binary, steps array<long>, churn array<double>", barrier=True).collect()[0]
    return np.frombuffer(row["vec"]), list(zip(row["steps"], row["churn"]))


def dec_labels(vectors: DataFrame, done: DecResult, d: int) -> DataFrame:
    """``(user_id, latent, cluster)`` of rows ``(user_id, indices, values)`` under a trained encoder and its centroids."""
    if done.encoder is None:
        return _encoded(vectors, done.model, done.shapes, d, len(done.centroids))
    bc = vectors.sparkSession.sparkContext.broadcast((done.encoder, done.centroids))  # at most DRIVER_VALUES numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pdf in row_chunks(batch, d):
                z = _dense_batch(pdf, d)
                for w, b in bc.value[0]:
                    z = _sigmoid(z @ w + b)
                yield pd.DataFrame({"user_id": pdf["user_id"].to_numpy(), "latent": list(z),
                                    "cluster": student_t(z, bc.value[1])[0].argmax(axis=1)})

    return vectors.select("user_id", "indices", "values").mapInPandas(run, "user_id long, latent array<double>, cluster int")
