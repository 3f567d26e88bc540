"""Training of ``networks``: minibatch steps whose slopes are summed over partitions.

Rows are dealt to ``batches`` minibatches by a hash and written once, a folder for each
minibatch, so that a step reads its own rows only. A step is one job: parameters are
broadcast, each task adds up the slopes of its rows, sums meet in two levels of a
shuffle in chunks of 64 Ki numbers, and AdamW moves the parameters on the driver. Memory
is that of the parameters everywhere, whatever the number of rows.

Columns of the rows: the network's ``reads``; ``y``, an array of numbers from 0 to 1, or
a class number for ``networks.Pairs``; ``unit``, a long of its own for each row; if asked
for ``weight`` and ``env``; and ``is_val``. Rows with null or NaN in y are left out.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import staging
from .networks import Arrays, Network, Pairs, _softmax, inputs, sigmoid

CHUNK = 1 << 16


@dataclass(frozen=True)
class Settings:
    """How to train. ``method``: ERM; DERM (rows count by ``weight``); vREx (the mean
    loss of environments and ``penalty`` times their variance); IRM (the sum of their
    losses and of the squares of each one's slope in a common scale of the logits)."""

    epochs: int = 20
    batches: int = 8
    rate: float = 1e-3
    decay: float = 0.0
    method: str = "ERM"
    penalty: float = 1.0
    class_weights: tuple[float, ...] | None = None
    positive_weights: tuple[float, ...] | None = None
    negatives: float | None = None
    seed: int = 0


@dataclass
class Fitted:
    """The parameters of the best epoch, the number of that epoch, each epoch's loss and
    balanced accuracies, what the losses tell (``diagnosed``), and the last parameters."""

    network: Network
    parameters: Arrays
    best_epoch: int
    history: list[dict] = field(default_factory=list)
    diagnostics: dict = field(default_factory=dict)
    last: Arrays = field(default_factory=dict)


def _losses(network: Network, z: np.ndarray, y: np.ndarray, how: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row: loss, its slope in the logits, how much the row counts in a mean,
    and the slope's own slope along the logits (for IRM)."""
    if isinstance(network, Pairs):
        p, rows = _softmax(z), np.arange(len(z))
        n = np.asarray(how.class_weights or [1.0] * z.shape[1])[y]
        slope = p * n[:, None]
        slope[rows, y] -= n
        return -n * np.log(np.maximum(p[rows, y], 1e-300)), slope, n, slope
    p = sigmoid(z)
    up = np.asarray(how.positive_weights or [1.0] * z.shape[1])
    soft = np.logaddexp(0, -np.abs(z))
    loss = up * y * (soft + np.maximum(-z, 0)) + (1 - y) * (soft + np.maximum(z, 0))
    slope = (1 - y) * p - up * y * (1 - p)
    turn = slope + z * p * (1 - p) * (1 - y + up * y)
    k = z.shape[1]
    return loss.mean(1), slope / k, np.ones(len(z)), turn / k


def _read(network: Network, batch: pa.RecordBatch) -> tuple[Arrays, np.ndarray]:
    columns = {n: batch.column(n) for n in network.reads}
    y = batch.column("y")
    if isinstance(network, Pairs):
        return inputs(network, columns), y.to_numpy(zero_copy_only=False).astype(int)
    return inputs(network, columns), y.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(y), -1)


def _parts(batch: pa.RecordBatch, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _slopes(network: Network, shared, how: Settings, scale: dict[int, tuple[float, float]] | None):
    """One task's sums: rows, loss, count, and the slope in each parameter, in chunks.
    ``scale``: for each environment what its rows' slopes and turns are multiplied by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = network.shaped(shared.value)
        total = np.zeros(3 + len(shared.value))
        for batch in batches:
            for part in _parts(batch):
                x, y = _read(network, part)
                z, keep = network.forward(w, x)
                loss, slope, n, turn = _losses(network, z, y, how)
                if scale is not None:
                    of = np.array([scale.get(e, (0.0, 0.0)) for e in part.column("env").to_pylist()]).reshape(-1, 2)
                    slope = of[:, :1] * slope + of[:, 1:] * turn
                elif how.method == "DERM":
                    own = part.column("weight").to_numpy(zero_copy_only=False)
                    loss, slope = loss * own, slope * own[:, None]
                total[:3] += len(part), loss.sum(), n.sum()
                total[3:] += network.flat(network.backward(w, keep, slope))
        if total[0]:
            chunks = [total[at : at + CHUNK] for at in range(0, len(total), CHUNK)]
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([task] * len(chunks), pa.int64()), pa.array(range(len(chunks)), pa.int64()), pa.array([c.tobytes() for c in chunks])], ["task", "chunk", "sums"])

    return run


def _added(table: pa.Table) -> pa.Table:
    """Sums in order of their tasks, so that reruns give the same bits."""
    order = np.argsort(table.column("task").to_numpy(), kind="stable")
    blobs = table.column("sums")
    total = np.frombuffer(blobs[int(order[0])].as_py()).copy()
    for i in order[1:]:
        total += np.frombuffer(blobs[int(i)].as_py())
    return pa.table({"task": table.column("task").take(pa.array(order[:1])), "chunk": table.column("chunk")[:1], "sums": pa.array([total.tobytes()])})


def _summed(rows: DataFrame, network: Network, values: np.ndarray, how: Settings, scale: dict | None = None) -> np.ndarray:
    """The sums of ``_slopes`` over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(values)
    schema = "task long, chunk long, sums binary"
    each = rows.mapInArrow(_slopes(network, shared, how, scale), schema)
    # two levels: a group holds about the square root of the number of tasks
    near = each.groupBy("chunk", F.floor(F.sqrt("task")).alias("_near")).applyInArrow(lambda t: _added(t), schema)
    found = near.groupBy("chunk").applyInArrow(lambda t: _added(t), schema).select("chunk", "sums").collect()
    shared.destroy()
    if not found:
        return np.zeros(3 + len(values))
    return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["chunk"])])


def _by_environment(rows: DataFrame, network: Network, values: np.ndarray, how: Settings) -> dict[int, tuple[float, float, float]]:
    """(rows, mean loss, slope in a scale of the logits) of each environment."""
    shared = rows.sparkSession.sparkContext.broadcast(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, sums = network.shaped(shared.value), {}
        for batch in batches:
            for part in _parts(batch):
                x, y = _read(network, part)
                z, _ = network.forward(w, x)
                loss, slope, _, _ = _losses(network, z, y, how)
                for e, a, b in zip(part.column("env").to_pylist(), loss, (slope * z).sum(1)):
                    s = sums.setdefault(e, np.zeros(3))
                    s += 1.0, a, b
        yield pa.RecordBatch.from_pydict({"env": pa.array(list(sums), pa.int64()), **{k: pa.array([float(s[i]) for s in sums.values()], pa.float64()) for i, k in enumerate(("n", "loss", "slope"))}})

    found = rows.mapInArrow(run, "env long, n double, loss double, slope double").groupBy("env").agg(*[F.sum(c).alias(c) for c in ("n", "loss", "slope")]).collect()
    shared.destroy()
    return {r["env"]: (r["n"], r["loss"] / r["n"], r["slope"] / r["n"]) for r in found}


def gradient(rows: DataFrame, network: Network, values: np.ndarray, how: Settings) -> tuple[float, np.ndarray]:
    """(loss, its slope in the flat parameters) over all of ``rows``."""
    if how.method in ("ERM", "DERM"):
        sums = _summed(rows, network, values, how)
        count = sums[2] or 1.0
        return sums[1] / count, sums[3:] / count
    envs = _by_environment(rows, network, values, how)
    if not envs:
        return 0.0, np.zeros(len(values))
    loss = {e: m for e, (_, m, _) in envs.items()}
    mean, k = sum(loss.values()) / len(loss), len(loss)
    if how.method == "vREx":
        # the variance is that of a sample; with one environment there is none
        spread = max(k - 1, 1)
        total = mean + how.penalty * sum((x - mean) ** 2 for x in loss.values()) / spread
        scale = {e: ((1 / k + 2 * how.penalty * (loss[e] - mean) / spread) / n, 0.0) for e, (n, _, _) in envs.items()}
    else:
        total = sum(loss.values()) + how.penalty * sum(s * s for _, _, s in envs.values())
        scale = {e: (1 / n, 2 * how.penalty * s / n) for e, (n, _, s) in envs.items()}
    return total, _summed(rows, network, values, how, scale)[3:]


class AdamW:
    def __init__(self, size: int, rate: float, decay: float):
        self.m, self.v, self.n, self.rate, self.decay = np.zeros(size), np.zeros(size), 0, rate, decay

    def step(self, values: np.ndarray, slope: np.ndarray) -> np.ndarray:
        self.n += 1
        self.m = 0.9 * self.m + 0.1 * slope
        self.v = 0.999 * self.v + 0.001 * slope * slope
        move = self.m / (1 - 0.9**self.n) / (np.sqrt(self.v / (1 - 0.999**self.n)) + 1e-8)
        return values * (1 - self.rate * self.decay) - self.rate * move


def _accuracies(rows: DataFrame, network: Network, values: np.ndarray) -> dict[bool, float]:
    """Balanced accuracy of rows for training and of rows for validation. Of 0/1 outcomes
    the mean of both recalls, then over outcomes; of classes the mean recall of all."""
    shared = rows.sparkSession.sparkContext.broadcast(values)
    classes = isinstance(network, Pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, sums = network.shaped(shared.value), {}
        for batch in batches:
            for part in _parts(batch):
                x, y = _read(network, part)
                z, _ = network.forward(w, x)
                val = part.column("is_val").to_numpy(zero_copy_only=False).astype(bool)
                for side in (False, True):
                    for k in range(z.shape[1]):
                        own = y == k if classes else y[:, k] == 1
                        told = z.argmax(1) == k if classes else z[:, k] > 0
                        s = sums.setdefault((side, k), np.zeros(4))
                        for i, hit in enumerate((own & told, own & ~told, ~own & told, ~own & ~told)):
                            s[i] += (hit & (val == side)).sum()
        yield pa.RecordBatch.from_pydict({"side": pa.array([s for s, _ in sums], pa.bool_()), "k": pa.array([k for _, k in sums], pa.int64()), **{c: pa.array([float(s[i]) for s in sums.values()], pa.float64()) for i, c in enumerate(("tp", "fn", "fp", "tn"))}})

    found = rows.mapInArrow(run, "side boolean, k long, tp double, fn double, fp double, tn double").groupBy("side", "k").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp", "tn")]).collect()
    shared.destroy()
    out: dict[bool, list[float]] = {}
    for r in found:
        if not r["tp"] + r["fn"] + r["fp"] + r["tn"]:
            continue
        hit = r["tp"] / max(r["tp"] + r["fn"], 1)
        out.setdefault(r["side"], []).append(hit if classes else (hit + r["tn"] / max(r["tn"] + r["fp"], 1)) / 2)
    return {side: float(np.mean(x)) for side, x in out.items()}


def diagnosed(history: list[dict], best_epoch: int, epochs: int) -> dict:
    """What the losses tell. converged: the best epoch is in the first nine tenths;
    rate_too_high: the fifth loss is above 1.5 times the first; rate_too_low: the last
    is less than 5% below the first; overfit_gap: training above validation, at best."""
    losses = [h["loss"] for h in history]
    finite = [x for x in losses if np.isfinite(x)]
    fell = (finite[0] - finite[-1]) / finite[0] if finite and finite[0] > 0 else 0.0
    best = history[best_epoch - 1] if 0 < best_epoch <= len(history) else {}
    val = best.get("val")
    return {
        "converged": best_epoch < 0.9 * epochs, "loss_ok": len(finite) == len(losses), "rate_too_high": len(finite) >= 5 and finite[4] > 1.5 * finite[0],
        "rate_too_low": fell < 0.05, "val": val, "overfit_gap": best["train"] - val if val is not None and "train" in best else None,
    }


def state_table(spark, network: Network, arrays: dict[str, np.ndarray], note: dict) -> DataFrame:
    """One row for each parameter: name, shape, and an array for each of ``arrays``
    (flat parameters, moments), with ``note`` as JSON in each row."""
    rows, at = [], 0
    for name, shape in network.shapes().items():
        size = int(np.prod(shape))
        rows.append((name, list(shape), *[a[at : at + size].tolist() for a in arrays.values()], json.dumps(note)))
        at += size
    return spark.createDataFrame(rows, "name string, shape array<int>, " + ", ".join(f"{k} array<double>" for k in arrays) + ", note string")


def read_state(df: DataFrame, network: Network, *arrays: str) -> tuple[list[np.ndarray], dict]:
    """The flat arrays and the note of a state table; refuses one of other shapes."""
    rows = {r["name"]: r for r in df.collect()}
    shapes = network.shapes()
    if set(rows) != set(shapes) or any(tuple(rows[n]["shape"]) != s for n, s in shapes.items()):
        raise ValueError("the table holds parameters of another network")
    return [np.concatenate([np.asarray(rows[n][a], float) for n in shapes]) for a in arrays], json.loads(next(iter(rows.values()))["note"])


def prepared(rows: DataFrame, network: Network, how: Settings) -> tuple[DataFrame, DataFrame, str]:
    """(rows for training by minibatch, all rows, path of both) written once."""
    known = F.col("y").isNotNull()
    if not isinstance(network, Pairs):
        known &= ~F.exists("y", lambda v: v.isNull() | F.isnan(v))
    extra = [c for c in ("weight", "env") if c in rows.columns]
    kept = rows.where(known).select(*network.reads, "y", "unit", F.coalesce("is_val", F.lit(False)).alias("is_val"), *extra)
    table, path = staging.staged(kept.withColumn("_batch", F.pmod(F.xxhash64(F.lit(how.seed), "unit"), F.lit(how.batches)).cast("int")), "_batch")
    return table.where(~F.col("is_val")), table, path


def fit(rows: DataFrame, network: Network, how: Settings, start: Arrays | None = None, folder: str | None = None, stop_after: int | None = None) -> Fitted:
    """One training run. Keeps the epoch with the best balanced accuracy on rows for
    validation, or for training where there are none; the later one of equals.

    With ``folder`` each epoch leaves a table of parameters, best parameters and AdamW's
    moments there; a run that finds some goes on after the last whole one, with the same
    result as if it had not stopped. ``stop_after`` ends a run early, after so many epochs
    of its own. With ``negatives`` each epoch takes all rows of classes above 0 and a new
    draw, by hash, of as many times as many of class 0.
    """
    if how.method not in ("ERM", "DERM", "vREx", "IRM"):
        raise ValueError(f"unknown method {how.method!r}")
    if how.method == "IRM" and isinstance(network, Pairs):
        raise ValueError("IRM is for 0/1 outcomes")
    spark = rows.sparkSession
    train, table, path = prepared(rows, network, how)
    try:
        share = None
        if how.negatives is not None:
            n = train.agg(F.count(F.when(F.col("y") > 0, 1)).alias("p"), F.count(F.when(F.col("y") == 0, 1)).alias("n")).first()
            share = min(1.0, how.negatives * n["p"] / max(n["n"], 1))
        if how.method in ("vREx", "IRM") and train.select("env").distinct().limit(2).count() < 2:
            warnings.warn(f"{how.method} with fewer than two environments is ERM", stacklevel=2)
        values = network.flat(start or network.initial(how.seed))
        adam = AdamW(len(values), how.rate, how.decay)
        best, best_epoch, top, history, own = values, 0, -1.0, [], 0
        for name in reversed(staging.folders(spark, folder) if folder else []):
            if staging.exists(spark, f"{folder}/{name}/_SUCCESS"):
                (values, best, adam.m, adam.v), note = read_state(spark.read.parquet(f"{folder}/{name}"), network, "value", "best", "m", "v")
                adam.n, best_epoch, top, history = note["steps"], note["best_epoch"], note["top"], note["history"]
                break
        while len(history) < how.epochs and (stop_after is None or own < stop_after):
            epoch, losses = len(history) + 1, []
            order = np.random.default_rng((how.seed, epoch)).permutation(how.batches)
            for b in order:
                part = train.where(F.col("_batch") == int(b))
                if share is not None and share < 1:
                    drawn = F.pmod(F.xxhash64(F.lit(f"{how.seed}/{epoch}"), "unit"), F.lit(1 << 30)) < int(share * (1 << 30))
                    part = part.where((F.col("y") > 0) | drawn)
                loss, slope = gradient(part, network, values, how)
                values = adam.step(values, slope)
                losses.append(loss)
            seen = _accuracies(table, network, values)
            history.append({"loss": float(np.mean(losses)), "train": seen.get(False), "val": seen.get(True)})
            now = seen.get(True, seen.get(False, 0.0))
            if now >= top:
                best, best_epoch, top = values, epoch, now
            own += 1
            if folder:
                note = {"steps": adam.n, "best_epoch": best_epoch, "top": top, "history": history}
                state_table(spark, network, {"value": values, "best": best, "m": adam.m, "v": adam.v}, note).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epoch-{epoch:06d}")
    finally:
        staging.remove(spark, path)
    return Fitted(network, network.shaped(best), best_epoch, history, diagnosed(history, best_epoch, how.epochs), network.shaped(values))


def train(rows: DataFrame, network: Network, how: Settings, start: Arrays | None = None, fitter=fit) -> tuple[Fitted, list[str]]:
    """``fit`` with what is done when it did not go well, and a list of what was done.

    At most twice a run starts again: at a third of its rate if its loss is not finite or
    rose, at three times its rate if it hardly fell. A run whose best epoch is among its
    last tenth goes on from it for half as many epochs, and the better of both stays."""
    start = start or network.initial(how.seed)
    done: list[str] = []
    for attempt in range(3):
        found = fitter(rows, network, how, start)
        d = found.diagnostics
        if attempt == 2:
            break
        if not d["loss_ok"] or d["rate_too_high"]:
            done.append("rate / 3")
            how = replace(how, rate=how.rate / 3)
        elif d["rate_too_low"]:
            done.append("rate * 3")
            how = replace(how, rate=how.rate * 3)
        else:
            break
    if not found.diagnostics["converged"] and how.epochs // 2:
        more = fitter(rows, network, replace(how, epochs=how.epochs // 2), found.parameters)
        kept = (more.diagnostics["val"] or 0.0) >= (found.diagnostics["val"] or 0.0)
        done.append("longer" if kept else "longer, left")
        found = more if kept else found
    return found, done


def class_weights(rows: DataFrame, classes: int, negatives: float) -> tuple[float, ...]:
    """Of what an epoch draws: all / (classes x count), class 0 counted as ``negatives``
    times all others, classes without rows as one row."""
    n = {r["y"]: r["n"] for r in rows.where(F.col("y").isNotNull()).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = [max(1.0, float(n.get(k, 0))) for k in range(classes)]
    counts[0] = negatives * sum(n.get(k, 0) for k in range(1, classes)) or 1.0
    return tuple(sum(counts) / (classes * c) for c in counts)
