"""Out-of-fold reconstruction errors of small autoencoders, trained on all rows where they lie.

A contract's fold is a hash of its key. A network per (fold left out, seed) learns from every row of the other folds: in
each round every partition starts from the shared weights, trains on its own rows batch by batch, and the weights are
averaged by rows. A part of the rows only decides when to stop. A contract is scored by the networks that haven't seen
its fold, and its errors are averaged over the seeds. Only sums of weights pass the driver. For the rounds rows are
written once more, each as one value of bytes: passing its features to Python one by one costs as much as learning from
them, and blocks of rows as one value fill the memory of executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import written
from .models import GROUP, KEY, anomaly_features, explain

FOLDS, SEEDS = 5, 5
HIDDEN, CODE = 8, 3
#: Rounds at most, and rounds without a lower error on the held rows after which training stops.
ROUNDS, PATIENCE = 40, 4
BATCH, RATE = 64, 0.005
#: What a partition learns with, and rebuilds held rows with; their errors are added up, and weights averaged and rows scored, as doubles.
LEARNT = np.float32
#: Percent of the rows that only decide when to stop.
HELD = 15
#: Rows of a block at most; a network takes those of one block in an order drawn.
BLOCK = 10_000


def start(width: int, seed: int) -> list[np.ndarray]:
    """Weights and biases of four layers, drawn."""
    rng = np.random.default_rng(seed)
    sizes = (width, HIDDEN, CODE, HIDDEN, width)
    return [p for a, b in zip(sizes, sizes[1:]) for p in (rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b)), np.zeros(b))]


def _tanh(y: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """tanh; of doubles to the last digit but one, by exp, which numpy does many times faster."""
    if y.dtype == np.float32:
        return np.tanh(y, out=out)
    e = np.multiply(y, 2, out=out)
    np.minimum(e, 300.0, out=e)
    np.exp(e, out=e)
    e += 1
    np.divide(2, e, out=e)
    return np.subtract(1, e, out=e)


def forward(params: list[np.ndarray], z: np.ndarray) -> list[np.ndarray]:
    layers = [z]
    for i in range(0, 8, 2):
        y = layers[-1] @ params[i] + params[i + 1]
        layers.append(_tanh(y) if i < 6 else y)
    return layers


class Adam:
    """Networks side by side, as rows of one array of weights, with the running moments of their gradients. Each learns
    what it would alone; a step costs all of them little more calls than one, and no new arrays.

    A layer's weights and biases lie behind one another, so they are one matrix for inputs that end in a one. Layers lie
    unit by unit, then network by network, the rows of the batch last: the units without that one are a whole piece of
    memory, which numpy passes over many times faster than over a piece for each network. Numbers are of the type of values.
    """

    def __init__(self, values: np.ndarray, width: int):
        self.values, self.t = values.copy(), np.zeros((len(values), 1))
        # Moments are kept without their factors of 0.1 and 0.001.
        self.first, self.second, self.grads = (np.zeros_like(self.values) for _ in range(3))
        self.spare = np.empty_like(self.values)
        sizes = (width, HIDDEN, CODE, HIDDEN, width)
        self.params, self.parts = stacked(self.values, sizes), stacked(self.grads, sizes)
        self.layers = [np.ones((size + 1, len(values), BATCH), values.dtype) for size in sizes]
        self.deltas = [np.empty((size, len(values), BATCH), values.dtype) for size in sizes]
        self.rows = np.empty((len(values) * BATCH, width), values.dtype)

    def _read(self, x: np.ndarray, at: np.ndarray) -> None:
        """Rows `at` of x, those of all networks' batches one after another, become the first layer."""
        np.take(x, at, axis=0, out=self.rows, mode="clip")
        self.layers[0][:-1].reshape(len(self.rows.T), -1)[:] = self.rows.T

    def _forward(self) -> None:
        for i, p in enumerate(self.params):
            y = self.layers[i + 1][:-1]
            np.matmul(p.transpose(0, 2, 1), self.layers[i].transpose(1, 0, 2), out=y.transpose(1, 0, 2))
            if i < 3:
                _tanh(y, out=y)

    def _backward(self) -> None:
        """Gradients of the weights, from the gradient of the last layer."""
        for i in (3, 2, 1, 0):
            np.matmul(self.layers[i].transpose(1, 0, 2), self.deltas[i + 1].transpose(1, 2, 0), out=self.parts[i])
            if i:
                y, delta = self.layers[i][:-1], self.deltas[i]
                np.matmul(self.params[i][:, :-1], self.deltas[i + 1].transpose(1, 0, 2), out=delta.transpose(1, 0, 2))
                np.multiply(y, y, out=y)
                np.subtract(1, y, out=y)
                delta *= y

    def _update(self) -> None:
        self.t += 1
        self.first *= 0.9
        self.first += self.grads
        np.multiply(self.grads, self.grads, out=self.grads)
        self.second *= 0.999
        self.second += self.grads
        # What corrects the second moment is a number for each network, so it is taken out of the root.
        spread = np.sqrt(0.001 / (1 - 0.999**self.t))
        np.sqrt(self.second, out=self.spare)
        self.spare += (1e-8 / spread).astype(self.spare.dtype)
        np.divide(self.first, self.spare, out=self.spare)
        self.spare *= (0.1 * RATE / (spread * (1 - 0.9**self.t))).astype(self.spare.dtype)
        self.values -= self.spare

    def learn(self, x: np.ndarray, of: np.ndarray, orders: list[np.ndarray]) -> None:
        """One pass in batches, on squared error. Network i reads the rows orders[i], in that order, of the table x[of[i]]."""
        size = np.array([len(o) for o in orders])
        steps = -(-size.max(initial=0) // BATCH)
        order = np.zeros((len(orders), steps * BATCH), np.intp)
        for i, o in enumerate(orders):
            order[i, : len(o)] = o
        # The batches of a step lie together, as places in the tables put one behind another.
        order = (order + of[:, None] * x.shape[1]).reshape(len(orders), steps, BATCH).transpose(1, 0, 2).reshape(steps, -1)
        x = x.reshape(-1, x.shape[-1])
        sizes = np.clip(size - np.arange(steps)[:, None] * BATCH, 0, BATCH)
        delta = self.deltas[-1]
        for at, n in zip(order, sizes):
            self._read(x, at)
            self._forward()
            np.subtract(self.layers[-1][:-1], self.layers[0][:-1], out=delta)
            if n.min() == BATCH:
                delta *= 2 / BATCH
                self._backward()
                self._update()
                continue
            delta *= (2 / np.maximum(n, 1)).astype(delta.dtype)[:, None]
            for i in np.flatnonzero(n < BATCH):
                delta[:, i, n[i] :] = 0
            self._backward()
            done = np.flatnonzero(n == 0)
            kept = [a[done] for a in (self.values, self.first, self.second, self.t)]
            self._update()
            for a, old in zip((self.values, self.first, self.second, self.t), kept):
                a[done] = old


def stacked(values: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """The layers of networks that are rows of values, as views of it: weights, and biases as their last row."""
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append(values[:, at : at + (a + 1) * b].reshape(len(values), a + 1, b))
        at += (a + 1) * b
    return out


def flat(params: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in params])


def unflat(values: np.ndarray, width: int) -> list[np.ndarray]:
    out, at = [], 0
    for p in start(width, 0):
        out.append(values[at : at + p.size].reshape(p.shape))
        at += p.size
    return out


def scaled(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip((x - scale[0].astype(x.dtype)) / scale[1].astype(x.dtype), -10, 10)


def blocks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows (fold, held, columns) as up to BLOCK of them in one: the features as doubles, row by row, folds and held as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float)
                flags = [b.column(c).to_numpy(zero_copy_only=False).astype(np.uint8) for c in ("fold", "held")]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, *flags)], ["features", "folds", "helds"])

    return rows.select("fold", "held", *columns).mapInArrow(run, "features binary, folds binary, helds binary")


def _tables(b: pd.DataFrame, columns: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features, folds and held of the rows of b, which are blocks or single ones."""
    if "features" not in b:
        yield b[columns].to_numpy(float), b.fold.to_numpy(), b.held.to_numpy(bool)
        return
    for x, fold, kept in zip(b.features, b.folds, b.helds):
        yield np.frombuffer(x).reshape(-1, len(columns)), np.frombuffer(fold, np.uint8), np.frombuffer(kept, np.uint8).astype(bool)


def packed(rows: DataFrame, columns: list[str], scale: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """rows (fold, held, columns) as one column of bytes: the features in single precision, as deviations from scale's means in
    its spreads, then fold and held as a byte each. A row is one small value, so no batch grows with the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float) if b.num_rows else np.zeros((0, len(columns)))
            z = ((x - scale[0]) / scale[1]).astype(np.float32).view(np.uint8)
            flags = [b.column(c).to_numpy(zero_copy_only=False).astype(np.uint8)[:, None] for c in ("fold", "held")]
            whole = np.ascontiguousarray(np.hstack([z, *flags]))
            ends = np.arange(b.num_rows + 1, dtype=np.int32) * whole.shape[1]
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(whole)])], ["row"])

    return rows.select("fold", "held", *columns).mapInArrow(run, "row binary")


def unpacked(b: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features as packed() has them, folds and held of up to BLOCK rows at a time."""
    for at in range(0, b.num_rows, BLOCK):
        own = b.column(0).slice(at, BLOCK)
        start = np.frombuffer(own.buffers()[1], np.int32)[own.offset]
        whole = np.frombuffer(own.buffers()[2], np.uint8)[start : start + len(own) * (4 * width + 2)].reshape(len(own), -1)
        yield np.ascontiguousarray(whole[:, :-2]).view(np.float32), whole[:, -2], whole[:, -1].astype(bool)


def _held_errors(params: list[np.ndarray], z: np.ndarray) -> np.ndarray:
    """Sums of the mean squared errors of rows z under networks side by side."""
    layer = np.vstack([z.T, np.ones((1, len(z)), z.dtype)])[None]
    for i, p in enumerate(params):
        y = np.matmul(p.transpose(0, 2, 1), layer)
        if i < 3:
            layer = np.ones((len(y), y.shape[1] + 1, len(z)), z.dtype)
            _tanh(y, out=layer[:, :-1])
    y -= z.T
    return np.square(y).sum((1, 2), dtype=float) / z.shape[1]


def _learned(models: dict, scales: dict, width: int, number: int, tables: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """One partition's part of a round, over tables of features, folds and held: per network its weights times its rows, and
    the error of its held rows before."""
    keys, outs = list(models), sorted({k[0] for k in models})
    of = np.array([outs.index(k[0]) for k in keys], np.intp)
    learner = Adam(np.array([models[k] for k in keys], LEARNT), width)
    before = [stacked(np.array([models[k] for k in keys if k[0] == out], LEARNT), (width, HIDDEN, CODE, HIDDEN, width)) for out in outs]
    seen, errors, held = (np.zeros(len(keys)) for _ in range(3))
    for x, fold, kept in tables:
        z = np.array([scaled(x, scales[out]) for out in outs], LEARNT)
        own = [np.flatnonzero((fold != out) & ~kept) for out in outs]
        learner.learn(z, of, [own[i][np.random.default_rng((number, *k, int(n))).permutation(len(own[i]))] for k, i, n in zip(keys, of, seen)])
        seen += [len(own[i]) for i in of]
        for i, out in enumerate(outs):
            rest = z[i][(fold != out) & kept]
            if len(rest):
                errors[of == i] += _held_errors(before[i], rest)
                held[of == i] += len(rest)
    sums = np.column_stack([learner.values.astype(float) * seen[:, None], seen, errors, held])
    place = np.append(np.arange(learner.values.shape[1]), (-1, -2, -3))
    out, seed = np.repeat(np.array(keys), len(place), axis=0).T
    return pd.DataFrame({"out": out, "seed": seed, "i": np.tile(place, len(keys)), "v": sums.ravel()})


def _round(models: dict, scales: dict, columns: list[str], number: int):
    """For mapInPandas over rows or blocks of them: _learned() of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _learned(models, scales, len(columns), number, (t for b in batches for t in _tables(b, columns)))

    return run


def _packed_round(models: dict, scales: dict, width: int, number: int):
    """The same for mapInArrow over rows as packed() has them, and scales of those."""
    schema = pa.schema([("out", pa.int32()), ("seed", pa.int32()), ("i", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pandas(_learned(models, scales, width, number, (t for b in batches for t in unpacked(b, width))), schema, preserve_index=False)

    return run


def fold_scales(rows: DataFrame, columns: list[str], folds: int = FOLDS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and deviation of the rows outside each fold, from one row of sums per fold."""
    sums = [f(F.col(c)).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("s", F.sum), ("q", lambda v: F.sum(v * v)))]
    by_fold = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *sums).collect()}
    scales = {}
    for out in range(folds):
        rest = [r for f, r in by_fold.items() if f != out]
        n = max(sum(r["n"] for r in rest), 1)
        mean = np.array([sum(r[f"s{i}"] for r in rest) / n for i in range(len(columns))])
        spread = np.sqrt(np.maximum(np.array([sum(r[f"q{i}"] for r in rest) / n for i in range(len(columns))]) - mean**2, 0))
        scales[out] = mean, np.where(spread < 1e-9, 1.0, spread)
    return scales


def by_fold(columns: list[str], keep: list[str], name: str, error: Callable[[int, np.ndarray], np.ndarray]):
    """For mapInArrow: the columns `keep` as they are, and error(fold, features) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float) if b.num_rows else np.zeros((0, len(columns)))
            fold, out = b.column("fold").to_numpy(zero_copy_only=False), np.full(b.num_rows, np.nan)
            for k in np.unique(fold):
                out[fold == k] = error(int(k), x[fold == k])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(out, pa.float64())], [*keep, name])

    return run


def _errors(rows: DataFrame, columns: list[str], keep: list[str], name: str, error: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    schema = rows.select(*keep).schema.add(name, "double")
    return rows.select(*dict.fromkeys([*keep, "fold", *columns])).mapInArrow(by_fold(columns, keep, name, error), schema)


def fit(rows: DataFrame, columns: list[str], folds: int = FOLDS, seeds: int = SEEDS, rounds: int = ROUNDS) -> tuple[dict, dict]:
    """Networks by (fold left out, seed) and scales by fold left out; rows have fold, held and columns."""
    scales = fold_scales(rows, columns, folds)
    # Of rows as deviations, every fold's means are near 0 and its spreads near 1, so single precision loses nothing.
    mean, spread = scales[0]
    near = {k: ((m - mean) / spread, s / spread) for k, (m, s) in scales.items()}
    table = written(packed(rows, columns, scales[0]), split_mb=4)
    models = {(out, seed): flat(start(len(columns), 1000 * seed + out)) for out in range(folds) for seed in range(seeds)}
    best, least, idle, going = dict(models), dict.fromkeys(models, np.inf), dict.fromkeys(models, 0), set(models)
    for number in range(rounds):
        now = {k: models[k] for k in going}
        got = table.mapInArrow(_packed_round(now, near, len(columns), number), "out int, seed int, i int, v double").groupBy("out", "seed", "i").agg(F.sum("v").alias("v")).toArrow()
        out, seed, i, v = (c.to_pylist() for c in got.columns)
        sums = dict(zip(zip(out, seed, i), v))
        for k in sorted(going):
            error = sums.get((*k, -2), 0.0) / max(sums.get((*k, -3), 0.0), 1)
            if error < least[k] - 1e-7:
                best[k], least[k], idle[k] = models[k], error, 0
            else:
                idle[k] += 1
            n = sums.get((*k, -1), 0.0)
            if idle[k] >= PATIENCE or not n:
                going.discard(k)
            else:
                models[k] = np.array([sums[(*k, i)] for i in range(len(models[k]))]) / n
        if not going:
            break
    return best, scales


def folded(c: DataFrame, folds: int = FOLDS, keep: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Contracts (of their columns those in `keep`, and what tells the fold) with features, fold and held, written once."""
    featured, columns = anomaly_features(c, None if keep is None else list(dict.fromkeys([*keep, *KEY])))
    key = F.xxhash64(*KEY)
    return written(featured.withColumn("fold", F.pmod(key, F.lit(folds)).cast("int")).withColumn("held", F.pmod(F.xxhash64(key), F.lit(100)) < HELD), split_mb=4, wide=True), columns


def networks_error(models: dict, scales: dict, width: int, seeds: int = SEEDS) -> Callable[[int, np.ndarray], np.ndarray]:
    """Mean squared error of rows of a fold under the networks that haven't seen it."""
    nets = {k: unflat(v, width) for k, v in models.items()}

    def error(fold: int, x: np.ndarray) -> np.ndarray:
        z = scaled(x, scales[fold])
        return np.mean([((forward(nets[fold, seed], z)[-1] - z) ** 2).mean(1) for seed in range(seeds)], axis=0)

    return error


def deep_scores(c: DataFrame, folds: int = FOLDS, seeds: int = SEEDS, keep: list[str] | None = None) -> DataFrame:
    """c, or its columns `keep`, with fold and deep_error."""
    keep = c.columns if keep is None else keep
    featured, columns = folded(c, folds, keep)
    models, scales = fit(featured.select("fold", "held", *columns), columns, folds, seeds)
    return _errors(featured, columns, [*keep, "fold"], "deep_error", networks_error(models, scales, len(columns), seeds))


def explain_deep(c: DataFrame, key: list[str], top: int = 400, least: float = 0.005, folds: int = FOLDS, seeds: int = SEEDS) -> DataFrame:
    """key, deep_error and factors of the contracts of the greatest error, scored again by their own fold's networks."""
    featured, columns = folded(c, folds, key)
    models, scales = fit(featured.select("fold", "held", *columns), columns, folds, seeds)
    error = networks_error(models, scales, len(columns), seeds)
    rows = _errors(featured, columns, [*key, GROUP, "fold", *columns], "deep_error", error)
    keep = [*key, "deep_error", "_at", "_own", "_peer"]
    return explain(rows, featured, columns, "deep_error", key, least, lambda v: _errors(v, columns, keep, "_new", error), top)


def _grams(scales: dict, columns: list[str]):
    """A partition's sums for each fold left out: rows, features and products of features, scaled as the fold has them."""
    width = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros((width + 1, width + 1)) for k in scales}
        for b in batches:
            if b.num_rows:
                x, fold = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns]).astype(float), b.column("fold").to_numpy(zero_copy_only=False)
                for k in scales:
                    z = scaled(x[fold != k], scales[k])
                    one = np.hstack([np.ones((len(z), 1)), z])
                    total[k] += one.T @ one
        out, i, v = zip(*[(k, i, v) for k, m in total.items() for i, v in enumerate(m.ravel())])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), pa.array(i, pa.int32()), pa.array(v, pa.float64())], ["out", "i", "v"])

    return run


def principal_components(rows: DataFrame, columns: list[str], scales: dict, components: int = 3) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per fold the mean and the leading components of the rows outside it, from one pass that sums products where they lie."""
    width = len(columns) + 1
    got = rows.select("fold", *columns).mapInArrow(_grams(scales, columns), "out int, i int, v double").groupBy("out", "i").agg(F.sum("v").alias("v")).collect()
    found = {}
    for k in scales:
        gram = np.zeros(width * width)
        for r in got:
            if r["out"] == k:
                gram[r["i"]] = r["v"]
        gram = gram.reshape(width, width)
        n = max(gram[0, 0], 1.0)
        mean = gram[0, 1:] / n
        _, vectors = np.linalg.eigh(gram[1:, 1:] / n - np.outer(mean, mean))
        found[k] = mean, vectors[:, ::-1][:, :components].T
    return found


def component_errors(c: DataFrame, components: int = 3, folds: int = FOLDS, keep: list[str] | None = None) -> DataFrame:
    """c, or its columns `keep`, with fold and pca_error, the linear measure beside deep_error: mean squared error of a contract's features rebuilt
    from the leading components of the other folds."""
    keep = c.columns if keep is None else keep
    featured, columns = folded(c, folds, keep)
    scales = fold_scales(featured, columns, folds)
    found = principal_components(featured, columns, scales, components)

    def error(fold: int, x: np.ndarray) -> np.ndarray:
        z, (mean, parts) = scaled(x, scales[fold]), found[fold]
        return (((z - mean) @ parts.T @ parts + mean - z) ** 2).mean(1)

    return _errors(featured, columns, [*keep, "fold"], "pca_error", error)
