"""Logistic regressions of many labels over shared sparse features: one pass serves all labels."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.operators.features import pair_counts, row_items, row_pairs, slices
from presswork.session import stage

#: Entries of one block of rows, and partial sums that are added up on the driver: those of at
#: most DIRECT tasks, or of PARTIALS tasks that add up those of all others.
BLOCK_ENTRIES = 1 << 18
PARTIALS, DIRECT = 16, 48
BLOCK = "starts binary, indices binary, entries binary, targets binary, weights binary"
PARTIAL = "slot int, total double, losses binary, gradient binary"


class Descent:
    """L-BFGS for one label: evaluate at ``trial``, ``tell`` the loss and gradient there, until ``done``.

    ``curvature`` is a diagonal near that of the second derivatives.  It scales the variables,
    so that the number of steps does not follow the spread between frequent and rare terms.
    """

    def __init__(self, start: np.ndarray, tol: float, memory: int = 10, curvature: np.ndarray | float = 1.0):
        self.inverse = 1.0 / curvature
        self.trial, self.tol, self.done = start, tol, False
        self.at, self.loss, self.gradient, self.step, self.way = None, np.inf, None, 0.0, None
        self.pairs: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)

    def tell(self, loss: float, gradient: np.ndarray) -> None:
        if self.at is not None:
            if loss > self.loss + 1e-4 * self.step * (self.gradient @ self.way):
                self.step *= 0.4
                self.done = self.step < 1e-8
                self.trial = self.at if self.done else self.at + self.step * self.way
                return
            moved, turned = self.trial - self.at, gradient - self.gradient
            if moved @ turned > 1e-12 * (turned @ turned):
                self.pairs.append((moved, turned, 1.0 / (moved @ turned)))
            self.done = self.loss - loss <= 1e-9 * max(1.0, abs(loss)) and abs(gradient).max() <= 100 * self.tol
        self.at, self.loss, self.gradient = self.trial, loss, gradient
        if self.done or abs(gradient).max() <= self.tol:
            self.done = True
            return
        way, steps = -gradient, []
        for moved, turned, share in reversed(self.pairs):
            steps.append(share * (moved @ way))
            way = way - steps[-1] * turned
        if self.pairs:
            moved, turned, share = self.pairs[-1]
            way = self.inverse * way / (share * (turned @ (self.inverse * turned)))
        else:
            way = self.inverse * way
        for moved, turned, share in self.pairs:
            way = way + (steps.pop() - share * (turned @ way)) * moved
        if way @ gradient >= 0:
            way = -self.inverse * gradient
            self.pairs.clear()
        self.way = way
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / np.linalg.norm(gradient))
        self.trial = self.at + self.step * self.way


class Block:
    """Rows of sparse features with their targets, one column per label."""

    def __init__(self, starts, indices, entries, targets, weights):
        self.starts, self.indices, self.entries, self.targets, self.weights = starts, indices, entries, targets, weights
        self.rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))

    def add_to(self, points: np.ndarray, labels: list[int], losses: np.ndarray, gradient: np.ndarray) -> None:
        """Add the losses and gradients at ``points``, one column per label with the intercept last."""
        n, size = len(self.starts) - 1, len(points) - 1
        columns = np.ascontiguousarray(points.T)
        for k, label in enumerate(labels):
            margin = np.bincount(self.rows, self.entries * columns[k][self.indices], n) + points[-1, k]
            y = self.targets[:, label]
            losses[k] += self.weights @ (np.logaddexp(0.0, margin) - y * margin)
            rest = self.weights * (1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700))) - y)
            gradient[:-1, k] += np.bincount(self.indices, self.entries * rest[self.rows], size)
            gradient[-1, k] += rest.sum()

    def curve(self, points: np.ndarray, curvature: np.ndarray) -> None:
        """Add the diagonal of the second derivatives at ``points``, one column per label."""
        n, size, squares = len(self.starts) - 1, len(points) - 1, self.entries * self.entries
        for k, at in enumerate(np.ascontiguousarray(points.T)):
            margin = np.bincount(self.rows, self.entries * at[self.indices], n) + at[-1]
            share = 1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700)))
            share = self.weights * share * (1.0 - share)
            curvature[:-1, k] += np.bincount(self.indices, squares * share[self.rows], size)
            curvature[-1, k] += share.sum()


def _read(batches: Iterator[pa.RecordBatch], labels: int) -> Iterator[Block]:
    for batch in batches:
        for row in zip(*(c for c in batch.columns)):
            parts = [np.frombuffer(v.as_py(), t) for v, t in zip(row, (np.int64, np.int32, np.float64, np.float64, np.float64))]
            parts[3] = parts[3].reshape(-1, labels)
            yield Block(*parts)


def blocks(terms: DataFrame, vocabulary: list[str], idf: list[float], labels: list[str], weight: str | None = None, *,
           column: str = "terms", pairs: bool = False) -> DataFrame:
    """Rows of an array of terms and labels as blocks of unit TF-IDF rows; tasks keep their rows.

    With ``pairs`` the array holds tokens, and their bigrams are terms as well.
    """
    scale = np.array(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = pa.array(vocabulary, pa.string())
        for batch in batches:
            targets = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], axis=1)
            for first, last in slices(batch.column(0)):
                n = last - first
                rows, items = row_items(batch.column(0).slice(first, n))
                rows, items = row_pairs(rows, items) if pairs else (rows, items)
                codes = pc.fill_null(pc.index_in(items, value_set=numbers), -1).to_numpy(zero_copy_only=False)
                rows, indices, counts = pair_counts(rows[codes >= 0], codes[codes >= 0], len(vocabulary))
                values = counts * scale[indices]
                starts = np.searchsorted(rows, np.arange(n + 1))
                norms = np.array([np.linalg.norm(values[a:b]) for a, b in zip(starts, starts[1:])])
                values = values / np.maximum(norms, 1e-300)[rows]
                at = 0
                while at < n:
                    end = int(np.searchsorted(starts, starts[at] + BLOCK_ENTRIES))
                    end = min(max(end, at + 1), at + (1 << 14), n)
                    own, y = slice(starts[at], starts[end]), targets[first + at:first + end]
                    parts = [(starts[at:end + 1] - starts[at]).astype(np.int64), indices[own].astype(np.int32), values[own],
                             np.ascontiguousarray(y[:, :len(labels)]), np.ascontiguousarray(y[:, -1])]
                    yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], [c.split()[0] for c in BLOCK.split(", ")])
                    at = end

    columns = [F.coalesce(F.col(x).cast("double"), F.lit(0.0)).alias(f"_y{i}") for i, x in enumerate(labels)]
    weights = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    return stage(terms.select(column, *columns, weights.alias("_w")).mapInArrow(run, BLOCK), "fit-blocks")


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, losses, gradient = 0.0, None, None
    for batch in batches:
        for _, t, x, g in zip(*(c.to_pylist() for c in batch.columns)):
            x, g = np.frombuffer(x), np.frombuffer(g)
            total, losses, gradient = (t, x, g) if losses is None else (total + t, losses + x, gradient + g)
    if losses is not None:
        yield _partial(0, total, losses, gradient)


def _summed(partials: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """The sums of partial results."""
    rows = partials.collect()
    return (sum(r["total"] for r in rows), sum(np.frombuffer(r["losses"]) for r in rows), sum(np.frombuffer(r["gradient"]) for r in rows))


def _partial(slot: int, total: float, losses: np.ndarray, gradient: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([slot], pa.int32()), pa.array([float(total)]), pa.array([losses.tobytes()], pa.binary()),
        pa.array([gradient.tobytes()], pa.binary())], ["slot", "total", "losses", "gradient"])


def _slot() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() % PARTIALS


def _descend(evaluate, starts: np.ndarray, penalty: float, tol: float, passes: int, curvature: np.ndarray | None = None) -> np.ndarray:
    """Minimise mean loss plus penalty of each label; ``evaluate(points, labels)`` gives mean losses and gradients."""
    runs = [Descent(starts[:, k].copy(), tol, curvature=1.0 if curvature is None else curvature[:, k]) for k in range(starts.shape[1])]
    for _ in range(passes):
        active = [k for k, r in enumerate(runs) if not r.done]
        if not active:
            break
        points = np.stack([runs[k].trial for k in active], axis=1)
        losses, gradient = evaluate(points, active)
        free = points.copy()
        free[-1] = 0.0  # the intercept is not penalised
        losses = losses + 0.5 * penalty * (free * free).sum(axis=0)
        gradient = gradient + penalty * free
        for i, k in enumerate(active):
            runs[k].tell(float(losses[i]), gradient[:, i])
    return np.stack([r.trial if r.at is None else r.at for r in runs], axis=1)


def fit_labels(data: DataFrame, size: int, labels: int, c: float = 1.0, tol: float = 1e-6, passes: int = 1000) -> np.ndarray:
    """Weights with the intercept last, a column per label, of the loss sum plus ``|w|**2 / (2 c)`` over ``blocks``.

    The first pass solves each task's own rows and averages, which is exact where one task
    holds all of them and close to the end elsewhere; it also gives the curvature there, by
    which further steps are scaled.  Each further pass evaluates all labels
    that are still moving at their own points; a label costs arithmetic, not passes.
    """
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = list(_read(batches, labels))
        n = sum(b.weights.sum() for b in own)
        if n > 0:
            def evaluate(points, active):
                losses, gradient = np.zeros(len(active)), np.zeros(points.shape)
                for b in own:
                    b.add_to(points, active, losses, gradient)
                return losses / n, gradient / n

            found = _descend(evaluate, np.zeros((size + 1, labels)), 1.0 / (c * n), tol, passes)
            curvature = np.zeros(found.shape)
            for b in own:
                b.curve(found, curvature)
            yield _partial(_slot(), n, np.zeros(labels), np.stack([found * n, curvature]))

    # two levels where the tasks are many; a second one costs each pass another round of tasks
    tasks = data.rdd.getNumPartitions()
    many = tasks > DIRECT

    def passed(run) -> DataFrame:
        partials = data.mapInArrow(run, PARTIAL)
        return partials.repartition(PARTIALS, "slot").mapInArrow(_added, PARTIAL) if many else partials

    n, _, summed = _summed(passed(local))
    start, curvature = summed.reshape(2, size + 1, labels) / n
    curvature[:-1] += 1.0 / (c * n)
    curvature[-1] += 1e-9

    def evaluate(points, active):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            losses, gradient = np.zeros(len(active)), np.zeros(points.shape)
            for b in _read(batches, labels):
                b.add_to(points, active, losses, gradient)
            yield _partial(_slot(), 0.0, losses, gradient)

        _, losses, gradient = _summed(passed(run))
        return losses / n, gradient.reshape(points.shape) / n

    # the solution of a single task is the end, whatever the scale
    return _descend(evaluate, start, 1.0 / (c * n), tol, passes, curvature if tasks > 1 else None)
