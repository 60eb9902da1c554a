"""Fitting a model with one weight per feature by L-BFGS, each gradient being one Spark job over stored features."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: (weights, label, feature index, feature value) of a batch, features row by row -> loss and gradient of the batch
Loss = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[float, np.ndarray]]


def gradient(rows: DataFrame, loss: Loss, weights: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of loss and gradient over all rows (label, ids, values); each task sends one vector, which the driver adds up."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, grad = 0.0, np.zeros(len(weights))
        for batch in batches:
            ids = batch.column("ids")
            sizes = np.diff(ids.offsets.to_numpy())
            one, g = loss(weights, batch.column("label").to_numpy(), sizes, ids.flatten().to_numpy(), batch.column("values").flatten().to_numpy())
            total, grad = total + one, grad + g
        yield pa.RecordBatch.from_pydict({"loss": [total], "grad": [grad.astype(np.float32).tobytes()]})

    total, grad = 0.0, np.zeros(len(weights))
    for row in rows.mapInArrow(part, "loss double, grad binary").toLocalIterator():
        total, grad = total + row.loss, grad + np.frombuffer(row.grad, np.float32)
    return total, grad


def minimise(rows: DataFrame, loss: Loss, start: np.ndarray, penalty: np.ndarray, count: int, steps: int = 25, memory: int = 8) -> np.ndarray:
    """Weights of the smallest mean loss plus ``penalty / 2 * weights^2``.

    ``rows`` is a stored sample of bounded size in a bounded number of partitions, so what reaches the driver per step is bounded.
    """

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        total, grad = gradient(rows, loss, w)
        return total / count + float((penalty * w * w).sum()) / 2, grad / count + penalty * w

    w = start
    value, grad = at(w)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, kept = grad.copy(), []
        for s, y in reversed(moves):
            a = (s @ direction) / (s @ y)
            kept.append(a)
            direction -= a * y
        if moves:
            s, y = moves[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y), a in zip(moves, reversed(kept)):
            direction += s * (a - (y @ direction) / (s @ y))
        size = 1.0 if moves else 1.0 / max(np.abs(grad).sum(), 1e-12)
        for _ in range(12):
            trial = w - size * direction
            new, slope = at(trial)
            if new <= value - 1e-4 * size * (direction @ grad):
                break
            size /= 2
        else:
            break
        step, change = trial - w, slope - grad
        done = value - new <= 1e-6 * max(abs(value), 1e-9)
        w, value, grad = trial, new, slope
        if done:
            break
        if step @ change > 1e-12:
            moves = [*moves, (step, change)][-memory:]
    return w
