"""Bounded labelled samples, small numpy models, and models that all tasks train and whose parameters are averaged."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import materialize


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training: Column, most: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of at most about `most` labelled training documents, chosen by a hash of the key.

    Rows of labels with a null key or label are left out; a key with several labels has the largest. The sample's keys
    are few by the bound, so they are broadcast and the documents are read once, without a shuffle.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & training).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    known = materialize(known, "labels")
    n = known.count()
    share = min(1.0, most / n) if n else 1.0
    chosen = known.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)))
    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), key)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Newton's method; the last weight is the intercept, which isn't penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2 * max(1, len(x)))
    penalty[-1] = 1e-9 * max(1, len(x))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-8)
        step = np.linalg.solve(h, g)
        norm = np.abs(step).max()
        w -= step * min(1.0, 5 / max(norm, 1e-12))
        if norm < 1e-6:
            break
    return w


#: Numbers of a parameter vector in one row of the averaging.
PIECE = 1 << 13


def averaged_round(df: DataFrame, start: np.ndarray, fit: Callable[[np.ndarray, Iterable[pa.RecordBatch]], tuple[np.ndarray, int]]) -> np.ndarray:
    """One round of training over all rows of df: each task fits the start vector to its rows, the results are averaged.

    fit(vector, batches) returns a task's vector and the examples that it took, by which it weighs. A task sends one
    vector, cut in small pieces; a piece's sum is made by one task, row by row, so only one vector reaches the driver.
    """
    shared = df.sparkSession.sparkContext.broadcast(start.astype(np.float32))
    pieces = range(0, len(start), PIECE)

    def local(batches):
        vector, n = fit(shared.value.copy(), batches)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([n] * len(pieces), pa.int64()), pa.array([vector[a : a + PIECE].astype("<f4").tobytes() for a in pieces], pa.binary())], names=["piece", "n", "part"])

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        weight: dict[int, int] = {}
        for b in batches:
            for k, n, part in zip(*(c.to_pylist() for c in b.columns)):
                total[k] = total.get(k, 0.0) + n * np.frombuffer(part, dtype="<f4").astype(np.float64)
                weight[k] = weight.get(k, 0) + n
        for k in total:
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([(total[k] / weight[k]).astype("<f4").tobytes()], pa.binary())], names=["piece", "part"])

    sent = df.mapInArrow(local, "piece int, n long, part binary").repartition("piece")
    got = {r["piece"]: np.frombuffer(bytes(r["part"]), dtype="<f4") for r in sent.mapInArrow(summed, "piece int, part binary").collect()}
    shared.unpersist()
    return np.concatenate([got[k] for k in range(len(pieces))]) if got else start


def packed_up(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([p.ravel() for p in parts]).astype(np.float32)


def unpacked(vector: np.ndarray, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    out, at = [], 0
    for shape in shapes:
        n = int(np.prod(shape))
        out.append(vector[at : at + n].reshape(shape).astype(np.float32))
        at += n
    return out
