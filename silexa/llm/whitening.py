"""Whitening of embeddings by singular value decompositions that are merged up a tree.

Every task keeps the number, the exact sums and the full-rank decomposition (singular values and right vectors) of the centred rows it has seen, some thousand rows at a time. Two
states merge without loss: the scaled vectors of both and one more row, sqrt(n1 n2 / (n1 + n2)) times the difference of the means, have the same products as all centred rows together, and are decomposed
again with all their dimensions. Tasks' states meet ``FAN`` at a time, level by level, as groups on Spark; one state of dimension squared numbers is left, whatever the number of rows.

Entries become integers first (floor(1024 c) + 100000), so numbers and sums are exact: they travel as decimal text, and means differ by exact fractions. Covariances have the divisor n.
The whitened rows' own covariance is measured over all rows, centred, and merged up the same tree.

Defined cases: rows whose vector is null, or holds a null, a value that is not finite or one of 2^52 or more (its integer would not fit), are dropped. The dimension is that of most
remaining rows (ties: the largest), and rows of another one are dropped, empty vectors too. Directions without variance (a standard deviation under 1e-12 of the greatest) have no component, so a
single row, or equal rows alone, give no rows; there are fewer components than asked for if the dimension is smaller. Repeated rows count each time. ``deviation`` is null where it is no long. Extra columns
are not returned; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch

SCALE, SHIFT = 1024, 100_000
#: States that meet in one group.
FAN = 8
#: Values that are decomposed at once.
BLOCK = 1 << 18
FLAT = 1e-12
_STATE = "slot long, n long, sums array<string>, spread array<double>, vectors array<double>"


@dataclass
class State:
    """Number and sums (exact) of rows, and the singular values and right vectors of the centred rows."""

    n: int
    sums: list[int]
    spread: np.ndarray
    vectors: np.ndarray

    def row(self, slot: int) -> dict:
        return {"slot": slot, "n": self.n, "sums": [str(s) for s in self.sums], "spread": self.spread.tolist(), "vectors": self.vectors.ravel().tolist()}

    @staticmethod
    def of(row) -> State:
        return State(int(row["n"]), [int(s) for s in row["sums"]], np.array(row["spread"], dtype=float), np.array(row["vectors"], dtype=float).reshape(len(row["spread"]), len(row["sums"])))


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of integers in two halves, so that none overflows."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(h << 32) + s for h, s in zip(high.sum(axis=0).tolist(), low.sum(axis=0).tolist(), strict=True)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n; whole parts are subtracted as integers."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    return (x - whole).astype(float) - np.array([(s % n) / n for s in sums])


def decompose(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, spread, vectors = np.linalg.svd(rows, full_matrices=False)
    return spread, vectors


def of_rows(x: np.ndarray) -> State:
    sums = exact_sums(x)
    return State(len(x), sums, *decompose(centred(x, len(x), sums)))


def merged(a: State, b: State) -> State:
    n = a.n + b.n
    apart = np.array([(s * b.n - t * a.n) / (a.n * b.n) for s, t in zip(a.sums, b.sums, strict=True)])
    stack = np.vstack([a.spread[:, None] * a.vectors, b.spread[:, None] * b.vectors, sqrt(a.n * b.n / n) * apart[None]])
    return State(n, [s + t for s, t in zip(a.sums, b.sums, strict=True)], *decompose(stack))


def usable(embedding: str) -> Column:
    """Whether a vector is there and all its entries are finite."""
    return F.col(embedding).isNotNull() & F.forall(embedding, lambda c: F.coalesce(F.abs(c.cast("double")) < float(1 << 52), F.lit(False)))


def integers(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def _tree(states: DataFrame, merge, schema: str) -> DataFrame:
    """The one row that the rows of ``states`` (slot, ...) come to when ``merge`` takes ``FAN`` of them at a time."""
    while states.count() > 1:
        states = materialise(states.groupBy(F.floor(F.col("slot") / FAN).alias("slot")).applyInPandas(merge, schema), "states")
    return states


def fit(vectors: DataFrame) -> State | None:
    """The state of all rows of ``vectors`` (embedding alone, all usable and of one length); None without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = None
        for batch in batches:
            x = integers(batch.column(0))
            step = max(1, BLOCK // max(1, x.shape[1]))
            for k in range(0, len(x), step):
                own = of_rows(x[k : k + step])
                state = own if state is None else merged(state, own)
        if state:
            yield pa.RecordBatch.from_pylist([state.row(TaskContext.get().partitionId())], schema=pa.schema([("slot", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("spread", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))]))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        states = [State.of(r) for r in rows.sort_values("slot").to_dict("records")]
        out = states[0]
        for s in states[1:]:
            out = merged(out, s)
        return pd.DataFrame([out.row(int(rows["slot"].min()) // FAN)])

    last = _tree(materialise(vectors.mapInArrow(run, _STATE), "states"), merge, _STATE).first()
    return State.of(last) if last else None


@dataclass
class Components:
    """Unit vectors by falling eigenvalue; each one's greatest entry is positive."""

    state: State
    values: np.ndarray
    vectors: np.ndarray
    shares: np.ndarray

    @staticmethod
    def of(state: State, most: int) -> Components:
        kept = state.spread[:most] > FLAT * max(state.spread.max(initial=0.0), np.finfo(float).tiny)
        vectors = state.vectors[:most][kept]
        signs = np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)]) if len(vectors) else np.ones(0)
        total = float((state.spread**2).sum())
        return Components(state, state.spread[:most][kept] ** 2 / state.n, vectors * signs[:, None], state.spread[:most][kept] ** 2 / total if total else np.zeros(0))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.state.n, self.state.sums) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Per row the sum of (n x - S)^2, exact."""
        n, sums = self.state.n, self.state.sums
        whole, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([s % n for s in sums], dtype=object)
        near = x - whole
        most = max(int(np.abs(near).max(initial=0)) + 1, 1) * n
        if most < 1 << 31 and most * most * x.shape[1] < 1 << 63:
            return ((near * n - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        far = ((near.astype(object) * n - rest) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in far.tolist()]


def _identity_error(vectors: DataFrame, model: Components) -> float:
    """Greatest absolute entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k = len(model.values)
    schema = "slot long, n long, mean array<double>, products array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = model.whiten(integers(batch.column(0)))
                own = w.mean(axis=0)
                n, mean, products = _joined((n, mean, products), (len(w), own, (w - own).T @ (w - own)))
        if n:
            yield pa.RecordBatch.from_pydict({"slot": [TaskContext.get().partitionId()], "n": [n], "mean": [mean.tolist()], "products": [products.ravel().tolist()]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out = (0, np.zeros(k), np.zeros((k, k)))
        for r in rows.sort_values("slot").to_dict("records"):
            out = _joined(out, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(k, k)))
        return pd.DataFrame([{"slot": int(rows["slot"].min()) // FAN, "n": out[0], "mean": out[1].tolist(), "products": out[2].ravel().tolist()}])

    last = _tree(materialise(vectors.mapInArrow(run, schema), "moments"), merge, schema).first()
    return float(np.abs(np.array(last["products"]).reshape(k, k) / last["n"] - np.eye(k)).max())


def _joined(a, b):
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def whitened(rows: DataFrame, most: int = 8, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each usable row and component up to ``most``: ``key``, component, n, deviation, whitened, explained and identity_error."""
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    good = rows.select(F.col(key).alias("key"), F.col(embedding).alias("v")).filter(usable("v") & (F.size("v") > 0))
    size = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if size is None:
        return rows.sparkSession.createDataFrame([], schema)
    good = good.filter(F.size("v") == size["size"])
    with scratch(rows.sparkSession):
        model = Components.of(fit(good.select("v")), most)
        if not len(model.values):
            return rows.sparkSession.createDataFrame([], schema)
        error = _identity_error(good.select("v"), model)
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // size["size"])
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = integers(batch.column(1))
                each = np.repeat(np.arange(len(x)), k)
                values = [batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), model.state.n)), pa.array(model.deviations(x), pa.int64()).take(pa.array(each)), pa.array(model.whiten(x).ravel()), pa.array(np.tile(model.shares, len(x))), pa.array(np.full(len(each), error))]
                yield pa.RecordBatch.from_arrays(values, names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return good.mapInArrow(run, schema)
