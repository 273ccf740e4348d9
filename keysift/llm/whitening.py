"""Embedding whitening by weighted multiplicity covariance.

Entries become whole numbers, ``floor(scale * c) + offset``, so that sums are exact and equal vectors are
equal. Identical vectors are grouped once, with their counts; the fit weighs each by its count, or by one.
The covariance is a product of the centred matrix with itself, weighted, summed over blocks of rows: the
mean is subtracted first, in whole numbers as far as it goes, so that nothing cancels. Each distinct vector
is whitened once and the rows are joined to it.

The driver holds sums and the covariance: the square of a vector's length, never a row. Everything per
vector is done in tasks. Vectors of one length are fitted together and apart from those of other lengths.

Rows whose vector is null or holds a null, NaN or infinite entry are in no fit and have no result; neither
has an empty vector. Components without variance, which are no direction of the data, are left out: a lone
vector has none. Entries beyond 2**31 once scaled raise an error, as sums of them might not be exact.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import fresh, stored

SCALE = 1024
OFFSET = 100_000
LIMIT = 2**31
COMPONENTS = 8
#: Vectors with over a thousandth of all rows are under a thousand: those are joined by a broadcast.
HOT_SHARE = 1000


def usable(vector: Column) -> Column:
    """Whether a vector has entries and all of them are finite; false for null."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def whole_numbers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    def entry(c: Column) -> Column:
        scaled = c.cast("double") * scale
        fits = F.abs(scaled) < float(LIMIT)
        return F.when(fits, F.floor(scaled) + offset).otherwise(
            F.raise_error(F.lit("an entry of a vector is too large to be summed exactly")).cast("long")
        )

    return F.transform(vector, entry)


def _key(x: Column) -> Column:
    return F.md5(F.array_join(x.cast("array<string>"), ","))


@dataclass(frozen=True)
class Whitening:
    """Fit of the vectors of one length. ``vectors`` has a unit eigenvector a row, ``values`` its variance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def deviation(self, x: np.ndarray) -> list[int]:
        """Squared distance from the mean times n squared, exact: in Python's whole numbers where 64 bits
        could overflow."""
        most = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums))
        if most * most * len(self.sums) < 2**63:
            off = x * self.n - np.array(self.sums)
            return (off * off).sum(axis=1).tolist()
        off = x.astype(object) * self.n - np.array(self.sums, object)
        return [sum(v * v for v in row) for row in off.tolist()]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.vectors.T / np.sqrt(self.values)


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``x - sums / n``: the nearest whole number is subtracted exactly, then the fraction that is left."""
    near = [(2 * s + n) // (2 * n) for s in sums]
    left = [(s - n * b) / n for s, b in zip(sums, near)]
    return (x - np.array(near, np.int64)) - np.array(left)


def _by_length(batch: pa.RecordBatch):
    """Of a batch, per length of vectors: the length, which rows they are, and the vectors as a matrix."""
    lists = batch.column("x")
    sizes = np.diff(np.asarray(lists.offsets, np.int64))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        own = lists.take(pa.array(at))
        yield size, at, np.asarray(own.flatten()).reshape(len(at), size)


def _summed(distinct: DataFrame, kind: str, add: Callable) -> dict[int, np.ndarray]:
    """Per length of vectors, the sum over all blocks of the matrix that ``add(size, x, weights)`` returns.

    A task adds up its own blocks and emits a row of each sum per row of the matrix. Spark adds up those of
    all tasks, cell by cell; the driver gets one matrix per length.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = np.asarray(batch.column("weight"))
            for size, at, x in _by_length(batch):
                part = add(size, x, weights[at])
                sums[size] = sums[size] + part if size in sums else part
        for size, total in sums.items():
            sizes, places = np.full(len(total), size, np.int32), np.arange(len(total), dtype=np.int32)
            columns = [pa.array(sizes), pa.array(places), pa.array(list(total))]
            yield pa.RecordBatch.from_arrays(columns, names=["size", "i", "cells"])

    rows = distinct.select("x", "weight").mapInArrow(run, f"size int, i int, cells array<{kind}>")
    cells = rows.select("size", "i", F.posexplode("cells").alias("j", "cell"))
    cells = cells.groupBy("size", "i", "j").agg(F.sum("cell").alias("cell"))
    shapes = {}
    collected = cells.collect()
    for cell in collected:
        rows_, columns_ = shapes.get(cell.size, (0, 0))
        shapes[cell.size] = (max(rows_, cell.i + 1), max(columns_, cell.j + 1))
    found = {
        size: np.zeros(shape, np.int64 if kind == "long" else np.float64) for size, shape in shapes.items()
    }
    for cell in collected:
        found[cell.size][cell.i, cell.j] = cell.cell
    return found


def distinct_vectors(df: DataFrame, column: str, weighting: str = "counts") -> DataFrame:
    """``(key, x, copies, weight)``: each vector of whole numbers once. Stored: all passes read it."""
    if weighting not in ("counts", "one"):
        raise ValueError("weighting is counts or one")
    vector = F.col(f"`{column}`")
    x = df.where(usable(vector)).select(whole_numbers(vector).alias("x"))
    weight = F.col("copies") if weighting == "counts" else F.lit(1).cast("long")
    grouped = x.groupBy("x").agg(F.count("*").alias("copies"))
    return stored(grouped.select(_key(F.col("x")).alias("key"), "x", "copies", weight.alias("weight")), "vectors")


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """Per length of vectors, a fit with up to ``components`` components, by falling variance."""

    def totals(size, x, weights):
        return np.append(weights @ x, weights.sum())[None, :]

    means = {}
    for size, total in _summed(distinct, "long", totals).items():
        *sums, n = total[0].tolist()
        means[size] = (n, tuple(sums))

    def products(size, x, weights):
        off = centred(x, *means[size])
        return (off * weights[:, None]).T @ off

    fits = {}
    for size, total in _summed(distinct, "double", products).items():
        n, sums = means[size]
        values, vectors = np.linalg.eigh((total + total.T) / (2 * n))
        values, vectors = values[::-1], vectors.T[::-1]
        real = values > max(values[0], 0) * size * np.finfo(float).eps
        best = slice(0, min(components, int(real.sum())))
        # Either sign would do; the largest entry is positive, so that reruns agree.
        signs = np.sign(vectors[np.arange(size), np.abs(vectors).argmax(axis=1)])
        vectors = vectors * signs[:, None]
        fits[size] = Whitening(n, sums, values[best].copy(), vectors[best].copy(), float(np.trace(total)) / n)
    return fits


def whitened_vectors(distinct: DataFrame, fits: dict[int, Whitening]) -> DataFrame:
    """``(key, copies, size, weight, x, deviation)``, where ``x`` are the whitened values. Stored."""
    schema = "key string, copies long, size int, weight long, x array<double>, deviation long"

    def run(batches):
        for batch in batches:
            for size, at, x in _by_length(batch):
                own = batch.take(pa.array(at))
                values = pa.array(list(fits[size].whitened(x)), pa.list_(pa.float64()))
                deviation = pa.array(fits[size].deviation(x), pa.int64())
                sizes = pa.array(np.full(len(at), size, np.int32))
                columns = [own.column("key"), own.column("copies"), sizes, own.column("weight"), values, deviation]
                names = ["key", "copies", "size", "weight", "x", "deviation"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return stored(distinct.mapInArrow(run, schema), "whitened")


def identity_errors(whitened: DataFrame, fits: dict[int, Whitening]) -> dict[int, float]:
    """Per length of vectors, how far the covariance of the whitened ones is from the identity at most.

    By number of components, each length's own: lengths are told apart by ``size``, not by ``x``.
    """
    found = {}
    for size, own in fits.items():
        rows, k = whitened.where(F.col("size") == size), len(own.values)
        if not k:
            found[size] = 0.0
            continue
        means = _summed(rows, "double", lambda _, x, w: (w @ x)[None, :])[k][0] / own.n
        products = _summed(rows, "double", lambda _, x, w: ((x - means) * w[:, None]).T @ (x - means))[k]
        found[size] = float(np.abs(products / own.n - np.eye(k)).max())
    return found


def with_whitened(
    df: DataFrame,
    column: str = "embedding",
    components: int = COMPONENTS,
    weighting: str = "counts",
    out: str = "whitened",
) -> DataFrame:
    """``df`` with a struct ``out``: ``n``, ``deviation``, ``values``, ``explained`` and ``identity_error``.

    ``values`` are a row's whitened components, ``explained`` the share of all variance of each; ``n`` is the
    sum of weights of the fit, ``deviation`` the exact sum over dimensions of (n * x - sum of x) squared.
    Null for rows whose vector cannot be used. ``weighting="one"`` fits each distinct vector once.
    """
    out = fresh(df, out)
    distinct = distinct_vectors(df, column, weighting)
    fits = fit(distinct, components)
    whitened = whitened_vectors(distinct, fits)
    errors = identity_errors(whitened, fits)

    def of_size(values: dict[int, object], kind: str) -> Column:
        picked = F.lit(None)
        for size, value in values.items():
            picked = F.when(F.col("size") == size, F.lit(value)).otherwise(picked)
        return picked.cast(kind)

    result = F.struct(
        of_size({size: own.n for size, own in fits.items()}, "long").alias("n"),
        "deviation",
        F.col("x").alias("values"),
        of_size({s: (own.values / own.trace).tolist() if own.trace else [] for s, own in fits.items()}, "array<double>").alias("explained"),
        of_size(errors, "double").alias("identity_error"),
    )
    found = whitened.select("key", "copies", result.alias("found"))
    total = whitened.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    hot = F.col("copies") * HOT_SHARE > total
    vector = F.col(f"`{column}`")
    key = F.when(usable(vector), _key(whole_numbers(vector)))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("key"))
    few = F.broadcast(found.where(hot).drop("copies"))
    often = rows.join(few, "key").select("row", "found")
    seldom = rows.where("key IS NOT NULL").join(few, "key", "left_anti")
    seldom = seldom.join(found.where(~hot).drop("copies"), "key").select("row", "found")
    without = rows.where("key IS NULL").select("row", F.lit(None).cast(found.schema["found"].dataType).alias("found"))
    return often.union(seldom).union(without).select("row.*", F.col("found").alias(out))
