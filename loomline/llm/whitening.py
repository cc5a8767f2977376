"""Embedding whitening: partitions compute count, mean and centred scatter, which merge pairwise in a tree (Chan's formula)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Entries beyond this give an error, as their integers and sums would leave 64 bits.
LARGEST = 2.0**40
#: An eigenvalue of at most this share of the largest one, times the dimensions, is zero but for rounding.
ROUNDING = 1e-13
#: Vectors centred at once.
BLOCK = 4096


@dataclass(frozen=True)
class Moments:
    """Of vectors: their number, exact sums, mean, and the scatter (sum of outer products) around the mean."""

    n: int
    sums: np.ndarray  # Python integers, of integer vectors only
    mean: np.ndarray
    scatter: np.ndarray

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(apart, apart) * (self.n * other.n / n)
        return Moments(n, self.sums + other.sums, self.mean + apart * (other.n / n), scatter)


@dataclass(frozen=True)
class Whitening:
    """What the fit knows: n vectors with sums; unit components as columns by falling eigenvalue; shares of the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - sums as exact integers, in 64 bits where they fit."""
        wide = int(np.abs(x).max(initial=0)) * self.n >= 2**62
        return x.astype(object) * self.n - self.sums if wide else x * self.n - self.sums.astype(np.int64)

    def projected(self, centred: np.ndarray) -> np.ndarray:
        """Coordinates of unit variance; NaN where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            made = (centred.astype(float) / self.n) @ self.components / np.sqrt(self.values)
        made[:, self.values <= 0] = np.nan
        return made


def moments_of(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0)
    apart = x - mean
    mean, apart = mean + apart.mean(axis=0), apart - apart.mean(axis=0)
    sums = x.sum(axis=0) if x.dtype == np.int64 else np.zeros(x.shape[1], np.int64)
    return Moments(len(x), sums.astype(object), mean, apart.T @ apart)


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), d)
    if np.abs(flat).max(initial=0) > LARGEST:
        raise OverflowError(f"an entry is beyond {LARGEST:.0f}: its integers would leave 64 bits")
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, _vectors(part.column("embedding"), d)


def _moments(d: int, fit: Whitening | None = None):
    """One row for each partition that has vectors: its moments, of the whitened coordinates if there is a fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _blocks(batches, d):
            part = moments_of(x if fit is None else fit.projected(fit.centred(x))[:, fit.values > 0])
            total = part if total is None else total.merged(part)
        if total is not None:
            sums = [str(s) for s in total.sums]
            yield pa.RecordBatch.from_arrays([pa.array([total.n]), pa.array([sums], pa.list_(pa.string())), pa.array([total.mean.tobytes()]), pa.array([total.scatter.tobytes()])], ["n", "sums", "mean", "scatter"])

    return run


def _loaded(row) -> Moments:
    d = len(row["sums"])
    return Moments(row["n"], np.array([int(s) for s in row["sums"]], dtype=object), np.frombuffer(row["mean"]), np.frombuffer(row["scatter"]).reshape(d, d))


def _merged(vectors: DataFrame, d: int, fit: Whitening | None = None) -> Moments:
    """The moments of all rows, one at least, merged pairwise in a tree of tasks."""
    parts = vectors.select("embedding").mapInArrow(_moments(d, fit), "n long, sums array<string>, mean binary, scatter binary")
    return parts.rdd.map(_loaded).treeReduce(Moments.merged)


def finite(vector: Column) -> Column:
    """A vector that has entries, none of them null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def fit(vectors: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of vectors (embedding, of d entries each), one at least. A second pass measures identity_error."""
    found = _merged(vectors, d)
    values, axes = np.linalg.eigh(found.scatter / found.n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    trace = np.trace(found.scatter) / found.n
    values = np.where(values > max(values[0], 0) * d * ROUNDING, values, 0.0)
    made = Whitening(found.n, found.sums, axes, values, values / trace if trace > 0 else values, 0.0)
    error = 0.0
    if (values > 0).any():
        seen = _merged(vectors, d, made)
        error = float(np.abs(seen.scatter / seen.n - np.eye(len(seen.mean))).max())
    return Whitening(made.n, made.sums, axes, values, made.explained, error)


def _whitened(d: int, fitted: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, d):
            centred = fitted.centred(x)
            if float(np.abs(centred).max(initial=0)) ** 2 * d >= 2**62:
                centred = centred.astype(object)
            deviation = (centred * centred).sum(axis=1)
            made = fitted.projected(centred)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * made.shape[1], pa.int32()), pa.array(made.ravel(), from_pandas=True))
            rest = [i for i, name in enumerate(part.schema.names) if name != "embedding"]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), pa.array(list(map(int, deviation)), pa.int64()), lists], [*(part.schema.names[i] for i in rest), "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, n, deviation, whitened, explained and identity_error of each row of vectors (vec_id, embedding).

    An entry c counts as floor(1024*c)+100000. n vectors fit the whitening; deviation is the exact sum over the dimensions of
    (n*x - sum)^2, an error where it leaves 64 bits; whitened and explained are arrays with one entry for each
    component, at most as many as there are dimensions; identity_error is the largest difference of the covariance of
    all whitened rows, seen in a second pass, from the identity. Components without variance (equal vectors, fewer vectors
    than dimensions) have null in whitened, 0 in explained, and no part in identity_error. Rows whose vector is null or
    empty or has null, NaN or infinite entries are dropped; vectors of unlike length can't be fitted together: those of the
    most frequent length are (of several the longest), the others are dropped. Repeated rows count each time; an empty table
    gives an empty one; columns but vec_id and embedding are ignored. The driver holds a scatter of dimensions squared.
    """
    sound = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(finite(F.col("embedding")))
    lengths = sound.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = lengths["d"] if lengths else 1
    sound = sound.where(F.size("embedding") == d)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, deviation long, whitened array<double>"
    fitted = fit(sound, d, components) if lengths else None
    made = sound.mapInArrow(_whitened(d, fitted), schema) if fitted else vectors.sparkSession.createDataFrame([], schema)
    constants = {
        "n": F.lit(fitted.n if fitted else 0).cast("long"),
        "explained": F.array(*map(F.lit, map(float, fitted.explained))) if fitted else F.array().cast("array<double>"),
        "identity_error": F.lit(fitted.identity_error if fitted else 0.0),
    }
    return made.withColumns(constants)
