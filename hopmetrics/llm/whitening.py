"""Whitening embeddings: projections on leading components, scaled to unit variance.

Each component c becomes the integer floor(1024 c) + 100000. Counts, sums and products of
all vectors are whole numbers, added up by task and then by Spark: a first pass gives the
sums, a second one the products of the vectors less the rounded mean, centred before they
are multiplied (``exact.gram``). The covariance follows from these integers with one
rounding per entry, whatever the partitions were. It has the size of the dimension
squared; its leading eigenpairs are found on the driver by spectrum slicing
(``spectrum.leading``). A third pass projects every row, and a last one takes the
covariance of what came out, to report its distance from the identity.

Cases: rows whose vector is null, empty or holds a null or a non-finite component are
dropped. Null ids, repeated rows and shared ids are rows of their own. There are as many
components as dimensions if those are fewer. A component whose variance is lost in
rounding (equal vectors, fewer rows than components) has a null ``whitened``, 0 as
``explained``, and no part in ``identity_error``. A deviation that does not fit into a
long is null. Vectors of different lengths, and components of 2^52 / 1024 and more, raise an error.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopmetrics.llm import common, exact, spectrum, vectors

SHIFT = 100_000
COMPONENTS = 8
#: Of the largest variance, what a component must have for its sign and scale to mean something.
LEAST = 1e-12


@dataclass
class Whitening:
    n: int
    sums: list[int]
    #: Rounded mean of each dimension, subtracted as a whole number.
    centre: np.ndarray
    trace: float
    values: np.ndarray
    #: A unit vector per row.
    components: np.ndarray

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) if used else 0.0 for e, used in zip(self.values, self.used, strict=True)]

    @property
    def used(self) -> list[bool]:
        return [bool(e > LEAST * self.values[0]) for e in self.values]


def kept(rows: DataFrame) -> DataFrame:
    """vec_id, v: the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(vectors.finite(F.col("v")))


def integers(v: np.ndarray) -> np.ndarray:
    return exact.scaled(v) + SHIFT


_CELLS = "cell long, n long, high long, low long"


def _cells(values: list[int], n: int) -> pa.RecordBatch:
    high, low = exact.halves(values)
    columns = [range(len(values)), [n] * len(values), high, low]
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["cell", "n", "high", "low"])


def _totals(partial: DataFrame) -> tuple[int, list[int]]:
    """Rows, and the total of each cell; as many as one task gives."""
    rows = partial.groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low"))).collect()
    rows.sort(key=lambda r: r.cell)
    return (rows[0].n, [exact.whole(r.high, r.low) for r in rows]) if rows else (0, [])


def sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and sum of each dimension."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for _, v in vectors.blocks(batches, 0, d):
            x = integers(v)
            n += len(x)
            high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
            total = [t + exact.whole(h, w) for t, h, w in zip(total, high, low, strict=True)]
        yield _cells(total, n)

    return _totals(rows.select("v").mapInArrow(add_up, _CELLS))


def products(rows: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Sums of the products of all pairs of dimensions less their centre, in Python integers."""
    d = len(centre)
    shared = rows.sparkSession.sparkContext.broadcast(centre)
    upper = np.triu_indices(d)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for _, v in vectors.blocks(batches, 0, d):
            total += exact.gram(integers(v) - shared.value)
        yield _cells(total[upper].tolist(), 0)

    out = np.zeros((d, d), object)
    out[upper] = _totals(rows.select("v").mapInArrow(add_up, _CELLS))[1]
    return np.triu(out) + np.triu(out, 1).T


def covariance(n: int, rest: list[int], gram: np.ndarray) -> np.ndarray:
    """Covariance with divisor n, from the sums and products of centred integers: one rounding each."""
    left = np.array(rest, object)
    exactly = gram * n - np.outer(left, left)
    return np.array([[int(c) / (n * n) for c in row] for row in exactly], float)


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """From the rows of ``kept``, all of them."""
    n, total = sums(rows, d)
    centre = [(2 * s + n) // (2 * n) for s in total]
    gram = products(rows, np.array(centre, np.int64))
    v = covariance(n, [s - n * c for s, c in zip(total, centre, strict=True)], gram)
    values, basis = spectrum.leading(v, components)
    return Whitening(n, total, np.array(centre, np.int64), float(np.trace(v)), values, basis)


def deviations(x: np.ndarray, model: Whitening) -> list[int]:
    """Of each vector the sum over dimensions of (n x - sum)^2."""
    low, high = x.min(axis=0).tolist(), x.max(axis=0).tolist()
    most = max(
        max(abs(model.n * a - s), abs(model.n * b - s)) for a, b, s in zip(low, high, model.sums, strict=True)
    )
    if most * most * x.shape[1] <= exact.LONG:
        away = model.n * x - np.array(model.sums, np.int64)
        return (away * away).sum(axis=1).tolist()
    away = model.n * x.astype(object) - np.array(model.sums, object)
    return (away * away).sum(axis=1).tolist()


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation, whitened (array of double): a row per row of ``kept``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    d = len(model.sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        rest = np.array([(s - model.n * int(c)) / model.n for s, c in zip(model.sums, model.centre, strict=True)])
        used = np.array(model.used)
        scale = np.sqrt(np.where(used, model.values, 1.0))
        for batch, v in vectors.blocks(batches, 1, d):
            x = integers(v)
            w = ((x - model.centre) - rest) @ model.components.T / scale
            flat = pa.array(w.ravel(), mask=np.tile(~used, len(w)))
            lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * len(used), flat)
            away = pa.array([a if a <= exact.LONG else None for a in deviations(x, model)], pa.int64())
            yield pa.record_batch([batch.column(0), away, lists], names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "v").mapInArrow(project, "vec_id long, deviation long, whitened array<double>")


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of what ``transform`` gave, minus the identity."""
    used = [i for i, u in enumerate(model.used) if u]
    w = F.col("whitened")
    each = [
        F.abs(F.covar_pop(w[i], w[j]) - F.lit(float(i == j))).alias(f"c{i}_{j}") for i in used for j in used if i <= j
    ]
    return max((float(e) for e in whitened.agg(*each).first()), default=0.0) if each else 0.0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every kept row of ``embeddings`` the leading components, a row each."""
    rows = kept(common.table(spark, sf_dir, "embeddings"))
    d = vectors.dimension(rows, "v")
    if not d:
        return spark.createDataFrame(
            [],
            "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double",
        )
    model = fit(rows, d)
    wide = common.durable(transform(rows, model))
    error = identity_error(wide, model)
    return wide.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*map(F.lit, model.explained))[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
