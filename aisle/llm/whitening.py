"""Embedding whitening: exact distributed covariance, leading eigenpairs, projection by a broadcast matrix.

Entries become whole numbers, so sums and products are exact and do not depend on the
order in which partitions arrive: a retried task changes no digit of the components. Three
passes read the vectors: sums, centred products, projection. What reaches the driver is a
covariance over dimensions, whose size does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.llm import eigen
from aisle.llm.common import cut_lineage

SCALE = 1024
SHIFT = 100_000
#: Scaled entries from here on are no whole numbers that a double holds exactly; such vectors are left out like non-finite ones.
REACH = float(1 << 52)
#: Rows of one matrix product.
BLOCK = 8192
#: Exact sums between tasks.
WIDE = pa.decimal128(38, 0)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Of each batch the rows with a usable vector: the rows, their whole-number entries one after the other, their lengths."""
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            rows = batch.slice(start, BLOCK)
            rows = rows.filter(pc.greater(pc.fill_null(pc.list_value_length(rows["vector"]), 0), 0))
            length = pc.list_value_length(rows["vector"]).to_numpy(zero_copy_only=False).astype(np.int64)
            entries = pc.list_flatten(rows["vector"]).to_numpy(zero_copy_only=False).astype(float)
            with np.errstate(invalid="ignore"):
                scaled = np.floor(entries * SCALE)
                wrong = ~(np.abs(scaled) < REACH)
            if wrong.any():
                bad = np.zeros(len(length), bool)
                bad[np.repeat(np.arange(len(length)), length)[wrong]] = True
                scaled, rows, length = scaled[~np.repeat(bad, length)], rows.filter(pa.array(~bad)), length[~bad]
            yield rows, scaled.astype(np.int64) + SHIFT, length


def _of_width(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with a vector of ``width`` entries, and those as a matrix."""
    for rows, entries, length in _blocks(batches):
        fits = length == width
        if not fits.all():
            rows, entries = rows.filter(pa.array(fits)), entries[np.repeat(fits, length)]
        if rows.num_rows:
            yield rows, entries.reshape(-1, width)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length of vectors in a task: their number and the sum of each dimension."""
    counts: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for _, entries, length in _blocks(batches):
        for width in np.unique(length).tolist():
            x = entries[np.repeat(length == width, length)].reshape(-1, width)
            counts[width] = counts.get(width, 0) + len(x)
            # 8192 rows below 2**52 stay within 64 bits only in two halves.
            total = ((x >> 26).sum(0).astype(object) << 26) + (x & ((1 << 26) - 1)).sum(0)
            sums[width] = sums.get(width, 0) + total
    for width, n in counts.items():
        yield pa.record_batch(
            {
                "width": pa.array([width] * width, pa.int32()), "dim": pa.array(range(width), pa.int32()),
                "n": pa.array([n] * width, pa.int64()), "total": pa.array(map(Decimal, sums[width]), WIDE),
            }
        )


def _product(y: np.ndarray) -> np.ndarray:
    """Sums of products of whole numbers, exact: by doubles where those hold them, else by integers of any size."""
    peak = int(np.abs(y).max(initial=0))
    if peak * peak * len(y) < 1 << 53:
        f = y.astype(float)
        return (f.T @ f).astype(np.int64).astype(object)
    wide = y.astype(object)
    return wide.T @ wide


def _products(width: int, centre: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _of_width(batches, width):
            part = _product(x - centre)
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(width)
            yield pa.record_batch(
                {"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "product": pa.array(map(Decimal, total[i, j]), WIDE)}
            )

    return run


def square_sums(d: np.ndarray) -> np.ndarray:
    """Sum of the squares of each row of whole numbers, exact."""
    peak = int(np.abs(d).max(initial=0))
    if peak * peak * d.shape[1] < 1 << 63:
        return (d * d).sum(1)
    if peak < 1 << 52 and d.shape[1] <= 64:
        high, low = d >> 26, d & ((1 << 26) - 1)
        parts = [(a * b).sum(1).astype(object) for a, b in ((high, high), (high, low), (low, low))]
        return (parts[0] << 52) + (parts[1] << 27) + parts[2]
    wide = d.astype(object)
    return (wide * wide).sum(1)


class Fit:
    """What the vectors' covariance gives: number of rows, sums, and up to ``k`` components with their eigenvalues."""

    def __init__(self, n: int, sums: np.ndarray, covariance: np.ndarray, k: int) -> None:
        self.n, self.sums, self.width = n, sums, len(sums)
        self.centre = np.array([round(s / n) for s in sums.tolist()], np.int64) if n else np.zeros(0, np.int64)
        self.trace = float(np.trace(covariance)) if n else 0.0
        values, vectors = eigen.leading(covariance, min(k, self.width)) if n else (np.zeros(0), np.zeros((0, 0)))
        # A direction without spread beyond rounding has no whitened value.
        real = values > self.trace * self.width * eigen.EPS
        self.values, self.vectors = values[real], vectors[:, real]


def fit(rows: DataFrame, k: int) -> Fit:
    """Sums, exact covariance and components of the vectors of the commonest length (of equally common ones the longest)."""
    sums = rows.select("vector").mapInArrow(_sums, "width int, dim int, n long, total decimal(38,0)")
    sums = cut_lineage(sums.groupBy("width", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "sums")
    first = sums.where("dim = 0").orderBy(F.desc("n"), F.desc("width")).first()
    if first is None:
        return Fit(0, np.zeros(0, object), np.zeros((0, 0)), k)
    n, width = first["n"], first["width"]
    totals = np.zeros(width, object)
    for row in sums.where(F.col("width") == width).collect():
        totals[row["dim"]] = int(row["total"])
    centre = [round(s / n) for s in totals.tolist()]
    products = rows.select("vector").mapInArrow(_products(width, np.array(centre, np.int64)), "i int, j int, product decimal(38,0)")
    covariance = np.zeros((width, width))
    left = [s - n * c for s, c in zip(totals.tolist(), centre, strict=True)]
    for i, j, product in products.groupBy("i", "j").agg(F.sum("product")).toLocalIterator():
        # Centred on whole numbers; what the mean is off them is taken out exactly, and the quotient is rounded once.
        covariance[i, j] = covariance[j, i] = (n * int(product) - left[i] * left[j]) / (n * n)
    return Fit(n, totals, covariance, k)


def _project(model: Fit) -> Callable:
    n, centre = model.n, model.centre
    left = np.array([s - n * c for s, c in zip(model.sums.tolist(), centre.tolist(), strict=True)], np.int64)
    matrix = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _of_width(batches, model.width):
            y = x - centre
            if int(np.abs(y).max(initial=0)) * n < 1 << 62:
                square = square_sums(y * n - left)
            else:
                off = y.astype(object) * n - left
                square = (off * off).sum(1)
            square = pa.array(square, pa.int64()).cast(WIDE) if square.dtype != object else pa.array(map(Decimal, square), WIDE)
            whitened = (y - left / n) @ matrix
            width = matrix.shape[1]
            lists = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * width, pa.array(whitened.ravel()))
            yield pa.record_batch({"vec_id": rows["vec_id"], "deviation": square, "whitened": lists})

    return run


def _covariance(k: int) -> list[Column]:
    z = F.col("whitened")
    return [F.covar_pop(z[i], z[j]) for i, j in combinations_with_replacement(range(k), 2)]


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """For each usable vector and component: the projection on it in units of its spread.

    Rows (vec_id, component, n, deviation, whitened, explained, identity_error). Entries c
    become floor(1024 c) + 100000; ``deviation`` is the exact sum over dimensions of
    (n x - S)^2 as decimal(38,0); ``explained`` the component's share of the variance;
    ``identity_error`` how far the covariance of all whitened rows is from the identity.

    Cases: a null vector, or one with a null, non-finite or astronomically large (2**42 or
    more) entry or with no entry, is left out; so are vectors of another length than the
    commonest one; repeated rows and ids each count; a null id stays null; components
    without variance (all of them for one vector or equal vectors) are not returned, so an
    empty table gives no rows; extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    model = fit(rows, components)
    k = len(model.values)
    if not k:
        schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return spark.createDataFrame([], schema)
    projected = rows.mapInArrow(_project(model), f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")
    projected = cut_lineage(projected, "projected")
    found = projected.agg(F.array(*_covariance(k)).alias("c")).first()["c"]
    identity = [float(i == j) for i, j in combinations_with_replacement(range(k), 2)]
    error = float(np.abs(np.array(found) - identity).max())
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    listed = projected.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return listed.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"),
    )


def report(vectors: DataFrame) -> DataFrame:
    """Eight components; ``deviation`` as long, null where it does not fit one (it grows with the square of the rows)."""
    return whiten(vectors).withColumn("deviation", F.col("deviation").try_cast("long"))
