"""Whitening of embeddings by exact integer cross-products from bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import Scratch

STEP, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: rows packed into words at once; bits of a partial sum's limb, so that a long holds the sum over any number of tasks
BLOCK_ROWS, LIMB = 8192, 40


# ---- whole numbers ----------------------------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    """No null, no entry that is null, not finite or too large for a long."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**62 / STEP))
    return vector.isNotNull() & F.forall(vector, entry)


def whole(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, x) of the rows that remain, and the length of their vectors: the most frequent one, the longer of two."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    sizes = rows.filter(F.size("v") > 0).groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = sizes[0]["size"] if sizes else 0
    x = F.transform("v", lambda c: F.floor(c * STEP) + SHIFT)
    return rows.filter(F.size("v") == size).select("vec_id", x.alias("x")), size


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def bounds(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest x of each dimension; one row per dimension and task is summed up."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            x = matrix(batch.column(0), size)
            if len(x):
                low = x.min(0) if low is None else np.minimum(low, x.min(0))
                high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(low), pa.array(high)], names=["i", "low", "high"])

    found = rows.select("x").mapInArrow(run, "i long, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    return np.array([r["low"] for r in found], np.int64), np.array([r["high"] for r in found], np.int64)


def packed(rows: DataFrame, size: int, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """(y): x less the least of its dimension, as bytes of the narrowest unsigned type that holds them all."""
    width = narrow(low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = (matrix(batch.column(0), size) - low).astype(width)
            step = size * y.itemsize
            yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(step), len(y), [None, pa.py_buffer(np.ascontiguousarray(y))]).cast(pa.binary())], names=["y"])

    return rows.select("x").mapInArrow(run, "y binary")


def narrow(low: np.ndarray, high: np.ndarray) -> np.dtype:
    return np.min_scalar_type(int((high - low).max())).newbyteorder("<")


def unpacked(column: pa.Array, size: int, width: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), width).reshape(-1, size)


# ---- bit-sliced scatter -------------------------------------------------------------------------------------------

def plane_words(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """One row of 64-bit words per bit plane, planes of a dimension from its lowest bit on; the rows of ``y`` lie along the words."""
    padded = np.zeros((-(-len(y) // 64) * 64, y.shape[1]), y.dtype)
    padded[:len(y)] = y
    planes = [np.packbits((padded[:, i] >> np.asarray(b, y.dtype)) & np.asarray(1, y.dtype)) for i, n in enumerate(bits) for b in range(n)]
    return np.array(planes, np.uint8).reshape(len(planes), len(padded) // 8).view(np.uint64)


def cross_products(y: np.ndarray, bits: np.ndarray, shifts: np.ndarray, owners: np.ndarray, total: dict[tuple[int, int], int]) -> None:
    """Add every sum of y_i * y_j, i <= j, and as (i, -1) every sum of y_i: popcounts of ANDed planes, weighted by their bits."""
    words = plane_words(y, bits)
    for i, n in enumerate(bits):
        first = int(bits[:i].sum())
        rest = words[first:]
        for b in range(n):
            plane = words[first + b]
            counts = np.bitwise_count(rest & plane).sum(1, dtype=np.int64)
            for j, s, c in zip(owners[first:].tolist(), shifts[first:].tolist(), counts.tolist()):
                if c:
                    total[i, j] = total.get((i, j), 0) + (c << (s + b))
            total[i, -1] = total.get((i, -1), 0) + (int(np.bitwise_count(plane).sum()) << b)


def scatter(distinct: DataFrame, size: int, low: np.ndarray, high: np.ndarray) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of y and of y_i * y_j over the distinct vectors, exact. A task sends one row per pair of dimensions and limb."""
    width = narrow(low, high)
    bits = np.array([int(h - w).bit_length() for w, h in zip(low.tolist(), high.tolist())])
    owners, shifts = np.repeat(np.arange(size), bits), np.concatenate([np.arange(n) for n in bits]) if bits.sum() else np.zeros(0, int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        n = 0
        for batch in batches:
            y = unpacked(batch.column(0), size, width)
            n += len(y)
            for start in range(0, len(y), BLOCK_ROWS):
                cross_products(y[start:start + BLOCK_ROWS], bits, shifts, owners, total)
        rows = [(-1, -1, 0, n)]
        for (i, j), value in total.items():
            limb = 0
            while value:
                rows.append((i, j, limb, value & ((1 << LIMB) - 1)))
                value >>= LIMB
                limb += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["i", "j", "limb", "part"])

    found = distinct.mapInArrow(run, "i long, j long, limb long, part long").groupBy("i", "j", "limb").agg(F.sum("part").alias("part")).collect()
    n, sums, products = 0, [0] * size, [[0] * size for _ in range(size)]
    for i, j, limb, part in found:
        if i < 0:
            n += part
        elif j < 0:
            sums[i] += part << (LIMB * limb)
        else:
            products[i][j] += part << (LIMB * limb)
    for i in range(size):
        for j in range(i):
            products[i][j] = products[j][i]
    return n, sums, products


# ---- axes ---------------------------------------------------------------------------------------------------------

class Axes(NamedTuple):
    """n and the sums of y over the fit list, unit eigenvectors as columns by falling eigenvalue, their eigenvalues, the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def axes(n: int, sums: list[int], products: list[list[int]], components: int) -> Axes:
    """Eigenvectors of the covariance; n * products - sums * sums is centred in whole numbers and rounded once. Components whose
    eigenvalue is no more than rounding have no direction of their own and are left out."""
    size = len(sums)
    whole = [[n * products[i][j] - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    covariance = np.array([[c / n**2 for c in row] for row in whole])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(covariance))
    order = order[values[order] > trace * size * np.finfo(float).eps]
    return Axes(n, sums, vectors[:, order], values[order], trace)


def centred(y: np.ndarray, found: Axes, span: int) -> np.ndarray:
    """n * y - sums, exact: 64-bit numbers where they are wide enough, else Python's."""
    if found.n * (span + 1) < 1 << 62:
        return y.astype(np.int64) * found.n - np.array(found.sums, np.int64)
    return y.astype(object) * found.n - np.array(found.sums, object)


def projected(moved: np.ndarray, found: Axes) -> np.ndarray:
    return (moved.astype(float) / found.n) @ (found.vectors / np.sqrt(found.values))


def identity_error(distinct: DataFrame, found: Axes, size: int, low: np.ndarray, high: np.ndarray) -> float:
    """Largest entry of the covariance of the whitened fit list less the identity; a task sends its sums and products of components."""
    width, span, k = narrow(low, high), int((high - low).max()), len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = projected(centred(unpacked(batch.column(0), size, width), found, span), found)
            total += np.vstack([w.sum(0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "part"])

    sums = np.zeros((k + 1) * k)
    for at, part in distinct.mapInArrow(run, "at long, part double").groupBy("at").agg(F.sum("part").alias("part")).collect():
        sums[at] = part
    sums = sums.reshape(k + 1, k) / found.n
    return float(np.abs(sums[1:] - np.outer(sums[0], sums[0]) - np.eye(k)).max(initial=0.0))


RESULT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row and each of the first components.

    One scan finds the least and largest entry of each dimension. Entries less the least go as narrow bytes through ``distinct``,
    which is map-side combined, so a vector that fills a third of the table is one row a task. The distinct vectors are written;
    bit planes give their exact cross-products, and only sums per pair of dimensions reach the driver.

    Defined results: rows whose vector is null or has an entry that is null, not finite or beyond a long drop out, and so do rows
    whose vector has not the most frequent length (of two, the longer) or no entry; repeated rows and null keys are rows of their
    own; components of no variance are left out, so equal vectors alone and an empty table give an empty result; deviation is null
    where it has more than 38 digits; columns other than the key and the vector are not read.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    kind = vectors.schema[key].dataType
    named = T.StructType([T.StructField(key, kind)] + T.StructType.fromDDL(RESULT).fields)
    rows, size = whole(vectors, key, vector)
    low, high = bounds(rows, size)
    if not len(low):
        return spark.createDataFrame([], named)
    distinct = scratch.keep(packed(rows, size, low, high).distinct(), "distinct")
    found = axes(*scatter(distinct, size, low, high), components)
    if not len(found.values):
        return spark.createDataFrame([], named)
    error, span = identity_error(distinct, found, size, low, high), int((high - low).max())
    small = size * (found.n * (span + 1)) ** 2 < 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = centred(matrix(batch.column(1), size) - low, found, span)
            if small:
                deviation = pa.array((moved * moved).sum(1)).cast(pa.decimal128(38, 0))
            else:
                sums = (moved.astype(object) ** 2).sum(1)
                deviation = pa.array([Decimal(int(d)) if d < 10**38 else None for d in sums], pa.decimal128(38, 0))
            w = projected(moved, found)
            offsets = pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], names=["vec_id", "deviation", "w"])

    out = T.StructType([T.StructField("vec_id", kind), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("w", T.ArrayType(T.DoubleType()))])
    shares = F.array(*[F.lit(float(v / found.trace)) for v in found.values])
    return (rows.mapInArrow(run, out).select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
            .select(F.col("vec_id").alias(key), (F.col("at") + 1).alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
