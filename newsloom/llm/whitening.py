"""Whitening of vectors by an exact integer covariance.

Components become whole numbers.  Per dimension these are shifted to start at zero and
cut into bit planes, and a plane packs one bit of 64 rows into each word.  The sum of
products of two dimensions is then a sum of ``2 ** (b + c)`` times the set bits of plane
b of one AND plane c of the other: whole numbers throughout.  They are centred as whole
numbers too, so no digit is lost before the eigenvectors are sought.

Defined results: vectors that are null or empty, hold null or non-finite entries or have
another than the most common length take no part; zero vectors, null ids and repeated
rows do.  Entries beyond ``2 ** 52`` in size after scaling count as that bound.
Components without variance have null ``whitened``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import pick
from .vectors import finite

BOUND = 1 << 52
# Whole numbers of any size travel as digits of this many bits; a million tasks can add them up in a long.
LIMB_BITS, LIMBS = 40, 4
# Numbers that one block of rows holds at most, whatever the length of the vectors.
BLOCK_VALUES = 1 << 19


def whole(vector: str | Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """floor(scale * c) + shift of every entry, as long."""
    bound = F.lit(float(BOUND))
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(
        c.cast("double") * scale, bound), -bound)) + shift)


def taking_part(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    """(vec_id, x): whole numbers of the rows that take part, written to the shared folder."""
    v = pick(rows, vec_id=id_, vector=vector)
    v = v.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & finite("vector"))
    v = settle(v.select("vec_id", whole("vector").alias("x")))
    size = v.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return v.where(F.size("x") == (size["d"] if size else 0))


def _blocks(batches, dims: int) -> Iterator[np.ndarray]:
    """Rows of an array column as matrices of bounded size."""
    most = max(64, BLOCK_VALUES // dims)
    for batch in batches:
        values = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        for at in range(0, len(values), most):
            yield values[at:at + most]


@dataclass(frozen=True)
class Shape:
    """Rows, sums, least and greatest whole number of every dimension."""

    n: int
    sums: list[int]
    low: list[int]
    high: list[int]


def shape(rows: DataFrame, dims: int) -> Shape:
    """Partial results of the tasks hold one row per dimension."""
    def run(batches):
        n, total, low, high = 0, [0] * dims, None, None
        for x in _blocks(batches, dims):
            n += len(x)
            # Below 2**53 times the rows of a block, so the parts of a sum fit a long.
            parts = np.stack([(x >> 26).sum(0), (x & (1 << 26) - 1).sum(0)]).tolist()
            total = [t + (a << 26) + b for t, a, b in zip(total, *parts)]
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(range(dims), pa.int32()), "n": [n] * dims, "limbs": list(map(limbs, total)),
                "low": low, "high": high})

    parts = rows.select("x").mapInArrow(run, "i int, n long, limbs array<long>, low long, high long")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
                                   *[F.sum(F.col("limbs")[k]).alias(f"l{k}") for k in range(LIMBS)])
    at = found.orderBy("i").collect()
    return Shape(at[0]["n"], [unlimbed(r) for r in at], [r["low"] for r in at], [r["high"] for r in at])


def limbs(value: int) -> list[int]:
    """Digits of a whole number, the last one signed."""
    out = [value >> LIMB_BITS * k & (1 << LIMB_BITS) - 1 for k in range(LIMBS - 1)]
    return [*out, value >> LIMB_BITS * (LIMBS - 1)]


def unlimbed(row) -> int:
    return sum(row[f"l{k}"] << LIMB_BITS * k for k in range(LIMBS))


def planes(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """One row of words per bit of each dimension; a word holds that bit of 64 rows."""
    padded = np.zeros((-(-len(x) // 64) * 64, x.shape[1]), np.int64)
    padded[:len(x)] = x
    out = np.empty((sum(bits), len(padded) // 64), np.uint64)
    at = 0
    for i, count in enumerate(bits):
        column = padded[:, i]
        for b in range(count):
            out[at] = np.packbits((column >> b & 1).astype(np.uint8)).view(np.uint64)
            at += 1
    return out


def scatter(words: np.ndarray, bits: list[int]) -> np.ndarray:
    """Sums of products of all pairs of dimensions j >= i, from set bits of ANDed planes.

    Whole numbers of any size: where a long could overflow, Python's are used.
    """
    dims, at, rows = len(bits), np.concatenate([[0], np.cumsum(bits)]).astype(int), words.shape[1] * 64
    most = max(bits, default=0)
    kind = np.int64 if max(2 * most + rows.bit_length(), most + (rows * dims).bit_length() + 1) < 63 else object
    weight = np.array([1 << b for count in bits for b in range(count)], kind)
    out = np.zeros((dims, dims), kind)
    for i in range(dims):
        first = at[i]
        for b in range(bits[i]):
            count = np.bitwise_count(words[first + b] & words[first:]).sum(1, dtype=np.int64)
            sums = np.concatenate([np.zeros(1, kind), np.cumsum(count.astype(kind) * weight[first:])])
            out[i, i:] += (sums[at[i + 1:] - first] - sums[at[i:-1] - first]) << b
    return out


def products(rows: DataFrame, of: Shape) -> dict[tuple[int, int], int]:
    """Sums of (x_i - low_i) * (x_j - low_j) over all rows, exact.

    A task reads its rows in blocks and gives one row per pair of dimensions.
    """
    dims, bits = len(of.low), [(h - low).bit_length() for low, h in zip(of.low, of.high)]
    low = np.array(of.low, np.int64)

    def run(batches):
        # Two halves, so that the sums of many blocks fit.
        below, above, mask = 0, 0, (1 << LIMB_BITS) - 1
        for x in _blocks(batches, dims):
            found = scatter(planes(x - low, bits), bits)
            below, above = below + (found & mask), above + (found >> LIMB_BITS)
        if not isinstance(below, int):
            i, j = np.triu_indices(dims)
            totals = [(a << LIMB_BITS) + b for a, b in zip(above[i, j].tolist(), below[i, j].tolist())]
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "limbs": list(map(limbs, totals))})

    parts = rows.select("x").mapInArrow(run, "i int, j int, limbs array<long>")
    sums = parts.groupBy("i", "j").agg(*[F.sum(F.col("limbs")[k]).alias(f"l{k}") for k in range(LIMBS)])
    return {(r["i"], r["j"]): unlimbed(r) for r in sums.collect()}


@dataclass(frozen=True)
class Whitening:
    """What turns x into whitened values: (n * x - sums) / n times ``axes``, one column per component.

    ``peak`` is the largest size of an x.
    """

    n: int
    sums: list[int]
    peak: int
    axes: np.ndarray
    explained: list[float]


def fit(rows: DataFrame, components: int) -> Whitening | None:
    """Eigenvectors of the covariance of all rows; null for an empty table.

    Only sums per pair of dimensions reach the driver, whatever the number of rows.
    """
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    of = shape(rows, first["d"])
    cross, n = products(rows, of), of.n
    sums = [s - n * low for s, low in zip(of.sums, of.low)]
    dims = len(sums)
    # n squared times the covariance is whole; a quotient of whole numbers is rounded once.
    cov = np.empty((dims, dims))
    for (i, j), c in cross.items():
        cov[i, j] = cov[j, i] = (n * c - sums[i] * sums[j]) / (n * n)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    trace = float(np.trace(cov))
    kept = min(components, dims)
    real = e[:kept] > max(trace, 0.0) * dims * np.finfo(float).eps
    scale = np.where(real, 1 / np.sqrt(np.where(real, e[:kept], 1.0)), np.nan)
    return Whitening(n, of.sums, max(map(abs, of.low + of.high)), u[:, :kept] * scale,
                     [float(v) / trace if trace > 0 and ok else 0.0 for v, ok in zip(e[:kept], real)])


def transform(rows: DataFrame, by: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened array) per row.

    ``deviation`` is the exact sum of (n * x - sums) ** 2, null where no long holds it.
    """
    n, sums = by.n, by.sums
    narrow = 2 * n * by.peak < 1 << 62

    def run(batches):
        for batch in batches:
            ids, x = batch.column(0), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums))
            if narrow:
                d = x * n - np.array(sums, np.int64)
            else:
                d = x.astype(object) * n - np.array(sums, object)
            about = (d.astype(float) ** 2).sum(1)
            if narrow and about.max(initial=0) < 2.0**62:
                deviation = (d * d).sum(1)
            else:
                exact = (sum(int(c) ** 2 for c in r) if a < 2.0**64 else 1 << 64 for r, a in zip(d, about))
                deviation = [v if v < 1 << 63 else None for v in exact]
            w = (d / n).astype(float) @ by.axes
            arrays = [[None if v != v else v for v in r] for r in w.tolist()]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(deviation, pa.int64()), pa.array(arrays, pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "whitened"])

    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>"
    return rows.select("vec_id", "x").mapInArrow(run, schema)


def identity_error(whitened: DataFrame, n: int, width: int) -> float:
    """Largest entry of the covariance of the whitened values minus the identity, measured on all rows.

    Means first, then centred products; components without variance are left out.
    """
    means = whitened.select(F.posexplode("whitened").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    means = {r["i"]: r["m"] for r in means.collect() if r["m"] is not None}
    if not means:
        return 0.0
    used = sorted(means)
    mean = np.array([means[i] for i in used])

    def run(batches):
        total = np.zeros((len(used), len(used)))
        for batch in batches:
            w = np.array(batch.column(0).to_pylist(), float).reshape(-1, width)[:, used] - mean
            total += w.T @ w
        i, j = np.triu_indices(len(used))
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": total[i, j]})

    sums = whitened.select("whitened").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(
        F.sum("v").alias("v"))
    return max(abs(r["v"] / n - (r["i"] == r["j"])) for r in sums.collect())


def whiten(rows: DataFrame, id_: str, vector: str, components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), one row per
    vector and component."""
    x = taking_part(rows, id_, vector)
    by = fit(x, components)
    if by is None:
        kind = x.schema["vec_id"].dataType.simpleString()
        return x.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, "
                                                  "whitened double, explained double, identity_error double")
    done = settle(transform(x, by))
    error = identity_error(done, by.n, len(by.explained))
    share = F.array(*[F.lit(v) for v in by.explained])
    return done.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(by.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"))
