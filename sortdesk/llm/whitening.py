"""Whitening of embeddings on leading principal components, found by slicing the spectrum.

Vectors are brought to whole numbers x = floor(scale * c). Counts, sums and products of the
distinct x are collected by Spark as sums over rows that are centred by a whole number near the
mean, so the products are exact as long as they stay below 2 ** 53, and the rest of the centring
is done in fractions. Only the d x d covariance comes to the driver.

There, the leading eigenvalues are found one by one. The signs in an LDL' factorisation of the
covariance less a shift (pivots of one or two rows) say how many eigenvalues lie above the shift.
Bisection on these counts isolates each eigenvalue, Rayleigh quotient iteration from a vector of
the isolating shift converges cubically to its vector, and counts on both sides of the quotient
certify that it is the one of that number. Equal eigenvalues get orthogonal vectors of their space.

Defined results. Vectors that are null, hold nulls or non-finite numbers, or have another
dimension than most (of equally common ones the smallest) are dropped. Entries whose x does not
fit a long take the nearest long; deviations that do not fit one are null. Null ids are kept.
Repeated rows: each gets its result, and a vector is fitted once. Components without variance (a
share of the trace below LEAST_SHARE) have no whitened values and no rows, so vectors that are all
equal give no rows, like an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

SCALE = 256
#: Below this share of the trace an eigenvalue is rounding.
LEAST_SHARE = 1e-12
MOST_TURNS = 200
_FIRST_LONG, _LAST_LONG = -2 ** 63, 2 ** 63 - 1
#: Products of two centred entries that a double holds without rounding.
_EXACT = 2.0 ** 53


# --- the spectrum --------------------------------------------------------------------------
def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues of a symmetric matrix above the shift, from the signs of an LDL' factorisation.

    The largest entry decides the pivot: a diagonal one, or the 2 x 2 block of an off-diagonal one,
    which has one eigenvalue of either sign.
    """
    left = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(left):
        n = len(left)
        diagonal = np.abs(np.diag(left))
        off = np.abs(left - np.diag(np.diag(left)))
        r, s = divmod(int(np.argmax(off)), n)
        p = int(np.argmax(diagonal))
        if diagonal[p] == 0 and off[r, s] == 0:
            break
        pivot = [p] if diagonal[p] >= (1 + math.sqrt(17)) / 8 * off[r, s] else [r, s]
        rest = np.setdiff1d(np.arange(n), pivot)
        block = left[np.ix_(pivot, pivot)]
        above += int(block[0, 0] > 0) if len(pivot) == 1 else 1
        side = left[np.ix_(rest, pivot)]
        left = left[np.ix_(rest, rest)] - side @ np.linalg.solve(block, side.T)
        left = (left + left.T) / 2
    return above


def _isolated(matrix: np.ndarray, number: int, width: float) -> tuple[float, float]:
    """(low, high) around the eigenvalue of that number from the top, alone there or with others
    nearer to it than `width`."""
    reach = float(np.abs(matrix).sum(axis=1).max())
    low, high = -reach - width, reach + width
    inside = (len(matrix), 0)                      # eigenvalues above low and above high
    while high - low > width and inside != (number, number - 1):
        middle = (low + high) / 2
        above = count_above(matrix, middle)
        if above >= number:
            low, inside = middle, (above, inside[1])
        else:
            high, inside = middle, (inside[0], above)
    return low, high


def _away_from(vector: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for f in found:
            vector = vector - (f @ vector) * f
    return vector / np.linalg.norm(vector)


def _solved(matrix: np.ndarray, shift: float, vector: np.ndarray, step: float) -> np.ndarray:
    """(matrix - shift)^-1 vector; a shift that makes it singular is moved by rounding."""
    while True:
        try:
            out = np.linalg.solve(matrix - shift * np.eye(len(matrix)), vector)
            if np.isfinite(out).all():
                return out
        except np.linalg.LinAlgError:
            pass
        shift, step = shift + step, 2 * step


def leading_components(matrix: np.ndarray, most: int) -> list[tuple[float, np.ndarray]]:
    """(eigenvalue, unit vector) of the `most` largest eigenvalues, each certified by counts.

    Of the two signs of a vector, the one whose largest entry is positive is taken.
    """
    norm = float(np.abs(matrix).sum(axis=1).max()) if len(matrix) else 0.0
    if norm == 0:
        return []
    least = 4 * np.finfo(float).eps * norm         # rounding of the factorisation
    found: list[tuple[float, np.ndarray]] = []
    for number in range(1, min(most, len(matrix)) + 1):
        low, high = _isolated(matrix, number, 1e3 * least)
        while True:
            value, vector = _iterated(matrix, low, high, [v for _, v in found], least)
            room = 1e3 * least
            if count_above(matrix, value - room) >= number > count_above(matrix, value + room):
                break
            if high - low <= room:
                raise ArithmeticError(f"eigenvalue {number} could not be certified")
            middle = (low + high) / 2              # it went to another one: start nearer
            low, high = (middle, high) if count_above(matrix, middle) >= number else (low, middle)
        found.append((value, vector * np.sign(vector[np.argmax(np.abs(vector))])))
    return found


def _iterated(matrix, low, high, found, least) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration out of (low, high), away from the vectors found before."""
    start = np.random.default_rng(len(found)).standard_normal(len(matrix))
    vector = _away_from(start, found)
    for _ in range(3):                             # into the space that belongs to the interval
        vector = _away_from(_solved(matrix, (low + high) / 2, vector, least), found)
    value, rest = float(vector @ matrix @ vector), math.inf
    for _ in range(MOST_TURNS):
        new = _away_from(_solved(matrix, value, vector, least), found)
        at = float(new @ matrix @ new)
        left = float(np.linalg.norm(matrix @ new - at * new))
        if left >= rest:
            break
        value, vector, rest = at, new, left
    return value, vector


# --- tables --------------------------------------------------------------------------------
def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, x): the vectors that take part, as whole numbers."""
    rows = vectors.select(F.col(id_col).alias("vec_id"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    good = rows.where("v is not null and size(v) > 0").where(
        "forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")

    def whole(c):
        y = c * F.lit(float(scale))
        return (F.when(y >= F.lit(2.0 ** 63), F.lit(_LAST_LONG))
                .when(y < F.lit(-2.0 ** 63), F.lit(_FIRST_LONG)).otherwise(F.floor(y)))
    rows = written(good.select("vec_id", F.transform("v", whole).alias("x")), "whole-vectors")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), "d").first()
    return rows.where(F.size("x") == (common["d"] if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, of, d: int) -> np.ndarray:
    """of(batch) is a matrix of d columns; the sum of those of all batches. One matrix leaves a
    task, row by row, and rows of one place are added in one group."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of(batch)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total))), pa.array(total.tolist(), pa.list_(pa.float64()))],
                ["i", "values"])

    def merge(part: pa.Table) -> pa.Table:
        total = _matrix(part.column("values")).sum(axis=0)
        return pa.table({"i": part.column("i")[:1], "values": pa.array(
            [total.tolist()], pa.list_(pa.float64()))})

    kind = "i long, values array<double>"
    found = rows.mapInArrow(add, kind).groupBy("i").applyInArrow(merge, kind).collect()
    out = np.zeros((max((r["i"] for r in found), default=-1) + 1, d))
    for r in found:                                # one row for each dimension
        out[r["i"]] = r["values"]
    return out


class Fit:
    """What the fit list says about all rows: count, sums, components."""

    def __init__(self, fit: DataFrame, most: int):
        sums = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(
            F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
        self.n = sums[0]["n"] if sums else 0
        self.sums = [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])]
        self.components: list[tuple[float, np.ndarray]] = []
        self.trace = 0.0
        if not self.n:
            return
        d = len(self.sums)
        near = np.array([round(Fraction(s, self.n)) for s in self.sums], dtype=np.int64)

        def products(batch: pa.RecordBatch) -> np.ndarray:
            z = _centred(_matrix(batch.column("x")), near)
            return z.T @ z

        both = _summed(fit, products, d)
        left = [s - self.n * int(m) for s, m in zip(self.sums, near)]
        self.covariance = np.array([[float((self.n * _whole(both[i, j]) - left[i] * left[j])
                                           / Fraction(self.n) ** 2)
                                     for j in range(d)] for i in range(d)])
        self.trace = float(np.trace(self.covariance))
        self.components = [(e, v) for e, v in leading_components(self.covariance, most)
                           if e > LEAST_SHARE * self.trace]
        self.near = near
        self.rest = np.array([float(Fraction(t, self.n)) for t in left])
        self.axes = np.array([v / math.sqrt(e) for e, v in self.components]).reshape(-1, d).T

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """(rows x components) of whole vectors."""
        return (_centred(x, self.near) - self.rest) @ self.axes

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n * x - S) ** 2, exactly; None beyond a long."""
        reach = self.n * int(np.abs(x.astype(np.float64)).max(initial=0) + 1) + max(map(abs, self.sums))
        if reach ** 2 * len(self.sums) < 2 ** 62:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        exact = (sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist())
        return [y if y <= _LAST_LONG else None for y in exact]


def _whole(value: float) -> Fraction:
    return Fraction(value)


def _centred(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """x - near as doubles; without overflow where the difference is beyond a long."""
    if np.abs(x.astype(np.float64)).max(initial=0) < _EXACT and np.abs(near.astype(np.float64)).max() < _EXACT:
        return (x - near).astype(np.float64)
    return x.astype(np.float64) - near.astype(np.float64)


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id",
           vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row that
    takes part and every component, numbered from 1 by falling eigenvalue.

    identity_error is the largest absolute entry of the whitened fit list's covariance less the
    identity, one value for all rows.
    """
    rows = whole_numbers(vectors, id_col, vector_col, scale)
    fit_list = written(rows.select("x").distinct(), "fit-list")
    fit = Fit(fit_list, components)
    many = len(fit.components)
    error = _identity_error(fit_list, fit) if many else 0.0
    share = [e / fit.trace for e, _ in fit.components]
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not many:
                continue
            x = _matrix(batch.column("x"))
            each = np.repeat(np.arange(len(x)), many)
            deviation = pa.array(fit.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), fit.n)), deviation.take(pa.array(each)),
                pa.array(fit.whitened(x).reshape(-1)), pa.array(np.tile(share, len(x))),
                pa.array(np.full(len(each), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, f"vec_id {id_type}, component int, n long, deviation long, "
                                    "whitened double, explained double, identity_error double")


def _identity_error(fit_list: DataFrame, fit: Fit) -> float:
    """From the whitened vectors themselves, centred by their mean."""
    many = len(fit.components)
    mean = _summed(fit_list, lambda b: fit.whitened(_matrix(b.column("x"))).sum(axis=0)[None, :],
                   many)[0] / fit.n

    def products(batch: pa.RecordBatch) -> np.ndarray:
        w = fit.whitened(_matrix(batch.column("x"))) - mean
        return w.T @ w

    return float(np.abs(_summed(fit_list, products, many) / fit.n - np.eye(many)).max())
