"""Operator 11: whitening of embeddings by polarisation covariance.

1. An entry c becomes the integer ``floor(64 * c) + 1000000``; each distinct integer
   vector counts once (the fit list: n vectors, sums S).
2. The vectors are centred at the whole part of their mean.  Every dimension and every
   sum of two dimensions is squared and added up over the fit list, in integers.
3. The rest of the mean is taken out of these sums exactly, which leaves the variance
   of every dimension and of every pair's sum; ``2 cov(i, j) = var(i + j) - var(i) -
   var(j)`` gives the covariances, assembled into one matrix for ``eigh``.
4. Rows are centred exactly, projected on the unit eigenvectors by falling eigenvalue
   and divided by the root of the eigenvalue.

Tasks return sums only: one row per dimension or pair, added up by Spark.  What reaches
the driver is bounded by the square of the dimension, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltide.llm.common import Stage

SCALE, SHIFT = 64, 1_000_000
#: Integer entries are held within this, far from the ends of 64 bits.
_LIMIT = float(1 << 47)


@dataclass
class Whitening:
    """The fit: ``n`` vectors of the fit list, exact ``sums``, and components by falling eigenvalue (rows)."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """Whole part of each dimension's mean; :attr:`rest` over n is the remainder, in [0, 1)."""
        return np.array([s // self.n for s in self.sums], dtype=np.int64)

    @property
    def rest(self) -> list[int]:
        return [s % self.n for s in self.sums]


def integer_vectors(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """The rows of ``df`` with a usable vector, and ``_x`` array<long>, its integer form.

    A null vector, and one with a null or non-finite entry, is dropped.
    """
    c = F.col(vector_col).cast("array<double>")
    usable = F.col(vector_col).isNotNull() & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(c, lambda e: F.floor(F.greatest(F.least(e * SCALE, F.lit(_LIMIT)), F.lit(-_LIMIT))) + SHIFT)
    return df.where(F.coalesce(usable, F.lit(False))).withColumn("_x", whole)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """width x rows of a list column whose lists all have ``width`` entries."""
    return np.ascontiguousarray(column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width).T)


def _exact_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per row of two integer matrices the exact sum of products; in 64 bits where they must suffice, else as Python integers."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 62:
        return np.einsum("ij,ij->i", a, b)
    return (a.astype(object) * b.astype(object)).sum(axis=1)


def _limbs(v: np.ndarray) -> np.ndarray:
    """Integers as 4 rows of limbs of 31 bits, the last one signed."""
    low = (1 << 31) - 1
    return np.array([(v >> 31 * k) & low if k < 2 else (v >> 62) & low if k == 2 else (v >> 62) >> 31 for k in range(4)]).astype(np.int64)


def _summed(df: DataFrame, keys: np.ndarray, sums: Callable[[np.ndarray], np.ndarray], width: int) -> dict[tuple[int, int], int]:
    """Exact totals over all rows of the integers that ``sums`` returns for a matrix, one for each of ``keys`` (i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_row = np.zeros((4, len(keys)), dtype=np.int64), False
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                total += _limbs(sums(_matrix(batch.column(0).slice(start, 2048), width)))
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys.T.astype(np.int32), *total)], names=["i", "j", "a", "b", "c", "d"])

    parts = df.select("_x").mapInArrow(run, "i int, j int, a long, b long, c long, d long")
    added = parts.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in "abcd"])
    return {(r["i"], r["j"]): sum(r[k] << 31 * place for place, k in enumerate("abcd")) for r in added.collect()}


def vector_sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and the exact sum of every dimension."""
    keys = np.array([(k, k) for k in range(-1, width)])
    totals = _summed(fit, keys, lambda x: np.concatenate(([x.shape[1]], _exact_rows(x, np.ones_like(x)))), width)
    return totals.get((-1, -1), 0), [totals.get((k, k), 0) for k in range(width)]


def polarised_sums(fit: DataFrame, centre: np.ndarray, width: int) -> dict[tuple[int, int], int]:
    """Exact sums over ``fit`` of (x_i - centre_i)^2 at (i, i), and of the squared sum of two such values at (i, j), i < j."""
    keys = np.array([(i, j) for i in range(width) for j in range(i, width)])

    def squares(x: np.ndarray) -> np.ndarray:
        x = x - centre[:, None]
        out = []
        for i in range(width):
            out.append(_exact_rows(x[i:i + 1], x[i:i + 1]))
            y = x[i] + x[i + 1:]
            out.append(_exact_rows(y, y))
        return np.concatenate(out)
    return _summed(fit, keys, squares, width)


def fit_whitening(fit: DataFrame, width: int, components: int = 16) -> Whitening | None:
    """Fit on the distinct vectors ``fit`` (``_x``), all of ``width`` entries; None without rows or dimensions.

    Components whose eigenvalue is zero within double precision have no whitened value
    and are left out.
    """
    n, sums = vector_sums(fit, width) if width else (0, [])
    if not n:
        return None
    found = Whitening(n, sums, np.zeros(0), np.zeros((0, width)), np.zeros(0))
    rest, q = found.rest, polarised_sums(fit, found.centre, width)

    def spread(i: int, j: int) -> int:
        """n^2 times the variance of dimension i, or of the sum of i and j."""
        r = rest[i] if i == j else rest[i] + rest[j]
        return n * q[i, j] - r * r

    own = [spread(i, i) for i in range(width)]
    v = np.zeros((width, width))
    for i in range(width):
        v[i, i] = own[i] / (n * n)
        for j in range(i + 1, width):
            v[i, j] = v[j, i] = (spread(i, j) - own[i] - own[j]) / (2 * n * n)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u.T[::-1]
    real = np.flatnonzero(e > width * np.finfo(float).eps * max(e[0], 0.0))[:components]
    e, u = e[real], u[real]
    u = u * np.where(u[np.arange(len(u)), np.abs(u).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    found.eigenvalues, found.components = e, u
    found.explained = e / (sum(own) / (n * n)) if len(e) else e
    return found


def _projector(fit: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    """width x rows integers -> rows x components, whitened."""
    centre, rest = fit.centre, np.array([r / fit.n for r in fit.rest])
    scaled = fit.components / np.sqrt(fit.eigenvalues)[:, None]
    return lambda x: ((x - centre[:, None]).astype(np.float64) - rest[:, None]).T @ scaled.T


def identity_error(fit_list: DataFrame, fit: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, measured over its rows."""
    project, width, k = _projector(fit), len(fit.sums), len(fit.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, k + 1)), 0
        for batch in batches:
            w = project(_matrix(batch.column(0), width))
            total += np.hstack((w.T @ w, w.sum(axis=0)[:, None]))
            n += len(w)
        if n:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "s"])

    cells = np.zeros((k, k + 1))
    for r in fit_list.select("_x").mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        cells[r["i"], r["j"]] = r["s"]
    mean = cells[:, k] / fit.n
    return float(np.abs(cells[:, :k] / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten_embeddings(df: DataFrame, vector_col: str = "embedding", components: int = 16, keep: list[str] | None = None) -> tuple[DataFrame, Whitening | None, float | None]:
    """(rows, fit, identity error): the ``keep`` columns (default all) of the usable rows, with ``whitened`` and ``deviation``.

    ``whitened`` array<double> has one value per component; ``deviation`` long is the exact
    sum over dimensions of ``(n * x - S)^2``, null where it needs more than 64 bits.
    Rows with a null vector, or a null or non-finite entry, are dropped.  Vectors must have
    one length: of several, the most frequent one counts (the longest of equally frequent
    ones) and rows of another are dropped too.  Entries beyond 2^41 count as 2^41.  Ids may
    be null or repeat; equal vectors all get a row and count once in the fit.  Columns of
    any names are kept as they are, unless named whitened or deviation.  Without usable
    rows or without dimensions the fit is None and there are no rows.
    """
    stage = Stage(df.sparkSession, "whitening")
    kept = F.struct(*(keep if keep is not None else [c for c in df.columns if c not in ("whitened", "deviation")])).alias("_row")
    rows = stage.put(integer_vectors(df.select(kept, F.col(vector_col).alias("_v")), "_v").select("_row", "_x"), "rows")
    widths = rows.groupBy(F.size("_x").alias("w")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("w")).first()
    width = widths["w"] if widths else 0
    rows = rows.where(F.size("_x") == width)
    fit_list = stage.put(rows.select("_x").distinct(), "fit")
    fit = fit_whitening(fit_list, width, components)
    error = identity_error(fit_list, fit) if fit is not None and len(fit.eigenvalues) else None
    stage.drop("fit")
    shape = rows.select("_row", F.array().cast("array<double>").alias("whitened"), F.lit(None).cast("long").alias("deviation"))
    if fit is None:
        return shape.where(F.lit(False)).select("_row.*", "whitened", "deviation"), None, None
    project, centre, rest, n = _projector(fit), fit.centre, fit.rest, fit.n
    k = len(fit.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), width)
            d = x - centre[:, None]
            if n * (int(np.abs(d).max(initial=0)) + 1) < 1 << 62:
                d = d * n - np.array(rest, dtype=np.int64)[:, None]
            else:
                d = d.astype(object) * n - np.array(rest, dtype=object)[:, None]
            deviation = [v if v < 1 << 63 else None for v in _exact_rows(d.T, d.T).tolist()]
            offsets = pa.array((np.arange(batch.num_rows + 1) * k).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(project(x).ravel())),
                                              pa.array(deviation, pa.int64())], names=["_row", "whitened", "deviation"])

    out = rows.mapInArrow(run, shape.schema)
    return out.select("_row.*", "whitened", "deviation"), fit, error


def whitening_report(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """One row per usable row and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    found, fit, error = whiten_embeddings(df, vector_col, components, keep=[id_col])
    share = F.array(*[F.lit(float(e)) for e in fit.explained]) if fit is not None and len(fit.explained) else F.array().cast("array<double>")
    each = found.select(id_col, "deviation", F.posexplode("whitened").alias("_k", "whitened"))
    return each.select(id_col, (F.col("_k") + 1).cast("int").alias("component"), F.lit(fit.n if fit else 0).cast("long").alias("n"), "deviation",
                       "whitened", F.get(share, F.col("_k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
