"""Operator 11, embedding whitening by shifted CholeskyQR.

The fit list is each distinct integer vector once. Sums give its mean; then three passes over it take the
Gram matrix of its centred rows, each row first brought through triangular solves with the factors found so
far. The first factor is the Cholesky factor of the Gram matrix plus a shift that keeps it positive, the
later ones of nearly orthogonal columns, so that nothing is lost to squaring. The factors' product R has the
singular values of the centred rows and their right singular vectors, which are the components; a last
pass measures how far the whitened rows' covariance is from the identity. A task adds up its own matrix, and
rows of the matrices are summed over the tasks; the driver holds matrices of the vectors' length only.

Contract: rows whose vector is null or holds null or non-finite entries are dropped. Vectors of unlike
lengths are fitted apart. Components whose variance is under 1e-12 of the largest have no direction of their
own and are left out, so a fit list of one vector, or of equal components throughout, gives no rows. Rows that
repeat are returned each; a null vec_id is kept; other columns are ignored; an empty table gives no rows.
A deviation or a sum over the range of long ends in an error rather than in a wrong number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.llm.common import written
from ripplefold.llm.vectors import finite, largest, matrix, on_grid

PASSES = 3  # a shifted and two plain ones: orthogonal to rounding for any condition that double precision holds
ROUNDING = 2.0**-53
LEAST_SHARE = 1e-12
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Moments:
    n: int
    sums: list[int]


@dataclass
class Fitted:
    """Components as columns, their variances, their shares of all variance, and the largest error of the whitened covariance."""

    moments: Moments
    directions: np.ndarray
    variances: np.ndarray
    shares: np.ndarray
    error: float = 0.0

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.directions / np.sqrt(self.variances)


def deviations(x: np.ndarray, m: Moments) -> np.ndarray:
    """n * x - sums, exact: longs where they hold it, Python integers otherwise."""
    most = m.n * largest(x) + max(map(abs, m.sums), default=0)
    kind = np.int64 if most < 2**62 else object
    return x.astype(kind) * m.n - np.array(m.sums, kind)


def solved(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """q with q @ r = a, column by column, r being upper triangular."""
    q = np.empty_like(a)
    for j in range(a.shape[1]):
        q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def by_length(batch: pa.RecordBatch, at_once: int = 4096):
    """(length, places, rows as a matrix) for the lengths of a batch, at most so many rows at a time."""
    length = batch.column("length").to_numpy(zero_copy_only=False)
    for n in np.unique(length).tolist():
        mine = np.flatnonzero(length == n)
        for k in range(0, len(mine), at_once):
            yield n, mine[k : k + at_once], matrix(batch.column("x"), mine[k : k + at_once])


def _sums(batches):
    n: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for batch in batches:
        for length, mine, x in by_length(batch):
            n[length] = n.get(length, 0) + len(mine)
            exact = x if largest(x) < 2**50 else x.astype(object)
            sums[length] = [a + int(b) for a, b in zip(sums.get(length, [0] * length), exact.sum(0))]
    rows = [(length, at, n[length], Decimal(s)) for length, own in sums.items() for at, s in enumerate(own)]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0)))], ["length", "at", "n", "s"])


def _matrix_rows(prepared: Callable[[np.ndarray, int], np.ndarray], moments: dict[int, Moments]):
    """The rows of each task's Gram matrix of prepared(centred rows, length)."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for length, _, x in by_length(batch):
                if length in moments:
                    q = prepared(deviations(x, moments[length]).astype(np.float64) / moments[length].n, length)
                    total[length] = total.get(length, 0) + q.T @ q
        rows = [(length, i, row.tobytes()) for length, g in total.items() for i, row in enumerate(g)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["length", "at", "row"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x) for x in table.column("row").to_pylist())
    return pa.table({"length": table.column("length")[:1], "at": table.column("at")[:1], "row": pa.array([total.tobytes()], pa.binary())})


def gram(fit: DataFrame, moments: dict[int, Moments], prepared: Callable[[np.ndarray, int], np.ndarray]) -> dict[int, np.ndarray]:
    """By length, the Gram matrix of prepared(centred rows) over all of fit: a matrix a length reaches the driver, whatever the rows."""
    rows = fit.mapInArrow(_matrix_rows(prepared, moments), "length long, at long, row binary").groupBy("length", "at").applyInArrow(_summed, "length long, at long, row binary")
    found: dict[int, dict[int, np.ndarray]] = {}
    for r in rows.collect():
        found.setdefault(r["length"], {})[r["at"]] = np.frombuffer(r["row"])
    return {length: np.array([own[i] for i in range(len(own))]) for length, own in found.items()}


def factor(g: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """The upper Cholesky factor of a Gram matrix of n rows, plus a shift where asked for or where it isn't positive without."""
    values = np.linalg.eigvalsh(g)
    if not shifted and values[0] > 0.5:
        return np.linalg.cholesky(g).T
    d = len(g)
    return np.linalg.cholesky(g + 11 * (n * d + d * (d + 1)) * ROUNDING * values[-1] * np.eye(d)).T


def fitted(fit: DataFrame, most: int) -> dict[int, Fitted]:
    """By length, up to `most` components of the rows of fit (length, x)."""
    sums = fit.mapInArrow(_sums, "length long, at long, n long, s decimal(38,0)").groupBy("length", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    moments: dict[int, Moments] = {}
    for r in sums.orderBy("length", "at").collect():  # one row for each component of a length
        moments.setdefault(r["length"], Moments(r["n"], [])).sums.append(int(r["s"]))
    factors: dict[int, list[np.ndarray]] = {length: [] for length in moments}

    def orthogonal(a: np.ndarray, length: int) -> np.ndarray:
        for r in factors[length]:
            a = solved(a, r)
        return a

    for k in range(PASSES):
        for length, g in gram(fit, moments, orthogonal).items():
            if np.trace(g) > 0:
                factors[length].append(factor(g, moments[length].n, k == 0))
            else:
                del moments[length], factors[length]  # no variance at all
    out = {}
    for length, (first, *later) in factors.items():
        r = first
        for next_r in later:
            r = next_r @ r
        _, values, vectors = np.linalg.svd(r)
        share = values**2 / (values**2).sum()
        kept = [i for i in range(min(most, length)) if share[i] > LEAST_SHARE * share[0]]
        out[length] = Fitted(moments[length], vectors[kept].T, values[kept] ** 2 / moments[length].n, share[kept])
    for length, g in gram(fit, {k: v.moments for k, v in out.items()}, lambda a, length: np.column_stack([out[length].whitened(a), np.ones(len(a))])).items():
        mean = g[:-1, -1] / g[-1, -1]
        out[length].error = float(np.abs(g[:-1, :-1] / g[-1, -1] - np.outer(mean, mean) - np.eye(len(mean))).max())
    return out


def _whitened(found: dict[int, Fitted]):
    def run(batches):
        for batch in batches:
            for length, mine, x in by_length(batch):
                if length not in found:
                    continue
                f = found[length]
                off = deviations(x, f.moments)
                exact = off if largest(off) ** 2 * length < 2**63 else off.astype(object)
                w, k = f.whitened(off.astype(np.float64) / f.moments.n), len(f.shares)
                columns = [
                    batch.column("vec_id").take(pa.array(np.repeat(mine, k))), pa.array(np.tile(np.arange(1, k + 1), len(mine)), pa.int32()), pa.array([f.moments.n] * (k * len(mine)), pa.int64()),
                    pa.array(np.repeat((exact * exact).sum(1), k).tolist(), pa.int64()), pa.array(w.reshape(-1)), pa.array(np.tile(f.shares, len(mine))), pa.array([f.error] * (k * len(mine)), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in WHITENED.split(", ")])

    return run


def whitened(vectors: DataFrame, components: int = 4, steps: int = 256) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each whole row of vectors and component."""
    rows = vectors.where(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").cast("long").alias("length"), on_grid("embedding", steps).alias("x"))
    fit = written(rows.select("length", "x").distinct())
    return rows.mapInArrow(_whitened(fitted(fit, components)), WHITENED)
