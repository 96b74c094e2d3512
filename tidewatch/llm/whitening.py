"""Whitening of embeddings by spectrum slicing.

The covariance is gathered in integers, so it does not depend on how rows are
dealt. On the driver, the LDL^T factors of ``V - shift`` tell by their signs how
many eigenvalues lie below the shift. Bisection with these counts isolates each
leading eigenvalue, Rayleigh quotient iteration then converges cubically inside
its interval, and two last counts certify the number of the eigenvalue."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries from here on (in absolute value) count as not finite: their squares would leave decimal(38).
LARGEST = 2.0 ** 33
#: Whole numbers up to here are exact in a double.
EXACT = 1 << 53
#: Bunch and Kaufman's bound for taking a diagonal entry as the pivot.
ALPHA = (1 + 17 ** 0.5) / 8


@dataclass(frozen=True)
class Whitening:
    """What :func:`fit` finds. ``sums`` are exact; ``vectors`` has one row per
    component; ``values`` falls; ``counts`` are the inertia counts just below and
    above each eigenvalue."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    counts: tuple[tuple[int, int], ...]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def usable(self) -> np.ndarray:
        """Components with variance; the others cannot be scaled to one."""
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.trace, 1e-300)


def negative_pivots(a: np.ndarray) -> int:
    """Number of negative eigenvalues of a symmetric matrix: the signs of D in
    P A P^T = L D L^T (Sylvester), with pivots of one or two rows."""
    a, count, k, d = a.copy(), 0, 0, len(a)
    while k < d:
        column = np.abs(a[k + 1:, k])
        off = column.max(initial=0.0)
        pair = None
        if abs(a[k, k]) < ALPHA * off:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0.0
            most = row.max()
            if abs(a[k, k]) * most >= ALPHA * off * off:
                pass
            elif abs(a[r, r]) >= ALPHA * most:
                a[[k, r]] = a[[r, k]]
                a[:, [k, r]] = a[:, [r, k]]
            else:
                pair = r
        if pair is None:
            pivot = a[k, k]
            count += bool(pivot < 0)
            if pivot and k + 1 < d:
                below = a[k + 1:, k].copy()
                a[k + 1:, k + 1:] -= np.outer(below, below / pivot)
            k += 1
        else:
            a[[k + 1, pair]] = a[[pair, k + 1]]
            a[:, [k + 1, pair]] = a[:, [pair, k + 1]]
            block, below = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2].copy()
            count += 1 if np.linalg.det(block) < 0 else 2 * bool(block[0, 0] < 0)
            if k + 2 < d:
                a[k + 2:, k + 2:] -= below @ np.linalg.solve(block, below.T)
            k += 2
    return count


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, tuple[tuple[int, int], ...]]:
    """The ``k`` largest eigenvalues of ``v``, unit eigenvectors as rows, and
    the certificates. Eigenvalues that no double tells apart share an interval;
    their vectors are made orthogonal to each other."""
    d, eye = len(v), np.eye(len(v))
    reach = float(np.abs(v).sum(axis=1).max(initial=0.0))
    tiny = reach * np.finfo(float).eps
    known: dict[float, int] = {-reach - tiny: 0, reach + tiny: d}

    def below(shift: float) -> int:
        if shift not in known:
            known[shift] = negative_pivots(v - shift * eye)
        return known[shift]

    def halve(low: float, high: float, index: int) -> tuple[float, float]:
        middle = (low + high) / 2
        return (middle, high) if below(middle) <= index else (low, middle)

    def solved(a: np.ndarray, shift: float, y: np.ndarray) -> np.ndarray:
        for nudge in (0.0, tiny, 16 * tiny, 256 * tiny):
            try:
                x = np.linalg.solve(a - (shift + nudge) * eye, y)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(x).all() and x.any():
                x = x / np.abs(x).max()
                return x / np.linalg.norm(x)
        return y

    def iterate(a: np.ndarray, shift: float, low: float, high: float, seed: int) -> tuple[np.ndarray, float, float]:
        """Inverse iteration once, then Rayleigh quotients, until the residual no longer falls."""
        x = np.random.default_rng(seed).standard_normal(d)
        best = (x / np.linalg.norm(x), shift, float("inf"))
        for _ in range(40):
            x = solved(a, shift, x)
            quotient = float(x @ a @ x)
            off = float(np.linalg.norm(a @ x - quotient * x))
            if off < best[2]:
                best = (x, quotient, off)
            elif best[2] <= 8 * d * tiny:
                break
            if low <= quotient <= high:
                shift = quotient
        return best

    values, vectors, counts = [], [], []
    for j in range(min(k, d)):
        if not reach:
            values.append(0.0)
            vectors.append(eye[j])
            counts.append((0, d))
            continue
        index = d - 1 - j  # so many eigenvalues lie below this one
        low = max(s for s, c in known.items() if c <= index)
        high = min(s for s, c in known.items() if c > index)
        while not (below(low) == index and below(high) == index + 1) and high - low > 4 * tiny:
            low, high = halve(low, high, index)
        while True:
            # of several eigenvalues in one interval, those found are moved away
            a = v - sum((2 * reach * np.outer(x, x) for x, e in zip(vectors, values) if e - high <= 1e-6 * reach), np.zeros((d, d)))
            x, quotient, off = iterate(a, (low + high) / 2, low - tiny, high + tiny, j)
            margin = 4 * tiny + 2 * off
            sides = below(quotient - margin), below(quotient + margin)
            if sides == (index, index + 1) and off <= 8 * d * tiny or high - low <= 4 * tiny:
                break
            low, high = halve(low, high, index)  # it ran to a neighbour, or the two are close: begin nearer
        values.append(quotient)
        vectors.append(x)
        counts.append(sides)
    return np.array(values), np.array(vectors).reshape(len(values), d), tuple(counts)


def _vectors(batch: pa.RecordBatch, d: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors of a batch, and x as int64 rows;
    ``d`` None: row numbers and their lengths only."""
    lists = batch.column("v")
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~(np.abs(flat) < LARGEST)
    owner = np.repeat(np.arange(len(lengths)), np.maximum(lengths, 0))
    good = lengths >= 0
    good[owner[bad]] = False
    if d is None:
        return np.flatnonzero(good), lengths[good]
    good &= lengths == d
    rows = np.flatnonzero(good)
    return rows, (np.floor(1024.0 * flat[good[owner]]).astype(np.int64) + 100000).reshape(len(rows), d)


def _lengths_and_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for batch in batches:
        for d in set(_vectors(batch, None)[1].tolist()):
            _, x = _vectors(batch, d)
            n[d] = n.get(d, 0) + len(x)
            part = x.astype(object) if len(x) * int(np.abs(x).max(initial=0)) >= 1 << 62 else x
            sums[d] = [a + int(b) for a, b in zip(sums.get(d, [0] * d), part.sum(axis=0))]
    rows = [(d, -1, Decimal(n[d])) for d in n] + [(d, i, Decimal(s)) for d in n for i, s in enumerate(sums[d])]
    yield _table(rows, ("d", "i", "s"), (pa.int32(), pa.int32(), pa.decimal128(38, 0)))


def _table(rows, names, kinds) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def _scatter(z: np.ndarray) -> np.ndarray:
    """z^T z in whole numbers: by doubles as long as these are exact."""
    most, out = int(np.abs(z).max(initial=0)), 0
    rows = EXACT // max(most * most, 1)
    if rows < 1:
        wide = z.astype(object)
        return wide.T @ wide
    for i in range(0, len(z), rows):
        part = z[i:i + rows].astype(np.float64)
        out = out + (part.T @ part).astype(np.int64).astype(object)
    return out


def fit(vectors: DataFrame, column: str = "embedding", components: int = 8) -> Whitening | None:
    """Mean, exact covariance and leading eigenpairs of all usable vectors.

    Two passes: sums, then products of centred rows; each task sends one matrix
    (d x d), and the driver holds one of them. Null vectors and vectors with a
    null, non-finite or enormous entry (2^33 or more) do not take part. Of
    several lengths the most frequent one counts (ties: the longer). Repeated
    rows count each. None if no vector, or only empty ones, are left."""
    narrow = vectors.select(F.col(column).alias("v"))
    found = narrow.mapInArrow(_lengths_and_sums, "d int, i int, s decimal(38,0)").groupBy("d", "i").agg(F.sum("s").alias("s"))
    best = found.filter("i = -1 and d > 0").orderBy(F.desc("s"), F.desc("d")).limit(1).collect()
    if not best:
        return None
    d, n = best[0]["d"], int(best[0]["s"])
    sums = [int(r["s"]) for r in found.filter(f"d = {d} and i >= 0").orderBy("i").collect()]
    centre = np.array([round(s / n) for s in sums], dtype=np.int64)
    kept = np.triu_indices(d)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            _, x = _vectors(batch, d)
            if len(x):
                total = total + _scatter(x - centre)
        rows = [] if isinstance(total, int) else [(i, Decimal(int(p))) for i, p in enumerate(total[kept])]
        yield _table(rows, ("i", "p"), (pa.int32(), pa.decimal128(38, 0)))

    sent = narrow.mapInArrow(products, "i int, p decimal(38,0)").groupBy("i").agg(F.sum("p").alias("p")).collect()
    rest = [s - n * int(c) for s, c in zip(sums, centre)]  # the centre is rounded: take the rest out
    v = np.zeros((d, d))
    for r in sent:
        a, b = int(kept[0][r["i"]]), int(kept[1][r["i"]])
        v[a, b] = v[b, a] = (n * int(r["p"]) - rest[a] * rest[b]) / (n * n)
    values, axes, counts = leading(v, components)
    return Whitening(n, tuple(sums), float(np.trace(v)), values, axes, counts)


def _whitened(model: Whitening, x: np.ndarray) -> np.ndarray:
    """Rows by components; NaN where a component has no variance."""
    scale = np.where(model.usable, np.sqrt(np.maximum(model.values, 1e-300)), np.nan)
    return ((x - model.mean) @ model.vectors.T) / scale


def identity_error(vectors: DataFrame, model: Whitening, column: str = "embedding") -> float | None:
    """Largest entry of the whitened vectors' covariance minus the identity,
    measured on all rows; None if no component has variance."""
    use = np.flatnonzero(model.usable)
    k, d = len(use), len(model.sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, line = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = _whitened(model, _vectors(batch, d)[1])[:, use]
            total += w.T @ w
            line += w.sum(axis=0)
        rows = [(i, float(p)) for i, p in enumerate([*total.ravel(), *line])]
        yield _table(rows, ("i", "p"), (pa.int32(), pa.float64()))

    if not k:
        return None
    sent = vectors.select(F.col(column).alias("v")).mapInArrow(products, "i int, p double").groupBy("i").agg(F.sum("p").alias("p")).collect()
    flat = np.zeros(k * k + k)
    for r in sent:
        flat[r["i"]] = r["p"] / model.n
    mean = flat[k * k:]
    return float(np.abs(flat[:k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening | None, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """One row per usable vector and component: id, component (from 1), n,
    deviation (decimal(38,0): the sum over dimensions of (n*x-S)^2, exact; null
    beyond 38 digits), whitened, explained and identity_error.

    Rows whose vector does not take part in the fit are left out; rows with
    equal or null ids stay apart. A component without variance (all vectors
    alike, or fewer of them than components) has whitened null; a trace of zero
    gives explained null. Without a model (empty table) the result is empty.
    Other columns are not read, whatever their names."""
    kind = vectors.schema[id_column].dataType.simpleString()
    ddl = f"`{id_column}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    narrow = vectors.select(F.col(id_column).alias("id"), F.col(column).alias("v"))
    if model is None:
        return vectors.sparkSession.createDataFrame([], ddl)
    error = identity_error(vectors, model, column)
    k, d, n = len(model.values), len(model.sums), model.n
    centre = np.array([round(s / n) for s in model.sums], dtype=np.int64)
    rest = [s - n * int(c) for s, c in zip(model.sums, centre)]
    share = [e / model.trace if model.trace else None for e in model.values.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _vectors(batch, d)
            if not len(rows):
                continue
            z = x - centre
            bound = n * int(np.abs(z).max()) + max(map(abs, rest))
            y = z * n - np.array(rest) if bound * bound * d < 1 << 63 else z.astype(object) * n - np.array(rest, dtype=object)
            off = [Decimal(int(s)) if s < 10 ** 38 else None for s in (y * y).sum(axis=1)]
            w = _whitened(model, x).ravel()
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                pa.array(np.full(len(w), n, dtype=np.int64)), pa.array(off, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                pa.array(w, mask=np.isnan(w)), pa.array(share * len(rows), pa.float64()), pa.array([error] * len(w), pa.float64()),
            ], names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return narrow.mapInArrow(run, ddl)
