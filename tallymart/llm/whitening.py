"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance V = XᵀX / n of the centred vectors is never formed: only products V Q with a thin block Q are, each one
distributed pass in which every task sums Xᵀ(X Q) over its own rows. A polynomial of V, applied by the three-term recurrence
of the Chebyshev polynomials on [0, b], damps the unwanted spectrum, b being the block's smallest Ritz value; QR and a
Rayleigh-Ritz step follow, until the residuals |V u - e u| of all wanted pairs certify them.

Entries are whole numbers x = floor(64 c) + 1000000, whose sums are exact; a vector is centred in whole numbers (x less the
whole part of the mean, then the fraction) before anything is multiplied, so that the offset costs no digits.

Vectors that are null or hold null or non-finite entries are dropped, and so are those with an entry whose x needs more than
62 bits, empty ones, and those of another length than the most frequent (of equal ones the longer). Repeated rows count
as often as they occur; ids may be null or repeat. Components whose variance is under 1e-8 of the largest aren't returned: whitening
would divide by rounding errors. So an empty table, a single vector or equal vectors give no rows. ``deviation`` is null where it
needs more than 63 bits.

To the driver come, for each pass, the sums of a block: dimensions times (components + guard) doubles, whatever the number of
rows. Sums of tasks meet by dimension in an aggregate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, table, written

SCALE, OFFSET, LARGEST = 64, 1_000_000, 1 << 62
COMPONENTS, GUARD = 32, 24
#: Residuals, over the largest eigenvalue: as wanted, and at most where they improve no more.
TIGHT, LOOSE, ROUNDS, FLAT = 1e-13, 1e-10, 60, 1e-8


def entries(column) -> np.ndarray:
    """An Arrow list column without nulls whose lists have one length, as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def fit_list(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, int]:
    """The rows that remain as (id, y), y = x - OFFSET, written; and their number of dimensions."""
    c = F.transform(column, lambda v: F.floor(v.cast("double") * SCALE))
    fine = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * SCALE < float(LARGEST)))
    rows = vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0)).filter(fine).select(F.col(id_column).alias("id"), c.alias("y"))
    rows = written(rows)
    lengths = rows.groupBy(F.size("y").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    return rows.filter(F.size("y") == d), d


def whole_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and the exact sums of x by dimension."""

    def run(parts):
        n, low, high = 0, [0] * d, [0] * d
        for part in small(parts):
            y = entries(part.column(0))
            n += len(y)
            low = [a + int(b) for a, b in zip(low, (y & 0x7FFFFFFF).sum(axis=0))]
            high = [a + int(b) for a, b in zip(high, (y >> 31).sum(axis=0))]
        if n:
            sums = [str((h << 31) + v + n * OFFSET) for v, h in zip(low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(sums)], ["i", "n", "s"])

    out = rows.select("y").mapInArrow(run, "i int, n long, s string").groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r["i"]: int(r["s"]) for r in out}
    return (out[0]["n"] if out else 0), [sums.get(i, 0) for i in range(d)]


class Centred:
    """The rows, centred: what tasks need to turn y into x - S / n."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        parts = [divmod(s, n) for s in sums]
        self.whole = np.array([q - OFFSET for q, _ in parts], np.int64)
        self.rest = np.array([r for _, r in parts], np.int64)

    def __call__(self, y: np.ndarray) -> np.ndarray:
        return (y - self.whole) - self.rest / self.n

    def deviation(self, y: np.ndarray) -> pa.Array:
        """Sum of (n x - S)² over the dimensions. Whole numbers wrap around, so that a result of at most 63 bits is exact."""
        about = (self.n**2 * self(y) ** 2).sum(axis=1)
        d = self.n * (y - self.whole) - self.rest
        return pa.array((d * d).sum(axis=1), pa.int64(), mask=about > 0.99 * 2.0**63)


def sums_of(rows: DataFrame, left, width: int, columns: int) -> np.ndarray:
    """Over all rows, the sum of Lᵀ R, where left(y) gives a batch's L (rows times width) and R (rows times columns)."""
    names = [f"v{k}" for k in range(columns)]

    def run(parts):
        total = np.zeros((width, columns))
        for part in small(parts, 1 << 14):
            a, b = left(entries(part.column(0)))
            total += a.T @ b
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), *[pa.array(np.ascontiguousarray(total[:, k])) for k in range(columns)]], ["i", *names])

    made = rows.select("y").mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros((width, columns))
    for r in made.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["i"]] = r[1:]
    return out


class Passes:
    """Products with the covariance; each is one pass over the rows."""

    def __init__(self, rows: DataFrame, centred: Centred, d: int):
        self.rows, self.centred, self.d, self.made = rows, centred, d, 0

    def __call__(self, q: np.ndarray) -> np.ndarray:
        centred = self.centred
        self.made += 1

        def left(y):
            x = centred(y)
            return x, x @ q

        return sums_of(self.rows, left, self.d, q.shape[1]) / centred.n

    def trace(self) -> float:
        centred = self.centred

        def left(y):
            x = centred(y)
            return np.ones((len(x), 1)), x * x

        return float(sums_of(self.rows, left, 1, self.d).sum() / centred.n)


def filtered(v, q: np.ndarray, vq: np.ndarray, degree: int, b: float, top: float) -> np.ndarray:
    """p(V) q of the Chebyshev polynomial on [0, b], scaled to about 1 at top; vq is V q, which is known. V is positive: 0 bounds it below."""
    half = b / 2
    sigma = first = half / (top - half)
    old, new = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        old, new = new, (v(new) - half * new) * (2 * after / half) - (sigma * after) * old
        sigma = after
    return new


def degree_for(wanted: float, b: float, top: float, residual: float, started: bool) -> int:
    """Enough to bring the residual to TIGHT, unless the largest would outgrow the others beyond what QR can hold apart."""
    if b <= 0:
        return 1
    growth = lambda x: np.arccosh(max(2 * x / b - 1, 1 + 1e-9))
    most = np.log(1e18 if started else 1e8) / max(growth(top) - (growth(wanted) if started else 0), 1e-9)
    return int(np.clip(min(np.ceil(np.log(10 * max(residual / TIGHT, 10)) / growth(wanted)), most), 2, 32))


def eigenpairs(v, d: int, k: int, guard: int = GUARD, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of v, their unit vectors (as columns), and the largest residual over the largest eigenvalue.

    v(Q) gives V Q. Raises an error where the residuals don't reach LOOSE.
    """
    k = min(k, d)
    size = min(d, k + guard)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, size)))[0]
    before = np.inf
    for turn in range(ROUNDS):
        w = v(q)
        t = q.T @ w
        e, y = np.linalg.eigh((t + t.T) / 2)
        e, y = e[::-1], y[:, ::-1]
        q, w = q @ y, w @ y
        if e[0] <= 0:
            return e[:k], q[:, :k], 0.0
        residual = float(np.linalg.norm(w[:, :k] - q[:, :k] * e[:k], axis=0).max() / e[0])
        if size == d or residual <= TIGHT or (residual <= LOOSE and residual > before / 2):
            return e[:k], q[:, :k], residual
        before = residual
        b = max(e[-1], 1e-12 * e[0])
        q = np.linalg.qr(filtered(v, q, w, degree_for(e[k - 1], b, e[0], residual, turn > 0), b, e[0]))[0]
    raise RuntimeError(f"no {k} components after {ROUNDS} rounds: residual {before}")


def upright(u: np.ndarray) -> np.ndarray:
    """Each column with its largest entry positive, so that reruns agree in sign."""
    return u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)


def whitened(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS, guard: int = GUARD) -> DataFrame:
    """A row for each vector that remains and each component: id, component, n, deviation, whitened, explained, identity_error, residual."""
    kind = vectors.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, residual double"
    rows, d = fit_list(vectors, id_column, column)
    n, sums = whole_sums(rows, d) if d else (0, [])
    empty = vectors.sparkSession.createDataFrame([], schema)
    if not n:
        return empty
    centred = Centred(n, sums)
    passes = Passes(rows, centred, d)
    trace = passes.trace()
    if trace <= 0:
        return empty
    e, u, residual = eigenpairs(passes, d, components, guard)
    some = e > FLAT * e[0]
    e, u = e[some], upright(u[:, some])
    turn, k = u / np.sqrt(e), len(e)

    def own(y):
        z = centred(y) @ turn
        return np.hstack([z, np.ones((len(z), 1))]), z

    found = sums_of(rows, own, k + 1, k) / n
    error = float(np.abs(found[:k] - np.outer(found[k], found[k]) - np.eye(k)).max())
    explained = e / trace

    def run(parts):
        for part in small(parts, 2048):
            y = entries(part.column(1))
            z = centred(y) @ turn
            at = pa.array(np.repeat(np.arange(len(y)), k))
            each = lambda x: pa.array(np.tile(x, len(y)))
            same = lambda x, t: pa.array(np.full(len(y) * k, x), t)
            cols = [part.column(0).take(at), each(np.arange(1, k + 1, dtype=np.int32)), same(n, pa.int64()), centred.deviation(y).take(at), pa.array(z.ravel()), each(explained), same(error, pa.float64()), same(residual, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error", "residual"])

    return rows.select("id", "y").mapInArrow(run, schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
