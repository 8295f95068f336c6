"""Embedding whitening: leading components of a covariance by Jacobi-Davidson, without forming the matrix.

Vectors become integers (floor(scale * c) + shift), whose count and sums per dimension are exact.  The centred rows are
written once as blocks of doubles.  A product of the covariance with some columns is one Spark job: each task multiplies
its blocks, Spark adds the tasks' partial sums, and d x columns numbers come back; neither rows nor a
d x d matrix do.  On the driver, per outer step:

* Rayleigh-Ritz in the search space (its product with the covariance is kept beside it);
* leading pairs whose residual is at the level of double precision are locked and the rest stays orthogonal to them;
* for the other wanted pairs the correction equations (I - QQ')(V - theta I)(I - QQ') t = -r are solved by
  MINRES, all of them in step, so that each inner iteration is one distributed product;
* the solutions extend the search space, which restarts from its best Ritz vectors when it is full.

The driver holds at most ``max_basis`` columns of d numbers, whatever the number of rows.

Edge cases: null vectors and those with null, NaN or infinite entries take no part, nor do vectors whose length isn't
the table's most frequent one (ties: the longest) and those with an entry beyond 2**50 / scale; components
without variance (fewer rows than components, repeated rows) are left out, since they can't be scaled to one; an
empty table gives an empty result; null and repeated ids keep a row each; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import stage_table

BLOCK_CELLS = 1 << 18
EPS = np.finfo(float).eps


@dataclass
class Whitening:
    n: int
    sums: list  # exact integers, one per dimension
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # d x components
    residuals: np.ndarray
    identity_error: float
    passes: int


def integer_vectors(df: DataFrame, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id",
                    vector_col: str = "embedding") -> DataFrame:
    """(id, x): the vectors that take part, as integers."""
    v = F.col("__v")
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c) < 2.0**50 / scale, F.lit(False)))  # NaN is above any number
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("__v")) \
        .where(v.isNotNull() & (F.size(v) > 0) & finite)
    width = rows.groupBy(F.size("__v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("__v") == (width.d if width else 0)).select(
        "id", F.transform("__v", lambda c: F.floor(c * scale).cast("long") + shift).alias("x"))


def matrices(batches, column: int):
    """The integer matrices of Arrow batches, at most ``BLOCK_CELLS`` cells each, and where they start."""
    for b in batches:
        lists = b.column(column)
        d = len(lists[0]) if b.num_rows else 1
        rows = max(1, BLOCK_CELLS // d)
        for at in range(0, b.num_rows, rows):
            part = lists.slice(at, rows)
            yield b, at, part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def count_and_sums(x: DataFrame) -> tuple[int, list[int]]:
    """Exact row count and sums: each task adds its blocks, Spark adds the tasks as decimals."""
    def run(batches):
        import pyarrow as pa

        n, total = 0, None
        for _, _, m in matrices(batches, 0):
            low, high = (m & 0xFFFFFFFF).sum(0).tolist(), (m >> 32).sum(0).tolist()  # neither can overflow
            part = [a + (b << 32) for a, b in zip(low, high)]
            n, total = n + len(m), part if total is None else [a + b for a, b in zip(total, part)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(total)), -1]), pa.array([str(t) for t in (*total, n)])],
                                             names=["i", "s"])

    rows = x.select("x").mapInArrow(run, "i long, s string").groupBy("i").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    values = [int(r.s) for r in rows]
    return (values[0], values[1:]) if values else (0, [])


def deviations(m: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as integers of the machine where they fit, else Python's."""
    top = n * int(np.abs(m).max(initial=0)) + max(abs(s) for s in sums)
    if top < 2**62:
        return m * np.int64(n) - np.array(sums, np.int64)
    return m.astype(object) * n - np.array(sums, object)


def centred(m: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once."""
    return (deviations(m, n, sums) / n).astype(np.float64)


class Covariance:
    """The covariance (divisor n) of the written, centred blocks as an operator on columns."""

    def __init__(self, x: DataFrame, n: int, sums: list[int]):
        def run(batches):
            import pyarrow as pa
            for _, _, m in matrices(batches, 0):
                yield pa.RecordBatch.from_arrays([pa.array([centred(m, n, sums).tobytes()], pa.binary())], names=["block"])

        self.n, self.d, self.passes = n, len(sums), 0
        self.blocks = stage_table(x.select("x").mapInArrow(run, "block binary"), "centred-vectors")

    def total(self, fold, size: int) -> np.ndarray:
        """The sum over all blocks of ``fold(block)``, ``size`` numbers."""
        d = self.d

        def run(batches):
            import pyarrow as pa
            total = np.zeros(size)
            for b in batches:
                for block in b.column(0):
                    total += fold(np.frombuffer(block.as_buffer(), np.float64).reshape(-1, d)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(range(size)), pa.array(total)], names=["i", "v"])

        self.passes += 1
        rows = self.blocks.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(size)
        out[rows.i.to_numpy()] = rows.v.to_numpy()
        return out

    def trace(self) -> float:
        return float(self.total(lambda m: np.array([(m * m).sum()]), 1)[0]) / self.n

    def __matmul__(self, columns: np.ndarray) -> np.ndarray:
        return self.total(lambda m: m.T @ (m @ columns), columns.size).reshape(columns.shape) / self.n

    def identity_error(self, scaled: np.ndarray) -> float:
        """Largest absolute entry of the covariance of the rows times ``scaled``, minus the identity."""
        k = scaled.shape[1]

        def fold(m):
            y = m @ scaled
            return np.concatenate((y.sum(0), (y.T @ y).ravel()))

        got = self.total(fold, k + k * k) / self.n
        return float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())


def orthonormal(new: np.ndarray, old: list[np.ndarray]) -> np.ndarray:
    """An orthonormal basis of what ``new`` adds to the orthonormal columns of ``old``."""
    for q in (*old, *old):
        new = new - q @ (q.T @ new)
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    if not new.size:
        return new[:, :0]
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    u = u[:, s > 1e-6 * s[0]]
    for q in old:
        u = u - q @ (q.T @ u)
    return np.linalg.qr(u)[0]


def minres(product, rhs: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """MINRES for several symmetric systems in step; ``product(columns, which)`` applies each system to its column."""
    beta = np.linalg.norm(rhs, axis=0)
    goal, x = tolerance * beta, np.zeros_like(rhs)
    which = np.flatnonzero(beta > 0)
    v, v0 = rhs[:, which] / beta[which], np.zeros((len(rhs), len(which)))
    w, w0 = np.zeros_like(v), np.zeros_like(v)
    beta, eta = np.zeros(len(which)), beta[which]
    c, c0, s, s0 = np.ones(len(which)), np.ones(len(which)), np.zeros(len(which)), np.zeros(len(which))
    for _ in range(steps):
        if not len(which):
            break
        q = product(v, which)
        alpha = (v * q).sum(0)
        q = q - alpha * v - beta * v0
        beta1 = np.linalg.norm(q, axis=0)
        delta = c * alpha - c0 * s * beta
        rho1 = np.hypot(delta, beta1)
        rho2, rho3 = s * alpha + c0 * c * beta, s0 * beta
        safe = np.where(rho1 > 0, rho1, 1)
        c0, s0, c, s = c, s, delta / safe, beta1 / safe
        w0, w = w, (v - rho3 * w0 - rho2 * w) / safe
        x[:, which] += np.where(rho1 > 0, c * eta, 0) * w
        eta = -s * eta
        on = (np.abs(eta) > goal[which]) & (beta1 > EPS * np.abs(alpha)) & (rho1 > 0)
        v0, v, beta = v, q / np.where(beta1 > 0, beta1, 1), beta1
        which, v, v0, w, w0 = which[on], v[:, on], v0[:, on], w[:, on], w0[:, on]
        beta, eta, c, c0, s, s0 = beta[on], eta[on], c[on], c0[on], s[on], s0[on]
    return x


def jacobi_davidson(a, d: int, wanted: int, scale: float, max_basis: int = 64, inner: int = 4, outer: int = 200,
                    seed: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residual norms) of the ``wanted`` leading pairs of the symmetric, positive operator ``a``.
    ``scale`` is its trace; residuals end below 4 d eps times the largest value (sums of that many rounded products)."""
    wanted = min(wanted, d)
    block = min(d, wanted + 4)  # some more than wanted, so that none hides behind a start vector
    max_basis = min(d, max(max_basis, 3 * block))
    draw = np.random.default_rng(seed)
    locked, values, residuals = np.zeros((d, 0)), [], []
    q = orthonormal(draw.standard_normal((d, block)), [])
    aq = a @ q
    tolerance = 0.25
    for _ in range(outer):
        # Rayleigh-Ritz in the search space
        h = q.T @ aq
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        q, aq = q @ y, aq @ y
        residual = aq - q * theta - locked @ (locked.T @ aq)
        size = np.linalg.norm(residual, axis=0)
        enough = 4 * d * EPS * max([*values, *theta[:1], EPS * scale])
        # locking, in falling order only
        whole = locked.shape[1] + q.shape[1] == d  # the search space is all there is: its pairs are the operator's
        done = 0
        while done < len(theta) and locked.shape[1] + done < wanted and (size[done] <= enough or whole):
            done += 1
        locked = np.concatenate((locked, q[:, :done]), 1)
        values += theta[:done].tolist()
        residuals += size[:done].tolist()
        left = wanted - locked.shape[1]
        if not left:
            break
        q, aq, theta, residual, size = q[:, done:], aq[:, done:], theta[done:], residual[:, done:], size[done:]
        if q.shape[1] + left > max_basis:
            q = orthonormal(q[:, :max(block, max_basis // 2)], [locked])
            aq = a @ q
            continue
        # correction equations of the wanted pairs that aren't there yet
        now = np.flatnonzero(size[:left] > enough)
        around = np.concatenate((locked, q[:, :left]), 1)

        def inside(m):
            return m - around @ (around.T @ m)

        def product(columns, which):
            return inside(a @ columns - columns * theta[now][which])

        more = orthonormal(minres(product, -inside(residual[:, now]), inner, tolerance), [locked, q])
        tolerance = max(tolerance * 0.3, 1e-4)
        if not more.shape[1]:
            more = orthonormal(draw.standard_normal((d, left)), [locked, q])
        q, aq = np.concatenate((q, more), 1), np.concatenate((aq, a @ more), 1)
    if locked.shape[1] < wanted:
        raise ArithmeticError(f"{wanted - locked.shape[1]} pairs stayed above the residual of double precision")
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order], np.array(residuals)[order]


def fit_whitening(x: DataFrame, components: int = 8) -> Whitening:
    """The leading components of the integer vectors ``x``, which is read from a written table."""
    n, sums = count_and_sums(x)
    none = np.zeros(0)
    if not n:
        return Whitening(0, [], 0.0, none, np.zeros((0, 0)), none, 0.0, 0)
    a = Covariance(x, n, sums)
    trace = a.trace()
    if trace == 0:
        return Whitening(n, sums, 0.0, none, np.zeros((a.d, 0)), none, 0.0, a.passes)
    values, vectors, residuals = jacobi_davidson(a, a.d, components, trace)
    with_variance = values > 16 * a.d * EPS * trace
    values, vectors, residuals = values[with_variance], vectors[:, with_variance], residuals[with_variance]
    error = a.identity_error(vectors / np.sqrt(values))
    return Whitening(n, sums, trace, values, vectors, residuals, error, a.passes)


def whiten(x: DataFrame, model: Whitening) -> DataFrame:
    """(id, component, deviation_exact, whitened) per row and component; deviation_exact is the sum over dimensions of (n x - S)^2."""
    sent = x.sparkSession.sparkContext.broadcast(model)  # components x d numbers

    def run(batches):
        import pyarrow as pa

        m = sent.value
        k = len(m.values)
        scaled = m.vectors / np.sqrt(m.values)
        for b, at, part in matrices(batches, 1):
            if not k:
                continue
            dev = deviations(part, m.n, m.sums)
            if dev.dtype != object and m.n * float(np.abs(part - np.array(m.sums, float) / m.n).max()) < (2**62 / part.shape[1]) ** 0.5:
                exact = (dev * dev).sum(1).tolist()
            else:
                exact = (dev.astype(object) ** 2).sum(1).tolist()
            y = centred(part, m.n, m.sums) @ scaled
            ids = b.column(0).slice(at, len(part)).take(pa.array(np.repeat(np.arange(len(part)), k)))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part))),
                 pa.array([str(e) for e in exact for _ in range(k)]), pa.array(y.ravel())],
                names=["id", "component", "deviation_exact", "whitened"])

    return x.select("id", "x").mapInArrow(run, "id long, component int, deviation_exact string, whitened double")


def whitening(df: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The whitened rows with what holds for the whole table: n, explained (share of the variance), identity_error, residual."""
    x = stage_table(integer_vectors(df, id_col=id_col, vector_col=vector_col), "integer-vectors")
    model = fit_whitening(x, components)
    spark = df.sparkSession
    k = spark.createDataFrame(
        [(i + 1, float(e / model.trace), float(r)) for i, (e, r) in enumerate(zip(model.values, model.residuals))],
        "component int, explained double, residual double")
    return whiten(x, model).join(F.broadcast(k), "component").select(
        "id", "component", F.lit(model.n).cast("long").alias("n"), "deviation_exact", "whitened", "explained",
        F.lit(model.identity_error).alias("identity_error"), "residual")
