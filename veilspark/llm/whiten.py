"""Whitening of embeddings by a randomised range finder.

Entries are put on a grid, x = floor(1024 c) + 100000 as long, so that counts, sums and squared deviations are exact whatever the order of the
rows. The components are the eigenvectors of the covariance V of all rows: a random basis of a few more directions than are asked for is
multiplied by V again and again, each time in one pass over all rows, centred before they are multiplied. After each pass Rayleigh-Ritz gives
eigenvectors within the basis and what V leaves of them outside it. Where those residuals, over the gap to the next value, aren't at rounding
after the last pass, the basis is expanded to the full dimension, which gives V itself. Only the basis and sums of its size are on the driver:
dimension times dimension at most, whatever the number of rows; a task adds up its rows and sends one row an entry.

Defined results: rows whose vector is null, empty or holds null or non-finite entries are left out, as are those with another length than most
vectors have (of equally frequent lengths the longest counts) and those with an entry beyond 2^40, for which the grid has no place. Repeated
vectors count as often as they occur. Components whose eigenvalue isn't above rounding are left out, so equal vectors, or a single one, give no
rows. deviation is null where it doesn't fit a long. Extra columns are kept; a new one takes an underscore in front where df has the name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _base as base

SCALE, SHIFT, LARGEST = 1024.0, 100_000, float(2**40)
#: Components, directions beside them, passes before the basis is expanded, rows that are multiplied at once.
COMPONENTS, OVERSAMPLE, PASSES, ROWS = 8, 8, 4, 8192
#: Residual over gap that counts as rounding; eigenvalue over the largest that counts as none.
ROUNDING, NOTHING = 1e-13, 1e-12
_SEED = 20240613


def _grid(column: pa.Array, dim: int) -> np.ndarray:
    """x of a list column whose rows all have dim entries."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(SCALE * flat).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], at: int, dim: int) -> Iterator[np.ndarray]:
    for b in batches:
        for k in range(0, b.num_rows, ROWS):
            yield _grid(b.column(at).slice(k, ROWS), dim)


def usable(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """(rows that take part, their dimension)."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & (F.abs(c) <= LARGEST))
    some = df.where(F.coalesce(fine, F.lit(False)))
    lengths = some.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    return (some.where(F.size(vector) == lengths[0].dim), lengths[0].dim) if lengths else (some, 0)


def _added(df: DataFrame, partial, kind: str) -> dict[int, float]:
    """The sums over all tasks of what partial(batches) gives for each task as {entry: number}."""
    arrow = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.asarray(partial(batches)).ravel()
        yield pa.RecordBatch.from_pydict({"entry": pa.array(np.arange(len(sums)), pa.int32()), "value": pa.array(sums, arrow)})

    return {r.entry: r.value for r in df.mapInArrow(run, f"entry int, value {kind}").groupBy("entry").agg(F.sum("value").alias("value")).collect()}


def _filled(sums: dict[int, float], *shape: int) -> np.ndarray:
    return np.array([sums.get(k, 0.0) for k in range(int(np.prod(shape)))]).reshape(shape)


def ritz(basis: np.ndarray, image: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(eigenvalues, eigenvectors, whether they are exact to rounding) within an orthonormal basis, image being V times the basis."""
    inner = basis.T @ image
    e, u = np.linalg.eigh((inner + inner.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    vectors = basis @ u
    if basis.shape[0] == basis.shape[1]:
        return e, vectors, True
    left = np.linalg.norm(image @ u - vectors * e, axis=0)
    gap = np.abs(np.subtract.outer(e, e)) + np.diag(np.full(len(e), np.inf))
    return e, vectors, bool((left[:wanted] <= ROUNDING * gap.min(axis=0)[:wanted]).all())


class Fit:
    """n, sums (exact), values and vectors of the components, trace of V, identity_error, passes over the rows, size of the last basis."""

    def __init__(self, dim: int = 0) -> None:
        self.dim, self.n, self.sums = dim, 0, []
        self.values, self.vectors, self.trace, self.identity_error, self.passes, self.basis = np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0, 0, 0


def _centred(n: int, sums: list[int], dim: int):
    """x to n x - S, exact, and (n x - S) / n."""
    total = np.array(sums, object)
    narrow = n * (int(SCALE * LARGEST) + SHIFT) + max(map(abs, sums)) < 2**62
    small = np.array(sums, np.int64) if narrow else None

    def scaled(x: np.ndarray) -> np.ndarray:
        return x * n - small if narrow else x.astype(object) * n - total

    return scaled


def fit(rows: DataFrame, dim: int, vector: str, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> Fit:
    """rows, dim: as usable() gives them."""
    out = Fit(dim)
    vectors = rows.select(vector)

    def totals(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros(dim + 1, np.int64)
        for x in _blocks(batches, 0, dim):
            sums[:dim] += x.sum(axis=0)
            sums[dim] += len(x)
        return sums

    exact = _added(vectors, totals, "long") if dim else {}
    out.n, out.sums = int(exact.get(dim, 0)), [int(exact.get(k, 0)) for k in range(dim)]
    if not out.n:
        return out
    n, scaled = out.n, _centred(out.n, out.sums, dim)

    def multiplied(basis: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            image, squares = np.zeros(basis.shape), 0.0
            for x in _blocks(batches, 0, dim):
                y = scaled(x).astype(np.float64) / n
                image += y.T @ (y @ basis)
                squares += float((y * y).sum())
            return np.r_[image.ravel(), squares]

        sums = _filled(_added(vectors, partial, "double"), basis.size + 1) / n
        out.trace, out.passes = float(sums[-1]), out.passes + 1
        return sums[:-1].reshape(basis.shape)

    wide = min(dim, components + oversample)
    basis = np.eye(dim) if wide == dim else np.linalg.qr(np.random.default_rng(_SEED).standard_normal((dim, wide)))[0]
    done = False
    while not done:
        image = multiplied(basis)
        if out.trace == 0:
            return out
        values, found, done = ritz(basis, image, components)
        out.basis = basis.shape[1]
        if not done:
            basis = np.linalg.qr(image)[0] if out.passes < passes else np.eye(dim)
    held = [k for k in range(min(components, dim)) if values[k] > NOTHING * values[0]]
    out.values, out.vectors = values[held], found[:, held]
    if held:
        out.identity_error = _identity_error(vectors, out, scaled)
    return out


def projection(model: Fit) -> np.ndarray:
    return model.vectors / np.sqrt(model.values)


def _identity_error(vectors: DataFrame, model: Fit, scaled) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, from the whitened rows themselves."""
    dim, n, k, onto = model.dim, model.n, len(model.values), projection(model)

    def white(x: np.ndarray) -> np.ndarray:
        return scaled(x).astype(np.float64) / n @ onto

    mean = _filled(_added(vectors, lambda batches: sum((white(x).sum(axis=0) for x in _blocks(batches, 0, dim)), np.zeros(k)), "double"), k) / n

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros((k, k))
        for x in _blocks(batches, 0, dim):
            w = white(x) - mean
            out += w.T @ w
        return out

    return float(np.abs(_filled(_added(vectors, partial, "double"), k, k) / n - np.eye(k)).max())


def apply(rows: DataFrame, model: Fit, vector: str, keep: list[str]) -> DataFrame:
    """A row for each of rows and component: the columns keep, component, n, deviation, whitened, explained, identity_error."""
    kept = rows.select(*keep)
    new = base.output_names(kept, "component", "n", "deviation", "whitened", "explained", "identity_error")
    kinds = ["int", "long", "long", "double", "double", "double"]
    schema = ", ".join([kept._jdf.schema().toDDL(), *[f"`{c}` {t}" for c, t in zip(new, kinds)]])
    dim, n, k = model.dim, model.n, len(model.values)
    if not k:
        return kept.where(F.lit(False)).select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(new, kinds)])
    scaled, onto, share, error = _centred(n, model.sums, dim), projection(model), model.values / model.trace, model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                far = scaled(_grid(b.column(b.num_columns - 1), dim))
                white = far.astype(np.float64) / n @ onto
                if far.dtype == object or float(np.abs(far).max()) ** 2 * dim >= 2.0**62:
                    sums = [sum(int(c) ** 2 for c in r) for r in far]
                    deviation = pa.array([s if s < 2**63 else None for s in sums], pa.int64())
                else:
                    deviation = pa.array((far * far).sum(axis=1), pa.int64())
                again = pa.array(np.repeat(np.arange(b.num_rows), k))
                m = b.num_rows * k
                made = [
                    pa.array(np.tile(np.arange(1, k + 1), b.num_rows), pa.int32()), pa.array(np.full(m, n), pa.int64()), deviation.take(again),
                    pa.array(white.ravel(), pa.float64()), pa.array(np.tile(share, b.num_rows), pa.float64()), pa.array(np.full(m, error), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([*[c.take(again) for c in b.columns[:-1]], *made], names=[*b.schema.names[:-1], *new])

    return rows.select(*keep, F.col(vector).alias("_whitened_vector")).mapInArrow(run, schema)


def whiten(df: DataFrame, vector: str = "embedding", keep: list[str] | None = None, components: int = COMPONENTS, oversample: int = OVERSAMPLE, passes: int = PASSES) -> DataFrame:
    """A row for each usable row of df and component, with df's other columns, or keep."""
    rows, dim = usable(df, vector)
    model = fit(rows, dim, vector, components, oversample, passes)
    return apply(rows, model, vector, [c for c in df.columns if c != vector] if keep is None else keep)


def op13_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(base.read(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])


QUERIES = {"op13_whiten": op13_whiten}
ORACLE: dict[str, str] = {}
