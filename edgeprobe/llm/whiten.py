"""Whitening of embeddings by their leading principal components, without ever forming a covariance matrix.

*Fixed point.*  An entry c becomes the whole number floor(scale * c) + shift, so that counts, sums and squared deviations are
exact and don't hang on how rows are dealt out.

*Passes.*  A pass multiplies the covariance V of all vectors by a block of a few directions B: a task centres its vectors, forms X(XᵀB) for them,
and its sum of (dimensions x block) numbers is added to the others', first by ``ADDERS`` tasks and then on the driver, which
thus holds a few blocks at any size of the data.

*Block Lanczos.*  The driver keeps an orthonormal basis Q and the products VQ.  Each pass multiplies the newest block; what is left of the product after
two orthogonalisations against the whole basis is the next block.  A direction that vanishes there (a breakdown: an invariant subspace
is exhausted) is restarted at random, orthogonally to all others.  The Rayleigh quotients of the basis give values and vectors, and since VQ is
known, their residuals |Vu - eu| are the true ones: when all are below ``TOLERANCE`` of the largest value it ends, or when the basis has
all dimensions.  The trace, for explained shares, is the sum of the rows' exact squared deviations.

Cases: rows whose vector is null or has null or non-finite entries are left out; shorter vectors are filled up with zeros;
entries that would pass 2**52 in fixed point are held there; components without variance (equal vectors, fewer rows than components, fewer dimensions) are left out, so the
arrays are shorter or empty; an empty table gives an empty result.  Equal rows and null ids are kept.  Other columns are kept; one
that is called ``whitened`` or ``deviation`` comes back with ``own_`` before its name.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SCALE, SHIFT = 1024, 100_000
#: Components, and further directions in a block that speed up their convergence.
COMPONENTS, SPARE = 8, 8
#: Residuals that count as none, as a share of the largest eigenvalue.
TOLERANCE = 1e-13
#: Tasks that add up the sums of all others.
ADDERS = 16
_MOST = 2.0**52
NEW = ["whitened", "deviation"]


@dataclass
class Model:
    """What has been learnt: rows, sums of each dimension, eigenvalues and unit eigenvectors (columns), by falling value."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    scale: int = SCALE
    shift: int = SHIFT
    trace: float = 0.0
    identity_error: float = 0.0
    passes: int = 0
    residuals: np.ndarray = field(default_factory=lambda: np.empty(0))

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.values]


def fixed_point(column: pa.Array, scale: int, shift: int, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a column of lists of doubles count, and their whole numbers (rows x dimensions)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    start, end = np.array(column.offsets)[:-1].astype(np.int64), np.array(column.offsets)[1:].astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))  # null entries have come as NaN
    ok = np.array(column.is_valid()) & (bad[end] == bad[start])
    start, size = start[ok], (end - start)[ok]
    dims = int(size.max(initial=0)) if dims is None else dims
    at = np.arange(dims)
    inside = at < size[:, None]
    c = np.where(inside, values[np.where(inside, start[:, None] + at, 0)] if len(values) else 0.0, 0.0)
    with np.errstate(over="ignore"):
        return ok, np.clip(np.floor(scale * c) + shift, -_MOST, _MOST).astype(np.int64)


class Centre:
    """The mean as a whole part and a rest, so that differences from it lose nothing."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.left = [s % n for s in sums]
        self.rest = np.array([r / n for r in self.left])

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n*x - S)**2 for each row."""
        x = x - self.whole
        if not x.size:
            return [0] * len(x)
        if self.n * (int(np.abs(x).max()) + 1) >= 2**62:
            y = x.astype(object) * self.n - np.array(self.left, object)
            return [int(v) for v in (y * y).sum(axis=1)]
        y = x * self.n - np.array(self.left, np.int64)
        if x.shape[1] * int(np.abs(y).max()) ** 2 < 2**63:
            return (y * y).sum(axis=1).tolist()
        digits = [y >> 20 * k & 0xFFFFF for k in range(3)] + [y >> 60]
        sums = [[int(v) for v in sum(np.einsum("ij,ij->i", digits[i], digits[k - i]) for i in range(max(0, k - 3), min(3, k) + 1))] for k in range(7)]
        return [sum(s[r] << 20 * k for k, s in enumerate(sums)) for r in range(len(x))]


def _cells(*cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x]) for x in cells], names=["exact", "sums"])


_CELLS = "exact string, sums binary"


def _added(df: DataFrame, make, add) -> object:
    """What ``add`` makes of all tasks' cells, by two levels of adding; None without any."""

    def adds(batches):
        cells = None
        for b in batches:
            for exact, sums in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cells = (exact, sums) if cells is None else add(cells, (exact, sums))
        if cells is not None:
            yield _cells(*cells)

    parts = df.mapInArrow(make, _CELLS).repartition(ADDERS).mapInArrow(adds, _CELLS)
    cells = None
    for r in parts.collect():  # a row for each of the ADDERS tasks
        cells = tuple(r) if cells is None else add(cells, (r[0], bytes(r[1])))
    return cells


def _add_sums(a, b):
    """Cells of (rows, entries of a row left out, sums): a shorter row of sums is filled up with what zeros give."""
    (n, shift, x), (m, _, y) = json.loads(a[0]), json.loads(b[0])
    size = max(len(x), len(y))
    full = lambda s, rows: s + [shift * rows] * (size - len(s))
    return json.dumps([n + m, shift, [p + q for p, q in zip(full(x, n), full(y, m), strict=True)]]), b""


def _add_blocks(a, b):
    exact = str(int(a[0]) + int(b[0]))
    return exact, (np.frombuffer(a[1]) + np.frombuffer(b[1])).tobytes()


def _counts(scale: int, shift: int):
    def run(batches):
        cells = None
        for b in batches:
            ok, x = fixed_point(b.column(0), scale, shift)
            if ok.any():
                new = json.dumps([int(ok.sum()), shift, [int(v) for v in x.sum(axis=0)]]), b""
                cells = new if cells is None else _add_sums(cells, new)
        if cells is not None:
            yield _cells(*cells)

    return run


def _products(model: Model, sent):
    """n times the covariance times the block that has been sent."""

    def run(batches):
        centre, block = Centre(model.n, model.sums), sent.value
        total = np.zeros(block.shape)
        for b in batches:
            _, x = fixed_point(b.column(0), model.scale, model.shift, len(model.sums))
            x = centre.of(x)
            total += x.T @ (x @ block)
        yield _cells("0", total.tobytes())

    return run


def _moments(sent):
    """The sum of all deviations, and n times the covariance of the whitened vectors, which are centred as the vectors are."""

    def run(batches):
        model = sent.value
        centre, k = Centre(model.n, model.sums), len(model.values)
        total, deviations = np.zeros((k, k)), 0
        for b in batches:
            _, x = fixed_point(b.column(0), model.scale, model.shift, len(model.sums))
            deviations += sum(centre.deviations(x))
            w = centre.of(x) @ (model.axes / np.sqrt(model.values))
            total += w.T @ w
        yield _cells(str(deviations), total.tobytes())

    return run


def _rest(block: np.ndarray, basis: np.ndarray, rng) -> np.ndarray:
    """An orthonormal block from what is left of ``block`` outside the basis; vanished directions start anew at random."""
    out = np.zeros((len(basis), 0))
    for v in block.T:
        if basis.shape[1] + out.shape[1] == len(basis):
            break
        size = np.linalg.norm(v)
        for again in range(100):
            for _ in range(2):
                v = v - basis @ (basis.T @ v)
                v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-10 * size:
                out = np.column_stack([out, v / left])
                break
            v = rng.standard_normal(len(basis))
            size = np.linalg.norm(v)
    return out


def block_lanczos(times, dims: int, k: int, width: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The ``k`` largest eigenvalues and unit eigenvectors of a symmetric matrix known by its products, their residuals, and the number of products.

    A block is at least ``k`` wide, so that equal eigenvalues are all found.
    """
    width = max(width, k)
    rng = np.random.default_rng(seed)
    basis = products = np.zeros((dims, 0))
    block, passes = _rest(rng.standard_normal((dims, min(width, dims))), basis, rng), 0
    while True:
        new = times(block)
        passes += 1
        basis, products = np.column_stack([basis, block]), np.column_stack([products, new])
        small = basis.T @ products
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
        axes = basis @ turn
        residuals = np.linalg.norm(products @ turn - axes * values, axis=0)
        if basis.shape[1] == dims or (len(values) == k and residuals.max(initial=0) <= TOLERANCE * max(values[0], 0)):
            return values, axes / np.linalg.norm(axes, axis=0), residuals, passes
        block = _rest(new, basis, rng)


def _vectors(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("array<double>").alias("v"))


def fit(df: DataFrame, column: str = "embedding", components: int = COMPONENTS, spare: int = SPARE, scale: int = SCALE, shift: int = SHIFT) -> Model:
    """Learn from all vectors of a column."""
    spark = small_batches(df.sparkSession)
    rows = _vectors(df, column)
    cells = _added(rows, _counts(scale, shift), _add_sums)
    if cells is None:
        return Model(0, [], np.empty(0), np.empty((0, 0)), scale, shift)
    n, _, sums = json.loads(cells[0])
    model = Model(n, sums, np.empty(0), np.empty((len(sums), 0)), scale, shift)
    if not sums:
        return model

    def times(block: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(block)
        total = _added(rows, _products(model, sent), _add_blocks)[1]
        sent.unpersist()
        return np.frombuffer(total).reshape(block.shape) / n

    values, axes, model.residuals, model.passes = block_lanczos(times, len(sums), min(components, len(sums)), components + spare)
    some = values > 10 * len(sums) * np.finfo(float).eps * max(values[0], 0)
    model.values, model.axes, model.residuals = values[some], axes[:, some], model.residuals[some]
    sent = spark.sparkContext.broadcast(model)
    deviations, total = _added(rows, _moments(sent), _add_blocks)
    sent.unpersist()
    model.trace = int(deviations) / n**3
    model.identity_error = float(np.abs(np.frombuffer(total).reshape(len(model.values), -1) / n - np.eye(len(model.values))).max(initial=0)) if len(model.values) else 0.0
    return model


def _whitened(sent):
    def run(batches):
        model = sent.value
        centre, k = Centre(model.n, model.sums) if model.n else None, len(model.values)
        for b in batches:
            ok, x = fixed_point(b.column(1), model.scale, model.shift, len(model.sums))
            if not ok.any():
                continue
            w = centre.of(x) @ (model.axes / np.sqrt(model.values))
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
            exact = [str(d) if d < 10**38 else None for d in centre.deviations(x)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), arrays, pa.array(exact, pa.string())], names=["own", *NEW])

    return run


def whiten(df: DataFrame, model: Model, column: str = "embedding") -> DataFrame:
    """The rows that have a vector, with ``whitened`` (an entry for each component) and ``deviation`` (decimal; null from 10**38 on)."""
    spark = small_batches(df.sparkSession)
    rest = [c for c in df.columns if c != column]
    rows = df.select(F.struct(*rest, F.lit(0).alias("_")).alias("own"), F.col(column).cast("array<double>").alias("v"))
    own = rows.schema["own"].dataType.simpleString()
    found = rows.mapInArrow(_whitened(spark.sparkContext.broadcast(model)), f"own {own}, whitened array<double>, deviation string")
    kept = [F.col("own")[c].alias(f"own_{c}" if c in NEW else c) for c in rest]
    return found.select(*kept, "whitened", F.col("deviation").cast("decimal(38,0)").alias("deviation"))


def by_component(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component; a deviation beyond a long is null."""
    df = df.select(id_column, column)
    model = fit(df, column, components)
    rows = whiten(df, model, column).select(id_column, F.col("deviation").try_cast("bigint").alias("deviation"), F.posexplode("whitened").alias("k", "whitened"))
    shares = F.array(*[F.lit(x) for x in model.explained]) if len(model.values) else F.array(F.lit(0.0))
    return rows.select(
        id_column, (F.col("k") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
