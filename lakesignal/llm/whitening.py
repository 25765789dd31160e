"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

The fit list X holds each distinct scaled vector once, centred.  From a start vector v, X v gives a left vector u, X'u the
next right vector, and so on; with both families kept orthonormal X V = U B for a small bidiagonal B, whose singular
values and right vectors are those of X.  One step is one distributed job:

* A left vector has an entry per row of X, so it is never stored or collected.  It lies in the range of X: u = X w for a
  w of one entry per dimension, and a task computes its part of u from its own rows.
* The job returns z = X'(X w), summed by Spark, one number per dimension.  Then |X w|^2 = w.z, and the products of u with
  all earlier left vectors are W'z, so full reorthogonalisation of u corrects w and z on the driver, where V, W and
  Z = X'U (dimension x steps numbers) are.  V is reorthogonalised there as well, both families twice.
* It ends when the leading singular vectors have converged to ``tolerance``, or when V spans all dimensions.  If the
  Krylov space is exhausted early, it goes on with a new direction orthogonal to V.

Rows are written once as blocks of vectors, the narrowest integers that hold them, so a step reads few large cells.  A
hot vector collapses before the shuffle (map-side aggregate), and blocks are cut by row position inside a task.

Defined cases: a null vector, an empty one, one with a null, NaN or infinite entry, and one whose scaled entry leaves 62
bits are dropped; vectors of another length than most distinct ones have (of equally frequent lengths the longest counts)
have no component and are dropped too; repeated rows each get their result; null ids are kept; a component with no variance has
no unit scale and is left out, so a constant or empty table gives no row; a deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesignal.llm.common import pinned

#: A vector is used as whole numbers floor(SCALE * c).  A constant added to all of them would cancel in every result.
SCALE = 64
#: Bytes of a block of vectors, as doubles.
BLOCK_BYTES = 8 << 20


def _scaled(vector: object) -> np.ndarray | None:
    """floor(SCALE * c) of each entry, or None where the vector has no such values."""
    if vector is None or not len(vector):
        return None
    try:
        values = np.asarray(vector, dtype=np.float64)
    except TypeError:  # a null entry
        return None
    if not np.isfinite(values).all():
        return None
    values = np.floor(SCALE * values)
    return values.astype(np.int64) if np.abs(values).max() < 2.0**62 else None


def _packed(x: np.ndarray) -> bytes:
    """One form per vector: the narrowest little-endian integers, after a byte that tells their width."""
    for width in (1, 2, 4, 8):
        if width == 8 or (x >= -(1 << (8 * width - 1))).all() and (x < 1 << (8 * width - 1)).all():
            return bytes([width]) + x.astype(f"<i{width}").tobytes()
    raise AssertionError


def _unpacked(cells: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(c, f"<i{c[0]}", offset=1).astype(np.int64) for c in cells])


def distinct_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """(packed, width): every distinct scaled vector once, and its number of entries."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_packed(x), len(x)) for x in map(_scaled, batch.column(0).to_pylist()) if x is not None]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int32())], ["packed", "width"])

    packed = rows.select(F.col(vector).alias("v")).mapInArrow(pack, "packed binary, width int")
    return packed.distinct()


def _blocks(fit: DataFrame, width: int) -> DataFrame:
    """(rows, data): blocks of vectors as one matrix of long integers each."""
    most = max(1, BLOCK_BYTES // (8 * width))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def block() -> pa.RecordBatch:
            data = _unpacked(held)
            small = next((t for t in ("<i2", "<i4") if np.iinfo(t).min <= data.min() and data.max() <= np.iinfo(t).max), "<i8")
            return pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int32()), pa.array([small]), pa.array([data.astype(small).tobytes()], pa.binary())], ["rows", "kind", "data"])

        for batch in batches:
            for cell in batch.column(0).to_pylist():
                held.append(cell)
                if len(held) == most:
                    yield block()
                    held = []
        if held:
            yield block()

    return pinned(fit.where(F.col("width") == width).select("packed").mapInArrow(gather, "rows int, kind string, data binary"))


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for kind, cell in zip(batch.column("kind").to_pylist(), batch.column("data")):
            yield np.frombuffer(cell.as_buffer(), kind).reshape(-1, width)


def _summed(blocks: DataFrame, width: int, size: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``part`` (matrix -> ``size`` numbers): a row per position, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for m in _matrices(batches, width):
            total += part(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "value"])

    rows = blocks.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r["at"]] = r["value"]
    return out


def _column_sums(blocks: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for m in _matrices(batches, width):
            n += len(m)
            m = m.astype(np.int64)
            low += (m & 0xFFFFFFFF).sum(axis=0)  # halves, so that no sum of 64-bit entries overflows
            high += (m >> 32).sum(axis=0)
        at = np.arange(-1, width, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([[n], low])), pa.array(np.concatenate([[0], high]))], ["at", "low", "high"])

    rows = blocks.mapInArrow(run, "at int, low long, high long").groupBy("at").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")]).collect()
    sums = {r["at"]: int(r["low"]) + (int(r["high"]) << 32) for r in rows}
    return sums.get(-1, 0), [sums.get(i, 0) for i in range(width)]


@dataclass(frozen=True)
class Whitening:
    """What the fit found.  ``sums`` are of x, as the mean in use; ``vectors`` has a column per component."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float
    steps: int


def bidiagonalise(product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, tolerance: float = 1e-13, seed: int = 12) -> tuple[np.ndarray, np.ndarray, int]:
    """Leading singular values (squared) and right vectors of X, of which ``product`` gives z = X'(X w).

    Returns (squares, vectors, steps); directions without variance are left out.
    """
    rng = np.random.default_rng(seed)
    v_all, w_all, z_all = (np.zeros((width, 0)) for _ in range(3))
    alphas: list[float] = []
    betas: list[float] = []  # betas[k] ties the left vector k to the right vector k + 1

    def fresh() -> np.ndarray | None:
        """A direction orthogonal to V, or None when V spans everything."""
        for _ in range(3 if v_all.shape[1] < width else 0):
            v = rng.standard_normal(width)
            for _ in range(3):
                v -= v_all @ (v_all.T @ v)
            if np.linalg.norm(v) > 1e-8:
                return v / np.linalg.norm(v)
        return None

    v, renewed = fresh(), True
    while v is not None:
        k = v_all.shape[1]
        v_all = np.column_stack([v_all, v])
        w = v - betas[k - 1] * w_all[:, k - 1] if k else v.copy()
        z = product(w)
        for _ in range(2):
            c = w_all.T @ z
            w, z = w - w_all @ c, z - z_all @ c
        square = float(w @ z)
        scale = max(alphas, default=0.0)
        alpha = np.sqrt(square) if square > 0 else 0.0
        if alpha <= 1e-10 * scale or alpha == 0.0:  # X v lies in the span of U: this direction adds no left vector
            alpha, w, z = 0.0, np.zeros(width), np.zeros(width)
            if renewed:  # a random direction beside V without variance: there is none left
                alphas.append(0.0)
                betas.append(0.0)
                break
        else:
            w, z = w / alpha, z / alpha
        alphas.append(alpha)
        w_all, z_all = np.column_stack([w_all, w]), np.column_stack([z_all, z])
        rest = z - alpha * v
        for _ in range(2):
            rest = rest - v_all @ (v_all.T @ rest)
        beta = float(np.linalg.norm(rest))
        top = max(max(alphas), max(betas, default=0.0))
        exhausted = beta <= 1e-12 * top
        betas.append(0.0 if exhausted else beta)
        b = np.diag(alphas) + np.diag(betas[:-1], 1)
        left, sigma, _ = np.linalg.svd(b)
        if not exhausted and k + 1 > wanted:
            # A Ritz triplet's residual is the last entry of its left vector times beta.
            if (beta * np.abs(left[-1, :wanted]) <= tolerance * sigma[0]).all():
                break
        v, renewed = (fresh(), True) if exhausted else (rest / beta, False)
    if not alphas or max(alphas) == 0.0:
        return np.zeros(0), np.zeros((width, 0)), len(alphas)
    b = np.diag(alphas) + np.diag(betas[:-1], 1)
    _, sigma, right = np.linalg.svd(b)
    keep = [i for i in range(min(wanted, len(sigma))) if sigma[i] > 1e-10 * sigma[0]]
    return sigma[keep] ** 2, v_all @ right.T[:, keep], len(alphas)


def fit(embeddings: DataFrame, vector: str = "embedding", components: int = 16) -> Whitening | None:
    """Components of the distinct scaled vectors; None for a table without a usable vector."""
    distinct = pinned(distinct_vectors(embeddings, vector))
    usual = distinct.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    if usual is None:
        return None
    width = usual["width"]
    blocks = _blocks(distinct, width)
    n, sums = _column_sums(blocks, width)
    base = np.array([s // n for s in sums], np.int64)  # whole part and rest of the mean apart: no digits are lost
    rest = np.array([s % n / n for s in sums])

    def centred(m: np.ndarray) -> np.ndarray:
        return (m.astype(np.int64) - base) - rest

    def product(w: np.ndarray) -> np.ndarray:
        def part(m: np.ndarray) -> np.ndarray:
            c = centred(m)
            return c.T @ (c @ w)

        return _summed(blocks, width, width, part)

    trace = float(_summed(blocks, width, 1, lambda m: np.array([(centred(m) ** 2).sum()]))[0]) / n
    squares, vectors, steps = bidiagonalise(product, width, min(components, width))
    k = len(squares)
    values = squares / n
    if not k:
        return Whitening(n, sums, trace, values, vectors, 0.0, steps)
    unit = vectors / np.sqrt(values)

    def products(m: np.ndarray) -> np.ndarray:
        y = centred(m) @ unit
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    found = _summed(blocks, width, k * k + k, products) / n
    covariance = found[: k * k].reshape(k, k) - np.outer(found[k * k :], found[k * k :])
    return Whitening(n, sums, trace, values, vectors, float(np.abs(covariance - np.eye(k)).max()), steps)


def transform(embeddings: DataFrame, model: Whitening | None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component."""
    kind = embeddings.schema[vec_id].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = embeddings.select(F.col(vec_id).alias("i"), F.col(vector).alias("v"))
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, width, k = model.n, model.sums, len(model.sums), len(model.values)
    base, rest = np.array([s // n for s in sums], np.int64), np.array([s % n / n for s in sums])
    unit, explained = model.vectors / np.sqrt(model.values), model.values / model.trace
    error = model.identity_error

    def deviations(x: np.ndarray) -> list[int | None]:
        d, left = x - base, np.array([s % n for s in sums], np.int64)  # n * x - S, with S = n * base + left
        about = ((n * d.astype(float) - left) ** 2).sum(axis=1)
        small = about < 2.0**62
        whole = n * d[small] - left
        out: list[int | None] = [None] * len(x)
        for i, e in zip(np.flatnonzero(small), (whole * whole).sum(axis=1).tolist()):
            out[i] = e
        for i in np.flatnonzero(~small & (about < 2.0**64)):
            exact = sum((n * int(c) - int(r)) ** 2 for c, r in zip(d[i], left))
            out[i] = exact if exact < 2**63 else None
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                scaled = [_scaled(v) for v in piece.column(1).to_pylist()]
                keep = [i for i, x in enumerate(scaled) if x is not None and len(x) == width]
                if not keep:
                    continue
                x = np.stack([scaled[i] for i in keep])
                y = ((x - base) - rest) @ unit
                ids = piece.column(0).take(pa.array(keep)).take(pa.array(np.repeat(np.arange(len(keep)), k)))
                m = len(keep)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n, np.int64)),
                        pa.array([d for d in deviations(x) for _ in range(k)], pa.int64()),
                        pa.array(y.ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, schema)


def whitened(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    return transform(embeddings, fit(embeddings, vector, components), vec_id, vector)
