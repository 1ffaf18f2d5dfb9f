"""Whitening of embeddings by principal components from exact integer covariances, summed as bit-sliced scatter.

Entries become whole numbers. Each task shifts every dimension by its batch's least value, packs each bit of the shifted
values across rows into 64-bit words, and takes cross-products as weighted counts of the bits that two planes share. The
sums are whole numbers of any size, split into limbs so that Spark adds them as longs; they are centred as whole numbers
on the driver, which holds one matrix of the dimensions, before its eigenvectors are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: x = floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Scaled entries beyond this size count as this.
LIMIT = 2.0 ** 62
COMPONENTS = 32
#: Rows whose planes are packed at once: 128 words of each plane.
BLOCK = 8192
LIMB, LIMBS = 40, 5


def whole(values: np.ndarray) -> np.ndarray:
    """The whole numbers of finite doubles."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * SCALE), -LIMIT, LIMIT).astype(np.int64) + OFFSET


def scatter(x: np.ndarray) -> np.ndarray:
    """Exact sums of products of all columns of whole numbers `x`, ones first, as Python integers: (1 + d, 1 + d).

    Entry (0, 0) is the number of rows and (0, j) the sum of column j.
    """
    n, d = x.shape
    least = x.min(axis=0)
    shifted = (x - least).view(np.uint64)        # below 2 ** 64 also where the difference passes a long
    widths = [int(v).bit_length() for v in shifted.max(axis=0)]
    words = -(-n // 64)
    padded = np.zeros((d, words * 64), np.uint64)
    padded[:, :n] = shifted.T
    planes, bits, dims = [_packed(np.arange(words * 64) < n)], [0], [0]
    for j, width in enumerate(widths):
        for b in range(width):
            planes.append(_packed((padded[j] >> np.uint64(b)) & np.uint64(1)))
            bits.append(b)
            dims.append(j + 1)
    planes, bits, dims = np.stack(planes), np.array(bits), np.array(dims)
    wide = 2 * bits.max() + n.bit_length() + 7 >= 62   # weighted sums may pass a long
    weights = np.array([1 << int(b) for b in bits], object if wide else np.int64)
    starts = np.flatnonzero(np.diff(dims, prepend=-1))
    out = np.zeros((1 + d, 1 + d), object)
    for p in range(len(planes)):
        shared = np.bitwise_count(planes[p] & planes).sum(axis=1, dtype=np.int64)
        if wide:
            shared = shared.astype(object)
        out[dims[p], dims[starts]] += (np.add.reduceat(shared * weights, starts) * weights[p]).astype(object)
    # undo the shift: sum (u + m)(v + k) = sum uv + m sum v + k sum u + n m k; ones have no shift
    m = np.array([0, *map(int, least)], object)
    return out + np.outer(m, out[0]) + np.outer(out[0], m) + n * np.outer(m, m)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def limbs(value: int) -> list[int]:
    """`value` in base 2 ** LIMB, least part first; only the last part can be negative."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


@dataclass(frozen=True)
class Whitening:
    """Exact moments of the fitted vectors and what follows from them."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray      # (kept, d), unit rows by falling eigenvalue
    eigenvalues: np.ndarray     # (kept,)
    explained: np.ndarray       # (kept,) shares of the trace
    scales: np.ndarray          # (kept,) 1 / sqrt(eigenvalue); NaN where a component has no spread


def usable(column: str = "embedding") -> Column:
    """Whether a vector is there, has entries, and all of them are numbers."""
    return F.expr(f"{column} IS NOT NULL AND size({column}) > 0 AND forall({column}, e -> e IS NOT NULL AND NOT isnan(e) "
                  f"AND abs(CAST(e AS DOUBLE)) < double('Infinity'))")


def fit_list(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """The rows that are fitted and whitened: usable vectors of the most frequent length (of the longest in a tie)."""
    rows = embeddings.where(usable(column))
    common = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size(column) == (common.d if common else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Moments of all rows of `fit_list` and their leading components; None without rows.

    The driver gets one row for each pair of dimensions.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                total = total + scatter(whole(_matrix(batch.column(0).slice(at, BLOCK))))
        if isinstance(total, np.ndarray):
            i, j = np.triu_indices(len(total))
            parts = [limbs(v) for v in total[i, j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(p, pa.int64()) for p in zip(*parts, strict=True)]],
                ["i", "j", *[f"l{k}" for k in range(LIMBS)]])

    parts = rows.select(column).mapInArrow(run, "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS)))
    cells = parts.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()
    if not cells:
        return None
    d = max(c.j for c in cells)
    sums = np.zeros((1 + d, 1 + d), object)
    for c in cells:
        sums[c.i, c.j] = sums[c.j, c.i] = sum(c[f"l{k}"] << (LIMB * k) for k in range(LIMBS))
    return from_sums(sums, components)


def from_sums(sums: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """Components from exact sums of products: centred as whole numbers, then divided once."""
    n, d = sums[0, 0], len(sums) - 1
    centred = n * sums[1:, 1:] - np.outer(sums[0, 1:], sums[0, 1:])
    cov = np.array([v / (n * n) for v in centred.ravel()], float).reshape(d, d)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = np.maximum(values[order], 0.0), vectors[:, order].T
    trace = sum(centred[i, i] for i in range(d)) / (n * n)
    spread = values > d * np.finfo(float).eps * max(values[0], 0.0)
    scales = np.full(len(values), np.nan)
    scales[spread] = 1 / np.sqrt(values[spread])
    return Whitening(n, tuple(sums[0, 1:]), np.ascontiguousarray(vectors), values, values / trace if trace else np.full(len(values), np.nan), scales)


def whitened_values(fitted: Whitening, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, kept) whitened values, and each row's exact sum of (n x - S) squared as Python integers or longs."""
    top = max(abs(fitted.n * int(v) - s) for m in (x.min(axis=0), x.max(axis=0)) for v, s in zip(m, fitted.sums, strict=True))
    if top * top * x.shape[1] < 2 ** 63 and fitted.n * max(abs(int(x.min())), abs(int(x.max()))) < 2 ** 63:
        off = x * np.int64(fitted.n) - np.array(fitted.sums, np.int64)
    else:
        off = x.astype(object) * fitted.n - np.array(fitted.sums, object)
    deviation = (off * off).sum(axis=1)
    centred = (off / fitted.n).astype(float)
    return (centred @ fitted.components.T) * fitted.scales, deviation


def transform(rows: DataFrame, fitted: Whitening | None, column: str = "embedding") -> DataFrame:
    """Rows of `fit_list` with `deviation` (null where it passes a long) and `whitened`, an array by component.

    A component without spread has null values. Columns of these names are replaced; all others stay.
    """
    rows = rows.drop(*[c for c in rows.columns if c.lower() in ("deviation", "whitened")])
    if fitted is None:
        return rows.selectExpr("*", "CAST(NULL AS BIGINT) AS deviation", "CAST(NULL AS ARRAY<DOUBLE>) AS whitened")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values, deviation = whitened_values(fitted, whole(_matrix(part.column(column))))
                flat = pa.array(values.ravel(), pa.float64(), mask=np.isnan(values.ravel()))
                ends = pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32())
                long = [v if v < 2 ** 63 else None for v in deviation.tolist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(long, pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                                                 [*part.schema.names, "deviation", "whitened"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, deviation long, whitened array<double>")


def identity_error(rows: DataFrame, fitted: Whitening | None, column: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened values' own covariance less the identity, over the components with spread.

    Measured on the values themselves: each task sums products of its rows, and Spark adds the tasks' matrices.
    """
    if fitted is None or np.isnan(fitted.scales).all():
        return None
    kept = int((~np.isnan(fitted.scales)).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums = np.zeros((kept, kept)), np.zeros(kept)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                values, _ = whitened_values(fitted, whole(_matrix(batch.column(0).slice(at, BLOCK))))
                values = values[:, ~np.isnan(fitted.scales)]
                products += values.T @ values
                sums += values.sum(axis=0)
        i, j = np.triu_indices(kept)
        cells = np.concatenate([products[i, j], sums])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([i, np.full(kept, -1)]), pa.int32()),
                                          pa.array(np.concatenate([j, np.arange(kept)]), pa.int32()), pa.array(cells)], ["i", "j", "v"])

    got = {(r.i, r.j): r.v for r in rows.select(column).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    mean = [got[-1, j] / fitted.n for j in range(kept)]
    return max(abs(got[i, j] / fitted.n - mean[i] * mean[j] - (i == j)) for i in range(kept) for j in range(i, kept))


def whiten(embeddings: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component from 1, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty, hold null or non-finite entries, or have another length than most are left out; each
    repeated row has its own rows; a null vec_id stays null. explained and identity_error are null if no vector differs.
    An empty table gives no rows.
    """
    rows = fit_list(embeddings.select("vec_id", column), column)
    fitted = fit(rows, column, components)
    error = identity_error(rows, fitted, column)
    shares = [] if fitted is None else [None if np.isnan(e) else float(e) for e in fitted.explained]
    given = F.array(*[F.lit(e).cast("double") for e in shares]) if shares else F.expr("CAST(NULL AS ARRAY<DOUBLE>)")
    return transform(rows, fitted, column).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n if fitted else 0).cast("long").alias("n"),
        "deviation", "whitened", F.get(given, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
