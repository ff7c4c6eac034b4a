"""Embedding whitening by a singular value decomposition of all rows.

Vectors become whole numbers, whose sums are exact. Each task compresses its centred rows, block by block, to a triangle R with
the same covariance (blockwise TSQR); triangles are combined in a tree of bounded fan-in. On the last R plane rotations make the columns
orthogonal (one-sided Jacobi): their lengths are the standard deviations, accurate for small ones too, as no covariance
matrix is formed, and the accumulated rotations are the components. Rows are projected in one more pass, and the covariance
of what comes out is measured over all rows. The driver sees sums, components and that covariance, whose sizes depend on the dimensions alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Fixed values of the whole numbers, and the components that are returned.
SCALE, ADDED, COMPONENTS = 64, 1_000_000, 32
#: Rows that a task takes at once, and bytes of triangles that one task of the tree combines.
ROWS, TREE_BYTES = 4096, 32 << 20
LONG = 1 << 63


def whole(c: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 as 64-bit integers; results beyond a long are the nearest long."""
    top = float(np.abs(c).max(initial=0))
    if top < 1 << 46:
        return np.floor(c * SCALE).astype("i8") + ADDED
    return np.array([[max(-LONG, min(LONG - 1, math.floor(max(-2.0**57, min(2.0**57, x)) * SCALE) + ADDED)) for x in row] for row in c.tolist()], "i8").reshape(c.shape)


def moved(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: 64-bit integers where they hold it, else Python's."""
    most = max([int(np.abs(x.astype("f8")).max(initial=0)) + 1, *(abs(s) // max(n, 1) + 1 for s in sums)])
    if 2 * n * most < LONG // 2:
        return n * x - np.array(sums, "i8")
    return x.astype(object) * n - np.array([int(s) for s in sums], object)


def by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, places of the rows, their whole numbers) of a batch's vectors, in its last column, up to ROWS at once."""
    col = batch.column(batch.num_columns - 1)
    if not len(col):
        return
    offsets, values = col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        every = np.flatnonzero(sizes == dim)
        for lo in range(0, len(every), ROWS):
            at = every[lo : lo + ROWS]
            yield int(dim), at, whole(values[offsets[at][:, None] + np.arange(dim)].astype("f8").reshape(len(at), dim))


def triangle(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a, mode="r")


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (as columns) and singular values of r, by falling value. In each round of a sweep disjoint pairs of columns
    are rotated at once until they are orthogonal to working precision."""
    d = r.shape[1]
    n = d + d % 2
    a = np.zeros((n, r.shape[0] + d))  # a row for each column: what is rotated, then the rotations so far
    a[:d, : r.shape[0]] = r.T
    a[:d, r.shape[0] :] = np.eye(d)
    m, eps = r.shape[0], np.finfo(float).eps
    floor = (eps * float(np.linalg.norm(r))) ** 2
    seats = np.arange(n)
    for _ in range(sweeps):
        turned = False
        for _ in range(n - 1):
            i, j = seats[: n // 2], seats[: n // 2 - 1 : -1]
            x, y = a[i], a[j]
            xx, yy, xy = (x[:, :m] ** 2).sum(1), (y[:, :m] ** 2).sum(1), (x[:, :m] * y[:, :m]).sum(1)
            go = (np.abs(xy) > eps * np.sqrt(xx * yy)) & (np.minimum(xx, yy) > floor * eps)
            if go.any():
                turned = True
                z = (yy[go] - xx[go]) / (2 * xy[go])
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.sqrt(1 + z * z))
                c = 1 / np.sqrt(1 + t * t)
                s = c * t
                a[i[go]] = c[:, None] * x[go] - s[:, None] * y[go]
                a[j[go]] = s[:, None] * x[go] + c[:, None] * y[go]
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
        if not turned:
            break
    values = np.sqrt((a[:d, :m] ** 2).sum(1))
    v = a[:d, m:]
    v = v / np.linalg.norm(v, axis=1, keepdims=True)
    order = np.argsort(-values, kind="stable")
    return v[order].T, values[order]


def tree(df: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray], dim: int) -> DataFrame:
    """Rows (dim, part, data) merged to one row a dim, in groups of bounded bytes."""
    fan = max(2, min(32, TREE_BYTES // (8 * max(1, dim) ** 2)))

    def run(key, t):
        made = merge([np.frombuffer(x, "<f8") for x in t["data"].to_pylist()], key[0].as_py())
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "data": pa.array([made.astype("<f8").tobytes()], pa.binary())})

    df, at = materialize(df, "whitening")
    n = df.count()
    while True:
        n = -(-n // fan)
        df, before = df.withColumn("part", F.pmod(F.col("part"), F.lit(max(1, n)))).groupBy("dim", "part").applyInArrow(run, STATE), at
        df, at = materialize(df, "whitening")
        discard(df.sparkSession, before)
        if n <= 1:
            return df


STATE = "dim int, part long, data binary"


def per_task(df: DataFrame, start: Callable, add: Callable, end: Callable) -> DataFrame:
    """(dim, part, data): what each task gathers of the vectors of each number of dimensions. Parts are numbered within each task's place, so
    that few tasks give few parts."""

    def run(batches):
        part, held = TaskContext.get().partitionId(), {}
        for b in batches:
            for dim, _, x in by_dimension(b):
                if dim:
                    held[dim] = add(held[dim] if dim in held else start(dim), dim, x)
        for dim, got in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part], pa.int64()), pa.array([end(got, dim).astype("<f8").tobytes()], pa.binary())], names=["dim", "part", "data"])

    return df.mapInArrow(run, STATE)


def fit(rows: DataFrame, components: int = COMPONENTS) -> dict[int, dict]:
    """For each number of dimensions that vectors (the last column of rows) have: n, sums, components (a column each), deviations (the square
    roots of their eigenvalues), total (the trace) and identity_error."""

    def sums(batches):
        held: dict[int, list] = {}
        for b in batches:
            for dim, at, x in by_dimension(b):
                got = held.setdefault(dim, [0, [0] * dim])
                add = x.sum(0) if np.abs(x.astype("f8")).max(initial=0) < 1 << 50 else x.astype(object).sum(0)
                got[0] += len(at)
                got[1] = [a + int(c) for a, c in zip(got[1], add, strict=True)]
        for dim, (n, total) in held.items():
            if dim:
                yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0)), pa.array([n] * dim, pa.int64())], names=["dim", "place", "total", "n"])

    found: dict[int, dict] = {}
    for r in rows.mapInArrow(sums, "dim int, place int, total decimal(38,0), n long").groupBy("dim", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("dim", "place").collect():
        got = found.setdefault(r["dim"], {"n": r["n"], "sums": []})
        got["sums"].append(int(r["total"]))
    if not found:
        return {}
    largest = max(found)

    def centred(x, dim):
        return moved(x, found[dim]["n"], found[dim]["sums"]).astype("f8") / found[dim]["n"]

    triangles = per_task(rows, lambda d: np.zeros((0, d)), lambda r, d, x: triangle(np.concatenate([r, centred(x, d)])), lambda r, d: r)
    merged = tree(triangles, lambda parts, d: triangle(np.concatenate([p.reshape(-1, d) for p in parts])), largest)

    def rotate(batches):
        for b in batches:
            for r in b.to_pylist():
                v, s = jacobi(np.frombuffer(r["data"], "<f8").reshape(-1, r["dim"]))
                yield pa.RecordBatch.from_arrays([pa.array([r["dim"]], pa.int32()), pa.array([np.ascontiguousarray(v[:, :components]).astype("<f8").tobytes()], pa.binary()), pa.array([s.astype("<f8").tobytes()], pa.binary())], names=["dim", "v", "s"])

    for r in merged.mapInArrow(rotate, "dim int, v binary, s binary").collect():
        got, d = found[r["dim"]], r["dim"]
        s = np.frombuffer(r["s"], "<f8") / math.sqrt(got["n"])
        v = np.frombuffer(r["v"], "<f8").reshape(d, -1)
        alive = s > s[0] * d * np.finfo(float).eps
        got |= {"components": v, "deviations": np.where(alive, s, 0.0)[: v.shape[1]], "total": float((s * s).sum())}

    def moments(state, dim, x):
        w = project(moved(x, found[dim]["n"], found[dim]["sums"]), found[dim])
        w = np.concatenate([np.where(np.isnan(w), 0.0, w), np.ones((len(w), 1))], 1)
        return state + w.T @ w

    def size(dim):
        return found[dim]["components"].shape[1] + 1

    for r in tree(per_task(rows, lambda d: np.zeros((size(d), size(d))), moments, lambda m, d: m), lambda parts, d: np.sum(parts, 0), components + 1).collect():
        got, k = found[r["dim"]], size(r["dim"]) - 1
        m = np.frombuffer(r["data"], "<f8").reshape(k + 1, k + 1)
        mean = m[:k, k] / m[k, k]
        alive = got["deviations"] > 0
        error = np.abs(m[:k, :k] / m[k, k] - np.outer(mean, mean) - np.eye(k))[np.ix_(alive, alive)]
        got["identity_error"] = float(error.max(initial=0))
    return found


def project(d: np.ndarray, model: dict) -> np.ndarray:
    """Whitened rows of d = n x - S; not a number for components without deviation."""
    z = d.astype("f8") / model["n"]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model["deviations"] > 0, z @ model["components"] / model["deviations"], np.nan)


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: for each row of (key, vector) and each of the first
    `components` components.

    Rows whose vector is null or holds null or non-finite entries take no part. Vectors of different numbers of entries are fitted each with
    their like, so n, components and identity_error are theirs; empty vectors have no component. A null key stays null, and rows that
    repeat count and return each. A component without variance (all rows alike, or fewer rows than dimensions) has explained 0 and a null
    whitened value. A deviation beyond a long is null. Whole numbers beyond a long are the nearest long. An empty table gives an empty
    result. Other columns are ignored."""
    v = F.col(vector).cast("array<double>")
    fits = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = df.filter(fits).select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    found = fit(rows, components)

    def run(batches):
        for b in batches:
            for dim, at, x in by_dimension(b):
                if not dim:
                    continue
                m = found[dim]
                d, k = moved(x, m["n"], m["sums"]), m["components"].shape[1]
                w = project(d, m)
                if d.dtype != object and float(np.abs(d.astype("f8")).max(initial=0)) ** 2 * dim < LONG // 4:
                    far = pa.array((d * d).sum(1))
                else:
                    far = pa.array([y if y < LONG else None for y in (sum(c * c for c in row) for row in d.astype(object).tolist())], pa.int64())
                rows_, again = len(at), np.repeat(np.arange(len(at)), k)
                explained = m["deviations"] ** 2 / m["total"] if m["total"] > 0 else np.zeros(k)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at[again])), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), rows_)), pa.array(np.full(rows_ * k, m["n"])), far.take(pa.array(again)), pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(explained, rows_)), pa.array(np.full(rows_ * k, m["identity_error"]))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
