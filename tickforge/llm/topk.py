"""Exact top-k by integer inner product with a pivot table.

Vectors get one more component that brings all to the norm of the longest, so that a larger inner product with a query
is a smaller Euclidean distance. Distances from every row to many pivots are computed once. For a query, the pivots give
each row a lower bound of its distance (the largest |d(q,p) - d(x,p)|), hence an upper bound of its inner product; rows
are evaluated in the order of that bound until no bound left can reach the k-th best score. Rows and queries meet in
blocks of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Rows of a block of candidates, queries of a block, pivots, and rows evaluated between two looks at the bounds.
ROWS, QUERIES, PIVOTS, STEP = 8192, 8192, 48, 64
#: Doubles hold whole numbers up to this exactly; blocks whose sums could pass it are evaluated in whole numbers of any size.
EXACT = float(1 << 53)

PACKED = "dim int, part long, ids binary, uids binary, vectors binary, large boolean, n int, pivots binary, distances binary, longest double"


def _pack(rows: int, scale: float, pivots: int):
    def run(batches):
        pool: dict[int, list] = {}
        made: dict[int, int] = {}

        def flush(dim):
            got = pool.pop(dim)
            v = np.array([g[2] for g in got], "f8").reshape(len(got), dim)
            large = bool(v.size) and not (np.abs(v).max(initial=0) * scale) ** 2 * max(1, dim) < EXACT / 4
            x = v if large else np.floor(v * scale)
            part = made[dim] = made.get(dim, (TaskContext.get().partitionId() << 32) - 1) + 1
            p, table, longest = pivot_table(x, pivots) if pivots and not large else (np.empty(0), np.empty(0), 0.0)
            return pa.RecordBatch.from_pylist([{"dim": dim, "part": part, "pivots": p.tobytes(), "distances": table.tobytes(), "longest": longest, "ids": np.array([g[0] for g in got], "<i8").tobytes(), "uids": np.array([g[1] for g in got], "<i8").tobytes(), "vectors": x.astype("<f8").tobytes(), "large": large, "n": len(got)}], schema=schema)

        for b in batches:
            for one, uid, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                pool.setdefault(len(v), []).append((one, uid, v))
                if len(pool[len(v)]) == rows:
                    yield flush(len(v))
        for dim in list(pool):
            yield flush(dim)

    schema = pa.schema([("dim", pa.int32()), ("part", pa.int64()), ("ids", pa.binary()), ("uids", pa.binary()), ("vectors", pa.binary()), ("large", pa.bool_()), ("n", pa.int32()), ("pivots", pa.binary()), ("distances", pa.binary()), ("longest", pa.float64())])
    return run


def pivot_table(x: np.ndarray, pivots: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Pivots of a block (some of its rows, spread over its norms), the distance of every row to each (a row a pivot), and
    the square of the norm that all rows are lifted to."""
    norms = (x * x).sum(1)
    longest = float(norms.max(initial=0))
    lift = np.sqrt(np.maximum(0.0, longest - norms))
    at = np.argsort(norms, kind="stable")[np.unique(np.linspace(0, len(x) - 1, min(pivots, len(x))).astype(int))]
    p = x[at]
    return p, np.ascontiguousarray(np.sqrt(np.maximum(0.0, 2 * longest - 2 * (x @ p.T + np.outer(lift, lift[at])))).T), longest


def search_block(ids, uids, x, large, p, xp, top, quids, q, qlarge, k: int, step: int, scale: float, counts: list | None = None):
    """The k best rows of a block for each query: lists of (query place, row place, score). p, xp, top: its pivot table."""
    out = []
    if large or qlarge:  # beyond exact doubles: whole numbers of any size
        whole = lambda a, is_large: [[int(np.floor(c)) for c in (r * scale if is_large else r)] for r in a]
        xs, qs = whole(x, large), whole(q, qlarge)
        clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        for i, a in enumerate(qs):
            got = sorted((-clip(sum(c * d for c, d in zip(a, b, strict=True))), ids[j], j) for j, b in enumerate(xs) if uids[j] != quids[i])
            out += [(i, j, -s) for s, _, j in got[:k]]
        return out
    qnorms = (q * q).sum(1)
    qp = np.sqrt(np.maximum(0.0, qnorms[:, None] + top - 2 * (q @ p.T)))
    slack = 1e-6 * (1 + np.sqrt(top) + np.sqrt(qnorms))
    for i in range(len(q)):
        low = np.zeros(len(x))
        for a, b in zip(xp, qp[i], strict=True):
            np.maximum(low, np.abs(a - b), out=low)
        low = np.maximum(0.0, low - slack[i])
        bound = (qnorms[i] + top - low * low) / 2 + slack[i] + 1
        left = np.flatnonzero(uids != quids[i])
        # The best bounds first; a chunk is sorted only when it is reached.
        best_s, best_id, best_j = np.empty(0), np.empty(0, "i8"), np.empty(0, "i8")
        size, seen = step, 0
        while len(left):
            if len(left) > size:
                cut = np.argpartition(-bound[left], size - 1)
                now, left = left[cut[:size]], left[cut[size:]]
            else:
                now, left = left, left[:0]
            seen += len(now)
            s = np.concatenate([best_s, x[now] @ q[i]])
            j = np.concatenate([best_j, now])
            one = np.concatenate([best_id, ids[now]])
            order = np.lexsort((one, -s))[:k]
            best_s, best_j, best_id = s[order], j[order], one[order]
            if len(best_s) == k and len(left):
                left = left[bound[left] >= best_s[-1]]
            size *= 2
        if counts is not None:
            counts.append(seen)
        out += [(i, int(j), int(s)) for s, j in zip(best_s, best_j, strict=True)]
    return out


def top_k(df: DataFrame, is_query, k: int = 5, vector: str = "embedding", key: str = "vec_id", scale: float = 256.0, rows: int = ROWS, queries: int = QUERIES, pivots: int = PIVOTS, step: int = STEP) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query (a condition on df) accepts, the k rows of the
    largest inner product of floor(scale * x), ties to the smaller id; fewer if there are fewer.

    Rows with a null key, a null vector, or a null or non-finite component take no part. A query's candidates are all
    other rows with as many components; a row that repeats a query's key is another row. Of repeated query rows each is
    answered, in rows of equal query_id. Scores beyond a long are clipped to it."""
    spark = df.sparkSession
    v = F.col(vector).cast("array<double>")
    fit = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.col(key).isNotNull()
    flat, flat_at = materialize(df.filter(fit).select(F.col(key).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    flat = flat.withColumn("uid", F.monotonically_increasing_id())
    base, base_at = materialize(flat.select("id", "uid", "v").mapInArrow(_pack(rows, scale, pivots), PACKED), "candidates")
    asked = flat.filter("asks").select("id", "uid", "v")
    ask, _ = materialize(asked.repartition(max(1, -(-asked.count() // queries))).mapInArrow(_pack(queries, scale, 0), PACKED), "queries")
    discard(spark, flat_at)
    # Every block of candidates goes to each block of queries of its number of components, by an equi-join on their place. Only
    # the blocks' names are numbered in order.
    numbers = ask.select("dim", F.col("part").alias("q_part")).withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy("q_part")))
    ask = ask.select("dim", *(F.col(c).alias(f"q_{c}") for c in ("part", "ids", "uids", "vectors", "large", "n"))).join(numbers, ["dim", "q_part"]).drop("q_part")
    places = {r["dim"]: r["n"] for r in numbers.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not places:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    times = F.create_map(*(F.lit(x) for kv in places.items() for x in kv))
    base = base.filter(F.col("dim").isin(list(places))).withColumn("place", F.explode(F.sequence(F.lit(1), times[F.col("dim")].cast("int"))))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                d = r["dim"]
                ids, uids, x = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["uids"], "<i8"), np.frombuffer(r["vectors"], "<f8").reshape(r["n"], d)
                qids, quids, q = np.frombuffer(r["q_ids"], "<i8"), np.frombuffer(r["q_uids"], "<i8"), np.frombuffer(r["q_vectors"], "<f8").reshape(r["q_n"], d)
                xp = np.frombuffer(r["distances"], "<f8").reshape(-1, r["n"])
                p = np.frombuffer(r["pivots"], "<f8").reshape(len(xp), d)
                got = np.array(search_block(ids, uids, x, r["large"], p, xp, r["longest"], quids, q, r["q_large"], k, step, scale), dtype=object).reshape(-1, 3)
                i, j = got[:, 0].astype("i8"), got[:, 1].astype("i8")
                yield pa.RecordBatch.from_arrays([pa.array(quids[i]), pa.array(qids[i]), pa.array(ids[j]), pa.array(uids[j]), pa.array(got[:, 2].tolist(), pa.int64())], names=["query_uid", "query_id", "vec_id", "uid", "score"])

    best = base.join(ask, ["dim", "place"]).mapInArrow(run, "query_uid long, query_id long, vec_id long, uid long, score long")
    w = Window.partitionBy("query_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
