"""Cross-validation of label intervals (pos, t0, t1; t0 ascending) as assignment tables (fold, pos, role): contiguous folds
with purging and an embargo, all combinations of groups, and walking forward. Rows that are in neither part are left out."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions that are looked at together.
BUCKET = 4096


def interval_problems(labels: DataFrame) -> DataFrame:
    """One row: how many intervals there are, how many end before they start, and how many starts go back."""
    bucket = F.floor(F.col("pos") / BUCKET)
    rows = labels.select("pos", "t0", (F.col("t1") < F.col("t0")).alias("ends"), bucket.alias("bucket"))
    rows = rows.withColumn("back", F.coalesce(F.lag("t0").over(Window.partitionBy("bucket").orderBy("pos")) > F.col("t0"), F.lit(False)))
    each = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("ends").alias("ends"), F.count_if("back").alias("back"), F.min_by("t0", "pos").alias("first"), F.max_by("t0", "pos").alias("last"))
    over = F.coalesce(F.lag("last").over(Window.orderBy("bucket")) > F.col("first"), F.lit(False)).cast("long")  # a row a bucket
    return each.withColumn("over", over).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("ends"), F.lit(0)).alias("ends"), F.coalesce(F.sum(F.col("back") + F.col("over")), F.lit(0)).alias("back"))


def validate_intervals(labels: DataFrame) -> DataFrame:
    """labels, after a look: none, an end before its start, or starts that go back are ValueErrors. One aggregation."""
    n, ends, back = interval_problems(labels).first()
    if not n:
        raise ValueError("there are no label intervals")
    if ends:
        raise ValueError("an interval ends before it starts")
    if back:
        raise ValueError("intervals aren't in the order of their starts")
    return labels


def groups(labels: DataFrame, n: int, k: int, first: int = 0) -> DataFrame:
    """grp: k contiguous groups of the n rows from pos `first` on, the larger ones first. pos is dense, so no row is sorted."""
    size, more = n // k, n % k
    at, edge = F.col("pos") - first, more * (size + 1)
    return labels.withColumn("grp", F.when(at < edge, F.floor(at / (size + 1))).otherwise(more + F.floor((at - edge) / max(1, size))).cast("int"))


def _blocks(cut: DataFrame) -> list:
    """Of each group (a few rows) the first and last pos and the envelope of its intervals."""
    return cut.groupBy("grp").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min("t0").alias("b0"), F.max("t1").alias("b1")).orderBy("grp").collect()


def _roles(rows: DataFrame, roles: list[Column]) -> DataFrame:
    """(fold, pos, role) from the role of a row in each fold, null for none: no join and no shuffle."""
    each = F.array(*(F.when(r.isNotNull(), F.struct(F.lit(k).alias("fold"), "pos", r.alias("role"))) for k, r in enumerate(roles)))
    return rows.select(F.explode(F.array_compact(each)).alias("r")).select("r.fold", "r.pos", "r.role")


def _assign(cut: DataFrame, tests: list[tuple[int, ...]], embargo: int) -> DataFrame:
    """tests: the groups tested in each fold. A row trains in a fold unless it is tested there, overlaps the envelope of a
    tested group (closed intervals), or is among the `embargo` rows after one. Bounds of groups are literals in the plan."""
    blocks = {r["grp"]: r for r in _blocks(cut)}
    roles = []
    for fold in tests:
        out = F.lit(False)
        for b in (blocks[g] for g in fold if g in blocks):
            out = out | (F.col("t0") <= F.lit(b["b1"])) & (F.col("t1") >= F.lit(b["b0"])) | (F.col("pos") > b["hi"]) & (F.col("pos") <= b["hi"] + embargo)
        roles.append(F.when(F.col("grp").isin(*fold), "test").when(~out, "train"))
    return _roles(cut, roles)


def purged_kfold(labels: DataFrame, n: int, k: int = 5, embargo: float = 0.0) -> DataFrame:
    """k folds of n rows; the embargo is the whole part of n times its share."""
    if k < 2 or k > n:
        raise ValueError(f"{k} folds of {n} rows")
    return _assign(groups(validate_intervals(labels), n, k), [(g,) for g in range(k)], int(n * embargo))


def combinatorial(labels: DataFrame, n: int, k: int = 6, tested: int = 2, embargo: float = 0.0) -> DataFrame:
    """Every choice of `tested` of k groups, in lexicographic order, is a fold."""
    if not 0 < tested < k:
        raise ValueError(f"{tested} of {k} groups")
    return _assign(groups(validate_intervals(labels), n, k), list(itertools.combinations(range(k), tested)), int(n * embargo))


def n_paths(k: int, tested: int) -> int:
    return tested * math.comb(k, tested) // k


def walk_forward(labels: DataFrame, n: int, k: int = 5, min_train: int | None = None, purge: bool = True) -> DataFrame:
    """k blocks after the first min_train rows (default: n / (k + 1)); each trains on all rows before it whose interval ends
    before the block's first start."""
    if not purge:
        raise ValueError("walking forward is always purged")
    first = n // (k + 1) if min_train is None else min_train
    if not 0 < first <= n - k:
        raise ValueError(f"{first} rows to train on of {n}")
    tail = groups(validate_intervals(labels).filter(F.col("pos") >= first), n - first, k, first)
    role = lambda b: F.when(F.col("pos").between(b["lo"], b["hi"]), "test").when((F.col("pos") < b["lo"]) & (F.col("t1") < F.lit(b["b0"])), "train")
    return _roles(labels, [role(b) for b in _blocks(tail)])


def scheme(kind: str, **settings) -> str:
    """The name of a scheme, settings sorted."""
    return f"{kind}({', '.join(f'{k}={v}' for k, v in sorted(settings.items()))})"
