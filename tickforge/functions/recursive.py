"""Exponentially weighted means without a row-by-row pass.

A linear recursion y = a x + (1-a) y_before is cut into blocks of positions. Inside a block the sum is a running window
sum over rescaled terms; between blocks only one number is carried, folded over the few blocks before whose weight is not
negligible. So a symbol's history is computed by blocks in parallel, with window functions alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
#: Carried weights below this are left out.
NEGLIGIBLE = 1e-18


def ewm(df: DataFrame, columns: dict[str, tuple[str, float, int]], keys: tuple[str, ...] = ("symbol",), pos: str = "pos") -> DataFrame:
    """df with a column for each of columns: name -> (input column, a, first position). The mean starts with its input at the
    first position (pos counts from 0 by keys) and is null before. Inputs from there on must not be null."""
    block = f"{pos}_block"
    df = df.withColumn(block, F.floor(F.col(pos) / BLOCK))
    inside = Window.partitionBy(*keys, block).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    at = F.col(pos) % BLOCK
    terms = {}
    for name, (x, a, first) in columns.items():
        if not 0 < a < 0.9999:
            raise ValueError(f"{name}: a is {a}")
        term = F.when(F.col(pos) == first, F.col(x)).when(F.col(pos) > first, F.lit(a) * F.col(x)).otherwise(F.lit(0.0))
        terms[name] = F.pow(F.lit(1 - a), at) * F.sum(term * F.pow(F.lit(1 - a), -at)).over(inside)
    local = df.withColumns({f"{n}_local": t for n, t in terms.items()})
    ends = local.groupBy(*keys, block).agg(*(F.max_by(F.struct(pos, f"{n}_local"), pos).alias(f"{n}_end") for n in columns))
    carried = {}
    for name, (_, a, _first) in columns.items():
        d = (1 - a) ** BLOCK
        back = max(1, math.ceil(math.log(NEGLIGIBLE) / math.log(d))) if d > 0 else 1
        w = Window.partitionBy(*keys).orderBy(block).rowsBetween(-back, -1)
        carried[f"{name}_carry"] = F.aggregate(F.collect_list(F.col(f"{name}_end.{name}_local")).over(w), F.lit(0.0), _decay(d))
    ends = ends.select(*keys, block, *(c.alias(n) for n, c in carried.items()))
    out = local.join(ends, [*keys, block])
    made = {n: F.when(F.col(pos) >= first, F.col(f"{n}_local") + F.pow(F.lit(1 - a), at + 1) * F.col(f"{n}_carry")) for n, (_, a, first) in columns.items()}
    return out.withColumns(made).drop(block, *(f"{n}_{x}" for n in columns for x in ("local", "carry")))


def _decay(d: float):
    return lambda acc, x: acc * F.lit(d) + x


def fold_sql(x: str, a: float, over: str) -> str:
    """The same mean as a DuckDB expression: a fold over the values so far, in order. over: a window without a frame."""
    return f"list_reduce(list({x}) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda y, x: (1 - {a!r}) * y + {a!r} * x)"
