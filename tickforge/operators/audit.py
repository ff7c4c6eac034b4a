"""Look-ahead audit: a point-in-time operator gives the same values on a prefix of history as on all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Operator = Callable[[DataFrame], DataFrame]
#: Where histories are cut, and tolerances.
CUTS, ATOL, RTOL = (0.5, 0.75, 0.9), 1e-9, 1e-5


class LookaheadError(ValueError):
    """An operator whose past values depend on the future."""


class Registry:
    """Operators by name; a name is registered once."""

    def __init__(self) -> None:
        self.operators: dict[str, Operator] = {}

    def register(self, name: str, op: Operator) -> None:
        if name in self.operators:
            raise ValueError(f"{name} is registered already")
        self.operators[name] = op

    def names(self) -> list[str]:
        return sorted(self.operators)

    def clear(self) -> None:
        self.operators.clear()

    def run(self, history: DataFrame) -> DataFrame:
        """A row for each operator and cut: checked values and mismatches."""
        out = None
        for name in self.names():
            got = violations(self.operators[name], history).select(F.lit(name).alias("operator"), "cut", "checked", "mismatches")
            out = got if out is None else out.unionByName(got)
        if out is None:
            raise ValueError("no operator is registered")
        return out


def violations(op: Operator, history: DataFrame, cuts: tuple[float, ...] = CUTS, atol: float = ATOL, rtol: float = RTOL) -> DataFrame:
    """(cut, checked, mismatches): values of op(history) at or before each cut of each symbol's positions against those of
    op(prefix), over all numeric columns; null equals null."""
    whole, out = op(history), None
    numeric = [c for c, t in whole.dtypes if t in ("double", "float", "int", "bigint") and c != "pos"]
    last = history.groupBy("symbol").agg(F.max("pos").alias("_last"))
    for cut in cuts:
        at = last.select("symbol", F.floor(F.col("_last") * cut).alias("_cut"))
        short = op(history.join(F.broadcast(at), "symbol").filter(F.col("pos") <= F.col("_cut")).drop("_cut"))  # a row a symbol
        a = whole.join(F.broadcast(at), "symbol").filter(F.col("pos") <= F.col("_cut")).select("symbol", "pos", *(F.col(c).alias(f"a_{c}") for c in numeric))
        met = a.join(short.select("symbol", "pos", *(F.col(c).alias(f"b_{c}") for c in numeric)), ["symbol", "pos"], "left")
        off = F.lit(0)
        for c in numeric:
            x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
            same = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False))
            off = off + (~same).cast("int")
        got = met.agg(F.lit(float(cut)).alias("cut"), (F.count("*") * len(numeric)).alias("checked"), F.coalesce(F.sum(off), F.lit(0)).alias("mismatches"))
        out = got if out is None else out.unionByName(got)
    return out


def assert_causal(op: Operator, history: DataFrame, name: str = "operator") -> None:
    bad = violations(op, history).filter("mismatches > 0").first()
    if bad is not None:
        raise LookaheadError(f"{name}: {bad['mismatches']} values before {bad['cut']:.0%} depend on what comes later")
