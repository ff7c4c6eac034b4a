"""Regimes of a symbol: change points of its closes by pruned search, and the detectors by name (hidden states are in hidden.py).

The search runs along one symbol's bars, so it is grouped by symbol, a task each; a symbol's bars (17 million for fifty years of
minutes) fit an executor as arrays of a few columns."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hidden import HmmDetector, hmm_regimes  # noqa: F401


def _square(s: np.ndarray, q: np.ndarray, a: np.ndarray, b: int) -> np.ndarray:
    return q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)


def _normal(s: np.ndarray, q: np.ndarray, a: np.ndarray, b: int) -> np.ndarray:
    return (b - a) * np.log(np.maximum(_square(s, q, a, b) / (b - a), 0) + 1e-6)


#: The cost of a piece by model: squared deviations from its mean, or the normal likelihood of its mean and variance.
COSTS = {"l2": _square, "normal": _normal}


def _widest(centre: np.ndarray, width: np.ndarray) -> tuple[float, float]:
    """The longest interval that the intervals around centre cover together."""
    order = np.argsort(centre - width)
    lo, hi = (centre - width)[order], np.maximum.accumulate((centre + width)[order])
    first = np.flatnonzero(np.append(True, lo[1:] > hi[:-1]))
    last = np.append(first[1:], len(lo)) - 1
    k = int(np.argmax(hi[last] - lo[first]))
    return float(lo[first[k]]), float(hi[last[k]])


def segments(x: np.ndarray, penalty: float, least: int = 2, jump: int = 1, cost: str = "l2", live: list | None = None) -> np.ndarray:
    """By prefix, the number of segments of the best cut of x[: t + 1], at multiples of `jump`, into pieces of `least` values or
    more with the smallest sum of costs plus the penalty for each cut (1 where a prefix is shorter than two pieces). live gets the number of
    starts that each prefix was priced with.

    A start that does worse at t than the best cut of t can never win once a piece fits behind t, so it is dropped from
    t + least on. With squared deviations the cost from a start is a parabola over the level of its piece, and two starts' parabolas
    differ by one that later values don't change. So when a start comes in, each older one keeps only the levels at which it is not worse than
    the new one (low to high), the new one only those at which no older one is as good (not gone to back), and a start goes when
    no level is left. Few stay even where levels drift, and the pass over all prefixes is one exact search."""
    n, price = len(x), COSTS[cost]
    x = x - (x[0] if n else 0.0)  # sums of squares stay small
    s, q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    best, pieces, out = np.full(n + 1, math.inf), np.zeros(n + 1, "i8"), np.ones(n, "i8")
    best[0] = -penalty
    starts, until = np.array([0]), np.array([n + 1])
    low, high, gone, back = np.array([-math.inf]), np.array([math.inf]), np.array([math.inf]), np.array([-math.inf])
    for t in range(least, n + 1):
        keep = until > t
        if (t - least) % jump == 0 and t - least >= least:
            new = t - least
            if cost == "l2":
                size = new - starts
                level = (s[new] - s[starts]) / size
                apart = (best[new] - best[starts] - (q[new] - q[starts])) / size + level * level
                slack = 1e-11 * (1.0 + abs(best[new]) + q[new] - q[starts]) / size  # rounding drops nothing
                width = np.sqrt(np.maximum(apart + slack, 0.0))
                low, high = np.maximum(low, level - width), np.minimum(high, level + width)
                keep &= (apart + slack >= 0) & (low <= high) & ((low < gone) | (high > back))
                lost = _widest(level, np.sqrt(np.maximum(apart - slack, 0.0)))
            else:
                lost = (math.inf, -math.inf)
            starts, until, low, high, gone, back = (np.append(a[keep], v) for a, v in ((starts, new), (until, n + 1), (low, -math.inf), (high, math.inf), (gone, lost[0]), (back, lost[1])))
        elif not keep.all():
            starts, until, low, high, gone, back = (a[keep] for a in (starts, until, low, high, gone, back))
        total = best[starts] + price(s, q, starts, t)
        if live is not None:
            live.append(len(starts))
        k = int(np.argmin(total))
        count = pieces[starts[k]] + 1
        out[t - 1] = count if t >= 2 * least else 1
        if t % jump == 0:
            best[t], pieces[t] = total[k] + penalty, count
            until = np.where(total > best[t], np.minimum(until, t + least), until)
    return out


class ChangePoints:
    """Regimes as the number of change points so far in each symbol's closes, searched anew on every prefix."""

    def __init__(self, penalty: float, model: str = "l2", least: int = 2, jump: int = 1):
        if penalty <= 0 or least < 1 or jump < 1:
            raise ValueError("a positive penalty, and a least size and jump of 1 at least, are needed")
        if model not in COSTS:
            raise ValueError(f"unknown cost {model}")
        self.settings, self.found = (penalty, least, jump, model), None

    def regimes(self, bars: DataFrame) -> DataFrame:
        settings = self.settings

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pos")
            return pd.DataFrame({"symbol": pdf["symbol"], "pos": pdf["pos"], "regime": (segments(pdf["close"].to_numpy("f8"), *settings) - 1).astype("i4")})

        return bars.select("symbol", "pos", "close").groupBy("symbol").applyInPandas(run, "symbol string, pos long, regime int")

    def fit(self, bars: DataFrame) -> ChangePoints:
        """Notes how many regimes each symbol's whole history has (symbol, n), which is all that is to be learned."""
        self.found = self.regimes(bars).groupBy("symbol").agg((F.max_by("regime", "pos") + 1).alias("n"))
        return self

    def proba(self, bars: DataFrame) -> DataFrame:
        """(symbol, pos, proba): 1 for the regime and 0 for the others, as many as the symbol ever has here or had in fit."""
        seen = self.regimes(bars)
        sizes = seen.groupBy("symbol").agg((F.max("regime") + 1).alias("k"))
        if self.found is not None:
            sizes = sizes.join(self.found, "symbol", "left").select("symbol", F.greatest("k", F.coalesce("n", F.lit(1))).alias("k"))
        one = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda k: (k == F.col("regime")).cast("double"))
        return seen.join(sizes, "symbol").select("symbol", "pos", one.alias("proba"))


def change_points(bars: DataFrame, penalty: float = 10.0, least: int = 2) -> DataFrame:
    """(symbol, pos, regime) of ChangePoints."""
    return ChangePoints(penalty, least=least).regimes(bars)


#: Detectors by name; any class with fit, regimes and proba can be added.
DETECTORS = {"hmm": HmmDetector, "change_points": ChangePoints}


def register_detector(name: str, make) -> None:
    if name in DETECTORS:
        raise ValueError(f"{name} is registered already")
    DETECTORS[name] = make


def detector(kind: str, **settings):
    return DETECTORS[kind](**settings)
