"""Changes of signals for many combinations at once, over blocks of positions.

A block of a symbol's bars comes with the bars before it that the longest window reaches, and one bar behind it, so blocks are independent
and one symbol uses many tasks. Inside a block a sparse table holds the extremes of all runs of 1, 2, 4, ... bars; any window is
covered by two of them. A combination costs a few passes of numpy over the block, and only bars where its target changes leave it, so
neither the plan nor the rows grow with bars times combinations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


class Extremes:
    """The largest (or with fmin the smallest) of the values of any run; null ones (not a number) don't count."""

    def __init__(self, x: np.ndarray, longest: int, of=np.fmax):
        self.of, self.levels = of, [x]
        while 2 << (len(self.levels) - 1) <= longest:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            up = last.copy()
            up[half:] = of(last[half:], last[:-half])
            self.levels.append(up)

    def ending(self, window: int) -> np.ndarray:
        """By place, of the `window` values that end there; fewer at the start."""
        k = window.bit_length() - 1
        out, back = self.levels[k].copy(), window - (1 << k)
        if back:
            out[back:] = self.of(out[back:], self.levels[k][:-back])
        return out


def donchian_changes(bars: dict[str, np.ndarray], combos: list[tuple[int, dict]]):
    """For each combination, 1 where the close is above the highs of its window before, -1 where it is below the lows, else not a number."""
    windows = {k: int(p["window"]) for k, p in combos}
    longest = max(windows.values())
    high, low, close = (bars[c] for c in ("high", "low", "close"))
    top, bottom, seen = Extremes(high, longest), Extremes(low, longest, np.fmin), np.concatenate([[0], np.cumsum(np.isfinite(close))])
    made: dict[int, np.ndarray] = {}
    for k, w in windows.items():
        if w not in made:
            out = np.full(len(close), np.nan)
            if len(close) > w:
                now = close[w:]
                whole = seen[w:-1] - seen[: -w - 1] >= w
                out[w:] = np.where(whole & (now > top.ending(w)[w - 1 : -1]), 1.0, np.where(whole & (now < bottom.ending(w)[w - 1 : -1]), -1.0, np.nan))
            made[w] = out
        yield k, made[w]


def target_changes(bars: DataFrame, combos: list[tuple[int, dict]], changes, reach: int, block: int = BLOCK) -> DataFrame:
    """(combo_id, symbol, pos, ts, open, held): the bars from which a combination holds another target than before. changes(arrays, combos) gives
    the targets that bars set, not a number where they set none; reach: how many bars before a bar it looks at."""
    own = F.floor(F.col("pos") / block)
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - 1) / block))
    blocks = F.sequence(first.cast("long"), F.floor((F.col("pos") + reach) / block).cast("long"))
    rows = bars.select("symbol", "pos", "ts", *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")), F.explode(blocks).alias("block"))
    schema = pa.schema([("combo_id", pa.int64()), ("symbol", pa.string()), ("pos", pa.int64()), ("ts", rows.select("ts").limit(0).toArrow().schema.field("ts").type), ("open", pa.float64()), ("held", pa.float64())])

    def run(key, t):
        t = t.sort_by("pos")
        pos = t["pos"].to_numpy()
        arrays = {c: t[c].to_numpy() for c in ("open", "high", "low", "close")}
        combo, place, held = [], [], []
        mine = pos // block == key[1].as_py()
        for k, target in changes(arrays, combos):
            at = np.flatnonzero(np.isfinite(target) & mine)
            at = at[at + 1 < len(pos)]  # a target is held from the next bar on
            if len(at):
                at = at[np.append(True, target[at[1:]] != target[at[:-1]])]
                combo.append(np.full(len(at), k))
                place.append(at + 1)
                held.append(target[at])
        at = np.concatenate(place) if place else np.empty(0, "i8")
        n = len(at)
        take = pa.array(at)
        return pa.table([pa.array(np.concatenate(combo) if n else at, pa.int64()), pa.array([key[0].as_py()] * n, pa.string()), t["pos"].take(take).cast(pa.int64()), t["ts"].take(take).cast(schema.field("ts").type), t["open"].take(take), pa.array(np.concatenate(held) if n else np.empty(0), pa.float64())], schema=schema)

    every = rows.groupBy("symbol", "block").applyInArrow(run, f"combo_id long, symbol string, pos long, ts {bars.schema['ts'].dataType.simpleString()}, open double, held double")
    # A block begins without knowing what is held, so its first change may be none.
    before = F.coalesce(F.lag("held").over(Window.partitionBy("combo_id", "symbol").orderBy("pos")), F.lit(0.0))
    return every.withColumn("_before", before).filter(F.col("held") != F.col("_before")).drop("_before")
