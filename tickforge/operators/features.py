"""Technical indicators and the feature matrix. All take bars (symbol, pos, prices, volume) and add columns; windows that
aren't full give null, and so does division by zero."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recursive import ewm
from ..sources.bars import by_time


def full(agg: Column, x: Column, window: int, least: int | None = None, keys: tuple[str, ...] = ()) -> Column:
    """An aggregate over the last `window` rows; null with fewer than `least` values (default: window)."""
    w = by_time(*keys).rowsBetween(-(window - 1), 0)
    return F.when(F.count(x).over(w) >= (window if least is None else least), agg.over(w))


def sma(x: str, window: int) -> Column:
    return full(F.avg(x), F.col(x), window)


def lagged(x: str, n: int = 1) -> Column:
    return F.lag(x, n).over(by_time())


def true_range(df: DataFrame) -> DataFrame:
    """tr: the largest of high - low and both distances from the close before, of those that exist."""
    before = lagged("close")
    return df.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def ema(df: DataFrame, x: str, spans: dict[str, int]) -> DataFrame:
    return ewm(df, {name: (x, 2 / (span + 1), 0) for name, span in spans.items()})


def moves(df: DataFrame) -> DataFrame:
    """_up and _down: gains and losses from the close before."""
    change = F.col("close") - lagged("close")
    return df.withColumn("_up", F.greatest(change, F.lit(0.0))).withColumn("_down", F.greatest(-change, F.lit(0.0)))


def rsi_value(window: int) -> Column:
    value = F.when(F.col("_down_mean") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide("_up_mean", "_down_mean")))
    return F.when(F.col("pos") >= window, value)


def rsi(df: DataFrame, window: int = 14, name: str = "rsi") -> DataFrame:
    """Wilder's index, from position `window` on; 100 without losses."""
    df = ewm(moves(df), {"_up_mean": ("_up", 1 / window, 1), "_down_mean": ("_down", 1 / window, 1)})
    return df.withColumn(name, rsi_value(window)).drop("_up", "_down", "_up_mean", "_down_mean")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ema(df, "close", {"_fast": fast, "_slow": slow}).withColumn("macd", F.col("_fast") - F.col("_slow"))
    return ema(df, "macd", {"macd_signal": signal}).withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def bollinger(df: DataFrame, window: int = 20, width: float = 2.0) -> DataFrame:
    mid, dev = full(F.avg("close"), F.col("close"), window), full(F.stddev_samp("close"), F.col("close"), window)
    df = df.withColumn("bb_mid", mid).withColumn("bb_upper", mid + width * dev).withColumn("bb_lower", mid - width * dev)
    return df.withColumn("bb_percent_b", F.try_divide(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")))


def atr(df: DataFrame, window: int = 14) -> DataFrame:
    df = ewm(true_range(df), {"atr": ("tr", 1 / window, 0)})
    return df.withColumn("atr", F.when(F.col("pos") >= window - 1, F.col("atr"))).drop("tr")


def obv(df: DataFrame) -> DataFrame:
    signed = F.coalesce(F.signum(F.col("close") - lagged("close")), F.lit(0.0)) * F.col("volume")
    return df.withColumn("_signed", signed).withColumn("obv", F.sum("_signed").over(by_time().rowsBetween(Window.unboundedPreceding, 0))).drop("_signed")


def stochastic_k(window: int = 14) -> Column:
    low, high = full(F.min("low"), F.col("low"), window), full(F.max("high"), F.col("high"), window)
    return 100 * F.try_divide(F.col("close") - low, high - low)


def log_returns(df: DataFrame, name: str = "log_ret") -> DataFrame:
    return df.withColumn(name, F.ln(F.col("close") / F.nullif(lagged("close"), F.lit(0.0))))


def rolling_volatility(df: DataFrame, window: int = 20, per_year: float = 1.0, name: str = "volatility") -> DataFrame:
    df = log_returns(df, "_lr")
    return df.withColumn(name, full(F.stddev_samp("_lr"), F.col("_lr"), window) * F.sqrt(F.lit(float(per_year)))).drop("_lr")


def trailing_volatility(df: DataFrame, window: int = 50, name: str = "vol") -> DataFrame:
    """Deviation of simple returns, full window."""
    df = df.withColumn("_r", F.col("close") / F.nullif(lagged("close"), F.lit(0.0)) - 1)
    return df.withColumn(name, full(F.stddev_samp("_r"), F.col("_r"), window)).drop("_r")


def periods_per_year(interval: str, session_hours: float = 23.0, days: int = 252) -> float:
    minutes = {"1m": 1, "5m": 5, "15m": 15, "1h": 60}
    if interval == "1d":
        return float(days)
    if interval not in minutes:
        raise ValueError(f"unknown interval {interval}")
    return session_hours * 60 / minutes[interval] * days


def ffd_weights(d: float, threshold: float = 1e-4, most: int = 100_000) -> list[float]:
    """Weights of fixed-width fractional differencing, the newest value's first, up to the first below the threshold.
    More than `most` of them (a threshold that asks for wider windows than a plan can hold) are an error."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    w = [1.0]
    while True:
        k = len(w)
        nxt = -w[-1] * (d - k + 1) / k
        if abs(nxt) < threshold:
            return w
        if k == most:
            raise ValueError(f"more than {most} weights for d {d} and threshold {threshold}")
        w.append(nxt)


def frac_diff(x: str = "close", d: float = 0.4, threshold: float = 1e-4) -> Column:
    """The weighted sum of the last values; null until there are as many as weights."""
    weights = ffd_weights(d, threshold)
    n = len(weights)
    w = by_time().rowsBetween(-(n - 1), 0)
    lit = F.array(*(F.lit(v) for v in reversed(weights)))
    return F.when(F.count(x).over(w) >= n, F.aggregate(F.zip_with(F.collect_list(x).over(w), lit, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))


def convolved(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """By place the sum of weights[k] x[place - k]; not a number where a value is missing or there are fewer. By the product of transforms, with the
    mean taken out first so that rounding is relative to the deviations."""
    n, out = len(weights), np.full(len(x), np.nan)
    good = np.isfinite(x)
    if len(x) < n or not good.any():
        return out
    seen = np.concatenate([[0], np.cumsum(good)])
    level = float(x[good].mean())
    size = 1 << (len(x) + n - 1).bit_length()
    sums = np.fft.irfft(np.fft.rfft(np.where(good, x - level, 0.0), size) * np.fft.rfft(weights, size), size)[n - 1 : len(x)] + level * weights.sum()
    out[n - 1 :] = np.where(seen[n:] - seen[:-n] == n, sums, np.nan)
    return out


def frac_diff_blocks(bars: DataFrame, x: str = "close", d: float = 0.4, threshold: float = 1e-4, name: str = "fracdiff", block: int | None = None) -> DataFrame:
    """(symbol, pos, name): what frac_diff gives, over blocks of positions that come with the values before them that the weights reach, so
    that a symbol uses many tasks and long weights cost the logarithm of their number. Blocks are four times the weights or more."""
    weights = np.array(ffd_weights(d, threshold))
    reach, size = len(weights) - 1, block or max(1 << 16, 1 << (4 * len(weights)).bit_length())
    blocks = F.sequence(F.floor(F.col("pos") / size).cast("long"), F.floor((F.col("pos") + reach) / size).cast("long"))
    rows = bars.select("symbol", F.col("pos").cast("long").alias("pos"), F.col(x).cast("double").alias("x"), F.explode(blocks).alias("block"))

    def run(key, t):
        t = t.sort_by("pos")
        pos = t["pos"].to_numpy()
        mine = pos // size == key[1].as_py()
        got = convolved(t["x"].to_numpy(), weights)[mine]
        return pa.table({"symbol": pa.array([key[0].as_py()] * len(got), pa.string()), "pos": pa.array(pos[mine]), name: pa.array(got, from_pandas=True)})

    return rows.groupBy("symbol", "block").applyInArrow(run, f"symbol string, pos long, {name} double")


@dataclass(frozen=True)
class FeatureConfig:
    """Windows of the feature matrix."""

    returns: tuple[int, ...] = (1, 5, 10, 21)
    rsi: int = 14
    macd: tuple[int, int, int] = (12, 26, 9)
    bollinger: tuple[int, float] = (20, 2.0)
    atr: int = 14
    volatility: int = 20
    volume: int = 20
    sma: tuple[int, int] = (50, 200)
    extreme: tuple[int, int] = (252, 60)
    stochastic: int = 14
    frac_d: float = 0.4
    frac_threshold: float = 1e-4
    interval: str = "1d"
    session_hours: float = 23.0
    days: int = 252


def feature_names(c: FeatureConfig = FeatureConfig()) -> list[str]:
    return [*(f"ret_{h}" for h in c.returns), "rsi", "macd_hist_norm", "bb_percent_b", "atr_ratio", "realized_vol", "volume_z", "dist_sma_fast", "dist_sma_slow", "dist_high_extreme", "dist_low_extreme", "stoch_k", "fracdiff_close"]


def build_features(bars: DataFrame, c: FeatureConfig = FeatureConfig()) -> DataFrame:
    """symbol, pos, ts and the 16 features in their fixed order."""
    fast, slow, signal = c.macd
    df = ewm(true_range(moves(bars)), {  # all means of inputs in one pass, then the mean of their difference
        "_up_mean": ("_up", 1 / c.rsi, 1), "_down_mean": ("_down", 1 / c.rsi, 1), "_fast": ("close", 2 / (fast + 1), 0), "_slow": ("close", 2 / (slow + 1), 0), "_atr": ("tr", 1 / c.atr, 0),
    })
    df = ewm(df.withColumn("_macd", F.col("_fast") - F.col("_slow")), {"_signal": ("_macd", 2 / (signal + 1), 0)})
    df = df.withColumns({"_rsi": rsi_value(c.rsi), "macd_hist": F.col("_macd") - F.col("_signal"), "atr": F.when(F.col("pos") >= c.atr - 1, F.col("_atr"))})
    df = bollinger(df, *c.bollinger)
    df = rolling_volatility(df, c.volatility, periods_per_year(c.interval, c.session_hours, c.days), "realized_vol")
    window, least = c.extreme
    close = F.col("close")
    made = {f"ret_{h}": close / F.nullif(lagged("close", h), F.lit(0.0)) - 1 for h in c.returns}
    made |= {
        "rsi": F.col("_rsi") / 100, "macd_hist_norm": F.try_divide("macd_hist", "close"), "atr_ratio": F.try_divide("atr", "close"),
        "volume_z": F.try_divide(F.col("volume") - full(F.avg("volume"), F.col("volume"), c.volume), full(F.stddev_samp("volume"), F.col("volume"), c.volume)),
        "dist_sma_fast": F.try_divide(close, sma("close", c.sma[0])) - 1, "dist_sma_slow": F.try_divide(close, sma("close", c.sma[1])) - 1,
        "dist_high_extreme": F.try_divide(close, full(F.max("close"), close, window, least)) - 1, "dist_low_extreme": F.try_divide(close, full(F.min("close"), close, window, least)) - 1,
        "stoch_k": stochastic_k(c.stochastic) / 100,
    }
    df = df.withColumns(made).join(frac_diff_blocks(bars, "close", c.frac_d, c.frac_threshold, "fracdiff_close"), ["symbol", "pos"], "left")
    return df.select("symbol", "pos", "ts", *feature_names(c))
