"""Trading accounts: days from trades, rule simulation, survival by resampled paths, and position sizes."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AccountRules

Z90 = 1.6448536269514722


def validate_days(days: DataFrame) -> DataFrame:
    """days (path_id, day, realized, lo, hi), raising when computed on a row whose extremes don't hold: both or none given,
    lo <= 0 <= hi and lo <= realized <= hi."""
    both = F.col("lo").isNull() == F.col("hi").isNull()
    fits = F.col("lo").isNull() | ((F.col("lo") <= 0) & (F.col("hi") >= 0) & (F.col("realized") >= F.col("lo")) & (F.col("realized") <= F.col("hi")))
    return days.withColumn("realized", F.when(both & fits, F.col("realized")).otherwise(F.raise_error(F.lit("a day's extremes don't hold its result")).cast("double")))


def capped(rules: AccountRules) -> Column:
    """A day's result under the daily loss limit: at the limit once the low reaches it."""
    if rules.daily_loss is None:
        return F.col("realized")
    low = F.coalesce("lo", F.least(F.lit(0.0), F.col("realized")))
    return F.when(low <= -rules.daily_loss, F.lit(-float(rules.daily_loss))).otherwise(F.col("realized"))


def simulate(days: DataFrame, rules: AccountRules, keys: tuple[str, ...] = ("path_id",)) -> DataFrame:
    """(keys, survived, hit_target, bust_reason, days_elapsed) of each path, by window functions alone: a floor trails the high
    water mark, a bust comes before a pass on the same day, and a path that does neither survives all its days."""
    w = Window.partitionBy(*keys).orderBy("day")
    run, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    start = F.lit(float(rules.start))
    df = days.withColumn("_c", capped(rules)).withColumn("_n", F.row_number().over(w)).withColumn("_bal", start + F.sum("_c").over(run))
    df = df.withColumn("_open", F.coalesce(F.lag("_bal").over(w), start)).withColumn("_peak", F.greatest(start, F.coalesce(F.max("_bal").over(prior), start)))
    if rules.drawdown == "intraday":
        given = F.when(F.col("lo").isNotNull(), F.col("lo")).otherwise(F.raise_error(F.lit("intraday rules need each day's extremes")).cast("double"))
        low = given if rules.daily_loss is None else F.greatest(given, F.lit(-float(rules.daily_loss)))
        df = df.withColumn("_test", F.col("_open") + low).withColumn("_hwm", F.greatest(F.col("_peak"), F.max(F.col("_open") + F.col("hi")).over(run)))
    else:
        df = df.withColumn("_test", F.col("_bal")).withColumn("_hwm", F.col("_peak"))
    floor = F.col("_hwm") - rules.trailing
    floor = F.least(floor, start) if rules.freeze_at_start else floor
    df = df.withColumn("_top", F.max("_c").over(run))
    won = F.col("_bal") - start
    passes = (won >= rules.target) & (F.col("_n") >= rules.min_days)
    if rules.consistency is not None:
        passes = passes & (F.col("_top") <= F.lit(float(rules.consistency)) * won)
    ends = df.groupBy(*keys).agg(F.min(F.when(F.col("_test") <= floor, F.col("_n"))).alias("bust"), F.min(F.when(passes, F.col("_n"))).alias("win"), F.max("_n").alias("n"))
    bust = F.col("bust").isNotNull() & (F.col("win").isNull() | (F.col("bust") <= F.col("win")))
    hit = ~bust & F.col("win").isNotNull()
    return ends.select(*keys, (~bust).alias("survived"), hit.alias("hit_target"), F.when(bust, F.lit("trailing_drawdown")).alias("bust_reason"), F.when(bust, F.col("bust")).when(hit, F.col("win")).otherwise(F.col("n")).cast("int").alias("days_elapsed"))


def trades_per_day(log: DataFrame, ts: str = "exit_ts") -> int:
    """The mean number of trades on days that have any, rounded half to even; 1 at least, and without trades."""
    mean = log.groupBy(F.to_date(ts).alias("d")).count().agg(F.avg("count")).first()[0]
    return 1 if mean is None else max(1, round(mean))


def _lags(n: int) -> tuple[int, int]:
    """How many autocovariances in a row are to be flat, and the largest lag, for a series of n."""
    reach = max(5, int(math.ceil(math.sqrt(math.log10(n)))))
    return reach, min(int(math.ceil(math.sqrt(n))) + reach, n - 1)


def block_of(n: int, cov: np.ndarray, stationary: bool = False) -> float:
    """The automatic block length of Politis and White with the correction of Patton, Politis and White, from autocovariances
    (NaN where there are none)."""
    if n < 4 or not np.isfinite(cov).all() or cov[0] <= 0:
        return float("nan")
    reach, _ = _lags(n)
    limit = 2 * math.sqrt(math.log10(n) / n)
    flat = np.abs(cov[1:] / cov[0]) < limit
    m = next((k + 1 for k in range(len(flat) - reach + 1) if flat[k : k + reach].all()), None)
    m = min(2 * max(1, (m - 1) if m else len(flat)), len(cov) - 1)
    lags = np.arange(-m, m + 1)
    weight = np.where(np.abs(lags / m) <= 0.5, 1.0, 2 * (1 - np.abs(lags / m)))
    acv = cov[np.abs(lags)]
    g, long_run = float((weight * np.abs(lags) * acv).sum()), float((weight * acv).sum())
    d = (2 if stationary else 4 / 3) * long_run**2
    if d <= 0:
        return float("nan")
    b = ((2 * g * g) / d) ** (1 / 3) * n ** (1 / 3)
    return min(b, math.ceil(min(3 * math.sqrt(n), n / 3)))


def optimal_block(x: np.ndarray, stationary: bool = False) -> float:
    """block_of for a series at hand."""
    x = np.asarray(x, "f8")
    n = len(x)
    if n < 4 or not np.isfinite(x).all() or x.std() == 0:
        return float("nan")
    e = x - x.mean()
    return block_of(n, np.array([float(e[: n - k] @ e[k:]) / n for k in range(_lags(n)[1] + 1)]), stationary)


def autocovariances(log: DataFrame, value: str = "net_pnl_usd", span: int = 1 << 16, lags: int | None = None) -> tuple[int, np.ndarray]:
    """How many rows log (idx from 0, value) has, and the autocovariances of value at all lags that block_of needs, or at so many lags from 0
    on (fewer, if there are fewer rows): all rows count. Stretches of idx are summed by task, each with the rows behind it that its lags reach; the driver gets a row a lag,
    some square root of the number of rows."""
    n, mean, low, high = log.agg(F.count("*"), F.avg(value), F.min(value), F.max(value)).first()
    if lags is None and (n < 4 or low == high or not math.isfinite(mean)):
        return n, np.full(1, math.nan)
    if not n:
        return n, np.empty(0)
    most = _lags(n)[1] if lags is None else min(lags, n) - 1
    span = max(span, most, 1)
    at = F.floor(F.col("idx") / span)
    reached = F.when(F.col("idx") % span < most, F.array(at, at - 1)).otherwise(F.array(at))  # a row also ends pairs that begin in the stretch before
    rows = log.select("idx", F.col(value).cast("double").alias("x"), F.explode(reached).alias("part")).filter("part >= 0")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iloc[0])
        pdf = pdf.sort_values("idx")
        e, own = pdf["x"].to_numpy() - mean, int((pdf["idx"] < (part + 1) * span).sum())
        size = 1 << (len(e) + most).bit_length()
        both = np.fft.irfft(np.fft.rfft(e, size) * np.conj(np.fft.rfft(e[:own], size)), size)[: most + 1]
        return pd.DataFrame({"lag": np.arange(most + 1), "total": both})

    got = rows.groupBy("part").applyInPandas(run, "lag long, total double").groupBy("lag").agg(F.sum("total").alias("total")).orderBy("lag").toPandas()
    return n, got["total"].to_numpy() / n


def default_block(x: np.ndarray) -> int:
    """1 for fewer than 16 values or where the rule has no result; within 1 and their number."""
    return _within(optimal_block(x) if len(x) >= 16 else math.nan, len(x))


def block_length(log: DataFrame) -> int:
    """default_block of all trades of log (idx, net_pnl_usd)."""
    n, cov = autocovariances(log)
    return _within(block_of(n, cov) if n >= 16 else math.nan, n)


def _within(b: float, n: int) -> int:
    return int(min(max(1, round(b)), n)) if math.isfinite(b) else 1


def resample(log: DataFrame, n: int, paths: int, length: int, block: int, seed: int, start: Column | None = None) -> DataFrame:
    """(path_id, at, the columns of log): each path is `length` rows of log (idx from 0 to n - 1) in circular blocks that start
    where a hash of seed, path and block says, whatever the partitioning. All columns of a row come along. From an empty log nothing is drawn."""
    spark = log.sparkSession
    at = spark.range(paths * length).select((F.col("id") / length).cast("long").alias("path_id"), (F.col("id") % length).alias("at"))
    size = F.lit(max(1, n))
    begin = F.lit(0) if not n else F.pmod(F.xxhash64(F.lit(seed), "path_id", F.floor(F.col("at") / block)), size) if start is None else start
    at = at.withColumn("idx", F.pmod(begin + F.col("at") % block, size))
    return at.join(log, "idx").drop("idx")


def to_days(drawn: DataFrame, per_day: int, contracts: float = 1.0, keys: tuple[str, ...] = ("path_id",)) -> DataFrame:
    """(keys, day, realized, lo, hi): every per_day rows in turn are a day; lo and hi are the extremes of the running result,
    0 included, with those of each trade (mae_usd, mfe_usd) where given. A last incomplete day is dropped."""
    w = Window.partitionBy(*keys, "day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    df = drawn.withColumn("day", F.floor(F.col("at") / per_day).cast("int"))
    before = F.sum("net_pnl_usd").over(w) - F.col("net_pnl_usd")
    df = df.withColumn("_run", before + F.col("net_pnl_usd"))
    low = F.least("_run", before + (F.least(F.lit(0.0), F.col("mae_usd")) if "mae_usd" in drawn.columns else F.lit(0.0)))
    high = F.greatest("_run", before + (F.greatest(F.lit(0.0), F.col("mfe_usd")) if "mfe_usd" in drawn.columns else F.lit(0.0)))
    got = df.withColumns({"_low": low, "_high": high}).groupBy(*keys, "day").agg(F.count("*").alias("_n"), F.sum("net_pnl_usd").alias("realized"), F.min("_low").alias("lo"), F.max("_high").alias("hi"))
    scale = F.lit(float(contracts))
    return got.filter(F.col("_n") == per_day).select(*keys, "day", (F.col("realized") * scale).alias("realized"), (F.least(F.lit(0.0), F.col("lo"), F.col("realized")) * scale).alias("lo"), (F.greatest(F.lit(0.0), F.col("hi"), F.col("realized")) * scale).alias("hi"))


def wilson(share: Column, n: Column, z: float = Z90) -> tuple[Column, Column]:
    """The ends of Wilson's interval, within 0 and 1."""
    mid, half, scale = share + z * z / (2 * n), z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.greatest(F.lit(0.0), (mid - half) / scale), F.least(F.lit(1.0), (mid + half) / scale)


def survival_report(outcomes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """p_survival, p_target, ci_lo and ci_hi (Wilson, 90 %), median_days_to_target (null without one), busts (share by reason)."""
    flat = outcomes.groupBy(*keys).agg(F.count("*").alias("n_paths"), F.avg(F.col("survived").cast("double")).alias("p_survival"), F.avg(F.col("hit_target").cast("double")).alias("p_target"), F.median(F.when(F.col("hit_target"), F.col("days_elapsed"))).alias("median_days_to_target"),
        F.sum(F.when(F.col("bust_reason") == "trailing_drawdown", 1).otherwise(0)).alias("_b"))
    lo, hi = wilson(F.col("p_survival"), F.col("n_paths"))
    busts = F.map_filter(F.create_map(F.lit("trailing_drawdown"), F.col("_b") / F.col("n_paths")), lambda k, v: v > 0)
    return flat.withColumns({"ci_lo": lo, "ci_hi": hi, "busts": busts}).drop("_b")


def survival(log: DataFrame, rules: AccountRules, paths: int = 1_000, days: int = 30, seed: int = 7, contracts: list[float] | None = None, block: int | None = None, start: Column | None = None) -> DataFrame:
    """A survival report by number of contracts. log (idx, net_pnl_usd, exit_ts, extremes if known) is drawn in blocks; all sizes
    share the drawn paths. Without trades every path survives."""
    sizes = contracts or [1.0]
    n = log.count()
    if not n:
        flat = log.sparkSession.createDataFrame([(float(s), paths, 1.0, 0.0, None, {}) for s in sizes], "contracts double, n_paths long, p_survival double, p_target double, median_days_to_target double, busts map<string,double>")
        return flat.withColumns(dict(zip(("ci_lo", "ci_hi"), wilson(F.col("p_survival"), F.col("n_paths")), strict=True)))
    per_day = trades_per_day(log)
    block = block or block_length(log)
    one = to_days(resample(log, n, paths, days * per_day, block, seed, start), per_day)
    each = one.withColumn("contracts", F.explode(F.array(*(F.lit(float(s)) for s in sizes))))
    scaled = each.select("contracts", "path_id", "day", *((F.col(c) * F.col("contracts")).alias(c) for c in ("realized", "lo", "hi")))
    return survival_report(simulate(scaled, rules, ("contracts", "path_id")), ("contracts",))


def max_contracts(log: DataFrame, rules: AccountRules, least: float = 0.90, most: int = 50, **kw) -> int:
    """The last number of contracts before the first that survives too rarely; all are simulated in one job."""
    report = survival(log, rules, contracts=[float(k) for k in range(1, most + 1)], **kw)
    first = report.filter(F.col("p_survival") < least).agg(F.min("contracts")).first()[0]
    return most if first is None else int(first) - 1


def kelly(p: Column, win: Column, loss: Column) -> Column:
    """p - (1 - p) / (win / loss), 0 at least and where it isn't defined."""
    return F.greatest(F.lit(0.0), F.coalesce(p - F.try_divide(1 - p, F.try_divide(win, loss)), F.lit(0.0)))


def position_size(vol_usd: Column, target_vol_usd: float, kelly_share: Column, avg_loss: Column, surviving: Column, hard_cap: int, kelly_cap: float = 0.25) -> Column:
    """The least of the volatility leg (target_vol_usd / vol_usd), the Kelly leg (kelly_cap * kelly_share * target_vol_usd /
    avg_loss), the number that survives and the hard cap, in whole contracts, 0 at least. vol_usd is a contract's daily
    deviation; one that isn't positive raises. The Kelly cap is 0.25 at most."""
    if not 0 < kelly_cap <= 0.25:
        raise ValueError("the Kelly cap is 0.25 at most")
    vol = F.when(vol_usd > 0, vol_usd).otherwise(F.raise_error(F.lit("volatility must be positive")).cast("double"))
    legs = [F.floor(F.lit(float(target_vol_usd)) / vol), F.floor(F.try_divide(F.lit(kelly_cap) * kelly_share * target_vol_usd, avg_loss)), surviving.cast("long"), F.lit(hard_cap).cast("long")]
    return F.greatest(F.lit(0).cast("long"), F.least(*legs)).cast("long")
