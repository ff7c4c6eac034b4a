"""Signals, positions, trades, fills, costs and their metrics. Everything is keyed by symbol and, over a grid, combo_id."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Costs, Instrument
from ..sources.bars import by_time
from .sweeps import donchian_changes, target_changes

KEYS = ("combo_id", "symbol")


def _w(keys: tuple[str, ...], order: str = "pos"):
    return Window.partitionBy(*keys).orderBy(order)


def donchian(window: int) -> Column:
    """1 above the highest high of the `window` bars before, -1 below their lowest low, else the last of these; 0 before."""
    prior = by_time().rowsBetween(-window, -1)
    whole = F.count("close").over(prior) >= window
    return F.when(whole & (F.col("close") > F.max("high").over(prior)), 1.0).when(whole & (F.col("close") < F.min("low").over(prior)), -1.0)


def held_state(change: str) -> Column:
    return F.coalesce(F.last(change, ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def ma_cross(fast: int, slow: int, vol_window: int, target: float) -> Column:
    """The sign of fast - slow mean, times target / realized volatility within [0, 1]; no volatility counts as 1 where there is
    a target, and no full window as 0. Needs the column log_ret."""
    if fast >= slow:
        raise ValueError("fast must be below slow")
    from .features import full, sma

    vol = full(F.stddev_samp("log_ret"), F.col("log_ret"), vol_window)
    scale = F.when(vol == 0, F.lit(1.0 if target > 0 else 0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.lit(float(target)), vol))))
    return F.coalesce(F.signum(sma("close", fast) - sma("close", slow)) * scale, F.lit(0.0))


def _donchian_columns(bars: DataFrame, combos: list[tuple[int, dict]]) -> tuple[DataFrame, dict[int, str]]:
    windows = sorted({int(p["window"]) for _, p in combos})
    df = bars.withColumns({f"_c{w}": donchian(w) for w in windows})
    return df.withColumns({f"_s{w}": held_state(f"_c{w}") for w in windows}), {k: f"_s{int(p['window'])}" for k, p in combos}


def _ma_cross_columns(bars: DataFrame, combos: list[tuple[int, dict]]) -> tuple[DataFrame, dict[int, str]]:
    from .features import log_returns

    made = {f"_s{k}": ma_cross(int(p["fast"]), int(p["slow"]), int(p["vol_window"]), float(p["target"])) for k, p in combos}
    return log_returns(bars).withColumns(made), {k: f"_s{k}" for k, _ in combos}


@dataclass(frozen=True)
class Signal:
    """A signal that can be swept. columns(bars, combos) gives bars with a column for each distinct raw target, over one sort,
    and each combination's column; least has the required parameters' least values; check says what else is wrong. changes, where there is
    one, gives the targets over arrays of a block of bars (see sweeps.py), of which each looks reach(combos) bars back."""

    columns: Callable[[DataFrame, list[tuple[int, dict]]], tuple[DataFrame, dict[int, str]]]
    least: dict[str, float]
    check: Callable[[dict], str | None] = lambda p: None
    fractions: tuple[str, ...] = ()
    changes: Callable | None = None
    reach: Callable[[list[tuple[int, dict]]], int] | None = None


#: Signals by name.
SIGNALS: dict[str, Signal] = {
    "donchian": Signal(_donchian_columns, {"window": 1}, changes=donchian_changes, reach=lambda combos: max(int(p["window"]) for _, p in combos)),
    "ma_cross": Signal(_ma_cross_columns, {"fast": 1, "slow": 2, "vol_window": 2, "target": 0}, lambda p: "fast isn't below slow" if p["fast"] >= p["slow"] else None, ("target",)),
}


def register_signal(name: str, signal: Signal) -> None:
    """Adds a signal, which sweeps, trades and research runs then take by its name."""
    if name in SIGNALS:
        raise ValueError(f"{name} is registered already")
    SIGNALS[name] = signal


def simple_signal(generate: Callable[[dict], Column], least: dict[str, float], check: Callable[[dict], str | None] = lambda p: None, fractions: tuple[str, ...] = ()) -> Signal:
    """A signal whose raw target is a column of the bars, made from a combination's parameters."""

    def columns(bars: DataFrame, combos: list[tuple[int, dict]]) -> tuple[DataFrame, dict[int, str]]:
        return bars.withColumns({f"_s{k}": generate(p) for k, p in combos}), {k: f"_s{k}" for k, _ in combos}

    return Signal(columns, least, check, fractions)


def bad_params(signal: str, params: dict) -> str | None:
    """Why a combination can't be run, or None. Missing keys, booleans, values below the least, and what the signal's own check
    finds are errors."""
    known = SIGNALS[signal]
    for name, least in known.least.items():
        if name not in params:
            return f"{name} is missing"
        v = params[name]
        if isinstance(v, bool) or not isinstance(v, (int, float)) or v < least or (name not in known.fractions and v != int(v)):
            return f"{name} is {v!r}"
    return known.check(params)


def _signal_columns(bars: DataFrame, signal: str, combos: list[tuple[int, dict]]) -> tuple[DataFrame, dict[int, str]]:
    if signal not in SIGNALS:
        raise ValueError(f"unknown signal {signal}")
    return SIGNALS[signal].columns(bars, combos)


def signal_over_grid(bars: DataFrame, signal: str, combos: list[tuple[int, dict]]) -> DataFrame:
    """(combo_id, symbol, pos, ts, open, raw) for all combinations at once: one scan and sort of the bars, a column for each
    combination, unpivoted."""
    df, column = _signal_columns(bars, signal, combos)
    each = F.array(*(F.struct(F.lit(k).cast("long").alias("combo_id"), F.col(c).alias("raw")) for k, c in column.items()))
    return df.select("symbol", "pos", "ts", "open", F.explode(each).alias("s")).select("s.combo_id", "symbol", "pos", "ts", "open", "s.raw")


def grid_trades(bars: DataFrame, signal: str, combos: list[tuple[int, dict]], instrument: Instrument, qty: float = 1.0) -> DataFrame:
    """trades(causal(signal_over_grid(...))), without a row for each bar and combination: only bars where a combination's
    position changes are made. A signal with changes over blocks is swept without window functions over bars."""
    known = SIGNALS.get(signal)
    if known is not None and known.changes is not None:
        starts = target_changes(bars, combos, known.changes, known.reach(combos))
        last = bars.groupBy("symbol").agg(F.max(F.struct("pos", "ts", "open")).alias("_last"))
        starts = starts.join(last, "symbol").withColumn("_exit", F.coalesce(F.lead(F.struct("pos", "ts", "open"), 1).over(_w(KEYS)), F.col("_last")))
        return _round_turns(starts.filter((F.col("held") != 0) & (F.col("_exit.pos") > F.col("pos"))), instrument, qty, KEYS)
    df, column = _signal_columns(bars, signal, combos)
    w = by_time()
    names = sorted(set(column.values()))
    df = df.withColumns({f"{c}_h": F.coalesce(F.lag(c, 1).over(w), F.lit(0.0)) for c in names} | {f"{c}_b": F.coalesce(F.lag(c, 2).over(w), F.lit(0.0)) for c in names} | {"_last": F.max(F.struct("pos", "ts", "open")).over(Window.partitionBy("symbol"))})
    moved = F.array_compact(F.array(*(F.when(F.col(f"{c}_h") != F.col(f"{c}_b"), F.struct(F.lit(k).cast("long").alias("combo_id"), F.col(f"{c}_h").alias("held"))) for k, c in column.items())))
    starts = df.select("symbol", "pos", "ts", "open", "_last", F.explode(moved).alias("s")).select("s.combo_id", "symbol", "pos", "ts", "open", "_last", "s.held")
    starts = starts.withColumn("_exit", F.coalesce(F.lead(F.struct("pos", "ts", "open"), 1).over(_w(KEYS)), F.col("_last")))
    return _round_turns(starts.filter((F.col("held") != 0) & (F.col("_exit.pos") > F.col("pos"))), instrument, qty, KEYS)


def causal(df: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """held: the raw target of the bar before, 0 at first."""
    return df.withColumn("held", F.coalesce(F.lag("raw", 1).over(_w(keys)), F.lit(0.0)))


def trades(df: DataFrame, instrument: Instrument, qty: float = 1.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Round turns: maximal runs of one non-zero position, entered and left at opens. A run ends where the next begins, the
    last at the last bar; one that would end where it began is dropped. A flip is two trades that share a bar."""
    w = _w(keys)
    last = Window.partitionBy(*keys)
    starts = (
        df.withColumn("_before", F.lag("held", 1).over(w)).withColumn("_last", F.max(F.struct("pos", "ts", "open")).over(last))
        .filter(F.col("_before").isNull() | (F.col("_before") != F.col("held")))
        .withColumn("_next", F.lead(F.struct("pos", "ts", "open"), 1).over(w))
        .withColumn("_exit", F.coalesce("_next", "_last"))
        .filter((F.col("held") != 0) & (F.col("_exit.pos") > F.col("pos")))
    )
    return _round_turns(starts, instrument, qty, keys)


def _round_turns(starts: DataFrame, instrument: Instrument, qty: float, keys: tuple[str, ...]) -> DataFrame:
    size = F.abs(F.col("held")) * F.lit(float(qty))
    gross = F.signum("held") * (F.col("_exit.open") - F.col("open")) * F.lit(instrument.multiplier) * size
    return starts.select(
        *keys, F.col("pos").alias("entry_pos"), F.col("_exit.pos").alias("exit_pos"), F.col("ts").alias("entry_ts"), F.col("_exit.ts").alias("exit_ts"),
        F.when(F.col("held") > 0, "long").otherwise("short").alias("side"), size.alias("qty"), F.col("open").alias("entry_px"), F.col("_exit.open").alias("exit_px"), gross.alias("gross_pnl_usd"),
    )


def event_trades(df: DataFrame, instrument: Instrument, qty: float = 1.0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As a netting broker reports round turns: runs of one sign of the rounded target, with the largest size in the run."""
    df = df.withColumn("_target", F.rint(F.col("held") * F.lit(float(qty)))).withColumn("_sign", F.signum("_target"))
    w, all_ = _w(keys), Window.partitionBy(*keys)
    df = df.withColumn("_new", F.coalesce((F.lag("_sign", 1).over(w) != F.col("_sign")).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_last", F.max(F.struct("pos", "ts", "open")).over(all_))
    runs = df.groupBy(*keys, "_run").agg(F.min(F.struct("pos", "ts", "open")).alias("entry"), F.max(F.abs("_target")).alias("qty"), F.first("_sign").alias("sign"), F.first("_last").alias("_last"))
    runs = runs.withColumn("exit", F.coalesce(F.lead("entry", 1).over(_w(keys, "_run")), F.col("_last"))).filter((F.col("sign") != 0) & (F.col("exit.pos") > F.col("entry.pos")))
    gross = F.col("sign") * (F.col("exit.open") - F.col("entry.open")) * F.lit(instrument.multiplier) * F.col("qty")
    return runs.select(
        *keys, F.col("entry.pos").alias("entry_pos"), F.col("exit.pos").alias("exit_pos"), F.col("entry.ts").alias("entry_ts"), F.col("exit.ts").alias("exit_ts"),
        F.when(F.col("sign") > 0, "long").otherwise("short").alias("side"), "qty", F.col("entry.open").alias("entry_px"), F.col("exit.open").alias("exit_px"), gross.alias("gross_pnl_usd"),
    )


def sides(df: DataFrame) -> DataFrame:
    """side in lower case; an unknown one raises when the result is computed."""
    low = F.lower("side")
    return df.withColumn("side", F.when(low.isin("long", "short"), low).otherwise(F.raise_error(F.concat(F.lit("unknown side "), F.coalesce("side", F.lit("null"))))))


def require(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")


def delayed_fill(log: DataFrame, bars: DataFrame, instrument: Instrument, delay: int, drop_tail: bool = True) -> DataFrame:
    """Trades filled `delay` bars later at opens, gross anew. Trades that the data have no room for are dropped, or raise."""
    fills = bars.select("symbol", "pos", F.lead("open", delay).over(by_time()).alias("_px"), F.lead("ts", delay).over(by_time()).alias("_ts")) if delay else bars.select("symbol", "pos", F.col("open").alias("_px"), F.col("ts").alias("_ts"))
    a = fills.select("symbol", F.col("pos").alias("entry_pos"), F.col("_px").alias("_entry"), F.col("_ts").alias("_entry_ts"))
    b = fills.select("symbol", F.col("pos").alias("exit_pos"), F.col("_px").alias("_exit"), F.col("_ts").alias("_exit_ts"))
    out = log.join(a, ["symbol", "entry_pos"], "left").join(b, ["symbol", "exit_pos"], "left")
    if drop_tail:
        out = out.filter(F.col("_entry").isNotNull() & F.col("_exit").isNotNull())
    else:
        out = out.withColumn("_exit", F.when(F.col("_entry").isNotNull() & F.col("_exit").isNotNull(), F.col("_exit")).otherwise(F.raise_error(F.lit("a fill is out of the data"))))
    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    out = out.withColumns({"entry_px": F.col("_entry"), "exit_px": F.col("_exit"), "entry_ts": F.col("_entry_ts"), "exit_ts": F.col("_exit_ts"), "entry_pos": F.col("entry_pos") + delay, "exit_pos": F.col("exit_pos") + delay, "gross_pnl_usd": sign * (F.col("_exit") - F.col("_entry")) * F.lit(instrument.multiplier) * F.col("qty")})
    return out.select(*log.columns)


def apply_costs(log: DataFrame, costs: Costs, instrument: Instrument) -> DataFrame:
    """Adds commission_usd, fees_usd, spread_cost_usd, slippage_usd and net_pnl_usd."""
    require(log, "qty", "gross_pnl_usd", *(["atr_ticks_at_entry"] if costs.slippage_mode == "vol_scaled" else []))
    qty = F.col("qty")
    ticks = F.lit(costs.slippage) * (F.col("atr_ticks_at_entry") if costs.slippage_mode == "vol_scaled" else F.lit(1.0))
    out = log.withColumns({
        "commission_usd": F.lit(costs.commission_per_side * 2) * qty, "fees_usd": F.lit((costs.exchange_fee_per_side + costs.nfa_fee_per_side) * 2) * qty,
        "spread_cost_usd": F.lit(costs.spread_ticks * instrument.tick_value) * qty, "slippage_usd": ticks * F.lit(instrument.tick_value) * qty,
    })
    return out.withColumn("net_pnl_usd", F.col("gross_pnl_usd") - (F.col("commission_usd") + F.col("fees_usd") + F.col("spread_cost_usd") + F.col("slippage_usd")))


def sharpe(x: str) -> Column:
    """Mean over sample deviation; 0 for fewer than two values or no deviation."""
    return F.coalesce(F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0))), F.lit(0.0))


def drawdowns(log: DataFrame, keys: tuple[str, ...] = KEYS, balance: float | None = None, order: tuple[str, ...] = ("entry_pos", "symbol")) -> DataFrame:
    """By keys, max_drawdown: the deepest fall of cumulative net P&L from its peak so far, which starts with the first value;
    with a balance, as a share of the peak of the account (0 where that isn't positive)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    eq = log.select(*keys, *(c for c in order if c not in keys), (F.sum("net_pnl_usd").over(w) + F.lit(balance or 0.0)).alias("_eq"))
    peak = F.max("_eq").over(w)
    eq = eq.withColumn("_fall", peak - F.col("_eq") if balance is None else F.when(peak > 0, F.try_divide(peak - F.col("_eq"), peak)).otherwise(0.0))
    return eq.groupBy(*keys).agg(F.max("_fall").alias("max_drawdown"))


def metrics(log: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """By keys: n_trades, sharpe_gross, sharpe_net, win_rate, net_pnl and max_drawdown of priced trades."""
    flat = log.groupBy(*keys).agg(
        F.count("*").alias("n_trades"), sharpe("gross_pnl_usd").alias("sharpe_gross"), sharpe("net_pnl_usd").alias("sharpe_net"),
        F.avg((F.col("net_pnl_usd") > 0).cast("double")).alias("win_rate"), F.sum("net_pnl_usd").alias("net_pnl"),
    )
    return flat.join(drawdowns(log, keys), list(keys))


def equity(log: DataFrame, balance: float, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Trades' returns (net over balance) and the account's equity after each, by exit."""
    w = Window.partitionBy(*keys).orderBy("exit_pos", "entry_pos").rowsBetween(Window.unboundedPreceding, 0)
    return log.select(*keys, "exit_pos", "exit_ts", (F.col("net_pnl_usd") / balance).alias("ret"), (F.sum("net_pnl_usd").over(w) + balance).alias("equity"))


METRICS = ("n_trades", "sharpe_gross", "sharpe_net", "win_rate", "net_pnl", "max_drawdown", "sharpe_delay1")


def sweep(spark: SparkSession, bars: DataFrame, signal: str, combos: list[dict], costs: Costs, instrument: Instrument, in_test: DataFrame | None = None) -> DataFrame:
    """A row of metrics and error for each combination, over all symbols. Combinations that can't be run have error 1 and
    zeros; so do those without trades, with error 0. in_test (symbol, pos): only trades that enter there count."""
    why = [bad_params(signal, p) for p in combos]
    grid = spark.createDataFrame([(k, float(w is not None)) for k, w in enumerate(why)], "combo_id long, error double")
    good = [(k, p) for k, (p, w) in enumerate(zip(combos, why, strict=True)) if w is None]
    zeros = [F.lit(0.0).alias(m) if m != "n_trades" else F.lit(0).cast("long").alias(m) for m in METRICS]
    if not good:
        return grid.select("combo_id", *zeros, "error")
    log = grid_trades(bars, signal, good, instrument)
    if in_test is not None:
        log = log.join(in_test.select("symbol", F.col("pos").alias("entry_pos")).distinct(), ["symbol", "entry_pos"], "left_semi").select(*log.columns)
    now = metrics(apply_costs(log, costs, instrument), ("combo_id",))
    late = apply_costs(delayed_fill(log, bars, instrument, 1), costs, instrument).groupBy("combo_id").agg(sharpe("net_pnl_usd").alias("sharpe_delay1"))
    out = grid.join(now, "combo_id", "left").join(late, "combo_id", "left")
    return out.select("combo_id", *(F.coalesce(m, F.lit(0)).alias(m) for m in METRICS), "error")


def best_combo(table: DataFrame, metric: str = "sharpe_net") -> int:
    """The combination with the largest metric among those without an error, the first of equals."""
    row = table.filter("error = 0").orderBy(F.desc(metric), "combo_id").select("combo_id").first()
    if row is None:
        raise ValueError("no combination ran")
    return row["combo_id"]


def slice_performance(log: DataFrame, configs: list[int], n: int, slices: int) -> DataFrame:
    """(config_id, slice_id, perf): mean net P&L of the trades that enter in each slice of positions; 0 without trades. Slices
    are cut at whole parts of n / slices."""
    edges = [int(n * k / slices) for k in range(slices + 1)]
    at = F.lit(None).cast("int")
    for k in range(slices):
        at = F.when((F.col("entry_pos") >= edges[k]) & (F.col("entry_pos") < edges[k + 1]), k).otherwise(at)
    got = log.withColumn("slice_id", at).groupBy(F.col("combo_id").alias("config_id"), "slice_id").agg(F.avg("net_pnl_usd").alias("perf"))
    spark = log.sparkSession
    every = spark.range(len(configs) * slices).select(F.element_at(F.array(*(F.lit(c).cast("long") for c in configs)), (F.col("id") / slices).cast("int") + 1).alias("config_id"), (F.col("id") % slices).cast("int").alias("slice_id"))
    return every.join(got, ["config_id", "slice_id"], "left").select("config_id", "slice_id", F.coalesce("perf", F.lit(0.0)).alias("perf"))


def parity(vector: DataFrame, event: DataFrame, keys: tuple[str, ...] = ("symbol",), pnl_tolerance: float = 1e-6) -> DataFrame:
    """By keys, trades and net P&L of two logs, their differences, and whether they agree within 1 % of trades and the tolerance."""
    side = lambda df, p: df.groupBy(*keys).agg(F.count("*").alias(f"{p}_trades"), F.sum("net_pnl_usd").alias(f"{p}_net"))
    out = side(vector, "vector").join(side(event, "event"), list(keys), "full_outer").na.fill(0)
    trades_off, net_off = F.abs(F.col("vector_trades") - F.col("event_trades")), F.abs(F.col("vector_net") - F.col("event_net"))
    return out.withColumns({"trades_off": trades_off, "net_off": net_off, "agree": (trades_off <= F.col("vector_trades") / 100) & (net_off <= F.lit(pnl_tolerance) * F.greatest(F.lit(1.0), F.abs("vector_net")))})
