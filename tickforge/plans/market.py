"""Queries of bars, features, signals, trades and sweeps, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INSTRUMENTS, Costs
from ..functions.recursive import fold_sql
from ..operators import features as f
from ..operators import trading as t
from ..sources.bars import DAILY_SQL, EVENT_SQL, event_bars, lineitem_bars

MES, COSTS = INSTRUMENTS["MES"], Costs()
WINDOW, GRID = 20, [5, 10, 20, 40]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _r(names, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n.split('.')[-1]}" for n in names)


def bars_hourly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(event_bars(spark, d).select("symbol", "pos", "open", "high", "low", "close", "volume"))


def bars_daily(spark: SparkSession, d: str) -> DataFrame:
    return rounded(lineitem_bars(spark, d).select("symbol", "pos", "open", "high", "low", "close", "volume"))


def indicators_window(spark: SparkSession, d: str) -> DataFrame:
    df = f.rolling_volatility(f.obv(f.bollinger(lineitem_bars(spark, d), 20, 2.0)), 20, 252.0, "volatility")
    df = df.withColumns({"sma": f.sma("close", 20), "stoch_k": f.stochastic_k(14), "volume_z": F.try_divide(F.col("volume") - f.full(F.avg("volume"), F.col("volume"), 20), f.full(F.stddev_samp("volume"), F.col("volume"), 20))})
    return rounded(df.select("symbol", "pos", "sma", "bb_mid", "bb_upper", "bb_lower", "bb_percent_b", "obv", "stoch_k", "volatility", "volume_z"))


def indicators_recursive(spark: SparkSession, d: str) -> DataFrame:
    df = f.atr(f.macd(f.rsi(f.ema(event_bars(spark, d), "close", {"ema12": 12}))))
    return rounded(df.select("symbol", "pos", "ema12", "rsi", "macd", "macd_signal", "macd_hist", "atr"))


def frac_diff(spark: SparkSession, d: str) -> DataFrame:
    return rounded(event_bars(spark, d).select("symbol", "pos", f.frac_diff("close", 0.4, 1e-2).alias("fracdiff")))


def frac_diff_long(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars with some hundreds of weights, over blocks of positions."""
    return rounded(f.frac_diff_blocks(lineitem_bars(spark, d), "close", 0.4, 1e-4))


def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(f.build_features(lineitem_bars(spark, d), _FEATURES).drop("ts"))


_FEATURES = f.FeatureConfig(frac_threshold=1e-3)


def _log(spark: SparkSession, d: str, combos=((0, {"window": WINDOW}),)) -> DataFrame:
    return t.grid_trades(event_bars(spark, d), "donchian", list(combos), MES)


def donchian_trades(spark: SparkSession, d: str) -> DataFrame:
    log = t.apply_costs(_log(spark, d), COSTS, MES)
    return rounded(log.select("symbol", "entry_pos", "exit_pos", "side", "qty", "entry_px", "exit_px", "gross_pnl_usd", "commission_usd", "fees_usd", "spread_cost_usd", "slippage_usd", "net_pnl_usd"))


def donchian_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.metrics(t.apply_costs(_log(spark, d), COSTS, MES), ("symbol",)))


def ma_cross_positions(spark: SparkSession, d: str) -> DataFrame:
    raw = t.signal_over_grid(event_bars(spark, d), "ma_cross", [(0, {"fast": 5, "slow": 20, "vol_window": 10, "target": 0.5})])
    return rounded(t.causal(raw).select("symbol", "pos", "raw", "held"))


def delayed_fills(spark: SparkSession, d: str) -> DataFrame:
    bars = event_bars(spark, d)
    log = t.trades(t.causal(t.signal_over_grid(bars, "donchian", [(0, {"window": WINDOW})])), MES)
    return rounded(t.delayed_fill(log, bars, MES, 1).select("symbol", "entry_pos", "exit_pos", "side", "entry_px", "exit_px", "gross_pnl_usd"))


def event_path_trades(spark: SparkSession, d: str) -> DataFrame:
    held = t.causal(t.signal_over_grid(event_bars(spark, d), "ma_cross", [(0, {"fast": 5, "slow": 20, "vol_window": 10, "target": 0.5})]))
    return rounded(t.event_trades(held, MES, 3.0).select("symbol", "entry_pos", "exit_pos", "side", "qty", "entry_px", "exit_px", "gross_pnl_usd"))


def path_parity(spark: SparkSession, d: str) -> DataFrame:
    held = t.causal(t.signal_over_grid(event_bars(spark, d), "donchian", [(0, {"window": WINDOW})]))
    both = [t.apply_costs(log, COSTS, MES) for log in (t.trades(held, MES), t.event_trades(held, MES))]
    return rounded(t.parity(*both))


def sweep_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.sweep(spark, event_bars(spark, d), "donchian", [{"window": w} for w in GRID] + [{"window": 0}], COSTS, MES))


#: Windows of the wide sweep: 500 combinations.
WIDE = range(2, 502)


def sweep_wide(spark: SparkSession, d: str) -> DataFrame:
    return rounded(t.sweep(spark, event_bars(spark, d), "donchian", [{"window": w} for w in WIDE], COSTS, MES))


def sweep_best(spark: SparkSession, d: str) -> DataFrame:
    table = t.sweep(spark, event_bars(spark, d), "donchian", [{"window": w} for w in GRID], COSTS, MES)
    return table.filter("error = 0 AND n_trades > 0").orderBy(F.desc("sharpe_net"), "combo_id").limit(1).select("combo_id", F.round("sharpe_net", 6).alias("sharpe_net"))


def slice_matrix(spark: SparkSession, d: str) -> DataFrame:
    log = t.apply_costs(_log(spark, d, [(k, {"window": w}) for k, w in enumerate(GRID)]), COSTS, MES)
    size = event_bars(spark, d).agg(F.max("pos") + 1).first()[0]
    return rounded(t.slice_performance(log, list(range(len(GRID))), size, 8))


def account_equity(spark: SparkSession, d: str) -> DataFrame:
    log = t.apply_costs(_log(spark, d), COSTS, MES)
    eq = t.equity(log, 100_000.0, ("symbol",)).groupBy("symbol").agg(F.max("equity").alias("top"), F.sum("ret").alias("ret"))
    return rounded(eq.join(t.drawdowns(log, ("symbol",), 100_000.0), "symbol"))


QUERIES = {q.__name__: q for q in (bars_hourly, bars_daily, indicators_window, indicators_recursive, frac_diff, frac_diff_long, feature_matrix, donchian_trades, donchian_metrics, ma_cross_positions, delayed_fills, event_path_trades, path_parity, sweep_grid, sweep_wide, sweep_best, slice_matrix, account_equity)}

_W = "PARTITION BY symbol ORDER BY pos"


def _full(agg: str, x: str, n: int, least: int | None = None) -> str:
    over = f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} >= {n if least is None else least} THEN {agg}({x}) {over} END"


def _lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({_W})"


def _frac(d: float, threshold: float) -> str:
    w = f.ffd_weights(d, threshold)
    terms = ", ".join(repr(v) for v in reversed(w))
    over = f"OVER ({_W} ROWS BETWEEN {len(w) - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {over} >= {len(w)} THEN list_dot_product(list(close) {over}, [{terms}]) END"


def donchian_ctes(windows: list[int], bars: str = EVENT_SQL) -> str:
    """CTEs up to `held` (combo_id, symbol, pos, open, raw, held) and `log` (trades) for Donchian windows."""
    parts = " UNION ALL ".join(
        f"""SELECT {k} AS combo_id, symbol, pos, open, CASE WHEN count(close) OVER w >= {n} AND close > max(high) OVER w THEN 1.0
            WHEN count(close) OVER w >= {n} AND close < min(low) OVER w THEN -1.0 END AS change FROM bars
            WINDOW w AS ({_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"""
        for k, n in enumerate(windows)
    )
    return f"""bars AS ({bars}), changes AS ({parts}),
        {held_ctes()}"""


def wide_ctes(windows: range, bars: str = EVENT_SQL) -> str:
    """The same CTEs by one join of bars and windows, whose frames differ by row."""
    return f"""bars AS ({bars}), sizes AS (SELECT x - {windows.start} AS combo_id, x AS n FROM range({windows.start}, {windows.stop}) r(x)),
        every AS (SELECT combo_id, n, b.* FROM sizes CROSS JOIN bars b),
        changes AS (SELECT combo_id, symbol, pos, open, CASE WHEN count(close) OVER w >= n AND close > max(high) OVER w THEN 1.0 WHEN count(close) OVER w >= n AND close < min(low) OVER w THEN -1.0 END AS change
            FROM every WINDOW w AS (PARTITION BY combo_id, symbol ORDER BY pos ROWS BETWEEN n PRECEDING AND 1 PRECEDING)),
        {held_ctes()}"""


def held_ctes() -> str:
    return f"""raws AS (SELECT combo_id, symbol, pos, open, CAST(coalesce(last_value(change IGNORE NULLS) OVER (PARTITION BY combo_id, symbol ORDER BY pos ROWS UNBOUNDED PRECEDING), 0.0) AS DOUBLE) AS raw FROM changes),
        {trades_ctes()}"""


def trades_ctes() -> str:
    return """held AS (SELECT *, coalesce(lag(raw) OVER (PARTITION BY combo_id, symbol ORDER BY pos), 0.0) AS held FROM raws),
        marked AS (SELECT *, lag(held) OVER w AS before, max(pos) OVER (PARTITION BY combo_id, symbol) AS last_pos, last_value(open) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_open
            FROM held WINDOW w AS (PARTITION BY combo_id, symbol ORDER BY pos)),
        starts AS (SELECT *, coalesce(lead(pos) OVER w, last_pos) AS exit_pos, coalesce(lead(open) OVER w, last_open) AS exit_px FROM marked
            WHERE before IS NULL OR before <> held WINDOW w AS (PARTITION BY combo_id, symbol ORDER BY pos)),
        log AS (SELECT combo_id, symbol, pos AS entry_pos, exit_pos, CASE WHEN held > 0 THEN 'long' ELSE 'short' END AS side, abs(held) AS qty, open AS entry_px, exit_px,
            sign(held) * (exit_px - open) * 5.0 * abs(held) AS gross_pnl_usd FROM starts WHERE held <> 0 AND exit_pos > pos),
        priced AS (SELECT *, 0.3 * qty AS commission_usd, 0.72 * qty AS fees_usd, 1.25 * qty AS spread_cost_usd, 1.25 * qty AS slippage_usd, gross_pnl_usd - 3.52 * qty AS net_pnl_usd FROM log)"""


def event_ctes(qty: float) -> str:
    """CTEs up to `event_log`, the trades of runs of one sign of the rounded target, from `held`."""
    return f"""target AS (SELECT symbol, pos, open, round_even(held * {qty}, 0) AS target FROM held),
        marked2 AS (SELECT *, sign(target) AS sg, CASE WHEN lag(sign(target)) OVER ({_W}) = sign(target) THEN 0 ELSE 1 END AS fresh FROM target),
        runs AS (SELECT *, sum(fresh) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS run, max(pos) OVER (PARTITION BY symbol) AS last_pos, arg_max(open, pos) OVER (PARTITION BY symbol) AS last_open FROM marked2),
        grouped AS (SELECT symbol, run, min(pos) AS entry_pos, arg_min(open, pos) AS entry_px, max(abs(target)) AS qty, min(sg) AS sg, min(last_pos) AS last_pos, min(last_open) AS last_open FROM runs GROUP BY symbol, run),
        ended AS (SELECT *, coalesce(lead(entry_pos) OVER w, last_pos) AS exit_pos, coalesce(lead(entry_px) OVER w, last_open) AS exit_px FROM grouped WINDOW w AS (PARTITION BY symbol ORDER BY run)),
        event_log AS (SELECT symbol, entry_pos, exit_pos, CASE WHEN sg > 0 THEN 'long' ELSE 'short' END AS side, qty, entry_px, exit_px, sg * (exit_px - entry_px) * 5.0 * qty AS gross_pnl_usd FROM ended WHERE sg <> 0 AND exit_pos > entry_pos)"""


_SHARPE = "coalesce(CASE WHEN stddev_samp({x}) > 0 THEN avg({x}) / stddev_samp({x}) END, 0.0)"


def metrics_sql(keys: str) -> str:
    """CTEs flat and falls over `priced`, and their join."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    return f"""eq AS (SELECT {keys}, entry_pos, symbol AS s, sum(net_pnl_usd) OVER (PARTITION BY {keys} ORDER BY entry_pos, symbol ROWS UNBOUNDED PRECEDING) AS eq FROM priced),
        peaks AS (SELECT {keys}, eq, max(eq) OVER (PARTITION BY {keys} ORDER BY entry_pos, s ROWS UNBOUNDED PRECEDING) AS peak FROM eq),
        falls AS (SELECT {keys}, max(peak - eq) AS max_drawdown FROM peaks GROUP BY {keys}),
        flat AS (SELECT {keys}, count(*) AS n_trades, {_SHARPE.format(x="gross_pnl_usd")} AS sharpe_gross, {_SHARPE.format(x="net_pnl_usd")} AS sharpe_net,
            avg(CASE WHEN net_pnl_usd > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(net_pnl_usd) AS net_pnl FROM priced GROUP BY {keys}),
        combined AS (SELECT a.*, b.max_drawdown FROM flat a JOIN falls b ON {on})"""


_MA = f"""bars AS ({EVENT_SQL}), lr AS (SELECT *, ln(close / {_lag("close")}) AS log_ret FROM bars),
    raws AS (SELECT 0 AS combo_id, symbol, pos, open, coalesce(sign(fast - slow) * CASE WHEN vol = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, 0.5 / vol)) END, 0.0) AS raw FROM (
        SELECT symbol, pos, open, {_full("avg", "close", 5)} AS fast, {_full("avg", "close", 20)} AS slow, {_full("stddev_samp", "log_ret", 10)} AS vol FROM lr)),
    {trades_ctes()}"""

_WILDER = 1 / 14
_FOLD = lambda x, a: fold_sql(x, a, _W)
_RECURSIVE = f"""moves AS (SELECT *, greatest(close - {_lag("close")}, 0.0) AS up, greatest({_lag("close")} - close, 0.0) AS down,
        greatest(high - low, abs(high - {_lag("close")}), abs(low - {_lag("close")})) AS tr FROM bars),
    first AS (SELECT *, {_FOLD("close", 2 / 13)} AS ema12, {_FOLD("close", 2 / 27)} AS ema26, {_FOLD("tr", _WILDER)} AS atr_all FROM moves),
    later AS (SELECT symbol AS s2, pos AS p2, {_FOLD("up", _WILDER)} AS up_mean, {_FOLD("down", _WILDER)} AS down_mean FROM moves WHERE pos >= 1),
    second AS (SELECT first.*, up_mean, down_mean, ema12 - ema26 AS macd FROM first LEFT JOIN later ON symbol = s2 AND pos = p2),
    third AS (SELECT *, {_FOLD("macd", 0.2)} AS macd_signal, CASE WHEN pos >= 14 THEN CASE WHEN down_mean = 0 THEN 100.0 ELSE 100 - 100 / (1 + up_mean / down_mean) END END AS rsi,
        CASE WHEN pos >= 13 THEN atr_all END AS atr FROM second)"""

_BAR_COLUMNS = f"symbol, pos, {_r(['open', 'high', 'low', 'close', 'volume'])}"
_BOLL = f"""{_full("avg", "close", 20)} AS bb_mid, {_full("stddev_samp", "close", 20)} AS dev"""

def _sweep_sql(ctes: str, grid: str) -> str:
    return f"""WITH {ctes}, {metrics_sql('combo_id')},
        late AS (SELECT l.combo_id, CASE WHEN side = 'long' THEN 1.0 ELSE -1.0 END * (b.open - a.open) * 5.0 * qty - 3.52 * qty AS net
            FROM log l JOIN bars a ON a.symbol = l.symbol AND a.pos = l.entry_pos + 1 JOIN bars b ON b.symbol = l.symbol AND b.pos = l.exit_pos + 1),
        late_s AS (SELECT combo_id, {_SHARPE.format(x="net")} AS sharpe_delay1 FROM late GROUP BY combo_id),
        grid(combo_id, error) AS ({grid})
        SELECT CAST(g.combo_id AS BIGINT) AS combo_id, coalesce(n_trades, 0) AS n_trades, {", ".join(f"round(coalesce({m}, 0.0), 6) AS {m}" for m in t.METRICS if m != "n_trades")}, error
        FROM grid g LEFT JOIN combined c ON g.combo_id = c.combo_id LEFT JOIN late_s s ON g.combo_id = s.combo_id"""


SQL = {
    "bars_hourly": f"SELECT {_BAR_COLUMNS} FROM ({EVENT_SQL})",
    "bars_daily": f"SELECT {_BAR_COLUMNS} FROM ({DAILY_SQL})",
    "indicators_window": f"""WITH bars AS ({DAILY_SQL}), moves AS (SELECT *, ln(close / {_lag("close")}) AS lr, coalesce(sign(close - {_lag("close")}), 0.0) * volume AS signed FROM bars),
        made AS (SELECT *, {_BOLL}, sum(signed) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS obv, {_full("min", "low", 14)} AS lowest, {_full("max", "high", 14)} AS highest,
            {_full("stddev_samp", "lr", 20)} * sqrt(252.0) AS volatility, {_full("avg", "volume", 20)} AS vm, {_full("stddev_samp", "volume", 20)} AS vd FROM moves)
        SELECT symbol, pos, round(bb_mid, 6) AS sma, round(bb_mid, 6) AS bb_mid, round(bb_mid + 2.0 * dev, 6) AS bb_upper, round(bb_mid - 2.0 * dev, 6) AS bb_lower,
            round((close - (bb_mid - 2.0 * dev)) / nullif((bb_mid + 2.0 * dev) - (bb_mid - 2.0 * dev), 0), 6) AS bb_percent_b, round(obv, 6) AS obv,
            round(100 * ((close - lowest) / nullif(highest - lowest, 0)), 6) AS stoch_k, round(volatility, 6) AS volatility, round((volume - vm) / nullif(vd, 0), 6) AS volume_z FROM made""",
    "indicators_recursive": f"WITH bars AS ({EVENT_SQL}), {_RECURSIVE} SELECT symbol, pos, round(ema12, 6) AS ema12, round(rsi, 6) AS rsi, round(macd, 6) AS macd, round(macd_signal, 6) AS macd_signal, round(macd - macd_signal, 6) AS macd_hist, round(atr, 6) AS atr FROM third",
    "frac_diff": f"WITH bars AS ({EVENT_SQL}) SELECT symbol, pos, round({_frac(0.4, 1e-2)}, 6) AS fracdiff FROM bars",
    "frac_diff_long": f"WITH bars AS ({DAILY_SQL}) SELECT symbol, pos, round({_frac(0.4, 1e-4)}, 6) AS fracdiff FROM bars",
    "feature_matrix": f"""WITH bars AS ({DAILY_SQL}), {_RECURSIVE},
        fourth AS (SELECT *, ln(close / {_lag("close")}) AS lr, {_BOLL} FROM third),
        made AS (SELECT symbol, pos, close / {_lag("close", 1)} - 1 AS ret_1, close / {_lag("close", 5)} - 1 AS ret_5, close / {_lag("close", 10)} - 1 AS ret_10, close / {_lag("close", 21)} - 1 AS ret_21,
            rsi / 100 AS rsi, (macd - macd_signal) / close AS macd_hist_norm, (close - (bb_mid - 2.0 * dev)) / nullif((bb_mid + 2.0 * dev) - (bb_mid - 2.0 * dev), 0) AS bb_percent_b, atr / close AS atr_ratio,
            {_full("stddev_samp", "lr", 20)} * sqrt(252.0) AS realized_vol, (volume - {_full("avg", "volume", 20)}) / nullif({_full("stddev_samp", "volume", 20)}, 0) AS volume_z,
            close / ({_full("avg", "close", 50)}) - 1 AS dist_sma_fast, close / ({_full("avg", "close", 200)}) - 1 AS dist_sma_slow,
            close / ({_full("max", "close", 252, 60)}) - 1 AS dist_high_extreme, close / ({_full("min", "close", 252, 60)}) - 1 AS dist_low_extreme,
            (close - {_full("min", "low", 14)}) / nullif({_full("max", "high", 14)} - {_full("min", "low", 14)}, 0) AS stoch_k, {_frac(0.4, 1e-3)} AS fracdiff_close FROM fourth)
        SELECT symbol, pos, {_r(f.feature_names(_FEATURES))} FROM made""",
    "donchian_trades": f"WITH {donchian_ctes([WINDOW])} SELECT symbol, entry_pos, exit_pos, side, {_r(['qty', 'entry_px', 'exit_px', 'gross_pnl_usd', 'commission_usd', 'fees_usd', 'spread_cost_usd', 'slippage_usd', 'net_pnl_usd'])} FROM priced",
    "donchian_metrics": f"WITH {donchian_ctes([WINDOW])}, {metrics_sql('symbol')} SELECT symbol, n_trades, {_r(['sharpe_gross', 'sharpe_net', 'win_rate', 'net_pnl', 'max_drawdown'])} FROM combined",
    "ma_cross_positions": f"WITH {_MA} SELECT symbol, pos, round(raw, 6) AS raw, round(held, 6) AS held FROM held",
    "delayed_fills": f"""WITH {donchian_ctes([WINDOW])}
        SELECT l.symbol, a.pos AS entry_pos, b.pos AS exit_pos, side, round(a.open, 6) AS entry_px, round(b.open, 6) AS exit_px,
            round(CASE WHEN side = 'long' THEN 1.0 ELSE -1.0 END * (b.open - a.open) * 5.0 * qty, 6) AS gross_pnl_usd
        FROM log l JOIN bars a ON a.symbol = l.symbol AND a.pos = l.entry_pos + 1 JOIN bars b ON b.symbol = l.symbol AND b.pos = l.exit_pos + 1""",
    "event_path_trades": f"""WITH {_MA}, {event_ctes(3.0)}
        SELECT symbol, entry_pos, exit_pos, side, round(qty, 6) AS qty, round(entry_px, 6) AS entry_px, round(exit_px, 6) AS exit_px, round(gross_pnl_usd, 6) AS gross_pnl_usd FROM event_log""",
    "path_parity": f"""WITH {donchian_ctes([WINDOW])}, {event_ctes(1.0)},
        a AS (SELECT symbol, count(*) AS n, sum(net_pnl_usd) AS net FROM priced GROUP BY symbol), b AS (SELECT symbol, count(*) AS n, sum(gross_pnl_usd - 3.52 * qty) AS net FROM event_log GROUP BY symbol),
        m AS (SELECT symbol, coalesce(a.n, 0) AS an, coalesce(a.net, 0.0) AS anet, coalesce(b.n, 0) AS bn, coalesce(b.net, 0.0) AS bnet FROM a FULL JOIN b USING (symbol))
        SELECT symbol, an AS vector_trades, round(anet, 6) AS vector_net, bn AS event_trades, round(bnet, 6) AS event_net, abs(an - bn) AS trades_off, round(abs(anet - bnet), 6) AS net_off,
            abs(an - bn) <= an / 100.0 AND abs(anet - bnet) <= 1e-6 * greatest(1.0, abs(anet)) AS agree FROM m""",
    "sweep_grid": _sweep_sql(donchian_ctes(GRID), f"VALUES {', '.join(f'({k}, 0.0::DOUBLE)' for k in range(len(GRID)))}, ({len(GRID)}, 1.0::DOUBLE)"),
    "sweep_wide": _sweep_sql(wide_ctes(WIDE), f"SELECT k, 0.0::DOUBLE FROM range({len(WIDE)}) r(k)"),
    "sweep_best": f"WITH {donchian_ctes(GRID)}, {metrics_sql('combo_id')} SELECT CAST(combo_id AS BIGINT) AS combo_id, round(sharpe_net, 6) AS sharpe_net FROM combined ORDER BY combined.sharpe_net DESC, combo_id LIMIT 1",
    "slice_matrix": f"""WITH {donchian_ctes(GRID)}, edges AS (SELECT k AS slice_id, CAST(trunc(size * k / 8.0) AS BIGINT) AS lo, CAST(trunc(size * (k + 1) / 8.0) AS BIGINT) AS hi FROM range(8) r(k) CROSS JOIN (SELECT max(pos) + 1 AS size FROM bars)),
        configs AS (SELECT c AS config_id FROM range({len(GRID)}) r(c)),
        got AS (SELECT combo_id, slice_id, avg(net_pnl_usd) AS perf FROM priced JOIN edges ON entry_pos >= lo AND entry_pos < hi GROUP BY 1, 2)
        SELECT config_id, CAST(e.slice_id AS INTEGER) AS slice_id, round(coalesce(perf, 0.0), 6) AS perf FROM configs c CROSS JOIN edges e LEFT JOIN got g ON g.combo_id = c.config_id AND g.slice_id = e.slice_id""",
    "account_equity": f"""WITH {donchian_ctes([WINDOW])}, eq AS (SELECT symbol, entry_pos, net_pnl_usd, 100000.0 + sum(net_pnl_usd) OVER (PARTITION BY symbol ORDER BY entry_pos ROWS UNBOUNDED PRECEDING) AS eq FROM priced),
        peaks AS (SELECT *, max(eq) OVER (PARTITION BY symbol ORDER BY entry_pos ROWS UNBOUNDED PRECEDING) AS peak FROM eq)
        SELECT symbol, round(max(eq), 6) AS top, round(sum(net_pnl_usd / 100000.0), 6) AS ret, round(max(CASE WHEN peak > 0 THEN (peak - eq) / peak ELSE 0.0 END), 6) AS max_drawdown FROM peaks GROUP BY symbol""",
}
