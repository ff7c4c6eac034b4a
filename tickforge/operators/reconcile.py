"""Reconciliation of broker and local records, netting of fills, and the ordering of live risk checks in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_discrepancies(broker: DataFrame, local: DataFrame) -> DataFrame:
    """(fill_id, kind, instrument): fills of one side alone, by two anti joins."""
    missing = broker.join(local.select("fill_id"), "fill_id", "left_anti").select("fill_id", F.lit("missing_locally").alias("kind"), "instrument")
    extra = local.join(broker.select("fill_id"), "fill_id", "left_anti").select("fill_id", F.lit("unknown_to_broker").alias("kind"), "instrument")
    return missing.union(extra)


def position_discrepancies(broker: DataFrame, local: DataFrame) -> DataFrame:
    """(instrument, broker_qty, local_qty) that differ. Zero positions count as none; the broker is right."""
    side = lambda df, name: df.filter("qty <> 0").groupBy("instrument").agg(F.sum("qty").alias(name))
    met = side(broker, "broker_qty").join(side(local, "local_qty"), "instrument", "full_outer").na.fill(0, ["broker_qty", "local_qty"])
    return met.filter("broker_qty <> local_qty")


def reconcile(broker_fills: DataFrame, local_fills: DataFrame, broker: DataFrame, local: DataFrame) -> DataFrame:
    """All discrepancies as (kind, ref, detail); in sync if there are none."""
    fills = fill_discrepancies(broker_fills, local_fills).select("kind", F.col("fill_id").cast("string").alias("ref"), "instrument")
    places = position_discrepancies(broker, local).select(F.lit("position").alias("kind"), F.col("instrument").alias("ref"), F.concat_ws(" ", F.lit("broker"), "broker_qty", F.lit("local"), "local_qty").alias("instrument"))
    return fills.union(places).withColumnRenamed("instrument", "detail")


#: Fills of a block on average.
FILLS = 4096


def _fold(state: Column, fill: Column) -> Column:
    """One fill after others: the position, the average price as a A + B of the price a before them, the profit as W + V a."""
    pos, q, px = state["pos"], fill["qty"], fill["price"]
    now = pos + q
    more, stays = (pos == 0) | (F.signum(pos) == F.signum(q)), F.signum(now) == F.signum(pos)
    a = F.when(more, F.coalesce(F.try_divide(pos, now), F.lit(0.0))).when(stays, 1.0).otherwise(0.0)
    b = F.when(more, F.coalesce(F.try_divide(q * px, now), F.lit(0.0))).when(stays | (now == 0), 0.0).otherwise(px)
    closed = F.when(more, 0.0).otherwise(F.least(F.abs(q), F.abs(pos)) * F.signum(pos))
    return F.struct(now.alias("pos"), (a * state["A"]).alias("A"), (a * state["B"] + b).alias("B"), (state["W"] + closed * (px - state["B"])).alias("W"), (state["V"] - closed * state["A"]).alias("V"))


def net_positions(fills: DataFrame, block: int = FILLS) -> DataFrame:
    """(instrument, qty, avg_px, realized) of signed fills (instrument, seq, qty, price): a fill in the position's direction
    moves the average price, one against it realizes, and what passes zero opens anew.

    A fill changes the average price by an affine map that the position before and after it fixes, and realizes what is affine in that
    price. So fills are cut into blocks of seq (of about `block` fills where seq numbers all fills); sums by block give the position before
    each, a block's fills are folded into one map, and an instrument's maps, one a block, are applied in order. One instrument uses as
    many tasks as it has blocks, and everything runs in expressions."""
    rows = fills.select("instrument", F.col("seq").cast("long").alias("seq"), F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price")).filter("qty <> 0")
    low, high, n = rows.agg(F.min("seq"), F.max("seq"), F.count("*")).first()
    width = max(1, int(block * ((high or 0) - (low or 0) + 1) / max(1, n)))
    rows = rows.withColumn("block", F.floor((F.col("seq") - F.lit(low or 0)) / F.lit(width)))
    before = Window.partitionBy("instrument").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("instrument", "block").agg(F.sum("qty").alias("sum"))
    starts = sums.select(F.col("instrument").alias("_of"), F.col("block").alias("_at"), F.coalesce(F.sum("sum").over(before), F.lit(0.0)).alias("start"))
    lists = rows.groupBy("instrument", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "qty", "price"))).alias("fills"))
    met = lists.join(starts, lists["instrument"].eqNullSafe(starts["_of"]) & (lists["block"] == starts["_at"]))
    one, none = F.lit(1.0), F.lit(0.0)
    maps = met.select("instrument", "block", F.aggregate("fills", F.struct(F.col("start").alias("pos"), one.alias("A"), none.alias("B"), none.alias("W"), none.alias("V")), _fold).alias("map"))
    through = lambda s, m: F.struct(m["map"]["pos"].alias("pos"), (m["map"]["A"] * s["avg"] + m["map"]["B"]).alias("avg"), (s["won"] + m["map"]["W"] + m["map"]["V"] * s["avg"]).alias("won"))
    got = maps.groupBy("instrument").agg(F.sort_array(F.collect_list(F.struct("block", "map"))).alias("maps")).select("instrument", F.aggregate("maps", F.struct(none.alias("pos"), none.alias("avg"), none.alias("won")), through).alias("s"))
    return got.select("instrument", F.col("s.pos").alias("qty"), F.col("s.avg").alias("avg_px"), F.col("s.won").alias("realized"))


def mark_to_market(positions: DataFrame, closes: DataFrame, balance: float, multiplier: float) -> DataFrame:
    """(instrument, equity): balance with realized and open profit at the close."""
    open_ = (F.col("close") - F.col("avg_px")) * F.col("qty")
    return positions.join(closes.select("instrument", "close"), "instrument").select("instrument", (F.lit(balance) + (F.col("realized") + open_) * multiplier).alias("equity"))


def simulate_fills(orders: DataFrame, bars: DataFrame, delay: int = 1) -> DataFrame:
    """(order_id, status, fill_px) of orders (order_id, symbol, pos, side, qty, type, limit_px, stop_px) against the bar `delay`
    on: a market order fills at its open; a limit or stop one at its price if the bar's range holds it. Orders without such a
    bar or with a quantity that isn't positive are rejected."""
    later = bars.select("symbol", (F.col("pos") - delay).alias("pos"), "open", "high", "low")
    met = orders.join(later, ["symbol", "pos"], "left")
    trigger = F.coalesce(F.when(F.col("type") == "limit", F.col("limit_px")), F.when(F.col("type") == "stop", F.col("stop_px")))
    px = F.when((F.col("qty") <= 0) | F.col("open").isNull(), None).when(F.col("type") == "market", F.col("open")).when((trigger >= F.col("low")) & (trigger <= F.col("high")), trigger)
    return met.select("order_id", F.when(px.isNotNull(), "filled").otherwise("rejected").alias("status"), px.alias("fill_px"))


def order_rate(df: DataFrame, key: str, ts: str = "ts", seconds: int = 60) -> DataFrame:
    """n: the key's rows in the last minute, its own included, the row exactly a minute before excluded."""
    span = seconds * 1_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    # A row comes where it happens and, once more, where it leaves the window, a span later: all that a stretch of one span needs, so that
    # its counts are running sums, and a key uses as many tasks as it has stretches.
    both = F.array(F.struct(at.alias("at"), F.lit(1).alias("come")), F.struct((at + span).alias("at"), F.lit(0).alias("come")))
    rows = df.withColumn("_e", F.explode(both)).withColumn("_part", F.col("_e.at") - F.pmod("_e.at", F.lit(span)))
    part = Window.partitionBy(key, "_part")
    left = 1 - F.col("_e.come")
    so_far = F.sum(F.col("_e.come") - left).over(part.orderBy("_e.at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("n", F.sum(left).over(part) + so_far).filter("_e.come = 1").select(*df.columns, "n")


def flatten_orders(positions: DataFrame) -> DataFrame:
    """A market order against each open position."""
    return positions.filter("qty <> 0").select("instrument", F.when(F.col("qty") > 0, "sell").otherwise("buy").alias("side"), F.abs("qty").alias("qty"), F.lit("market").alias("type"), F.lit(True).alias("is_automated"))


#: Order of the checks of an order; the first that fails decides.
CHECKS = ("disconnected", "halted", "stale_data", "order_rate", "daily_loss", "trailing_drawdown", "sizing")


def approve(df: DataFrame, limits) -> DataFrame:
    """approved and reason (null or the first failing check) of orders with the account's state beside them: connected, halted,
    tick_age (null: never), rate (orders in the last minute before this), day_pnl, equity, floor, position, qty."""
    stop = limits.daily_loss - limits.daily_loss_buffer
    fails = [
        ~F.col("connected"), F.col("halted"), F.col("tick_age").isNull() | (F.col("tick_age") > limits.stale_seconds), F.col("rate") >= limits.orders_per_minute,
        F.col("day_pnl") <= -stop, F.col("equity") <= F.col("floor") + limits.trailing_margin, F.abs(F.col("position") + F.col("qty")) > limits.max_contracts,
    ]
    reason = F.lit(None).cast("string")
    for name, c in reversed(list(zip(CHECKS, fails, strict=True))):
        reason = F.when(F.coalesce(c, F.lit(True)), name).otherwise(reason)
    return df.withColumn("reason", reason).withColumn("approved", F.col("reason").isNull())


def rolling_monitor(fills: DataFrame, window: int = 50, least: int = 20) -> DataFrame:
    """Over the last `window` of each strategy's fills (strategy, seq, slippage_usd, pnl_usd): mean absolute slippage, and the
    Sharpe ratio by population deviation (null with fewer than `least`, 0 without deviation)."""
    w = Window.partitionBy("strategy").orderBy("seq").rowsBetween(-(window - 1), 0)
    n = F.count("*").over(w)
    ratio = F.coalesce(F.try_divide(F.avg("pnl_usd").over(w), F.nullif(F.stddev_pop("pnl_usd").over(w), F.lit(0.0))), F.lit(0.0))
    return fills.withColumns({"n": n, "mean_slippage": F.avg(F.abs("slippage_usd")).over(w), "sharpe": F.when(n >= least, ratio)})


def dedupe_orders(orders: DataFrame) -> DataFrame:
    """The first order (by seq) of each client_order_id."""
    w = Window.partitionBy("client_order_id").orderBy("seq")
    return orders.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
