"""Queries of snapshots, vendor files, trials, resampling, brokers and orders, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from ..config import PRESETS, config_hash
from ..functions.normal import NORMAL_SQL
from ..operators import account, labels, metamodel, reconcile, statistics, stitch
from ..operators import trading as t
from ..operators.features import periods_per_year
from ..operators.order import dense_index
from ..session import new_path
from ..sources import snapshots, vendors
from ..sources.bars import DAILY_SQL, EVENT_SQL, event_bars, lineitem_bars, resample, union_bars
from ..sources.trials import TrialStore
from ..streaming import brokers, live, submit
from . import market, research, validation
from .backtest import Strategy, event_log
from .market import GRID, MES, WINDOW, _SHARPE, donchian_ctes, event_ctes, rounded
from .validation import COSTS, _contracts, _indexed, _priced, _stitched_sql, _table

_BARS = ("symbol", "pos", "open", "high", "low", "close", "volume")


# Snapshots ------------------------------------------------------------------------------------------------------------------


def _meta(root: str, interval: str, span: tuple, grade: bool = True) -> snapshots.SnapshotMeta:
    return snapshots.SnapshotMeta(root, "events", interval, str(span[0]), str(span[1]), grade, "now", continuous={"roll_rule": "volume", "adjustment": "none", "roll_dates": [], "underlying_contracts": [root]} if grade else None)


def snapshot_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Bars saved under their content hash and loaded again; saving them twice, or with another order of rows, is refused."""
    store, bars = snapshots.SnapshotStore(spark, new_path(spark, "snapshots")), event_bars(spark, d)
    digest = store.save(bars, _meta("EV", "1h", ("a", "b")))
    try:
        store.save(bars.repartition(7, "close"), _meta("EV", "1h", ("a", "b")))
        raise AssertionError("a snapshot was written twice")
    except snapshots.SnapshotExistsError:
        pass
    back, meta = store.load(digest)
    snapshots.require_validation_grade(meta)
    return rounded(back.select(*_BARS))


def snapshot_listing(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot for each symbol, listed from their records alone."""
    store, bars = snapshots.SnapshotStore(spark, new_path(spark, "snapshots")), event_bars(spark, d)
    for r in bars.groupBy("symbol").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect():
        span = tuple(x.strftime("%Y-%m-%d %H") for x in (r["lo"], r["hi"]))
        store.save(bars.filter(F.col("symbol") == r["symbol"]), _meta(r["symbol"], "1h", span, r["symbol"] != "view"))
    return spark.createDataFrame([(m.symbol_root, m.start, m.end, m.validation_grade) for m in store.list()], "symbol string, first string, last string, validation_grade boolean")


def snapshot_union(spark: SparkSession, d: str) -> DataFrame:
    """Bars in two parts by time, put together; a bar that both have would raise."""
    bars = event_bars(spark, d).drop("pos")
    cut = F.dayofmonth("ts") <= 12
    return rounded(union_bars([bars.filter(cut), bars.filter(~cut).drop("open_interest")]).select("symbol", F.unix_seconds("ts").alias("at"), "open", "high", "low", "close", "volume"))


def synthetic_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a synthetic snapshot that has as many bars as there are events: its bars by session, and how many hold together."""
    store = snapshots.SnapshotStore(spark, new_path(spark, "snapshots"))
    bars, _ = store.load(snapshots.synthetic_snapshot(store, _table(spark, d, "events").count(), 3))
    whole = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close")) & (F.col("low") > 0)
    return bars.groupBy(F.floor(F.col("pos") / snapshots.SESSION).alias("session")).agg(F.count("*").alias("n"), F.sum(whole.cast("long")).alias("whole"), F.unix_seconds(F.min("ts")).alias("first"), F.unix_seconds(F.max("ts")).alias("last"))


def reference_bars(spark: SparkSession, d: str) -> DataFrame:
    """The closed-form history of as many business days as have line items."""
    days = _table(spark, d, "lineitem").select(F.to_date("l_shipdate")).distinct().count()
    return rounded(snapshots.reference_history(spark, days).select("pos", F.date_format("ts", "yyyy-MM-dd").alias("day"), "open", "high", "low", "close", "volume"))


# Vendor files ------------------------------------------------------------------------------------------------------------------


def _definitions(spark: SparkSession, d: str) -> DataFrame:
    """Contract definitions of the events' types: known from the first event on (one of them doesn't say), expired with the last."""
    nanos = lambda c: F.unix_micros(c.cast("timestamp")) * 1000
    e = _table(spark, d, "events").groupBy("event_type").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return e.select(F.col("event_type").alias("raw_symbol"), F.crc32(F.col("event_type").cast("binary")).alias("instrument_id"), F.when(F.col("event_type") != "view", nanos(F.col("lo"))).alias("activation"), nanos(F.col("hi")).alias("expiration"))


def vendor_fixed_point(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars of all symbols as records in units of 1e-9, a line each, read by the instruments' definitions."""
    at, bars = new_path(spark, "records"), event_bars(spark, d)
    _definitions(spark, d).write.json(f"{at}/definitions")
    raw = bars.select((F.unix_micros("ts") * 1000).alias("ts_event"), F.lit(34).alias("rtype"), F.crc32(F.col("symbol").cast("binary")).alias("instrument_id"), *(F.round(F.col(c) * 1e9).cast("long").alias(c) for c in ("open", "high", "low", "close")), F.col("volume").cast("long").alias("volume"))
    raw.write.json(f"{at}/records")
    got = vendors.read_fixed_point(spark, f"{at}/records", vendors.read_definitions(spark, f"{at}/definitions", lines=True), lines=True)
    return rounded(got.select("symbol", F.unix_seconds("ts").alias("at"), "open", "high", "low", "close", "volume"))


def vendor_definitions(spark: SparkSession, d: str) -> DataFrame:
    at = new_path(spark, "definitions")
    _definitions(spark, d).write.json(at)
    return vendors.read_definitions(spark, at, lines=True).select("symbol", F.date_format("expiry", "yyyy-MM-dd").alias("expiry"), F.date_format("first_trade", "yyyy-MM-dd").alias("first_trade"))


def _daily_files(spark: SparkSession, d: str, last: str, at: str) -> str:
    """Daily bars of all symbols as named columns, in a folder for each symbol."""
    bars = lineitem_bars(spark, d)
    more = [(F.col("pos") + 1).cast("double").alias("Open Interest")] if last == "Open Interest" else []
    dev = [] if more else [F.col("close").alias("Adj Close")]
    bars.select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("Date"), *(F.col(c.lower()).alias(c) for c in ("Open", "High", "Low", "Close")), *dev, F.col("volume").alias("Volume"), *more).write.partitionBy("symbol").csv(at, header=True)
    return at


def vendor_daily(spark: SparkSession, d: str) -> DataFrame:
    at = _daily_files(spark, d, "Open Interest", new_path(spark, "daily"))
    return rounded(vendors.read_daily_csv(spark, at, None).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), "open", "high", "low", "close", "volume", "open_interest"))


def vendor_development(spark: SparkSession, d: str) -> DataFrame:
    at = _daily_files(spark, d, "Volume", new_path(spark, "dev"))
    return rounded(vendors.read_dev_csv(spark, at, None).select("symbol", F.date_format("ts", "yyyy-MM-dd").alias("day"), "open", "high", "low", "close", "volume", "validation_grade"))


def fetched_series(spark: SparkSession, d: str) -> DataFrame:
    """Contract files of a provider, fetched, stitched and saved as one snapshot, which is loaded."""
    root = new_path(spark, "provider")
    bars, listed = _contracts(spark, d)
    for k in range(1, 8):
        own = bars.filter(F.col("contract") == str(k)).select(F.date_format("ts", "yyyy-MM-dd").alias("Date"), *(F.col(c.lower()).alias(c) for c in ("Open", "High", "Low", "Close", "Volume")), F.lit(1.0).alias("Open Interest"))
        own.write.csv(f"{root}/{k}.csv", header=True)
    listed.select("symbol", F.col("expiry").alias("expiration"), F.lit(None).cast("date").alias("first_trade")).coalesce(1).write.csv(f"{root}/contracts.csv", header=True)
    store = snapshots.SnapshotStore(spark, new_path(spark, "snapshots"))
    digest = vendors.fetch_snapshot(vendors.FileProvider(spark, root), store, "", "1990-01-01", "2010-01-01", "1d", "calendar", "ratio", "files", "now")
    return rounded(store.load(digest)[0].select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "open", "high", "low", "close", "volume"), 4)


def roll_dates_open_interest(spark: SparkSession, d: str) -> DataFrame:
    li = _table(spark, d, "lineitem").select("l_linenumber", "l_shipdate", "l_extendedprice", "l_quantity", "l_orderkey")
    symbol = F.col("l_linenumber").cast("string")
    bars = resample(li, symbol, F.col("l_shipdate"), F.col("l_extendedprice"), "day", [F.col("l_orderkey")], F.col("l_quantity"))
    interest = li.groupBy(symbol.alias("symbol"), F.date_trunc("day", "l_shipdate").alias("ts")).agg(F.sum(F.col("l_orderkey") % 97).cast("double").alias("open_interest"))
    bars = bars.join(interest, ["symbol", "ts"]).withColumnRenamed("symbol", "contract")
    got = stitch.rolls(stitch.checked(bars, stitch.ordered(_contracts(spark, d)[1])), "open_interest", 3)
    return rounded(got.select(F.col("seq").cast("long").alias("seq"), F.date_format("roll_ts", "yyyy-MM-dd").alias("day"), "front_close", "back_close"))


# Trials ------------------------------------------------------------------------------------------------------------------------


def _trials(spark: SparkSession, d: str) -> TrialStore:
    store = TrialStore(spark, new_path(spark, "trials"))
    counts = _table(spark, d, "events").groupBy("event_type").count().orderBy("event_type").collect()
    for family in ("a", "b"):
        store.append([{"trial_id": f"{family}-{r['event_type']}", "run_id": "r", "strategy_family": family, "config_hash": config_hash("FE-TRIALCFG-v1", {"params": {"of": r["event_type"]}, "signal": family}), "params": {"of": r["event_type"]}, "cv_scheme": "none", "metrics": {"n": float(r["count"])}} for r in counts])
    return store


def trial_list(spark: SparkSession, d: str) -> DataFrame:
    """Trials in the order they were added, with their configurations' hashes; a trial that is there already is refused."""
    store = _trials(spark, d)
    try:
        store.append([store.all("b").first().asDict() | {"params": {}}])
        raise AssertionError("a trial was added twice")
    except ValueError:
        pass
    return store.all().select("id", "trial_id", "strategy_family", "config_hash", "params", F.col("metrics")["n"].alias("n"))


def trial_counts(spark: SparkSession, d: str) -> DataFrame:
    """How many trials each family has, and the hash of its list."""
    store = _trials(spark, d)
    return spark.createDataFrame([(f, store.count(f), store.count(), store.list_hash(f)) for f in ("a", "b")], "strategy_family string, n long, n_all long, list_hash string")


# Trades and statistics -----------------------------------------------------------------------------------------------------------


def normalized_sides(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "LONG").when(F.col("o_orderkey") % 3 == 1, "Short").otherwise("long").alias("side"))
    return t.sides(o)


def sampled_events(spark: SparkSession, d: str) -> DataFrame:
    return labels.sample_events(event_bars(spark, d), 50, F.col("pos") >= 10).select("symbol", "pos")


def trades_a_day(spark: SparkSession, d: str) -> DataFrame:
    log = _table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("exit_ts"))
    return spark.createDataFrame([(account.trades_per_day(log), account.trades_per_day(log.filter("false")))], "per_day int, without int")


def gross_difference(spark: SparkSession, d: str) -> DataFrame:
    """Trades of the vector path against those of the event path with two contracts."""
    bars = event_bars(spark, d)
    held = t.causal(t.signal_over_grid(bars, "donchian", [(0, {"window": WINDOW})]))
    return rounded(statistics.gross_reconciliation(t.trades(held, MES), t.event_trades(held, MES, 2.0), ("symbol", "entry_pos")))


def event_backtest(spark: SparkSession, d: str) -> DataFrame:
    """Net trades of the event path, on time and a bar late."""
    bars, s = event_bars(spark, d), Strategy("donchian", {"window": WINDOW}, 3)
    both = [event_log(bars, s, COSTS, "MES", k).withColumn("delay", F.lit(k)) for k in (0, 1)]
    return rounded(both[0].unionByName(both[1]).select("delay", "symbol", "entry_pos", "exit_pos", "side", "qty", "entry_px", "exit_px", "gross_pnl_usd", "net_pnl_usd"))


def sweep_tested(spark: SparkSession, d: str) -> DataFrame:
    """A sweep that counts only the trades that enter in the second third of positions."""
    bars = event_bars(spark, d)
    last = bars.agg(F.max("pos")).first()[0]
    inside = bars.filter(F.col("pos").between(last // 3, 2 * (last // 3)))
    table = t.sweep(spark, bars, "donchian", [{"window": w} for w in GRID], COSTS, MES, inside)
    return rounded(table.select("combo_id", "n_trades", "net_pnl", "sharpe_net"))


def sharpe_errors(spark: SparkSession, d: str) -> DataFrame:
    m = statistics.moments("net_pnl_usd", (None, None))
    flat = _priced(spark, d, GRID).groupBy("combo_id").agg(t.sharpe("net_pnl_usd").alias("sharpe"), *(m[k].alias(k) for k in ("n", "skew", "kurt")))
    return rounded(flat.select("combo_id", statistics.sharpe_error(F.col("sharpe"), F.col("n"), F.col("skew"), F.col("kurt")).alias("error")))


def meta_features(spark: SparkSession, d: str) -> DataFrame:
    bars = event_bars(spark, d)
    primary = t.signal_over_grid(bars, "donchian", [(0, {"window": WINDOW})]).select("symbol", "pos", "raw")
    rows = metamodel.meta_features(bars, primary).na.drop(subset=metamodel.FEATURES)
    return rounded(rows.select("symbol", "pos", *metamodel.FEATURES))


def annual_periods(spark: SparkSession, d: str) -> DataFrame:
    """Bars a year by symbol, each read as another interval."""
    kinds = ["1m", "5m", "15m", "1h", "1d"]
    e = _table(spark, d, "events").select("event_type").distinct()
    return dense_index(e, F.lit(0), ["event_type"]).select(F.col("event_type").alias("symbol"), F.element_at(F.array(*(F.lit(periods_per_year(k)) for k in kinds)), (F.col("idx") % 5 + 1).cast("int")).alias("per_year"))


def bad_intervals(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with intervals of orders that end at the commit date of their first line."""
    from ..operators import crossval

    o, li = _table(spark, d, "orders"), _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship"))
    met = o.join(li, o["o_orderkey"] == li["l_orderkey"])
    rows = dense_index(met, F.floor(F.col("o_orderkey") / 4096), ["o_orderkey"], "pos").select("pos", F.to_date("o_orderdate").alias("t0"), F.to_date("ship").alias("t1"))
    return crossval.interval_problems(rows)


def resampled_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Circular blocks of trades whose starts are arithmetic, so that SQL can follow."""
    log = _indexed(_priced(spark, d, [WINDOW])).select("idx", "net_pnl_usd")
    n = log.count()
    return rounded(account.resample(log, n, 20, 30, 7, 1, _starts(n, 7)).select("path_id", "at", "net_pnl_usd"))


def _starts(n: int, block: int):
    return F.pmod(F.col("path_id") * 7919 + F.floor(F.col("at") / block) * 104729 + 7, F.lit(n))


def survival_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    """Survival by contracts over paths of blocks whose starts are arithmetic."""
    log = _indexed(_priced(spark, d, [WINDOW]))
    got = account.survival(log, PRESETS["topstep_50k"], 100, 20, 7, [1.0, 3.0, 9.0], 5, _starts(log.count(), 5))
    return rounded(got.select("contracts", "n_paths", "p_survival", "p_target", "median_days_to_target", "ci_lo", "ci_hi"))


def autocovariance(spark: SparkSession, d: str) -> DataFrame:
    log = _indexed(_priced(spark, d, [5]))
    n, cov = account.autocovariances(log, span=64, lags=12)
    return rounded(spark.createDataFrame([(k, n, float(v)) for k, v in enumerate(cov)], "lag long, n long, cov double"), 4)


# Orders and brokers --------------------------------------------------------------------------------------------------------------


def _fills(spark: SparkSession, d: str) -> DataFrame:
    o = _table(spark, d, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("instrument"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderpriority") < "3", 2.0).otherwise(-1.0).alias("qty"), F.col("o_totalprice").alias("price"))


def simulated_fills(spark: SparkSession, d: str) -> DataFrame:
    bars, e = event_bars(spark, d), _table(spark, d, "events")
    k = F.col("event_id")
    orders = e.select(
        k.alias("order_id"), F.col("event_type").alias("symbol"), (k % 700).alias("pos"), F.lit("buy").alias("side"), (k % 5).cast("int").alias("qty"),
        F.when(k % 3 == 0, "market").when(k % 3 == 1, "limit").otherwise("stop").alias("type"), (F.col("value") / 2).alias("limit_px"), (F.col("value") * 3).alias("stop_px"),
    )
    return rounded(reconcile.simulate_fills(orders, bars))


def marked_positions(spark: SparkSession, d: str) -> DataFrame:
    positions = reconcile.net_positions(_fills(spark, d))
    closes = _fills(spark, d).groupBy("instrument").agg(F.max("price").alias("close"))
    return rounded(reconcile.mark_to_market(positions, closes, 1000.0, 5.0), 4)


def flattening_orders(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.flatten_orders(reconcile.net_positions(_fills(spark, d))).select("instrument", "side", F.round("qty", 6).alias("qty"), "type", "is_automated")


def _orders(df: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    return df.select(k.cast("string").alias("client_order_id"), F.col("o_custkey").cast("string").alias("instrument"), F.when(k % 2 == 0, "buy").otherwise("sell").alias("side"), (k % 7 + 1).cast("int").alias("qty"), F.when(k % 3 == 0, "market").when(k % 3 == 1, "limit").otherwise("stop").alias("type"),
        F.when(k % 3 == 1, F.col("o_totalprice")).alias("limit_px"), F.when(k % 3 == 2, F.col("o_totalprice")).alias("stop_px"), F.lit(True).alias("is_automated"))


def broker_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as two brokers' JSON, some fields of which are read back."""
    orders, out = _orders(_table(spark, d, "orders")), None
    for name, paths in (("tradovate", ("clOrdId", "action", "orderQty", "price", "stopPrice")), ("projectx", ("customTag", "side", "size", "limitPrice", "stopPrice"))):
        field = lambda c: F.get_json_object("body", f"$.{c}")
        got = brokers.codec(name).orders(orders, 42, "acct").select(F.lit(name).alias("broker"), field(paths[0]).alias("id"), field(paths[1]).alias("side"), field(paths[2]).cast("int").alias("qty"), *(F.round(field(c).cast("double"), 4).alias(n) for c, n in zip(paths[3:], ("limit_px", "stop_px"), strict=True)), field("isAutomated").alias("automated"), field("accountId").alias("account"))
        out = got if out is None else out.unionByName(got)
    return out


def broker_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers of two brokers, every fifth a refusal."""
    k = F.col("o_orderkey")
    no, out = k % 5 == 0, None
    bodies = {
        "tradovate": F.when(no, F.to_json(F.struct(F.lit("Rejected").alias("failureReason"), F.concat(F.lit("no "), k).alias("failureText")))).otherwise(F.to_json(F.struct((k * 10).alias("orderId")))),
        "projectx": F.when(no, F.to_json(F.struct(F.lit(False).alias("success"), F.concat(F.lit("no "), k).alias("errorMessage")))).otherwise(F.to_json(F.struct(F.lit(True).alias("success"), (k * 10).alias("orderId")))),
    }
    for name, body in bodies.items():
        got = brokers.codec(name).acks(_table(spark, d, "orders").select(k.cast("string").alias("client_order_id"), body.alias("body"))).withColumn("broker", F.lit(name))
        out = got if out is None else out.unionByName(got)
    return out.select("broker", "client_order_id", "accepted", "reason", "order_id")


def broker_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions of customers as two brokers state them."""
    net = _fills(spark, d).groupBy("instrument").agg(F.sum("qty").cast("int").alias("qty"), F.max("price").alias("px"))
    a = net.select(F.to_json(F.struct(F.col("instrument").alias("symbol"), F.col("qty").alias("netPos"), F.col("px").alias("netPrice"))).alias("body"))
    b = net.select(F.to_json(F.struct(F.col("instrument").alias("contractId"), F.when(F.col("qty") > 0, 1).otherwise(2).alias("type"), F.abs("qty").alias("size"), F.col("px").alias("averagePrice"))).alias("body"))
    both = [brokers.codec(n).open_positions(x).withColumn("broker", F.lit(n)) for n, x in (("tradovate", a), ("projectx", b))]
    return rounded(both[0].unionByName(both[1]).select("broker", "instrument", "qty", "avg_px"), 4)


def broker_accounts(spark: SparkSession, d: str) -> DataFrame:
    c = _table(spark, d, "customer")
    a = c.select(F.to_json(F.struct(F.col("c_acctbal").alias("cashBalance"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") / 4).alias("totalPnL"))).alias("body"))
    b = c.select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))).alias("body"))
    both = [brokers.codec(n).balances(x).withColumn("broker", F.lit(n)) for n, x in (("tradovate", a), ("projectx", b))]
    return rounded(both[0].unionByName(both[1]).groupBy("broker").agg(F.count("*").alias("n"), F.sum("balance").alias("balance"), F.sum("equity").alias("equity")), 3)


def quote_ticks(spark: SparkSession, d: str) -> DataFrame:
    """Events as quote frames, read back as ticks."""
    quote = F.struct(F.col("user_id").alias("contractId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.struct(F.struct(F.col("value").alias("price"), F.lit(1.0).alias("size")).alias("Trade")).alias("entries"))
    frames = _table(spark, d, "events").select(F.to_json(F.struct(F.lit("md").alias("e"), F.struct(F.array(quote).alias("quotes")).alias("d"))).alias("body"))
    return rounded(live.parse_quotes(frames).groupBy("instrument").agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.unix_seconds(F.min("ts")).alias("first"), F.unix_seconds(F.max("ts")).alias("last")))


def streaming_submit(spark: SparkSession, d: str) -> DataFrame:
    """Orders of two streams on their way to a broker that refuses every seventh customer: each id once, approved or not, with its answer. The
    line breaks while the first stream's orders are sent; a new process, which starts with the second stream, sends them, and two more
    recoveries send nothing."""
    e = live.event_stream(spark, d).select(F.concat_ws("-", "user_id", "event_type").alias("client_order_id"), F.col("event_id").alias("seq"), "user_id", "event_type")

    def decide(orders: DataFrame) -> DataFrame:
        no = F.col("event_type") == "view"
        return orders.withColumn("approved", ~no).withColumn("reason", F.when(no, "halted"))

    def send(orders: DataFrame) -> DataFrame:
        no = F.col("user_id") % 7 == 0
        return orders.select("client_order_id", (~no).alias("accepted"), F.when(no, "refused").alias("reason"), F.when(~no, F.col("user_id")).cast("long").alias("order_id"))

    def broken(orders: DataFrame) -> DataFrame:
        raise ConnectionError("the line broke")

    path = new_path(spark, "submit")
    before, after = (submit.Submitter(spark, path, decide, f) for f in (broken, send))
    before.accept(e.filter("event_id % 2 = 0"), f"{path}-checkpoint-0").awaitTermination()
    try:
        before.forward(e.schema)
    except StreamingQueryException:
        after.start(e.filter("event_id % 2 = 1"), f"{path}-checkpoint-1")
    for _ in range(2):
        after.recover(e.schema)
    return after.acks()


#: Seconds without an event after which a user's feed is stale.
STALE = 6 * 3600


def streaming_stale(spark: SparkSession, d: str) -> DataFrame:
    """When each user's feed of events was stale: between two of its events, or at the end once the stream is that far."""
    ticks = live.event_stream(spark, d).select(F.col("user_id").cast("string").alias("account"), F.col("ts").cast("timestamp").alias("ts"))
    return live.run_once(live.stale_feeds(ticks, STALE), "stale").select("account", F.unix_millis("last_tick").alias("last_tick_ms"), F.unix_millis("stale_at").alias("stale_at_ms"))


QUERIES = {q.__name__: q for q in (
    snapshot_round_trip, snapshot_listing, snapshot_union, synthetic_calendar, reference_bars, vendor_fixed_point, vendor_definitions, vendor_daily, vendor_development, fetched_series, roll_dates_open_interest, trial_list, trial_counts, normalized_sides,
    sampled_events, trades_a_day, gross_difference, event_backtest, sweep_tested, sharpe_errors, meta_features, annual_periods, bad_intervals, resampled_blocks, survival_arithmetic, autocovariance, simulated_fills, marked_positions, flattening_orders,
    broker_orders, broker_answers, broker_positions, broker_accounts, quote_ticks, streaming_submit, streaming_stale,
)}

_R = "round({0}, 6) AS {0}"
_OHLC = ", ".join(_R.format(c) for c in ("open", "high", "low", "close", "volume"))
_TRIALS = """c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), f AS (SELECT unnest(['a', 'b']) AS family),
    t AS (SELECT row_number() OVER (ORDER BY family, event_type) AS id, family || '-' || event_type AS trial_id, family AS strategy_family,
        sha256('FE-TRIALCFG-v1' || chr(10) || '{"params":{"of":"' || event_type || '"},"signal":"' || family || '"}') AS config_hash, '{"of":"' || event_type || '"}' AS params, CAST(n AS DOUBLE) AS n FROM f CROSS JOIN c)"""
_FLAT = f"""m AS (SELECT combo_id, count(*) AS n, {_SHARPE.format(x="net_pnl_usd")} AS sr, skewness(net_pnl_usd) AS skew, kurtosis(net_pnl_usd) + 3 AS kurt FROM priced GROUP BY combo_id),
    e AS (SELECT *, sqrt((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1)) AS error FROM m)"""
_DRAWN = """ix AS (SELECT row_number() OVER (ORDER BY entry_pos, symbol) - 1 AS idx, net_pnl_usd, symbol, exit_pos FROM priced), nn AS (SELECT count(*) AS n FROM ix),
    drawn AS (SELECT p AS path_id, a AS spot, net_pnl_usd FROM range({paths}) r(p) CROSS JOIN range({length}) s(a) CROSS JOIN nn JOIN ix ON idx = ((p * 7919 + (a // {block}) * 104729 + 7) % n + a % {block}) % n)"""


def _survival_sql() -> str:
    r, z = PRESETS["topstep_50k"], account.Z90
    cap = "realized" if r.daily_loss is None else f"CASE WHEN lo <= -{r.daily_loss} THEN -{r.daily_loss} ELSE realized END"
    assert r.drawdown == "eod" and r.consistency is not None
    floor = f"peak - {r.trailing}"
    floor = f"least({floor}, {r.start})" if r.freeze_at_start else floor
    edge = lambda sign: f"(p {sign[0]} z * sqrt(p_ * (1 - p_) / n + z * z / (4 * n * n))) / (1 + z * z / n)"
    return f"""WITH {donchian_ctes([WINDOW])},
        ix AS (SELECT row_number() OVER (ORDER BY p.entry_pos, p.symbol) - 1 AS idx, p.net_pnl_usd, b.ts AS exit_ts FROM priced p JOIN bars b ON b.symbol = p.symbol AND b.pos = p.exit_pos), nn AS (SELECT count(*) AS n FROM ix),
        per AS (SELECT greatest(1, CAST(round_even(avg(k), 0) AS BIGINT)) AS per_day FROM (SELECT count(*) AS k FROM ix GROUP BY CAST(exit_ts AS DATE))),
        spots AS (SELECT q AS path_id, unnest(range(20 * per_day)) AS spot, per_day FROM range(100) r(q) CROSS JOIN per),
        drawn AS (SELECT path_id, spot, per_day, net_pnl_usd AS x FROM spots CROSS JOIN nn JOIN ix ON idx = ((path_id * 7919 + (spot // 5) * 104729 + 7) % n + spot % 5) % n),
        run AS (SELECT path_id, spot // per_day AS day, x, sum(x) OVER (PARTITION BY path_id, spot // per_day ORDER BY spot ROWS UNBOUNDED PRECEDING) AS run FROM drawn),
        one AS (SELECT path_id, day, sum(x) AS realized, least(0.0, min(run)) AS lo, greatest(0.0, max(run)) AS hi FROM run GROUP BY 1, 2),
        days AS (SELECT c AS contracts, path_id, day, realized * c AS realized, lo * c AS lo, hi * c AS hi FROM one CROSS JOIN (SELECT unnest([1.0, 3.0, 9.0])::DOUBLE AS c)),
        capped AS (SELECT *, {cap} AS c FROM days),
        bal AS (SELECT *, {r.start} + sum(c) OVER w AS bal, max(c) OVER w AS top, row_number() OVER w AS k FROM capped WINDOW w AS (PARTITION BY contracts, path_id ORDER BY day ROWS UNBOUNDED PRECEDING)),
        prior AS (SELECT *, greatest({r.start}, coalesce(max(bal) OVER (PARTITION BY contracts, path_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {r.start})) AS peak FROM bal),
        ends AS (SELECT contracts, path_id, min(CASE WHEN bal <= {floor} THEN k END) AS bust, min(CASE WHEN bal - {r.start} >= {r.target} AND k >= {r.min_days} AND top <= {r.consistency} * (bal - {r.start}) THEN k END) AS win FROM prior GROUP BY 1, 2),
        o AS (SELECT contracts, bust IS NULL OR bust > win AS survived, win IS NOT NULL AND (bust IS NULL OR bust > win) AS hit, win FROM ends),
        flat AS (SELECT contracts, count(*) AS n, avg(CASE WHEN survived THEN 1.0 ELSE 0.0 END) AS p_, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS p_target, CAST(median(CASE WHEN hit THEN win END) AS DOUBLE) AS med, {z} AS z FROM o GROUP BY 1),
        g AS (SELECT *, p_ + z * z / (2 * n) AS p FROM flat)
        SELECT contracts, n AS n_paths, round(p_, 6) AS p_survival, round(p_target, 6) AS p_target, round(med, 6) AS median_days_to_target, round(greatest(0.0, {edge("-")}), 6) AS ci_lo, round(least(1.0, {edge("+")}), 6) AS ci_hi FROM g"""


def _risk_sql(r) -> str:
    """The risk state folded along each account's events, in the order of time."""
    stop, floor = r.daily_loss - r.daily_loss_buffer, f"s.peak - {r.trailing} + {r.trailing_margin}"
    state = {"day": "-1::BIGINT", "won": "0.0::DOUBLE", "balance": f"{r.start}::DOUBLE", "peak": f"{r.start}::DOUBLE", "halted": "FALSE", "tick": "-1::BIGINT", "pos": "0::BIGINT", "recent": "[]::BIGINT[]", "made": "[]::STRUCT(id VARCHAR, why VARCHAR)[]"}
    same = {k: f"s.{k}" for k in state}
    struct = lambda **new: "{" + ", ".join(f"'{k}': {new.get(k, same[k])}" for k in state) + "}"
    won = "(CASE WHEN e.us // 86400000000 = s.day THEN s.won ELSE 0.0 END + e.value)"
    top = "greatest(s.peak, s.balance + e.value)"
    stale = f"(s.tick < 0 OR e.us - s.tick > {r.stale_seconds * 1e6})"
    recent = "list_filter(s.recent, lambda x: x > e.us - 60000000)"
    why = f"""CASE WHEN s.halted THEN 'halted' WHEN {stale} THEN 'stale_data' WHEN len({recent}) >= {r.orders_per_minute} THEN 'order_rate' WHEN s.won <= -{stop} THEN 'daily_loss'
        WHEN s.balance <= {floor} THEN 'trailing_drawdown' WHEN abs(s.pos + e.qty) > {r.max_contracts} THEN 'sizing' END"""
    booked = struct(day="e.us // 86400000000", won=won, balance="s.balance + e.value", peak=top, halted=f"s.halted OR {won} <= -{stop} OR s.balance + e.value <= {top} - {r.trailing} + {r.trailing_margin}")
    ordered = struct(halted=f"s.halted OR {stale}", pos=f"CASE WHEN {why} IS NULL THEN s.pos + e.qty ELSE s.pos END", recent=f"CASE WHEN {why} IS NULL THEN list_append({recent}, e.us) ELSE {recent} END", made=f"list_append(s.made, {{'id': e.id, 'why': {why}}})")
    first = "{" + ", ".join(f"'{k}': {v}" for k, v in state.items()) + "}"
    return f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS account, epoch_us(ts) AS us, ts, CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS qty, value - 150 AS value,
            CASE event_type WHEN 'purchase' THEN 'pnl' WHEN 'click' THEN 'tick' WHEN 'view' THEN 'tick' ELSE 'order' END AS kind FROM events),
        b AS (SELECT account, list({{'us': us, 'id': id, 'qty': qty, 'value': value, 'kind': kind}} ORDER BY us, id) AS events FROM e GROUP BY account),
        s AS (SELECT account, unnest(list_reduce(events, lambda s, e: CASE e.kind WHEN 'tick' THEN {struct(tick="e.us")} WHEN 'pnl' THEN {booked} ELSE {ordered} END, {first}).made) AS m FROM b)
        SELECT s.account, m.id AS order_id, e.ts, m.why IS NULL AS approved, m.why AS reason FROM s JOIN e ON e.id = m.id"""


def _interest() -> str:
    return validation._CONTRACT.replace("CAST(sum(l_quantity) AS DOUBLE) AS volume", "CAST(sum(l_orderkey % 97) AS DOUBLE) AS volume")


#: The netting fold is written once, with the query of netted positions.
_NETTED = f"net AS ({validation.SQL['netted_positions'].replace('round(s.q, 6)', 's.q').replace('round(s.p, 6)', 's.p').replace('round(s.r, 6)', 's.r')})"

SQL = {
    "snapshot_round_trip": f"SELECT symbol, pos, {_OHLC} FROM ({EVENT_SQL})",
    "snapshot_listing": f"SELECT symbol, strftime(min(ts), '%Y-%m-%d %H') AS first, strftime(max(ts), '%Y-%m-%d %H') AS last, symbol <> 'view' AS validation_grade FROM ({EVENT_SQL}) GROUP BY symbol",
    "snapshot_union": f"SELECT symbol, CAST(epoch(ts) AS BIGINT) AS at, {_OHLC} FROM ({EVENT_SQL})",
    "synthetic_calendar": "SELECT k // 1320 AS session, count(*) AS n, count(*) AS whole, min(1704153600 + 60 * k + 7140 * (k // 1320)) AS first, max(1704153600 + 60 * k + 7140 * (k // 1320)) AS last FROM (SELECT row_number() OVER () - 1 AS k FROM events) GROUP BY 1",
    "reference_bars": """WITH d AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS pos FROM (SELECT unnest(generate_series(DATE '2020-01-01', DATE '2059-12-31', INTERVAL 1 DAY)) AS day) WHERE isodow(day) < 6),
        c AS (SELECT *, 1000.0 + sin(pos * 0.1) * 10 + pos * 0.25 AS close FROM d WHERE pos < (SELECT count(DISTINCT CAST(l_shipdate AS DATE)) FROM lineitem))
        SELECT pos, strftime(day, '%Y-%m-%d') AS day, round(coalesce(lag(close) OVER (ORDER BY pos), close), 6) AS open, round(close + 2, 6) AS high, round(close - 2, 6) AS low, round(close, 6) AS close, 5000.0::DOUBLE AS volume FROM c""",
    "vendor_fixed_point": f"SELECT symbol, CAST(epoch(ts) AS BIGINT) AS at, {_OHLC} FROM ({EVENT_SQL})",
    "vendor_definitions": """SELECT event_type AS symbol, strftime(max(ts), '%Y-%m-%d') AS expiry, CASE WHEN event_type <> 'view' THEN strftime(min(ts), '%Y-%m-%d') END AS first_trade FROM events GROUP BY event_type""",
    "vendor_daily": f"SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, {_OHLC}, CAST(pos + 1 AS DOUBLE) AS open_interest FROM ({DAILY_SQL})",
    "vendor_development": f"SELECT symbol, strftime(ts, '%Y-%m-%d') AS day, {_OHLC}, FALSE AS validation_grade FROM ({DAILY_SQL})",
    "fetched_series": f"SELECT * EXCLUDE (contract) FROM ({_stitched_sql('ratio')})",
    "roll_dates_open_interest": f"""WITH {_interest()}, c AS (SELECT *, sum(CASE WHEN bv > fv THEN 1 ELSE 0 END) OVER (PARTITION BY seq1 ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS k FROM common)
        SELECT CAST(seq1 - 1 AS BIGINT) AS seq, strftime(min(ts), '%Y-%m-%d') AS day, round(arg_min(front_close, ts), 6) AS front_close, round(arg_min(back_close, ts), 6) AS back_close FROM c WHERE k = 3 GROUP BY seq1""",
    "trial_list": f"WITH {_TRIALS} SELECT * FROM t",
    "trial_counts": f"""WITH {_TRIALS} SELECT strategy_family, count(*) AS n, (SELECT count(*) FROM t) AS n_all,
        sha256('FE-TRIALLIST-v1' || chr(10) || '[' || string_agg('{{"config_hash":"' || config_hash || '","cv_scheme":"none","metrics":{{"n":' || CAST(n AS VARCHAR) || '}},"trial_id":"' || trial_id || '"}}', ',' ORDER BY id) || ']') AS list_hash FROM t GROUP BY strategy_family""",
    "normalized_sides": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 'short' ELSE 'long' END AS side FROM orders",
    "sampled_events": f"""WITH b AS (SELECT symbol, pos, row_number() OVER (PARTITION BY symbol ORDER BY pos) - 1 AS k, greatest(1, count(*) OVER (PARTITION BY symbol) // 50) AS step FROM ({EVENT_SQL}) WHERE pos >= 10)
        SELECT symbol, pos FROM b WHERE k % step = 0""",
    "trades_a_day": "SELECT CAST(greatest(1, round_even(avg(n), 0)) AS INTEGER) AS per_day, 1 AS without FROM (SELECT count(*) AS n FROM orders GROUP BY CAST(o_orderdate AS DATE))",
    "gross_difference": f"""WITH {donchian_ctes([WINDOW])}, {event_ctes(2.0)} SELECT round(max(abs(l.gross_pnl_usd - e.gross_pnl_usd)), 6) AS max_off, count(*) AS n FROM log l JOIN event_log e USING (symbol, entry_pos)""",
    "event_backtest": f"""WITH {donchian_ctes([WINDOW])}, {event_ctes(3.0)},
        late AS (SELECT symbol, a.pos AS entry_pos, b.pos AS exit_pos, side, qty, a.open AS entry_px, b.open AS exit_px, CASE WHEN side = 'long' THEN 1.0 ELSE -1.0 END * (b.open - a.open) * 5.0 * qty AS gross_pnl_usd
            FROM event_log l JOIN bars a USING (symbol) JOIN bars b USING (symbol) WHERE a.pos = l.entry_pos + 1 AND b.pos = l.exit_pos + 1)
        SELECT delay, symbol, entry_pos, exit_pos, side, {", ".join(_R.format(c) for c in ("qty", "entry_px", "exit_px", "gross_pnl_usd"))}, round(gross_pnl_usd - 3.52 * qty, 6) AS net_pnl_usd
        FROM (SELECT 0 AS delay, * FROM event_log UNION ALL BY NAME SELECT 1 AS delay, * FROM late)""",
    "sweep_tested": f"""WITH {donchian_ctes(GRID)}, size AS (SELECT max(pos) // 3 AS k FROM bars), grid AS (SELECT CAST(k AS BIGINT) AS combo_id FROM range({len(GRID)}) r(k)),
        got AS (SELECT combo_id, count(*) AS n, sum(net_pnl_usd) AS net, {_SHARPE.format(x="net_pnl_usd")} AS sr FROM priced JOIN size ON entry_pos BETWEEN k AND 2 * k GROUP BY combo_id)
        SELECT g.combo_id, coalesce(n, 0) AS n_trades, round(coalesce(net, 0.0), 6) AS net_pnl, round(coalesce(sr, 0.0), 6) AS sharpe_net FROM grid g LEFT JOIN got USING (combo_id)""",
    "sharpe_errors": f"WITH {donchian_ctes(GRID)}, {_FLAT} SELECT CAST(combo_id AS BIGINT) AS combo_id, round(error, 6) AS error FROM e",
    "deflated_sharpe": f"""WITH RECURSIVE {donchian_ctes(GRID)}, {_FLAT},
        halved AS (SELECT k, p, -6.0::DOUBLE AS lo, 6.0::DOUBLE AS hi, 0 AS i FROM (VALUES (0, 1 - 1.0::DOUBLE / {len(GRID)}), (1, 1 - exp(-1.0::DOUBLE) / {len(GRID)})) v(k, p)
            UNION ALL SELECT k, p, CASE WHEN c < p THEN mid ELSE lo END, CASE WHEN c < p THEN hi ELSE mid END, i + 1 FROM (SELECT *, {NORMAL_SQL.format(x="mid")} AS c FROM (SELECT *, (lo + hi) / 2 AS mid FROM halved)) WHERE i < 60),
        luck AS (SELECT sum(CASE WHEN k = 0 THEN 1 - 0.5772156649015329 ELSE 0.5772156649015329 END * (lo + hi) / 2) AS z FROM halved WHERE i = 60), x AS (SELECT *, sr / error - (SELECT z FROM luck) AS x FROM e)
        SELECT CAST(combo_id AS BIGINT) AS combo_id, round(sr, 6) AS sharpe, n, round(skew, 6) AS skew, round(kurt, 6) AS kurt, round({NORMAL_SQL.format(x="x")}, 6) AS dsr FROM x""",
    "meta_features": f"""WITH {donchian_ctes([WINDOW])}, r AS (SELECT *, {", ".join(f"close / lag(close, {h}) OVER w - 1 AS ret_{h}" for h in (1, 5, 20))} FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY pos)),
        v AS (SELECT *, CASE WHEN count(ret_1) OVER w = 20 THEN stddev_samp(ret_1) OVER w END AS vol_20 FROM r WINDOW w AS (PARTITION BY symbol ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
        SELECT v.symbol, v.pos, {", ".join(_R.format(c) for c in ("ret_1", "ret_5", "ret_20", "vol_20", "raw"))} FROM v JOIN raws s ON s.symbol = v.symbol AND s.pos = v.pos WHERE ret_20 IS NOT NULL AND vol_20 IS NOT NULL""",
    "annual_periods": "SELECT event_type AS symbol, CASE (row_number() OVER (ORDER BY event_type) - 1) % 5 WHEN 0 THEN 23.0 * 60 * 252 WHEN 1 THEN 23.0 * 12 * 252 WHEN 2 THEN 23.0 * 4 * 252 WHEN 3 THEN 23.0 * 252 ELSE 252.0 END::DOUBLE AS per_year FROM (SELECT DISTINCT event_type FROM events)",
    "bad_intervals": """WITH m AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS t0, CAST(ship AS DATE) AS t1 FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
        n AS (SELECT *, lead(t0) OVER (ORDER BY o_orderkey) AS next_t0 FROM m) SELECT count(*) AS n, count(*) FILTER (t1 < t0) AS ends, count(*) FILTER (next_t0 < t0) AS back FROM n""",
    "resampled_blocks": f"""WITH {donchian_ctes([WINDOW])}, {_DRAWN.format(paths=20, length=30, block=7)} SELECT path_id, spot AS at, round(net_pnl_usd, 6) AS net_pnl_usd FROM drawn""",
    "survival_arithmetic": _survival_sql(),
    "autocovariance": f"""WITH {donchian_ctes([5])}, ix AS (SELECT row_number() OVER (ORDER BY entry_pos, symbol) - 1 AS idx, net_pnl_usd - avg(net_pnl_usd) OVER () AS e FROM priced), nn AS (SELECT count(*) AS n FROM ix)
        SELECT k AS lag, n, round(sum(a.e * b.e) / n, 4) AS cov FROM range(12) r(k) CROSS JOIN nn CROSS JOIN ix a JOIN ix b ON b.idx = a.idx + k GROUP BY k, n""",
    "simulated_fills": f"""WITH b AS ({EVENT_SQL}), o AS (SELECT event_id, event_type AS symbol, event_id % 700 AS pos, event_id % 5 AS qty, event_id % 3 AS kind, CASE WHEN event_id % 3 = 1 THEN value / 2 ELSE value * 3 END AS trigger FROM events),
        m AS (SELECT event_id, CASE WHEN qty <= 0 OR open IS NULL THEN NULL WHEN kind = 0 THEN open WHEN trigger BETWEEN low AND high THEN trigger END AS px FROM o LEFT JOIN b ON b.symbol = o.symbol AND b.pos = o.pos + 1)
        SELECT event_id AS order_id, CASE WHEN px IS NULL THEN 'rejected' ELSE 'filled' END AS status, round(px, 6) AS fill_px FROM m""",
    "marked_positions": f"""WITH {_NETTED}, c AS (SELECT CAST(o_custkey AS VARCHAR) AS instrument, max(o_totalprice) AS close FROM orders GROUP BY 1)
        SELECT instrument, round(1000.0 + (realized + (close - avg_px) * qty) * 5.0, 4) AS equity FROM net JOIN c USING (instrument)""",
    "flattening_orders": f"WITH {_NETTED} SELECT instrument, CASE WHEN qty > 0 THEN 'sell' ELSE 'buy' END AS side, round(abs(qty), 6) AS qty, 'market' AS type, TRUE AS is_automated FROM net WHERE qty <> 0",
    "broker_orders": """WITH o AS (SELECT o_orderkey AS k, o_totalprice AS px FROM orders), f AS (SELECT CAST(k AS VARCHAR) AS id, k % 2 = 0 AS buy, CAST(k % 7 + 1 AS INTEGER) AS qty, CASE WHEN k % 3 = 1 THEN round(px, 4) END AS limit_px, CASE WHEN k % 3 = 2 THEN round(px, 4) END AS stop_px FROM o)
        SELECT 'tradovate' AS broker, id, CASE WHEN buy THEN 'Buy' ELSE 'Sell' END AS side, qty, limit_px, stop_px, 'true' AS automated, '42' AS account FROM f
        UNION ALL SELECT 'projectx', id, CASE WHEN buy THEN '0' ELSE '1' END, qty, limit_px, stop_px, 'true', '42' FROM f""",
    "broker_answers": """SELECT broker, CAST(o_orderkey AS VARCHAR) AS client_order_id, o_orderkey % 5 <> 0 AS accepted, CASE WHEN o_orderkey % 5 = 0 THEN 'no ' || o_orderkey END AS reason, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 10 END AS order_id
        FROM orders CROSS JOIN (SELECT unnest(['tradovate', 'projectx']) AS broker)""",
    "broker_positions": """WITH n AS (SELECT CAST(o_custkey AS VARCHAR) AS instrument, CAST(sum(CASE WHEN o_orderpriority < '3' THEN 2 ELSE -1 END) AS INTEGER) AS qty, max(o_totalprice) AS avg_px FROM orders GROUP BY 1)
        SELECT broker, instrument, qty, round(avg_px, 4) AS avg_px FROM n CROSS JOIN (SELECT unnest(['tradovate', 'projectx']) AS broker) WHERE qty <> 0""",
    "broker_accounts": """SELECT broker, count(*) AS n, round(sum(c_acctbal), 3) AS balance, round(sum(c_acctbal + CASE WHEN broker = 'tradovate' AND c_custkey % 2 = 0 THEN c_custkey / 4.0 ELSE 0 END), 3) AS equity
        FROM customer CROSS JOIN (SELECT unnest(['tradovate', 'projectx']) AS broker) GROUP BY broker""",
    "quote_ticks": "SELECT CAST(user_id AS VARCHAR) AS instrument, count(*) AS n, round(sum(value), 6) AS total, min(CAST(floor(epoch(ts)) AS BIGINT)) AS first, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last FROM events GROUP BY 1",
    "streaming_submit": """SELECT DISTINCT concat_ws('-', user_id, event_type) AS client_order_id, event_type <> 'view' AND user_id % 7 <> 0 AS accepted,
        CASE WHEN event_type = 'view' THEN 'halted' WHEN user_id % 7 = 0 THEN 'refused' END AS reason, CASE WHEN event_type <> 'view' AND user_id % 7 <> 0 THEN CAST(user_id AS BIGINT) END AS order_id FROM events""",
    "lookahead_audit": f"""WITH src AS ({EVENT_SQL}), cuts AS (SELECT symbol, cut, CAST(floor(max(pos) * cut) AS BIGINT) AS spot FROM src CROSS JOIN (SELECT unnest([0.5, 0.75, 0.9])::DOUBLE AS cut) GROUP BY symbol, cut),
        bars AS (SELECT symbol || '|whole' AS symbol, symbol AS own, NULL::DOUBLE AS cut, pos, open, high, low, close, volume FROM src
            UNION ALL SELECT s.symbol || '|' || c.cut, s.symbol, c.cut, pos, open, high, low, close, volume FROM src s JOIN cuts c ON s.symbol = c.symbol AND pos <= spot),
        {market._RECURSIVE}, prior AS (SELECT *, {market._full("avg", "close", 20)} AS sma, 100 * ((close - {market._full("min", "low", 14)}) / nullif({market._full("max", "high", 14)} - {market._full("min", "low", 14)}, 0)) AS stoch,
            lead(close) OVER ({market._W}) AS next_close, count(close) OVER b AS seen, max(high) OVER b AS top, min(low) OVER b AS bottom FROM third WINDOW b AS ({market._W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
        made AS (SELECT *, coalesce(last_value(CASE WHEN seen >= 20 AND close > top THEN 1.0 WHEN seen >= 20 AND close < bottom THEN -1.0 END IGNORE NULLS) OVER ({market._W} ROWS UNBOUNDED PRECEDING), 0.0)::DOUBLE AS raw FROM prior),
        long AS (SELECT own, cut, pos, unnest(['feature.window', 'feature.window', 'feature.rsi', 'signal.donchian', 'leaky.next_close']) AS operator, unnest([1, 2, 1, 1, 1]) AS k, unnest([sma, stoch, rsi, raw, next_close]) AS v FROM made)
        SELECT a.operator, b.cut, count(*) AS checked, CAST(sum(CASE WHEN a.v IS NOT DISTINCT FROM b.v OR coalesce(abs(a.v - b.v) <= 1e-9 + 1e-5 * abs(b.v), FALSE) THEN 0 ELSE 1 END) AS BIGINT) AS mismatches
        FROM long a JOIN long b ON a.own = b.own AND a.pos = b.pos AND a.operator = b.operator AND a.k = b.k WHERE a.cut IS NULL AND b.cut IS NOT NULL GROUP BY a.operator, b.cut""",
    "streaming_risk": _risk_sql(research.replace_limits()),
    "streaming_stale": f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS account, epoch_ms(ts) AS ms, epoch_ms(max(ts) OVER ()) AS last FROM events),
        n AS (SELECT *, lead(ms) OVER (PARTITION BY account ORDER BY ms) AS next FROM e)
        SELECT account, ms AS last_tick_ms, ms + {STALE * 1000} AS stale_at_ms FROM n WHERE coalesce(next, last) - ms > {STALE * 1000}""",
}
