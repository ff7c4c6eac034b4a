"""Live risk checks, monitoring and order handling as Structured Streaming.

State is kept by account or strategy, so accounts spread over executors and a lost one is restored from the checkpoint.
Rows of a micro-batch are handled in the order of their time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..config import LiveLimits
from ..session import new_path

RISK_STATE = "connected boolean, halted boolean, last_tick long, day long, day_pnl double, balance double, peak double, position int, recent array<long>, queued boolean, deadline long"
DECISIONS = "account string, order_id string, ts timestamp, approved boolean, reason string"
ALERTS = "strategy string, seq long, n int, mean_slippage double, sharpe double, drift_z double, shut_down boolean, reason string"
MINUTE = 60_000_000


@dataclass
class Risk:
    """An account's state and the checks of its orders. Halts latch until reset(); an account without a tick is stale."""

    limits: LiveLimits
    connected: bool = True
    halted: bool = False
    last_tick: int = -1
    day: int = -1
    day_pnl: float = 0.0
    balance: float = 0.0
    peak: float = 0.0
    position: int = 0
    recent: list[int] | None = None
    queued: bool = False
    #: Milliseconds of the machine's clock at which the data are stale, if no tick comes; 0 while no timer runs.
    deadline: int = 0

    def __post_init__(self) -> None:
        self.recent = list(self.recent or [])
        if not self.balance:
            self.balance = self.peak = self.limits.start

    def floor(self) -> float:
        return self.peak - self.limits.trailing

    def tick(self, at: int) -> None:
        self.last_tick = at

    def pnl(self, at: int, value: float) -> str | None:
        """Books a result; the daily loss and trailing switches halt. Returns why, if they do."""
        day = at // (24 * 60 * MINUTE)
        if day != self.day:
            self.day, self.day_pnl = day, 0.0
        self.day_pnl += value
        self.balance += value
        self.peak = max(self.peak, self.balance)
        if self.day_pnl <= -(self.limits.daily_loss - self.limits.daily_loss_buffer):
            self.halted = True
            return "daily_loss"
        if self.balance <= self.floor() + self.limits.trailing_margin:
            self.halted = True
            return "trailing_drawdown"
        return None

    def disconnect(self) -> None:
        """The flattening of an open position waits for the connection."""
        self.connected, self.queued = False, self.queued or self.position != 0

    def reconnect(self) -> bool:
        """Whether a flattening had been waiting; it is done now."""
        self.connected = True
        waiting, self.queued = self.queued, False
        if waiting:
            self.position = 0
        return waiting

    def order(self, at: int, qty: int) -> str | None:
        """Why an order of so many contracts (signed) isn't approved, or None; approved ones count and move the position."""
        self.recent = [t for t in self.recent if t > at - MINUTE]
        stale = self.last_tick < 0 or at - self.last_tick > self.limits.stale_seconds * 1e6
        if not self.connected:
            return "disconnected"
        if self.halted:
            return "halted"
        if stale:
            self.halted = True
            return "stale_data"
        if len(self.recent) >= self.limits.orders_per_minute:
            return "order_rate"
        if self.day_pnl <= -(self.limits.daily_loss - self.limits.daily_loss_buffer):
            return "daily_loss"
        if self.balance <= self.floor() + self.limits.trailing_margin:
            return "trailing_drawdown"
        if abs(self.position + qty) > self.limits.max_contracts:
            return "sizing"
        self.recent.append(at)
        self.position += qty
        return None

    def values(self) -> tuple:
        return (self.connected, self.halted, self.last_tick, self.day, self.day_pnl, self.balance, self.peak, self.position, self.recent, self.queued, self.deadline)


def _gathered(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of one micro-batch, which come in no order; the stream's trigger bounds how many."""
    held = [p for p in parts if len(p)]
    return held[0] if len(held) == 1 else pd.concat(held)


def risk_decisions(events: DataFrame, limits: LiveLimits = LiveLimits(), timer: bool = False) -> DataFrame:
    """Decisions on the orders in a stream of (account, ts, kind, order_id, qty, value); kind: tick, pnl, order, disconnect,
    reconnect, reset. Other kinds are ignored.

    With timer, an account without a tick for limits.stale_seconds of the machine's clock is halted although no order comes, and a
    row without order_id says so. Such a stream runs until it is stopped: its timers ask for a micro-batch again and again."""
    patience = int(limits.stale_seconds * 1000)

    def run(key, parts: Iterator[pd.DataFrame], state):
        r = Risk(limits, *state.get) if state.exists else Risk(limits)
        out = []
        if state.hasTimedOut:
            r.deadline = 0
            if not r.halted:
                r.halted = True
                out.append((key[0], None, pd.Timestamp(state.getCurrentProcessingTimeMs(), unit="ms"), False, "stale_data"))
            state.update(r.values())
            if out:
                yield pd.DataFrame(out, columns=["account", "order_id", "ts", "approved", "reason"])
            return
        ticked = not state.exists
        for e in _gathered(parts).sort_values(["ts", "order_id"], kind="stable").itertuples(index=False):
            at = int(e.ts.value // 1000)
            if e.kind == "tick":
                r.tick(at)
                ticked = True
            elif e.kind == "pnl":
                r.pnl(at, float(e.value))
            elif e.kind == "disconnect":
                r.disconnect()
            elif e.kind == "reconnect":
                r.reconnect()
            elif e.kind == "reset":
                r.halted = False
            elif e.kind == "order":
                why = r.order(at, int(e.qty))
                out.append((key[0], e.order_id, e.ts, why is None, why))
        if timer:
            now = state.getCurrentProcessingTimeMs()
            r.deadline = now + patience if ticked else r.deadline
            if r.deadline and not r.halted:
                state.setTimeoutDuration(max(1, r.deadline - now))
        state.update(r.values())
        if out:
            yield pd.DataFrame(out, columns=["account", "order_id", "ts", "approved", "reason"])

    return events.groupBy("account").applyInPandasWithState(run, DECISIONS, RISK_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if timer else GroupStateTimeout.NoTimeout)


def stale_feeds(ticks: DataFrame, seconds: float, delay: str = "0 seconds") -> DataFrame:
    """(account, last_tick, stale_at) for each time that an account of (account, ts) had no tick for more than so many seconds, by the ticks' own
    times: once its next tick shows it, or once the stream as a whole is that far. Ticks more than delay behind the latest
    of the stream are left out, and times count in milliseconds, to the nearest (halves up)."""
    life = int(seconds * 1000)
    us = F.unix_micros("ts") + 500
    ticks = ticks.withColumn("ts", F.timestamp_micros(us - F.pmod(us, F.lit(1000))))

    def run(key, parts: Iterator[pd.DataFrame], state):
        out = []
        if state.hasTimedOut:
            out.append(state.get[0])
            state.remove()  # the next tick begins anew
        else:
            times = sorted(t.value // 1_000_000 for t in _gathered(parts)["ts"])
            last = state.get[0] if state.exists else times[0]
            for t in times:
                if t - last > life:
                    out.append(last)
                last = max(last, t)
            state.update((last,))
            state.setTimeoutTimestamp(max(last + life + 1, state.getCurrentWatermarkMs() + 1))  # due once the watermark is there
        if out:
            yield pd.DataFrame({"account": key[0], "last_tick": pd.to_datetime(out, unit="ms"), "stale_at": pd.to_datetime([t + life for t in out], unit="ms")})

    return ticks.withWatermark("ts", delay).groupBy("account").applyInPandasWithState(run, "account string, last_tick timestamp, stale_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def live_monitor(fills: DataFrame, limits: LiveLimits = LiveLimits(), expected_mean: float = 0.0, expected_dev: float = 1.0) -> DataFrame:
    """For each fill (strategy, seq, slippage_usd, pnl_usd), the figures of its strategy's last ones: mean absolute slippage, Sharpe
    ratio by population deviation, the drift of mean P&L in standard errors, and whether one of them passes its limit."""
    window, least = limits.sharpe_window, limits.sharpe_samples

    def run(key, parts: Iterator[pd.DataFrame], state):
        slips, pnls = (deque(x, window) for x in (state.get if state.exists else ([], [])))
        out = []
        for f in _gathered(parts).sort_values("seq").itertuples(index=False):
            slips.append(abs(float(f.slippage_usd)))
            pnls.append(float(f.pnl_usd))
            n = len(pnls)
            mean = sum(pnls) / n
            dev = (sum((p - mean) ** 2 for p in pnls) / n) ** 0.5
            sharpe = (mean / dev if dev else 0.0) if n >= least else None
            slip, drift = sum(slips) / n, (mean - expected_mean) / (expected_dev / n**0.5) if expected_dev > 0 else 0.0
            why = "slippage" if slip > limits.slippage_usd else "sharpe" if sharpe is not None and sharpe < limits.sharpe_floor else "drift" if n >= least and abs(drift) > limits.drift_z else None
            out.append((key[0], f.seq, n, slip, sharpe, drift, why is not None, why))
        state.update((list(slips), list(pnls)))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ALERTS.split(", ")])

    return fills.groupBy("strategy").applyInPandasWithState(run, ALERTS, "slips array<double>, pnls array<double>", "append", GroupStateTimeout.NoTimeout)


def unique_orders(orders: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first order of each client_order_id; ids are forgotten after the delay of event time."""
    return orders.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["client_order_id"])


def outbox(orders: DataFrame, path: str, checkpoint: str):
    """Writes each micro-batch of approved orders once: a batch's folder carries its number, so a batch that runs again after a
    crash replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:09d}")

    return orders.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pending(spark: SparkSession, path: str, sent: DataFrame) -> DataFrame:
    """Orders in the outbox that aren't among sent (client_order_id): what a restart sends again."""
    return spark.read.parquet(path).join(sent.select("client_order_id"), "client_order_id", "left_anti")


def run_once(stream: DataFrame, name: str) -> DataFrame:
    """All that the stream has now, through a file sink in the shared folder."""
    spark = stream.sparkSession
    out = new_path(spark, name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The event table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*events*.parquet").parquet(sf_dir)


def codec_orders(orders: DataFrame) -> DataFrame:
    """Orders (client_order_id, instrument, side, qty, type, limit_px, stop_px) as JSON for a broker; automation is always stated."""
    kind = F.initcap("type")
    return orders.select("client_order_id", F.to_json(F.struct(F.col("client_order_id").alias("clOrdId"), F.col("instrument").alias("symbol"), F.initcap("side").alias("action"), F.col("qty").alias("orderQty"), kind.alias("orderType"), F.col("limit_px").alias("price"), F.col("stop_px").alias("stopPrice"), F.lit(True).alias("isAutomated"))).alias("body"))


ACK = "orderId long, clOrdId string, ordStatus string, errorText string"
QUOTE = "e string, d struct<quotes:array<struct<contractId:long,timestamp:string,entries:struct<Trade:struct<price:double,size:double>>>>>"


def parse_acks(df: DataFrame, body: str = "body") -> DataFrame:
    """order_id, client_order_id, status and error of acknowledgements; malformed ones raise."""
    a = F.from_json(body, ACK, {"mode": "FAILFAST"})
    return df.select(a.alias("a")).select(F.col("a.orderId").alias("order_id"), F.col("a.clOrdId").alias("client_order_id"), F.lower("a.ordStatus").alias("status"), F.col("a.errorText").alias("error"))


def parse_quotes(df: DataFrame, body: str = "body") -> DataFrame:
    """Ticks (instrument, price, ts) of quote frames; malformed ones raise."""
    q = F.explode(F.from_json(body, QUOTE, {"mode": "FAILFAST"})["d"]["quotes"])
    return df.select(q.alias("q")).select(F.col("q.contractId").cast("string").alias("instrument"), F.col("q.entries.Trade.price").alias("price"), F.to_timestamp("q.timestamp").alias("ts"))
