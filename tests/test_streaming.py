"""Streams: state over micro-batches, the outbox after a crash, and codecs."""

import json

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tickforge.config import LiveLimits
from tickforge.streaming import live

EVENTS = "account string, ts timestamp, kind string, order_id string, qty int, value double"


def feed(spark, path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part-{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def at(seconds):
    return pd.Timestamp(1_700_000_000 + seconds, unit="s").to_pydatetime()


def test_risk_state_lasts_over_batches(spark, tmp_path):
    tick = lambda s, a="A": (a, at(s), "tick", None, None, None)
    order = lambda s, i, a="A", q=1: (a, at(s), "order", i, q, None)
    batches = [[tick(0), order(1, "o1"), order(1, "b1", "B")], [order(4, "o2"), order(9, "o3")], [tick(10), order(11, "o4"), ("A", at(12), "reset", None, None, None), tick(12), order(13, "o5"), ("A", at(14), "pnl", None, None, -900.0), order(15, "o6")]]
    got = live.run_once(live.risk_decisions(feed(spark, tmp_path / "in", batches, EVENTS), LiveLimits()), "risk").collect()
    assert {r["order_id"]: r["reason"] for r in got} == {"o1": None, "b1": "stale_data", "o2": None, "o3": "stale_data", "o4": "halted", "o5": None, "o6": "halted"}


def test_orders_are_unique_over_batches(spark, tmp_path):
    rows = [[("a", at(0)), ("b", at(1)), ("a", at(2))], [("a", at(3)), ("c", at(4))]]
    got = live.run_once(live.unique_orders(feed(spark, tmp_path / "in", rows, "client_order_id string, ts timestamp")), "orders")
    assert sorted(r["client_order_id"] for r in got.collect()) == ["a", "b", "c"]


def test_outbox_writes_a_batch_once_and_knows_what_is_pending(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", [[("a",)], [("b",), ("c",)]], "client_order_id string")
    for name in ("checkpoint", "lost"):  # a lost checkpoint runs the batches again
        live.outbox(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/{name}").awaitTermination()
    sent = spark.createDataFrame([("b",)], "client_order_id string")
    assert sorted(r["client_order_id"] for r in live.pending(spark, f"file://{tmp_path}/out", sent).collect()) == ["a", "c"]


def test_monitor_limits(spark, tmp_path):
    fills = [[("s", k, 50.0, 1.0 + k % 2) for k in range(3)], [("t", k, 1.0, -1.0 - k % 2) for k in range(25)]]
    got = live.run_once(live.live_monitor(feed(spark, tmp_path / "in", fills, "strategy string, seq long, slippage_usd double, pnl_usd double")), "monitor").collect()
    by = {(r["strategy"], r["seq"]): r for r in got}
    assert by["s", 0]["reason"] == "slippage" and by["t", 18]["reason"] is None and by["t", 19]["reason"] == "sharpe"


def test_codecs(spark):
    order = spark.createDataFrame([("x1", "MES", "buy", 2, "limit", 5000.25, None)], "client_order_id string, instrument string, side string, qty int, type string, limit_px double, stop_px double")
    body = json.loads(live.codec_orders(order).first()["body"])
    assert body == {"clOrdId": "x1", "symbol": "MES", "action": "Buy", "orderQty": 2, "orderType": "Limit", "price": 5000.25, "isAutomated": True}
    frames = spark.createDataFrame([('{"e":"md","d":{"quotes":[{"contractId":7,"timestamp":"2024-01-02T03:04:05Z","entries":{"Trade":{"price":5.5,"size":1}}}]}}',)], "body string")
    tick = live.parse_quotes(frames).first()
    assert (tick["instrument"], tick["price"]) == ("7", 5.5)
    assert live.parse_acks(spark.createDataFrame([('{"orderId":3,"clOrdId":"x1","ordStatus":"Filled"}',)], "body string")).first()["status"] == "filled"
    with pytest.raises(Exception):
        live.parse_quotes(spark.createDataFrame([("{bad",)], "body string")).select(F.col("price")).collect()


ORDERS = "client_order_id string, seq long, qty int, ts timestamp"


class Line:
    """A submitter over a folder of order files, and what its broker has been sent. `breaks` names the write before which, or the send
    after which, the process is killed; sends of an approved order count by id."""

    def __init__(self, spark, path, keep=None):
        from tickforge.streaming import submit

        self.spark, self.path, self.breaks, self.sent, self.halted, self.files, line = spark, f"file://{path}", None, [], False, 0, self

        class Killed(submit.Submitter):
            def _write(self, df, kind, batch):
                if line.breaks == kind:
                    raise RuntimeError("killed")
                return super()._write(df, kind, batch)

        def send(orders):
            line.sent.extend(r["client_order_id"] for r in orders.collect())
            if line.breaks == "send":
                raise RuntimeError("killed")
            return orders.selectExpr("client_order_id", "qty < 5 AS accepted", "CASE WHEN qty >= 5 THEN 'too many' END AS reason", "seq AS order_id")

        def decide(orders):
            no = F.lit(self.halted) | (F.col("qty") <= 0)
            return orders.withColumn("approved", ~no).withColumn("reason", F.when(no, "sizing"))

        self.make = lambda: Killed(spark, f"{self.path}/records", decide, send, keep)

    def put(self, *rows, folder="in"):
        self.files += 1
        self.spark.createDataFrame([(i, seq, qty, at(seq)) for i, seq, qty in rows], ORDERS).coalesce(1).write.parquet(f"{self.path}/{folder}/{self.files}")

    def start(self, folder="in", checkpoint="checkpoint"):
        self.make().start(self.spark.readStream.schema(ORDERS).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/{folder}/*"), f"{self.path}/{checkpoint}")

    def acks(self):
        return sorted((tuple(r) for r in self.make().acks().collect()), key=str)

    def pending(self):
        return sorted(r["client_order_id"] for r in self.make().pending(ORDERS).collect())


def test_submit_path(spark, tmp_path):
    """Each id is sent once, over batches and restarts; an order without answer is pending until the next start."""
    line = Line(spark, tmp_path)
    line.put(("a", 2, 1), ("a", 1, 2), ("b", 3, 9), ("c", 4, 0))
    line.breaks = "send"
    with pytest.raises(StreamingQueryException):
        line.start()
    assert line.pending() == ["a", "b", "c"] and line.acks() == []
    line.breaks = None
    line.start()
    line.start()
    line.put(("a", 9, 1), ("d", 9, 1))
    line.start()
    want = [("a", True, None, 1), ("b", False, "too many", 3), ("c", False, "sizing", None), ("d", True, None, 9)]
    assert line.acks() == want and sorted(line.sent) == ["a", "a", "b", "b", "d"] and line.pending() == []


def test_first_orders_without_a_call_an_id(spark, tmp_path):
    """Over Arrow batches of three rows: the smallest seq of a micro-batch, unless the id came before; known ids are Spark's own state."""
    from tickforge.streaming import submit

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        batches = [[(f"i{k % 40}", 1000 - k, k) for k in range(400)] + [(None, 5, 1), (None, 4, 2), ("n", None, 1), ("n", 7, 2)], [("i3", 1, 0), ("new", 2, 0), ("new", 1, 1), (None, 1, 0)]]
        first = submit.first_orders(feed(spark, tmp_path / "in", batches, "client_order_id string, seq long, qty int"))
        got = sorted((tuple(r) for r in live.run_once(first, "first").collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted([*((f"i{k}", 1000 - 360 - k, 360 + k) for k in range(40)), (None, 4, 2), ("n", 7, 2), ("new", 1, 1)], key=str)
    plan = first._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "WithState" not in plan


def test_smallest_orders_over_several_rounds():
    """More rows than are held at once: what is kept is compared again."""
    import numpy as np
    import pyarrow as pa

    from tickforge.streaming import submit

    seq = np.random.default_rng(1).permutation(300_000)
    ids = np.arange(300_000) % 100_000
    table = pa.table({"client_order_id": pa.array(ids).cast(pa.string()), "seq": seq})
    got = pa.Table.from_batches(submit._smallest_of(iter(table.to_batches(max_chunksize=10_000))))
    assert dict(zip(got["client_order_id"].to_pylist(), got["seq"].to_pylist(), strict=True)) == {str(k): int(seq[k::100_000].min()) for k in range(100_000)}
    assert list(submit._smallest_of(iter([]))) == []


@pytest.mark.parametrize("kind", ["judged", "send", "acks"])
def test_killed_between_two_writes(spark, tmp_path, kind):
    """Wherever the process is killed, three recoveries send each order once more at the most, and answers stay."""
    line = Line(spark, tmp_path)
    line.put(("a", 1, 1))
    line.start()
    line.put(("b", 2, 1), ("c", 3, 0))
    line.breaks = kind
    with pytest.raises(StreamingQueryException):
        line.start()
    assert line.acks() == [("a", True, None, 1)] and line.pending() == ["b", "c"]
    line.breaks = None
    for _ in range(3):
        line.make().recover(ORDERS)
        assert line.acks() == [("a", True, None, 1), ("b", True, None, 2), ("c", False, "sizing", None)]
    assert line.sent.count("a") == 1 and line.sent.count("b") == (1 if kind == "judged" else 2) and "c" not in line.sent


def test_recovered_orders_are_judged_anew(spark, tmp_path):
    line = Line(spark, tmp_path)
    line.put(("a", 1, 1))
    line.breaks = "send"
    with pytest.raises(StreamingQueryException):
        line.start()
    line.breaks, line.halted = None, True
    line.make().recover(ORDERS)
    assert line.acks() == [("a", False, "sizing", None)]


def test_lost_checkpoints_and_second_streams(spark, tmp_path):
    """Orders that come again by another stream, or because a checkpoint was lost, have their answers already."""
    import shutil

    line = Line(spark, tmp_path)
    line.put(("a", 1, 1), ("b", 2, 1))
    line.start()
    line.put(("b", 3, 1), ("z", 4, 1), folder="other")
    line.start("other", "checkpoint-2")
    shutil.rmtree(tmp_path / "checkpoint")
    line.start()
    for c in (tmp_path / "records/forward").iterdir():
        shutil.rmtree(c)
    line.start()
    assert line.acks() == [("a", True, None, 1), ("b", True, None, 2), ("z", True, None, 4)] and sorted(line.sent) == ["a", "b", "z"]


def test_a_batch_does_not_read_what_came_before(spark, tmp_path):
    """A later batch touches its own folders and the names of epochs, whatever has been recorded."""
    line = Line(spark, tmp_path)
    for k in range(3):
        line.put((f"o{k}", k, 1))
        line.start()
    s, seen = line.make(), []
    s._read = lambda *a: seen.append(a)
    s._batch(spark.createDataFrame([("n", 9, 1, at(9))], ORDERS), 77, s._names("acks")[0])
    assert seen == [] and ("n", True, None, 9) in line.acks()


def test_ids_are_forgotten(spark, tmp_path):
    """With `keep` an id is new again once the orders' time is that far beyond its last one."""
    line = Line(spark, tmp_path, keep="100 seconds")
    for row in (("a", 0, 1), ("a", 60, 1), ("b", 150, 1), ("a", 155, 1), ("c", 400, 1), ("d", 401, 1), ("a", 500, 1)):
        line.put(row)
    line.start()
    assert [(i, n) for i, _, _, n in line.acks()] == [("a", 0), ("a", 500), ("b", 150), ("c", 400), ("d", 401)]


def test_stale_feeds(spark, tmp_path):
    """A gap between two ticks, one that lasts to the end, and none for the account that ticks last."""
    rows = [[("A", at(0)), ("B", at(1)), ("A", at(20))], [("B", at(21)), ("C", at(21))], [("C", at(40)), ("C", at(45)), ("C", at(50))]]
    got = live.run_once(live.stale_feeds(feed(spark, tmp_path / "in", rows, "account string, ts timestamp"), 19.5), "stale")
    second = lambda t: int(t.timestamp()) - 1_700_000_000
    assert sorted((r["account"], second(r["last_tick"])) for r in got.collect()) == [("A", 0), ("A", 20), ("B", 1), ("B", 21)]


def test_stale_feeds_round_to_milliseconds(spark, tmp_path):
    """Half a millisecond and more counts as one, in the gap, at the end and in what comes out."""
    us = lambda n: at(0) + pd.Timedelta(n, "us").to_pytimedelta()
    rows = [[("A", us(1_499)), ("A", us(1_002_500)), ("B", us(2_500)), ("B", us(1_003_499)), ("C", us(500)), ("D", us(2_003_500))]]
    got = live.run_once(live.stale_feeds(feed(spark, tmp_path / "in", rows, "account string, ts timestamp"), 1.001), "stale")
    base = int(at(0).timestamp() * 1000)
    assert sorted((r["account"], r["ms"] - base) for r in got.select("account", F.unix_millis("last_tick").alias("ms")).collect()) == [("A", 1), ("C", 1)]


def test_account_without_ticks_is_halted(spark, tmp_path):
    """No order comes, and the halt is said by a timer; an order afterwards is refused."""
    import time

    tick = ("A", at(0), "tick", None, None, None)
    stream = feed(spark, tmp_path / "in", [[tick]], EVENTS)
    out = live.risk_decisions(stream, LiveLimits(stale_seconds=1.0), timer=True)
    q = out.writeStream.format("memory").queryName("halts").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 60
        while time.time() < end and not spark.table("halts").count():
            time.sleep(0.3)
        spark.createDataFrame([("A", at(1), "tick", None, None, None), ("A", at(1), "order", "o1", 1, None)], EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/part-9")
        while time.time() < end and spark.table("halts").count() < 2:
            time.sleep(0.3)
        assert [(r["account"], r["order_id"], r["approved"], r["reason"]) for r in spark.table("halts").collect()] == [("A", None, False, "stale_data"), ("A", "o1", False, "halted")]
    finally:
        q.stop()


def test_broker_formats(spark):
    from tickforge.streaming.brokers import codec

    one = spark.createDataFrame([("x", "{\"orderId\": 5}"), ("y", "{}")], "client_order_id string, body string")
    t = codec("tradovate")
    assert tuple(t.acks(one.filter("client_order_id = 'x'")).first()) == ("x", True, None, 5)
    for bad in (t.acks(one), t.acks(spark.createDataFrame([("x", "{oops")], "client_order_id string, body string")), t.open_positions(spark.createDataFrame([("{}",)], "body string"))):
        with pytest.raises(Exception):
            bad.collect()
    order = spark.createDataFrame([("x", "ES", "buy", 1, "limit", 5.0, None, False)], "client_order_id string, instrument string, side string, qty int, type string, limit_px double, stop_px double, is_automated boolean")
    for name in ("tradovate", "projectx"):
        with pytest.raises(Exception):
            codec(name).orders(order, 1).collect()
    p = codec("projectx")
    assert tuple(p.acks(one).filter("client_order_id = 'y'").first()) == ("y", False, "rejected", None)
    with pytest.raises(ValueError):
        codec("other")
    with pytest.raises(NotImplementedError):
        codec("rithmic")
