"""The path of an order: accepted once for each client_order_id, recorded, judged, sent, and its answer recorded.

accept() is a stream whose state, kept by client_order_id, knows which ids have come; it appends first orders to the outbox, a file
sink that commits each micro-batch once. forward() is a stream over the outbox: each of its micro-batches is judged, what is approved is
sent, and the answers are written before the batch counts as done. So the outbox is written before anything is sent; a batch that broke
off is judged and sent again by the next forward(), a batch whose answers are recorded never; and neither looks at what came
before it. A broker that knows an id takes it once.

A checkpoint carries a name of its own, its epoch. Only where there is more than one (one was lost, or orders come by another stream) is a
batch compared with the answers of the other epochs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

ACKS = "client_order_id string, accepted boolean, reason string, order_id long"


def _smallest(t: pa.Table) -> pa.Table:
    """The row of the smallest seq of each client_order_id."""
    t = t.sort_by("seq")
    at = pa.table({"id": t["client_order_id"], "at": np.arange(t.num_rows)}).group_by("id", use_threads=False).aggregate([("at", "min")])
    return t.take(at["at_min"])


def _smallest_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The row of the smallest seq of each client_order_id of a task. It holds a row an id, and as many that are still to be compared."""
    kept, more, n = None, [], 0
    for b in batches:
        more.append(b)
        n += b.num_rows
        if n >= max(1 << 16, kept.num_rows if kept else 0):
            kept, more, n = _smallest(pa.concat_tables([*([kept] if kept else []), pa.Table.from_batches(more)])), [], 0
    if more:
        kept = _smallest(pa.concat_tables([*([kept] if kept else []), pa.Table.from_batches(more)]))
    if kept:
        yield from kept.to_batches(max_chunksize=1 << 14)


def first_orders(orders: DataFrame, keep: str | None = None) -> DataFrame:
    """Of a stream's orders with one client_order_id the first to come, in a micro-batch the smallest by seq. Ids are remembered for good, or
    for `keep` (such as "30 days") of the orders' time ts; orders that come later than that are dropped.

    For good, a micro-batch is brought to a row an id by Arrow batches, and Spark's state drops the ids that it knows. With `keep` each id that
    a micro-batch has is a call of Python (some milliseconds), as its time is counted from its last order."""
    if not keep:
        return orders.repartition("client_order_id").mapInArrow(_smallest_of, orders.schema).dropDuplicates(["client_order_id"])
    names = orders.columns
    life = int(pd.Timedelta(keep).total_seconds() * 1000)

    def run(key, parts: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        known, best, last = state.exists, None, state.get[0] if state.exists else 0
        for p in parts:
            if not len(p):
                continue
            last = max(last, int(p["ts"].max().value // 1_000_000))
            if not known:
                r = p.iloc[[int(p["seq"].to_numpy().argmin())]]
                best = r if best is None or r["seq"].iloc[0] < best["seq"].iloc[0] else best
        state.update((last,))
        state.setTimeoutTimestamp(max(last + life, state.getCurrentWatermarkMs() + 1))
        if best is not None:
            yield best[names]

    return orders.withWatermark("ts", keep).groupBy("client_order_id").applyInPandasWithState(run, orders.schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


class Submitter:
    """decide(orders) adds approved and reason; send(orders) gives ACKS for approved orders, on the executors. Orders have
    client_order_id, seq and any other columns, and ts where ids are to be forgotten after `keep`."""

    def __init__(self, spark: SparkSession, path: str, decide: Callable[[DataFrame], DataFrame], send: Callable[[DataFrame], DataFrame], keep: str | None = None, files: int = 1000):
        self.spark, self.path, self.decide, self.send, self.keep, self.files = spark, path.rstrip("/"), decide, send, keep, files

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def _names(self, kind: str) -> list[str]:
        """The epochs that have records of a kind."""
        fs, p = self._at(f"{self.path}/{kind}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _epoch(self, checkpoint: str) -> str:
        """The name of a checkpoint, given to it when it is first used and lost with it."""
        fs, p = self._at(f"{checkpoint}/epoch")
        if not fs.exists(p):
            name, out = uuid.uuid4().hex[:12], fs.create(p, False)
            out.write(bytearray(name.encode()))
            out.close()
            return name
        return self.spark.read.text(p.toString()).first()[0]

    def _write(self, df: DataFrame, kind: str, batch: str) -> DataFrame:
        at = f"{self.path}/{kind}/{batch}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def _read(self, kind: str, schema, names: list[str]) -> DataFrame:
        out = self.spark.createDataFrame([], schema)
        for name in names:
            at = f"{self.path}/{kind}/{name}"
            if kind == "acks" or self._exists(f"{at}/_spark_metadata"):
                out = out.unionByName(self.spark.read.schema(schema).parquet(at).select(*out.columns))
        return out

    def acks(self) -> DataFrame:
        """Answers so far: of the broker, and of orders that weren't approved."""
        return self._read("acks", ACKS, self._names("acks"))

    def pending(self, schema) -> DataFrame:
        """Orders (of the schema) in the outbox that have no answer."""
        return self._read("outbox", schema, self._names("outbox")).join(self.acks().select("client_order_id"), "client_order_id", "left_anti")

    def _batch(self, orders: DataFrame, number: int, epoch: str) -> None:
        """A micro-batch from the outbox. One whose answers are recorded is done; one that broke off replaces its own records."""
        name = f"{epoch}/batch={number:09d}"
        if self._exists(f"{self.path}/acks/{name}/_SUCCESS"):
            return
        others = [x for x in self._names("acks") if x != epoch]
        if others:
            w = Window.partitionBy("client_order_id").orderBy("seq")
            first = orders.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
            orders = first.join(self._read("acks", ACKS, others).select("client_order_id"), "client_order_id", "left_anti").select(*orders.columns)
        judged = self._write(self.decide(orders), "judged", name)
        refused = judged.filter(~F.col("approved")).select("client_order_id", F.lit(False).alias("accepted"), "reason", F.lit(None).cast("long").alias("order_id"))
        answers = self.send(judged.filter("approved").select(*orders.columns)).select("client_order_id", "accepted", "reason", "order_id")
        self._write(answers.unionByName(refused), "acks", name)

    def accept(self, orders: DataFrame, checkpoint: str, trigger: dict | None = None):
        """A streaming query that appends each id's first order to the outbox; by default over all orders that there are now."""
        at = f"{self.path}/outbox/{self._epoch(checkpoint)}"
        return first_orders(orders, self.keep).writeStream.format("parquet").option("path", at).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()

    def forward(self, schema, trigger: dict | None = None) -> list:
        """Streaming queries over the outbox, one for each of its epochs: judge, send, record."""
        queries = []
        for source in self._names("outbox"):
            if not self._exists(f"{self.path}/outbox/{source}/_spark_metadata"):
                continue
            checkpoint = f"{self.path}/forward/{source}"
            epoch = f"{source}-{self._epoch(checkpoint)}"
            rows = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", self.files).parquet(f"{self.path}/outbox/{source}")
            query = rows.writeStream.foreachBatch(lambda df, k, e=epoch: self._batch(df, k, e)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
            if trigger is None:
                query.awaitTermination()  # one epoch after the other, so that the next knows its answers
            queries.append(query)
        return queries

    def recover(self, schema) -> None:
        """After a restart: what the outbox holds without an answer is judged anew and sent, if approved. Doing so again sends nothing."""
        self.forward(schema)

    def start(self, orders: DataFrame, checkpoint: str) -> None:
        """All orders of the stream that there are now, accepted and forwarded."""
        self.accept(orders, checkpoint).awaitTermination()
        self.forward(orders.schema)
