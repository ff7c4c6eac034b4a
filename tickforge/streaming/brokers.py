"""Messages of brokers as columns: orders to JSON, and acknowledgements, positions and accounts from it. No connection is made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of order types and sides in the second format.
TYPE_NUMBERS, SIDE_NUMBERS = {"limit": 1, "market": 2, "stop": 4}, {"buy": 0, "sell": 1}


def _fail(message: str, kind: str = "string") -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def _needed(value: Column, what: str, kind: str) -> Column:
    """value, which raises where it is null."""
    return F.when(value.isNotNull(), value.cast(kind)).otherwise(_fail(f"a message lacks {what}", kind))


def _number(of: dict[str, int], name: str) -> Column:
    out = _fail(f"unknown {name}", "int")
    for k, v in of.items():
        out = F.when(F.lower(name) == k, v).otherwise(out)
    return out


def automated(orders: DataFrame) -> DataFrame:
    """orders, of which one that isn't marked as automated (is_automated, where there is such a column) raises: every order
    that a program makes is to be marked."""
    if "is_automated" not in orders.columns:
        return orders
    ok = F.coalesce("is_automated", F.lit(False))
    return orders.withColumn("client_order_id", F.when(ok, F.col("client_order_id")).otherwise(_fail("an order isn't marked as automated")))


@dataclass(frozen=True)
class Codec:
    """One broker's messages. body(account): an order's JSON; the schemas and columns of what comes back."""

    body: Callable[[int, str], Column]
    ack: str
    accepted: Column
    reason: Column
    venue_id: Column
    position: str
    positions: dict[str, Column]
    account: str
    accounts: dict[str, Column]

    def orders(self, orders: DataFrame, account: int, name: str = "") -> DataFrame:
        """(client_order_id, body) of orders (client_order_id, instrument, side, qty, type, limit_px, stop_px)."""
        return automated(orders).select("client_order_id", self.body(account, name).alias("body"))

    def _read(self, df: DataFrame, schema: str, keep: list[str], columns: dict[str, Column]) -> DataFrame:
        return df.select(*keep, F.from_json("body", schema, {"mode": "FAILFAST"}).alias("m")).select(*keep, *(c.alias(k) for k, c in columns.items()))

    def acks(self, df: DataFrame) -> DataFrame:
        """(client_order_id, accepted, reason, order_id) of answers (client_order_id, body); an accepted one without an order's
        number raises, and so does malformed JSON."""
        number = F.when(self.accepted, _needed(self.venue_id, "an order's number", "long"))
        return self._read(df, self.ack, ["client_order_id"], {"accepted": self.accepted, "reason": F.when(~self.accepted, self.reason), "order_id": number})

    def open_positions(self, df: DataFrame) -> DataFrame:
        """(instrument, qty, avg_px) of positions, a body each; those of no size are left out."""
        return self._read(df, self.position, [], self.positions).filter("qty <> 0")

    def balances(self, df: DataFrame) -> DataFrame:
        """(balance, equity) of accounts, a body each."""
        return self._read(df, self.account, [], self.accounts)


BROKERS = ("tradovate", "projectx")
#: Brokers whose gateway is binary: they have a name and no codec.
WITHOUT_CODEC = ("rithmic",)


def codec(broker: str) -> Codec:
    """A broker's public format. The second has no profit of open positions in its accounts: its equity is the balance."""
    if broker in WITHOUT_CODEC:
        raise NotImplementedError(f"{broker} has no text format")
    if broker not in BROKERS:
        raise ValueError(f"unknown broker {broker}")
    if broker == "tradovate":
        return Codec(
            body=lambda account, name: F.to_json(F.struct(
                F.lit(name).alias("accountSpec"), F.lit(account).alias("accountId"), F.col("client_order_id").alias("clOrdId"), F.initcap("side").alias("action"), F.col("instrument").alias("symbol"), F.col("qty").alias("orderQty"),
                F.initcap("type").alias("orderType"), F.lit(True).alias("isAutomated"), F.col("limit_px").alias("price"), F.col("stop_px").alias("stopPrice"),
            )),
            ack="orderId long, failureReason string, failureText string",
            accepted=F.col("m.failureReason").isNull() & F.col("m.failureText").isNull(), reason=F.coalesce("m.failureText", "m.failureReason"), venue_id=F.col("m.orderId"),
            position="symbol string, netPos int, netPrice double",
            positions={"instrument": _needed(F.col("m.symbol"), "a symbol", "string"), "qty": _needed(F.col("m.netPos"), "a size", "int"), "avg_px": F.col("m.netPrice")},
            account="cashBalance double, totalPnL double",
            accounts={"balance": _needed(F.col("m.cashBalance"), "a balance", "double"), "equity": _needed(F.col("m.cashBalance"), "a balance", "double") + F.coalesce("m.totalPnL", F.lit(0.0))},
        )
    return Codec(
        body=lambda account, name: F.to_json(F.struct(
            F.lit(account).alias("accountId"), F.col("instrument").alias("contractId"), _number(TYPE_NUMBERS, "type").alias("type"), _number(SIDE_NUMBERS, "side").alias("side"), F.col("qty").alias("size"),
            F.col("client_order_id").alias("customTag"), F.lit(True).alias("isAutomated"), F.col("limit_px").alias("limitPrice"), F.col("stop_px").alias("stopPrice"),
        )),
        ack="success boolean, orderId long, errorCode string, errorMessage string",
        accepted=F.coalesce("m.success", F.lit(False)), reason=F.coalesce("m.errorMessage", "m.errorCode", F.lit("rejected")), venue_id=F.col("m.orderId"),
        position="contractId string, type int, size int, averagePrice double",
        positions={"instrument": _needed(F.col("m.contractId"), "a contract", "string"), "qty": F.when(F.col("m.type") == 1, _needed(F.col("m.size"), "a size", "int")).otherwise(-F.col("m.size")), "avg_px": F.col("m.averagePrice")},
        account="id long, balance double",
        accounts={"balance": _needed(F.col("m.balance"), "a balance", "double"), "equity": F.col("m.balance")},
    )
