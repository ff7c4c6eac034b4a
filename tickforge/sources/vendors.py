"""Vendor files as bars and contracts, and the protocol that providers follow. Reading is offline; fetching is injected."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contracts import DAILY_COLUMNS, contract_bars

#: Record names by interval, and price scale.
RECORDS = {"1m": "ohlcv-1m", "1h": "ohlcv-1h", "1d": "ohlcv-1d"}
PRICE_SCALE = 1e-9
OHLCV = "ts_event long, rtype int, instrument_id long, open long, high long, low long, close long, volume long"
DEFINITIONS = "raw_symbol string, instrument_id long, activation long, expiration long"


class Provider(Protocol):
    """A source of contract bars. One that also has fetch_all(contracts, start, end, interval), with a column contract, gives all in one scan."""

    def fetch_bars(self, contract: str, start: str, end: str, interval: str) -> DataFrame: ...

    def list_contracts(self, root: str, start: str, end: str) -> DataFrame: ...


def _no_nulls(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    first = columns[0]
    return df.withColumn(first, F.when(bad, F.raise_error(F.lit(f"{what} lacks a field")).cast(df.schema[first].dataType)).otherwise(F.col(first)))


def fixed_point_bars(records: DataFrame, symbol: str | DataFrame) -> DataFrame:
    """Records with nanosecond times and prices in units of 1e-9 as bars; a missing field raises, and so does an instrument that
    definitions (instrument_id, symbol) lack."""
    records = _no_nulls(records, ["ts_event", "open", "high", "low", "close", "volume"], "a record")
    price = lambda c: (F.col(c) * PRICE_SCALE).alias(c)
    own = F.lit(symbol) if isinstance(symbol, str) else F.coalesce("_symbol", F.raise_error(F.concat(F.lit("no such instrument: "), F.col("instrument_id").cast("string"))))
    if not isinstance(symbol, str):
        records = records.join(symbol.select("instrument_id", F.col("symbol").alias("_symbol")), "instrument_id", "left")
    return records.select(own.alias("symbol"), F.timestamp_micros(F.floor(F.col("ts_event") / 1000).cast("long")).alias("ts"), *(price(c) for c in ("open", "high", "low", "close")), F.col("volume").cast("double").alias("volume"))


def read_fixed_point(spark: SparkSession, path: str, symbol: str | DataFrame, lines: bool = False) -> DataFrame:
    """Records as bars: of one symbol, or of all in definitions (instrument_id, symbol). A file is one array, which a task reads whole, or with
    lines a record a line, which is split like any text."""
    return fixed_point_bars(spark.read.schema(OHLCV).json(path, multiLine=not lines), symbol)


def read_definitions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """symbol, expiry, first_trade (null where not given) and instrument_id of contract definitions."""
    d = _no_nulls(spark.read.schema(DEFINITIONS).json(path, multiLine=not lines), ["raw_symbol", "expiration"], "a definition")
    day = lambda c: F.to_date(F.timestamp_micros(F.floor(F.col(c) / 1000).cast("long")))
    return d.select(F.col("raw_symbol").alias("symbol"), day("expiration").alias("expiry"), day("activation").alias("first_trade"), "instrument_id")


def _daily(spark: SparkSession, path: str, symbol: str | None, columns: str, **options) -> tuple[DataFrame, Column]:
    """Daily files of one symbol, or of all in folders symbol=..., and their symbol."""
    if symbol is not None:
        return spark.read.schema(columns).csv(path, header=True, **options), F.lit(symbol)
    return spark.read.schema(columns + ", symbol string").csv(path, header=True, **options), F.col("symbol")


def read_daily_csv(spark: SparkSession, path: str, symbol: str | None, open_interest: bool = True) -> DataFrame:
    """Daily files with named columns, in UTC: of one symbol, or (None) of all that have a folder symbol=... there."""
    names = [c for c in DAILY_COLUMNS if open_interest or c != "Open Interest"]
    raw, own = _daily(spark, path, symbol, "Date date, " + ", ".join(f"`{c}` double" for c in names), enforceSchema=False)
    return raw.select(own.alias("symbol"), F.col("Date").cast("timestamp").alias("ts"), *(F.col(c).alias(DAILY_COLUMNS[c]) for c in names))


def read_contract_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("symbol string, expiration date, first_trade date").csv(path, header=True).select("symbol", F.col("expiration").alias("expiry"), "first_trade")


def read_dev_csv(spark: SparkSession, path: str, symbol: str | None) -> DataFrame:
    """Daily files with an adjusted close, which is dropped. Never of validation grade: validation_grade is false."""
    raw, own = _daily(spark, path, symbol, "Date date, Open double, High double, Low double, Close double, `Adj Close` double, Volume double")
    return raw.select(own.alias("symbol"), F.col("Date").cast("timestamp").alias("ts"), *(F.col(c).alias(DAILY_COLUMNS[c]) for c in ("Open", "High", "Low", "Close", "Volume")), F.lit(False).alias("validation_grade"))


class FileProvider:
    """A provider over one folder: <contract>.csv files and contracts.csv."""

    def __init__(self, spark: SparkSession, root: str, validation_grade: bool = True):
        self.spark, self.root, self.validation_grade = spark, root.rstrip("/"), validation_grade

    def fetch_bars(self, contract: str, start: str, end: str, interval: str = "1d") -> DataFrame:
        if interval != "1d":
            raise ValueError("daily files only")
        return read_daily_csv(self.spark, f"{self.root}/{contract}.csv", contract).filter(F.col("ts").between(start, end))

    def fetch_all(self, contracts: list[str], start: str, end: str, interval: str = "1d") -> DataFrame:
        if interval != "1d":
            raise ValueError("daily files only")
        return contract_bars(self.spark, self.root).filter(F.col("contract").isin(contracts) & F.col("ts").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).withColumn("symbol", F.col("contract"))

    def list_contracts(self, root: str, start: str, end: str) -> DataFrame:
        if not self.validation_grade:
            raise NotImplementedError("development data have no contracts")
        return read_contract_csv(self.spark, f"{self.root}/contracts.csv").filter(F.col("symbol").startswith(root) & (F.col("expiry") >= start))


def fetch_snapshot(provider: Provider, store, root: str, start: str, end: str, interval: str, rule: str, adjustment: str, source: str, as_of: str) -> str:
    """Fetches all contracts, stitches them and saves the series; nothing is saved unless all succeed."""
    from ..operators.stitch import checked, continuous, ordered, rolls
    from .snapshots import SnapshotMeta

    contracts = provider.list_contracts(root, start, end)
    names = [r["symbol"] for r in contracts.select("symbol").orderBy("expiry").collect()]  # a row a contract
    if not names:
        raise ValueError(f"{root} has no contracts")
    bars = provider.fetch_all(names, start, end, interval) if hasattr(provider, "fetch_all") else None
    for n in () if hasattr(provider, "fetch_all") else names:
        part = provider.fetch_bars(n, start, end, interval).withColumn("contract", F.lit(n))
        bars = part if bars is None else bars.unionByName(part, allowMissingColumns=True)
    series = continuous(bars, contracts, rule, adjustment, symbol=root)
    # A row for each contract that rolls into the next.
    rolled = rolls(checked(bars, ordered(contracts)), rule).select("seq", F.date_format("roll_ts", "yyyy-MM-dd").alias("day")).orderBy("seq").collect()
    used = {r["contract"] for r in series.select("contract").distinct().collect()}
    if missing := [n for n in names if n not in used]:
        raise ValueError(f"contracts without a session of their own: {missing}")
    meta = SnapshotMeta(root, source, interval, start, end, True, as_of, continuous={"roll_rule": rule, "adjustment": adjustment, "roll_dates": [r["day"] for r in rolled], "underlying_contracts": names})
    return store.save(series.drop("contract"), meta)
