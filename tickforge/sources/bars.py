"""Bars: validation, dense positions, and price bars made from the event and line-item tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PRICES = ("open", "high", "low", "close")
REQUIRED = (*PRICES, "volume")
OPTIONAL = ("open_interest",)
INTERVALS = ("1m", "5m", "15m", "1h", "1d")


def by_time(*more: str, order: str = "pos"):
    """The window of a symbol (and further keys) in time order."""
    return Window.partitionBy("symbol", *more).orderBy(order)


def validate(df: DataFrame) -> DataFrame:
    """df, if it has a timestamp ts and the required columns as doubles, and no unknown ones; else ValueError."""
    kinds = dict(df.dtypes)
    if kinds.get("ts") != "timestamp":
        raise ValueError("bars need a timestamp column ts")
    if missing := [c for c in REQUIRED if c not in kinds]:
        raise ValueError(f"bars lack columns: {', '.join(missing)}")
    if unknown := sorted(set(kinds) - {*REQUIRED, *OPTIONAL, "ts", "symbol", "pos", "contract"}):
        raise ValueError(f"bars have unknown columns: {', '.join(unknown)}")
    if wrong := [c for c in (*REQUIRED, *OPTIONAL) if kinds.get(c, "double") != "double"]:
        raise ValueError(f"bars' columns aren't double: {', '.join(wrong)}")
    return df


def clean(df: DataFrame) -> DataFrame:
    """NaN becomes null in all double columns."""
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def with_pos(df: DataFrame, stretch: Column | None = None) -> DataFrame:
    """A dense position from 0 for each symbol's bars in time order. Where a stretch is given, which doesn't fall as time goes on, bars are numbered
    within it and only the counts of stretches, a row each, are summed by symbol, so no task has all bars of a symbol."""
    if stretch is None:
        return df.withColumn("pos", (F.row_number().over(by_time(order="ts")) - 1).cast("long"))
    cut = df.withColumn("_stretch", stretch)
    before = Window.partitionBy("_symbol").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(F.col("symbol").alias("_symbol"), F.col("_stretch").alias("_part")).agg(F.count("*").alias("_n"))
    offsets = counts.select("_symbol", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    placed = cut.withColumn("_at", F.row_number().over(by_time("_stretch", order="ts")) - 1)
    joined = placed.join(offsets, F.col("symbol").eqNullSafe(F.col("_symbol")) & F.col("_stretch").eqNullSafe(F.col("_part")))
    return joined.select(*df.columns, (F.col("_from") + F.col("_at")).cast("long").alias("pos"))


def union_bars(parts: list[DataFrame]) -> DataFrame:
    """Bars of several snapshots; a symbol's timestamp that occurs twice raises when the result is computed."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    w = Window.partitionBy("symbol", "ts")
    twice = F.count("*").over(w) > 1
    return out.withColumn("ts", F.when(twice, F.raise_error(F.concat(F.lit("duplicate bar at "), F.col("ts").cast("string"))).cast("timestamp")).otherwise(F.col("ts")))


def resample(df: DataFrame, symbol: Column, ts: Column, price: Column, unit: str, order: list[Column], volume: Column | None = None) -> DataFrame:
    """OHLCV of prices by symbol and unit of time; order breaks ties of ts. One shuffle, with partial aggregation."""
    at = F.struct(ts, *order)
    return (
        df.select(symbol.alias("symbol"), F.date_trunc(unit, ts).alias("bar"), at.alias("at"), price.cast("double").alias("price"), (volume if volume is not None else F.lit(1)).cast("double").alias("v"))
        .groupBy("symbol", F.col("bar").alias("ts"))
        .agg(F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("v").alias("volume"))
    )


def event_bars(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Bars of events: a symbol for each event type, a price for each value."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "ts", "value")
    return with_pos(resample(e, F.col("event_type"), F.col("ts"), F.col("value"), unit, [F.col("event_id")]))


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of line items: a symbol for each return flag."""
    e = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity", "l_orderkey", "l_linenumber")
    return with_pos(resample(e, F.col("l_returnflag"), F.col("l_shipdate"), F.col("l_extendedprice"), "day", [F.col("l_orderkey"), F.col("l_linenumber")], F.col("l_quantity")))


_SQL = """
    SELECT symbol, ts, open, high, low, close, volume, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS pos FROM (
        SELECT {symbol} AS symbol, date_trunc('{unit}', {at}) AS ts,
               arg_min({price}, row({at}, {ties})) AS open, max({price}) AS high, min({price}) AS low,
               arg_max({price}, row({at}, {ties})) AS close, CAST(sum({volume}) AS DOUBLE) AS volume
        FROM {table} GROUP BY 1, 2)
"""
#: The same bars as SQL, for queries' checks.
EVENT_SQL = _SQL.format(symbol="event_type", unit="hour", at="ts", price="value", ties="event_id", volume="1", table="events")
DAILY_SQL = _SQL.format(symbol="l_returnflag", unit="day", at="l_shipdate", price="l_extendedprice", ties="l_orderkey, l_linenumber", volume="l_quantity", table="lineitem")
