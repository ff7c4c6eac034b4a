"""Continuous series from contract bars (contract, ts, prices, volume, open_interest) and contracts (symbol, expiry)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULES, ADJUSTMENTS = ("volume", "open_interest", "calendar"), ("none", "panama_diff", "ratio")


def ordered(contracts: DataFrame) -> DataFrame:
    """symbol, seq (from 0 by expiry) and the next contract. Contracts are few: one window over all of them."""
    w = Window.orderBy("expiry", "symbol")
    return contracts.select("symbol", "expiry", (F.row_number().over(w) - 1).alias("seq"), F.lead("symbol").over(w).alias("back"))


def checked(bars: DataFrame, chain: DataFrame) -> DataFrame:
    """bars with seq and expiry; a contract that isn't listed raises."""
    met = bars.join(F.broadcast(chain.select(F.col("symbol").alias("contract"), "seq", "expiry")), "contract", "left")  # as many rows as contracts
    return met.withColumn("seq", F.when(F.col("seq").isNotNull(), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("no such contract: "), F.coalesce("contract", F.lit("null")))).cast("int")))


def common_sessions(bars: DataFrame) -> DataFrame:
    """seq, ts and both contracts' columns where a contract and the next have a bar. bars from checked()."""
    values = ("close", "volume", *(["open_interest"] if "open_interest" in bars.columns else []))
    front = bars.select("seq", "ts", "expiry", *(F.col(c).alias(f"front_{c}") for c in values))
    back = bars.select((F.col("seq") - 1).alias("seq"), "ts", *(F.col(c).alias(f"back_{c}") for c in values))
    return front.join(back, ["seq", "ts"])


def business_days_before(day: Column, n: int) -> Column:
    """n Mondays to Fridays before a date."""
    weekday = F.weekday(day)
    start = F.date_sub(day, F.greatest(weekday - 4, F.lit(0)).cast("int"))  # from a weekend, the Friday before counts as a step from the Monday
    first = F.when(weekday > 4, n - 1).otherwise(F.lit(n))
    wd = F.least(weekday, F.lit(4))
    return F.date_sub(start, (first + 2 * F.floor((first + 4 - wd) / 5)).cast("int"))


def rolls(bars: DataFrame, rule: str = "volume", confirm: int = 2, days: int = 4) -> DataFrame:
    """(seq, roll_ts, front_close, back_close) of each contract that has a next one. volume, open_interest: the first common
    session that ends `confirm` sessions in a row with more in the next contract; calendar: the last common session on or
    before `days` business days before expiry."""
    if rule not in RULES:
        raise ValueError(f"unknown roll rule {rule}")
    met = common_sessions(bars)
    if rule == "calendar":
        good = F.to_date("ts") <= business_days_before(F.col("expiry"), days)
        return met.filter(good).groupBy("seq").agg(F.max(F.struct("ts", "front_close", "back_close")).alias("r")).select("seq", F.col("r.ts").alias("roll_ts"), "r.front_close", "r.back_close")
    w = Window.partitionBy("seq").orderBy("ts").rowsBetween(-(confirm - 1), 0)
    more = F.coalesce(F.col(f"back_{rule}") > F.col(f"front_{rule}"), F.lit(False)).cast("int")
    met = met.withColumn("done", (F.sum(more).over(w) == confirm))
    return met.filter("done").groupBy("seq").agg(F.min(F.struct("ts", "front_close", "back_close")).alias("r")).select("seq", F.col("r.ts").alias("roll_ts"), "r.front_close", "r.back_close")


def adjustments(roll: DataFrame, adjustment: str = "none") -> DataFrame:
    """(seq, factor, offset_px) that bring each contract onto the newest; a front price of 0 raises for all kinds. A missing
    roll between two contracts shows as a null in checked_rolls."""
    if adjustment not in ADJUSTMENTS:
        raise ValueError(f"unknown adjustment {adjustment}")
    w = Window.orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    front = F.when(F.col("front_close") != 0, F.col("front_close")).otherwise(F.raise_error(F.lit("a front price is 0")).cast("double"))
    factor = F.exp(F.sum(F.ln(F.col("back_close") / front)).over(w)) if adjustment == "ratio" else F.lit(1.0) + 0 * front
    offset = F.sum(F.col("back_close") - front).over(w) if adjustment == "panama_diff" else F.lit(0.0)
    return roll.select("seq", factor.alias("factor"), offset.alias("offset_px"))


def continuous(bars: DataFrame, contracts: DataFrame, rule: str = "volume", adjustment: str = "none", confirm: int = 2, days: int = 4, symbol: str = "CONT") -> DataFrame:
    """(symbol, ts, open, high, low, close, volume, contract): each contract from the roll into it to the roll out of it, the
    latter excluded, adjusted. Rolls that are missing or don't follow one another raise; open interest is left out."""
    chain = ordered(contracts)
    bars = checked(bars, chain)
    roll = rolls(bars, rule, confirm, days)
    w = Window.orderBy("seq")
    legs = chain.select("seq", "back").join(roll, "seq", "left")
    legs = legs.withColumn("lo", F.lag("roll_ts").over(w))
    bad = (F.col("back").isNotNull() & F.col("roll_ts").isNull()) | (F.col("lo") >= F.col("roll_ts"))
    legs = legs.withColumn("hi", F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("contracts don't roll one after the other")).cast("timestamp")).otherwise(F.col("roll_ts")))
    legs = legs.join(adjustments(roll, adjustment), "seq", "left")
    inside = (F.col("lo").isNull() | (F.col("ts") >= F.col("lo"))) & (F.col("hi").isNull() | (F.col("ts") < F.col("hi")))
    met = bars.join(F.broadcast(legs.select("seq", "lo", "hi", "factor", "offset_px")), "seq").filter(inside)  # as many rows as contracts
    price = lambda c: (F.col(c) * F.coalesce("factor", F.lit(1.0)) + F.coalesce("offset_px", F.lit(0.0))).alias(c)
    return met.select(F.lit(symbol).alias("symbol"), "ts", *(price(c) for c in ("open", "high", "low", "close")), "volume", "contract")
