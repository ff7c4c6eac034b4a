"""Labels of events on bars: triple barriers, meta-labels, uniqueness weights and fixed horizons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.bars import by_time


def triple_barrier(events: DataFrame, bars: DataFrame, take: float = 2.0, stop: float = 2.0, horizon: int = 10) -> DataFrame:
    """(symbol, pos, end_pos, label, ret, touch) of events (symbol, pos, vol) on bars. Barriers lie take * vol above and stop *
    vol below the close at the event. The first later bar within the horizon (the data's end at most) that touches one
    decides, the stop first; without a touch the label is 0 at the last of them. An event without a bar or vol raises.

    Events meet bars by an equi-join on a bucket of `horizon` positions: each event looks in two buckets."""
    size = F.max("pos").over(Window.partitionBy("symbol"))
    last = F.least(F.col("pos") + horizon, size)
    path = bars.select("symbol", "pos", "high", "low", "close", size.alias("last_pos"))
    at = events.select("symbol", "pos", "vol").join(path.select("symbol", "pos", F.col("close").alias("entry"), "last_pos"), ["symbol", "pos"], "left")
    good = F.col("entry").isNotNull() & F.col("vol").isNotNull()
    at = at.withColumn("entry", F.when(good, F.col("entry")).otherwise(F.raise_error(F.lit("an event has no bar or no volatility")).cast("double")))
    at = at.withColumns({"until": F.least(F.col("pos") + horizon, F.col("last_pos")), "up": F.col("entry") * (1 + F.lit(take) * F.col("vol")), "down": F.col("entry") * (1 - F.lit(stop) * F.col("vol"))})
    bucket = lambda c: F.floor(F.col(c) / horizon)
    looks = at.withColumn("bucket", F.explode(F.array_distinct(F.array(F.floor((F.col("pos") + 1) / horizon), bucket("until")))))
    later = path.select("symbol", F.col("pos").alias("bar"), "high", "low", bucket("pos").alias("bucket"), F.col("close").alias("bar_close"))
    met = looks.join(later, ["symbol", "bucket"]).filter((F.col("bar") > F.col("pos")) & (F.col("bar") <= F.col("until")))
    touch = F.when(F.col("low") <= F.col("down"), "sl").when(F.col("high") >= F.col("up"), "pt")
    found = met.groupBy("symbol", "pos").agg(F.min(F.when(touch.isNotNull(), F.struct("bar", touch.alias("touch")))).alias("first"), F.max(F.struct("bar", "bar_close")).alias("end"))
    out = at.join(found, ["symbol", "pos"], "left")
    kind = F.coalesce("first.touch", F.lit("time"))
    end_close = F.coalesce("end.bar_close", "entry")
    ret = F.when(kind == "pt", F.lit(take) * F.col("vol")).when(kind == "sl", F.lit(-stop) * F.col("vol")).otherwise(end_close / F.col("entry") - 1)
    label = F.when(kind == "pt", 1).when(kind == "sl", -1).otherwise(0).cast("long")
    return out.select("symbol", "pos", F.coalesce("first.bar", "until").alias("end_pos"), label.alias("label"), ret.alias("ret"), kind.alias("touch"))


def meta_labels(labels: DataFrame, sides: DataFrame) -> DataFrame:
    """meta 1 where the side (symbol, pos, side in -1, 0, 1) times the label's return is positive, else 0; a side that is
    missing or another number raises."""
    met = labels.join(sides.select("symbol", "pos", "side"), ["symbol", "pos"], "left")
    ok = F.coalesce(F.col("side").isin(-1, 0, 1), F.lit(False))
    return met.withColumn("meta", F.when(ok, (F.col("side") * F.col("ret") > 0).cast("long")).otherwise(F.raise_error(F.lit("a label has no side")).cast("long")))


def model_meta_labels(labels: DataFrame, primary: DataFrame) -> DataFrame:
    """As the meta-model counts them: 1 where the sign of the primary signal is the label and the label isn't 0."""
    met = labels.join(primary.select("symbol", "pos", "raw"), ["symbol", "pos"], "left")
    return met.withColumn("meta", F.coalesce(((F.signum("raw") == F.col("label")) & (F.col("label") != 0)).cast("long"), F.lit(0).cast("long")))


def uniqueness_weights(labels: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, pos, end_pos, weight): the mean over a label's bars of one over the number of labels that span the bar. By
    running sums of starts and ends; labels and bars never meet as pairs."""
    spans = labels.select("symbol", "pos", "end_pos")
    steps = spans.select("symbol", "pos", F.lit(1).alias("step")).union(spans.select("symbol", (F.col("end_pos") + 1).alias("pos"), F.lit(-1).alias("step")))
    steps = steps.groupBy("symbol", "pos").agg(F.sum("step").alias("step"))
    run = by_time().rowsBetween(Window.unboundedPreceding, 0)
    track = bars.select("symbol", "pos").join(steps, ["symbol", "pos"], "left").withColumn("live", F.sum(F.coalesce("step", F.lit(0))).over(run))
    track = track.withColumn("total", F.sum(F.when(F.col("live") > 0, 1.0 / F.col("live")).otherwise(0.0)).over(run)).select("symbol", "pos", "total", F.coalesce(F.lag("total", 1).over(by_time()), F.lit(0.0)).alias("before"))
    out = spans.join(track.select("symbol", "pos", "before"), ["symbol", "pos"]).join(track.select("symbol", F.col("pos").alias("end_pos"), "total"), ["symbol", "end_pos"])
    return out.select("symbol", "pos", "end_pos", ((F.col("total") - F.col("before")) / (F.col("end_pos") - F.col("pos") + 1)).alias("weight"))


def fixed_horizon(bars: DataFrame, horizon: int, band: float = 0.0) -> DataFrame:
    """(symbol, pos, end_pos, label, ret): the sign of the return to the close `horizon` bars on, the last one's at the end; 0
    within the band."""
    w = by_time()
    end = F.last("close").over(w.rowsBetween(0, horizon))
    at = F.last("pos").over(w.rowsBetween(0, horizon))
    ret = end / F.nullif(F.col("close"), F.lit(0.0)) - 1
    return bars.select("symbol", "pos", at.alias("end_pos"), F.when(ret > band, 1).when(ret < -band, -1).otherwise(0).cast("long").alias("label"), ret.alias("ret"))


def sample_events(bars: DataFrame, most: int = 200, good: Column | None = None) -> DataFrame:
    """Every k-th of a symbol's bars that `good` accepts, about `most` of them (k: their number over `most`, 1 at least)."""
    df = bars if good is None else bars.filter(good)
    n = F.count("*").over(Window.partitionBy("symbol"))
    step = F.greatest(F.lit(1).cast("long"), F.floor(n / most))
    return df.withColumn("_step", step).withColumn("_rank", F.row_number().over(by_time()) - 1).filter(F.pmod("_rank", "_step") == 0).drop("_step", "_rank")
