"""Session defaults and the schemas of the engine's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Explicit schemas for every reader; nothing is inferred.
SCHEMAS = {
    "bars": "symbol string, ts timestamp, open double, high double, low double, close double, volume double, open_interest double",
    "contracts": "symbol string, expiry date, first_trade date",
    "trades": "combo_id long, symbol string, entry_ts timestamp, exit_ts timestamp, side string, qty double, entry_px double, exit_px double, gross_pnl_usd double",
    "labels": "symbol string, t0 timestamp, t1 timestamp, label long, ret double, touch string",
    "folds": "fold int, pos long, role string",
    "perf": "config_id long, slice_id int, perf double",
    "days": "path_id long, day int, realized double, lo double, hi double",
    "fills": "fill_id string, instrument string, qty int",
    "positions": "instrument string, qty int",
    "ticks": "instrument string, price double, ts timestamp",
    "trials": "id long, trial_id string, run_id string, ts timestamp, strategy_family string, config_hash string, params string, data_snapshot_hashes array<string>, cv_scheme string, metrics map<string,double>, seed long, git_sha string",
}


def session(app: str = "tickforge", **conf: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution; further settings by keyword, dots as double underscores."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.python.filterPushdown.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where unset one made here, on a local master alone."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tickforge-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
