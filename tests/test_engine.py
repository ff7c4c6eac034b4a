"""Hand-computed cases, published values and properties of the engine's operators."""

import hashlib
import json
import math
import random
from dataclasses import replace
from datetime import UTC

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickforge import config
from tickforge.config import INSTRUMENTS, PRESETS, AccountRules, Costs
from tickforge.functions.recursive import ewm
from tickforge.operators import account, audit, crossval, features, hidden, labels, reconcile, regimes, statistics, stitch, sweeps
from tickforge.operators import trading as t
from tickforge.sources import bars as b
from tickforge.sources import snapshots
from tickforge.sources.snapshots import DataIntegrityError, SnapshotExistsError, SnapshotMeta, SnapshotStore, reference_history, require_validation_grade, synthetic_bars
from tickforge.sources.trials import TrialStore
from tickforge.sources.vendors import FileProvider, fetch_snapshot, fixed_point_bars, read_daily_csv, read_definitions, read_dev_csv
from tickforge.streaming.live import Risk

MES, MNQ = INSTRUMENTS["MES"], INSTRUMENTS["MNQ"]


def make_bars(spark, opens, close=None, high=None, low=None, symbol="S"):
    close = close or opens
    rows = [(symbol, k, float(o), float((high or opens)[k]), float((low or opens)[k]), float(close[k]), 1.0) for k, o in enumerate(opens)]
    df = spark.createDataFrame(rows, "symbol string, pos long, open double, high double, low double, close double, volume double")
    return df.withColumn("ts", F.timestamp_seconds(F.col("pos") * 3600))


def held(spark, opens, values):
    df = make_bars(spark, opens)
    pos = spark.createDataFrame(list(enumerate(map(float, values))), "pos long, held double")
    return df.join(pos, "pos").withColumn("combo_id", F.lit(0).cast("long"))


def test_costs(spark):
    log = spark.createDataFrame([("MES", 2.0, 100.0), ("MNQ", 1.0, 50.0)], "k string, qty double, gross_pnl_usd double")
    assert t.apply_costs(log.filter("k = 'MES'"), Costs(), MES).first()["net_pnl_usd"] == pytest.approx(92.96)
    assert t.apply_costs(log.filter("k = 'MNQ'"), Costs(), MNQ).first()["net_pnl_usd"] == pytest.approx(47.98)
    with pytest.raises(ValueError, match="atr_ticks_at_entry"):
        t.apply_costs(log, Costs(slippage_mode="vol_scaled"), MES)
    for bad in ({"spread_ticks": -1.0}, {"fill_delay_bars": 2}, {"slippage_mode": "x"}):
        with pytest.raises(config.ConfigError):
            Costs(**bad)


def test_toy_trades(spark):
    opens, path = [100, 102, 105, 103, 101, 99, 100, 104, 108], [0, 1, 1, 0, -1, -1, 0, 1, 0]
    log = t.trades(held(spark, opens, path), MES)
    got = log.orderBy("entry_pos").collect()
    assert [(r["entry_pos"], r["exit_pos"], r["gross_pnl_usd"]) for r in got] == [(1, 3, 5.0), (4, 6, 5.0), (7, 8, 20.0)]
    priced = t.apply_costs(log, Costs(), MES).orderBy("entry_pos").collect()
    assert [r["gross_pnl_usd"] - r["net_pnl_usd"] for r in priced] == pytest.approx([3.52] * 3)


def test_flip_and_last_bar(spark):
    got = t.trades(held(spark, [1, 2, 3, 4], [1, -1, -1, 1]), MES).orderBy("entry_pos").collect()
    assert [(r["entry_pos"], r["exit_pos"], r["side"]) for r in got] == [(0, 1, "long"), (1, 3, "short")]  # the run from the last bar has no length


def test_event_path_merges_sizes_of_one_sign(spark):
    df = held(spark, [1, 2, 3, 4, 5], [0.5, 1.0, 0.5, 0, 0])
    assert t.event_trades(df, MES, 2.0).collect()[0]["qty"] == 2.0
    assert t.event_trades(df, MES, 2.0).count() == 1 and t.trades(df, MES).count() == 3


def test_same_bar_fill_isnt_causal(spark):
    df = t.causal(make_bars(spark, [1, 2, 3]).withColumn("combo_id", F.lit(0)).withColumn("raw", F.col("pos").cast("double")))
    assert [r["held"] for r in df.orderBy("pos").collect()] == [0.0, 0.0, 1.0]


@pytest.mark.parametrize("a", [2 / 13, 1 / 14, 2 / 201, 0.9])
def test_ewm_is_the_recursion(spark, a):
    x = np.random.default_rng(1).normal(0, 1, 700)
    df = spark.createDataFrame([("S", k, float(v)) for k, v in enumerate(x)], "symbol string, pos long, x double")
    got = [r["y"] for r in ewm(df, {"y": ("x", a, 0)}).orderBy("pos").collect()]
    assert got == pytest.approx(pd.Series(x).ewm(alpha=a, adjust=False).mean().tolist(), rel=1e-9, abs=1e-12)
    late = [r["y"] for r in ewm(df, {"y": ("x", a, 3)}).orderBy("pos").collect()]
    assert late[:3] == [None] * 3 and late[3:] == pytest.approx(pd.Series(x[3:]).ewm(alpha=a, adjust=False).mean().tolist(), rel=1e-9, abs=1e-12)


def test_rsi_starts_at_its_window_and_is_100_without_losses(spark):
    got = [r["rsi"] for r in features.rsi(make_bars(spark, list(range(1, 31))), 14).orderBy("pos").collect()]
    assert got[:14] == [None] * 14 and got[14:] == [100.0] * 16


def test_ffd_weights():
    assert features.ffd_weights(0.4, 0.05) == pytest.approx([1, -0.4, -0.12, -0.064])
    with pytest.raises(ValueError):
        features.ffd_weights(0.4, 0)
    assert features.periods_per_year("1d") == 252 and features.periods_per_year("1h") == 23 * 252


def test_feature_matrix_columns(spark):
    got = features.build_features(synthetic_bars(spark, 300))
    assert got.columns == ["symbol", "pos", "ts", *features.feature_names()] and len(features.feature_names()) == 16
    full = got.filter("pos = 299").first()
    assert all(full[c] is not None for c in features.feature_names() if c != "fracdiff_close")


def test_features_are_causal_and_leaks_are_found(spark):
    history = reference_history(spark, 120)
    audit.assert_causal(lambda x: features.build_features(x).drop("ts"), history)
    with pytest.raises(audit.LookaheadError):
        audit.assert_causal(lambda x: x.select("symbol", "pos", F.lead("close").over(b.by_time()).alias("next")), history)
    r = audit.Registry()
    r.register("a", lambda x: x)
    with pytest.raises(ValueError):
        r.register("a", lambda x: x)


@pytest.mark.parametrize("high,low,want", [(103, 99, ("pt", 1, 0.02)), (101, 97, ("sl", -1, -0.02)), (103, 97, ("sl", -1, -0.02)), (101, 99, ("time", 0, 0.01)), (102, 99, ("pt", 1, 0.02))])
def test_barriers(spark, high, low, want):
    bars = make_bars(spark, [100, 100, 100], close=[100, 100, 101], high=[100, high, 101], low=[100, low, 100])
    events = spark.createDataFrame([("S", 0, 0.01)], "symbol string, pos long, vol double")
    r = labels.triple_barrier(events, bars, 2, 2, 5).first()
    assert (r["touch"], r["label"]) == want[:2] and r["ret"] == pytest.approx(want[2])


def test_events_without_bars_raise(spark):
    events = spark.createDataFrame([("S", 9, 0.01)], "symbol string, pos long, vol double")
    with pytest.raises(Exception, match="no bar"):
        labels.triple_barrier(events, make_bars(spark, [1, 2]), 2, 2, 5).collect()


def test_uniqueness(spark):
    lab = spark.createDataFrame([("S", 0, 2), ("S", 1, 3)], "symbol string, pos long, end_pos long")
    got = {r["pos"]: r["weight"] for r in labels.uniqueness_weights(lab, make_bars(spark, [1] * 5)).collect()}
    assert got == pytest.approx({0: (1 + 0.5 + 0.5) / 3, 1: (0.5 + 0.5 + 1) / 3})


def plain_kfold(iv, k, embargo):
    n, out = len(iv), []
    for f, block in enumerate(np.array_split(np.arange(n), k)):
        b0, b1 = min(iv[i][0] for i in block), max(iv[i][1] for i in block)
        gap = set(range(block[-1] + 1, block[-1] + 1 + int(n * embargo)))
        out += [(f, i, "test") if i in set(block) else (f, i, "train") for i in range(n) if i in set(block) or not (iv[i][0] <= b1 and iv[i][1] >= b0) and i not in gap]
    return sorted(out)


def test_purged_folds(spark):
    rnd = random.Random(2)
    iv, at = [], 0
    for _ in range(57):
        at += rnd.randrange(3)
        iv.append((at, at + rnd.randrange(6)))
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(iv)], "pos long, t0 long, t1 long")
    crossval.validate_intervals(df)
    got = sorted(tuple(r) for r in crossval.purged_kfold(df, 57, 5, 0.05).collect())
    assert got == plain_kfold(iv, 5, 0.05)
    pairs = crossval.combinatorial(df, 57, 6, 2)
    assert pairs.select("fold").distinct().count() == 15 and crossval.n_paths(6, 2) == 5
    walk = crossval.walk_forward(df, 57, 4)
    ends = {k: x[1] for k, x in enumerate(iv)}
    for f in range(4):
        rows = walk.filter(F.col("fold") == f).collect()
        test = [r["pos"] for r in rows if r["role"] == "test"]
        assert all(ends[r["pos"]] < iv[min(test)][0] for r in rows if r["role"] == "train")
    with pytest.raises(ValueError):
        crossval.walk_forward(df, 57, 4, purge=False)
    with pytest.raises(ValueError, match="order"):
        crossval.validate_intervals(spark.createDataFrame([(0, 5, 6), (1, 4, 6)], "pos long, t0 long, t1 long"))


def test_expected_maxima():
    assert [statistics.expected_max_z(n) for n in (1, 10, 50, 100, 1000)] == pytest.approx([0, 1.574598, 2.276303, 2.530603, 3.255122], abs=1e-6)


def test_pbo_of_noise_and_of_skill(spark):
    rng = np.random.default_rng(4)
    rows = [(c, s, float(rng.normal())) for c in range(12) for s in range(8)]
    noise = statistics.pbo(spark.createDataFrame(rows, "config_id long, slice_id int, perf double"), 8).first()
    assert noise["splits"] == 70 and 0.2 < noise["pbo"] < 0.85
    skill = [(c, s, p + (40 + s % 3 if c == 3 else 0)) for c, s, p in rows]
    assert statistics.pbo(spark.createDataFrame(skill, "config_id long, slice_id int, perf double"), 8).first()["pbo"] == 0
    with pytest.raises(ValueError):
        statistics.halves(7)


def test_deflation_falls_with_trials(spark):
    df = spark.createDataFrame([(0.1, 500, 0.0, 3.0), (0.0, 1, 0.0, 3.0)], "sharpe double, n long, skew double, kurt double")
    values = [sorted(r["dsr"] for r in statistics.deflated_sharpe(df, n).collect()) for n in (1, 10, 100)]
    assert values[0][1] > values[1][1] > values[2][1] and values[0][0] == 0


def test_bootstrap_covers_and_wraps(spark):
    index = statistics.stationary_index(spark, 50, 20, 5.0, 3)
    assert index.count() == 1000 and index.filter("idx < 0 OR idx >= 50").count() == 0
    x = np.random.default_rng(0).normal(0.2, 1, 200)
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "idx long, ret double")
    r = statistics.bootstrap_sharpe(df, 200, 200, 0.9, 4.0).first()
    assert r["lo"] < x.mean() / x.std(ddof=1) < r["hi"]
    assert account.default_block(x[:10]) == 1 and 1 <= account.default_block(x) <= 200


def plain_account(days, r):
    bal = hwm = r.start
    floor, frozen, best = r.start - r.trailing, False, -math.inf

    def lift(x):
        nonlocal hwm, floor, frozen
        if not frozen and x > hwm:
            hwm, floor = x, x - r.trailing
            if r.freeze_at_start and floor >= r.start:
                floor, frozen = r.start, True

    for k, (res, lo, hi) in enumerate(days, 1):
        low = lo if lo is not None else min(0.0, res)
        cap = -r.daily_loss if r.daily_loss is not None and low <= -r.daily_loss else res
        if r.drawdown == "intraday":
            lift(bal + hi)
            if bal + (lo if r.daily_loss is None else max(lo, -r.daily_loss)) <= floor:
                return False, False, k
            bal += cap
            lift(bal)
        else:
            bal += cap
            if bal <= floor:
                return False, False, k
            lift(bal)
        best = max(best, cap)
        won = bal - r.start
        if won >= r.target and k >= r.min_days and (r.consistency is None or best <= r.consistency * won):
            return True, True, k
    return True, False, len(days)


@pytest.mark.parametrize("rules", [*PRESETS.values(), AccountRules("x", drawdown="intraday", daily_loss=700.0, consistency=0.6, min_days=4, freeze_at_start=True)], ids=lambda r: r.name)
def test_accounts_are_the_daily_fold(spark, rules):
    rnd = random.Random(7)
    paths = []
    for _ in range(400):
        days = []
        for _ in range(rnd.randrange(1, 25)):
            res = 100.0 * rnd.randrange(-9, 12)
            days.append((res, min(0.0, res) - 100 * rnd.randrange(3), max(0.0, res) + 100 * rnd.randrange(3)))
        paths.append(days)
    df = spark.createDataFrame([(p, d, *x) for p, days in enumerate(paths) for d, x in enumerate(days)], "path_id long, day int, realized double, lo double, hi double")
    got = {r["path_id"]: (r["survived"], r["hit_target"], r["days_elapsed"]) for r in account.simulate(account.validate_days(df), rules).collect()}
    assert got == {p: plain_account(days, rules) for p, days in enumerate(paths)}


def test_gamblers_ruin(spark):
    """Steps of 100 from 50,000 with a frozen floor 1,000 below and a target 3,000 above: ruin has probability 3/4."""
    log = spark.createDataFrame([(k, 100.0 if k % 2 else -100.0) for k in range(64)], "idx long, net_pnl_usd double").withColumn("exit_ts", F.timestamp_seconds(F.col("idx") * 86_400))
    rules = AccountRules("g", trailing=1e9, target=3_000.0)
    one = account.to_days(account.resample(log, 64, 400, 1500, 1, 5), 1).withColumn("bal", F.sum("realized").over(__import__("pyspark").sql.Window.partitionBy("path_id").orderBy("day")))
    first = one.groupBy("path_id").agg(F.min(F.when(F.col("bal") <= -1000, F.col("day"))).alias("lose"), F.min(F.when(F.col("bal") >= 3000, F.col("day"))).alias("win"))
    ended = first.filter("lose IS NOT NULL OR win IS NOT NULL").agg(F.avg((F.col("lose").isNotNull() & (F.col("win").isNull() | (F.col("lose") < F.col("win")))).cast("double")), F.count("*")).first()
    assert ended[1] > 300 and abs(ended[0] - 0.75) < 0.08
    assert account.survival(log, rules, 50, 20).first()["p_survival"] == 1.0
    assert account.max_contracts(log, PRESETS["topstep_50k"], most=3, paths=50, days=10) in range(4)


def test_bad_days_raise(spark):
    bad = spark.createDataFrame([(0, 0, 5.0, 1.0, 6.0)], "path_id long, day int, realized double, lo double, hi double")
    with pytest.raises(Exception, match="extremes"):
        account.validate_days(bad).collect()


def contract_bars(spark):
    """Two contracts, 10 business days in common; the second one's volume is larger from the fifth on, its price 25 higher."""
    days = pd.bdate_range("2024-01-01", periods=20)
    rows = [("A", d, 100.0 + k, 10.0 if k < 9 else 3.0) for k, d in enumerate(days[:15])] + [("B", d, 125.0 + k, 2.0 if k < 9 else 9.0) for k, d in enumerate(days) if k >= 5]
    df = spark.createDataFrame([(c, d.to_pydatetime(), p, p + 1, p - 1, p, v) for c, d, p, v in rows], "contract string, ts timestamp, open double, high double, low double, close double, volume double")
    return df, spark.createDataFrame([("B", days[19].date()), ("A", days[14].date())], "symbol string, expiry date"), days


def test_stitching(spark):
    bars, contracts, days = contract_bars(spark)
    roll = stitch.rolls(stitch.checked(bars, stitch.ordered(contracts)), "volume").first()
    assert roll["roll_ts"] == days[10].to_pydatetime()  # the second session in a row
    cal = stitch.rolls(stitch.checked(bars, stitch.ordered(contracts)), "calendar").first()
    assert cal["roll_ts"] == days[10].to_pydatetime()  # four business days before the fifteenth
    raw, diff, ratio = ({r["ts"]: r for r in stitch.continuous(bars, contracts, "volume", a).collect()} for a in stitch.ADJUSTMENTS)
    assert len(raw) == 20 and [r["contract"] for _, r in sorted(raw.items())] == ["A"] * 10 + ["B"] * 10
    first = days[0].to_pydatetime()
    assert diff[first]["close"] == 125 and ratio[first]["close"] == pytest.approx(100 * 135 / 110)
    for k in range(9):  # differences and ratios of neighbours are kept
        x, y = days[k].to_pydatetime(), days[k + 1].to_pydatetime()
        assert diff[y]["close"] - diff[x]["close"] == pytest.approx(raw[y]["close"] - raw[x]["close"])
        assert ratio[y]["close"] / ratio[x]["close"] == pytest.approx(raw[y]["close"] / raw[x]["close"])
    with pytest.raises(Exception, match="no such contract"):
        stitch.continuous(bars, contracts.filter("symbol = 'A'")).collect()


def test_business_days(spark):
    days = pd.date_range("2024-02-20", periods=25)
    df = spark.createDataFrame([(d.date(),) for d in days], "d date")
    for n in (1, 4, 7):
        got = [r[0] for r in df.select(stitch.business_days_before(F.col("d"), n)).collect()]
        assert got == [(d - pd.offsets.BDay(n)).date() for d in days]


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}")
    assert store.list() == []
    bars = synthetic_bars(spark, 50)
    meta = SnapshotMeta("MES", "synthetic", "1m", "a", "b", True, "now", continuous={"roll_rule": "volume"})
    digest = store.save(bars, meta)
    back, got = store.load(digest)
    assert got.snapshot_hash == digest and back.count() == 50 and [m.snapshot_hash for m in store.list()] == [digest]
    with pytest.raises(SnapshotExistsError):
        store.save(bars, SnapshotMeta("MES", "synthetic", "1m", "a", "b", True, "later", continuous={"roll_rule": "volume"}))  # when it was taken isn't hashed
    with pytest.raises(FileNotFoundError):
        store.load("0" * 64)
    require_validation_grade(got)
    for bad in (SnapshotMeta("M", "s", "1d", "a", "b", False, "n"), SnapshotMeta("M", "s", "1d", "a", "b", True, "n")):
        with pytest.raises(DataIntegrityError):
            require_validation_grade(bad)
    again, other = (synthetic_bars(spark, 20_000, k).orderBy("pos").collect() for k in (7, 8))
    rows = synthetic_bars(spark, 20_000).repartition(3).orderBy("pos").collect()
    assert rows == again != other
    assert all(r["low"] <= min(r["open"], r["close"]) and max(r["open"], r["close"]) <= r["high"] and 100 <= r["volume"] < 9100 for r in rows)
    assert all(abs(a["close"] - c["open"]) < 1e-6 for a, c in zip(rows, rows[1:]))
    gaps = [(c["ts"] - a["ts"]).total_seconds() for a, c in zip(rows, rows[1:])]
    assert all(g == (7200 if (k + 1) % 1320 == 0 else 60) for k, g in enumerate(gaps))
    assert abs(np.std(np.diff(np.log([r["close"] for r in rows]))) / 0.0012 - 1) < 0.05
    with pytest.raises(ValueError, match="unknown columns"):
        b.validate(bars.withColumn("x", F.lit(1)))


def plain_flat_hash(rows, meta):
    h = hashlib.sha256(b"FE-SNAPSHOT-v1\n")
    h.update(b"index\0" + np.array([int(r["ts"].replace(tzinfo=UTC).timestamp()) * 10**9 for r in rows], "<i8").tobytes() + b"\ncols\0")
    for c in ("open", "high", "low", "close", "volume"):
        h.update(c.encode() + b"\0" + np.array([r[c] for r in rows], "<f8").tobytes() + b"\0")
    h.update(b"\nmeta\0" + json.dumps({k: getattr(meta, k) for k in ("symbol_root", "source", "interval", "start", "end", "validation_grade", "continuous")}, sort_keys=True, separators=(",", ":")).encode())
    return h.hexdigest()


def plain_tree_hash(rows, meta, leaf, branch):
    """The same digests by loops over sorted rows."""
    step, keyed = leaf * 60 * 10**9, {}
    for r in sorted(rows, key=lambda r: (r["symbol"], r["ts"])):
        nanos = int(r["ts"].replace(tzinfo=UTC).timestamp()) * 10**9
        keyed.setdefault((r["symbol"], nanos // step), []).append((nanos, *(r[c] for c in ("open", "high", "low", "close", "volume"))))
    tops = {}
    for (symbol, k), got in sorted(keyed.items()):
        a = np.array(got, dtype=object)
        data = a[:, 0].astype("<i8").tobytes() + b"".join(a[:, c].astype("<f8").tobytes() for c in range(1, 6))
        tops.setdefault((symbol, k // branch), hashlib.sha256()).update(np.int64(k).tobytes() + hashlib.sha256(data).digest())
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":")).encode()
    h = hashlib.sha256(b"tickforge-tree-v1\n" + dump(["open", "high", "low", "close", "volume"]))
    for key, d in sorted(tops.items()):
        h.update(b"\0" + dump(list(key)) + b"\0" + d.digest())
    h.update(b"\nmeta\0" + dump({k: getattr(meta, k) for k in ("symbol_root", "source", "interval", "start", "end", "validation_grade", "continuous")}))
    return h.hexdigest()


def test_tree_hash(spark, tmp_path, monkeypatch):
    """Equal for any partitions and order, by stretches that executors digest; each value counts, and the driver gets a row a branch."""
    monkeypatch.setattr(snapshots, "LEAF_BARS", 64)
    monkeypatch.setattr(snapshots, "BRANCH", 4)
    bars = synthetic_bars(spark, 1500).unionByName(synthetic_bars(spark, 700, 3, symbol="MNQ")).cache()
    meta = SnapshotMeta("MES", "synthetic", "1m", "a", "b", True, "now", continuous={"roll_rule": "volume"}, recipe="tree")
    digest = snapshots.tree_hash(bars, meta)
    assert digest == snapshots.tree_hash(bars.repartition(7, "close"), meta) == plain_tree_hash(bars.collect(), meta, 64, 4)
    one = F.when((F.col("pos") == 900) & (F.col("symbol") == "MES"), F.col("close") * (1 + 1e-15)).otherwise(F.col("close"))
    others = [bars.withColumn("close", one), bars.filter("pos < 1499"), bars.withColumn("symbol", F.lit("MES")), bars.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND")), bars.withColumn("open_interest", F.lit(1.0))]
    assert len({digest, snapshots.tree_hash(bars, replace(meta, end="c")), *(snapshots.tree_hash(o, meta) for o in others)}) == 7
    one = bars.filter("symbol = 'MES'")
    assert snapshots.content_hash(one, meta) == plain_flat_hash(one.orderBy("ts").collect(), meta)
    store = SnapshotStore(spark, f"file://{tmp_path}")
    for recipe in ("tree", "flat"):
        digest = store.save(one, replace(meta, source=recipe), recipe)
        assert store.load(digest)[1].recipe == recipe and store.verify(digest)
        files = spark.read.parquet(f"file://{tmp_path}/{digest}.parquet").withColumn("close", F.col("close") + 1).collect()
        spark.createDataFrame(files, bars.drop("pos").schema).write.mode("overwrite").parquet(f"file://{tmp_path}/{digest}.parquet")
        assert not store.verify(digest)
    monkeypatch.setattr(snapshots, "FLAT_ROWS", 100)
    with pytest.raises(ValueError, match="flat recipe"):
        store.save(one, meta, "flat")


def test_positions_of_loaded_bars(spark, tmp_path, monkeypatch):
    """Dense by symbol over stretches of time, some of them empty, whatever the partitions; a symbol's bars aren't all in one partition."""
    monkeypatch.setattr(snapshots, "LEAF_BARS", 64)
    hole = F.col("pos").between(100, 700) & (F.col("symbol") == "MNQ")
    bars = synthetic_bars(spark, 1500).unionByName(synthetic_bars(spark, 900, 3, symbol="MNQ")).filter(~hole)
    none = bars.filter("symbol = 'MNQ'").withColumn("symbol", F.lit(None).cast("string"))
    bars = bars.unionByName(none).repartition(5, "close").drop("pos")
    store = SnapshotStore(spark, f"file://{tmp_path}")
    back, _ = store.load(store.save(bars, SnapshotMeta("M", "synthetic", "1m", "a", "b", False, "now")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = back.select("symbol", "ts", "pos", "close", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for symbol, ts in sorted(((r["symbol"] or "", r["ts"]) for r in bars.collect())):
        want.setdefault(symbol, []).append(ts)
    assert sorted((r["symbol"] or "", r["pos"], r["ts"]) for r in got) == [(s, k, ts) for s in sorted(want) for k, ts in enumerate(want[s])]
    assert len({r["part"] for r in got if r["symbol"] == "MES"}) > 1
    assert back.columns == [*bars.columns, "pos"]


def test_trials(spark, tmp_path):
    store = TrialStore(spark, f"file://{tmp_path}/trials")
    trial = lambda k, family="f": {"trial_id": f"t{k}", "run_id": "r", "strategy_family": family, "config_hash": "h", "params": {"w": k}, "metrics": {"s": 1.0}}
    assert store.count() == 0
    store.append([trial(1), trial(2, "g")])
    store.append([trial(3)])
    with pytest.raises(ValueError, match="there already"):
        store.append([trial(4), trial(2)])
    assert [r["trial_id"] for r in store.all().collect()] == ["t1", "t2", "t3"] and store.count("f") == 2
    assert store.list_hash() == store.list_hash() != store.list_hash("f")


def test_trials_of_many_writers(spark, tmp_path):
    """Eight threads add 100 trials each: ids are 1 to 800, each writer's in its order; of equal trial_ids one is added."""
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/trials"
    trial = lambda i: {"trial_id": i, "run_id": "r", "strategy_family": "f", "config_hash": "h", "params": {}, "metrics": {}}

    def write(k):
        store = TrialStore(spark, path)
        for part in range(2):
            store.append([trial(f"{k}-{n:03d}") for n in range(50 * part, 50 * part + 50)])

    with ThreadPoolExecutor(8) as pool:
        list(pool.map(write, range(8)))
    rows = TrialStore(spark, path).all().collect()
    assert [r["id"] for r in rows] == list(range(1, 801)) and len({r["trial_id"] for r in rows}) == 800
    for k in range(8):
        own = [r["trial_id"] for r in rows if r["trial_id"].startswith(f"{k}-")]
        assert own == sorted(own)

    def same(k):
        try:
            TrialStore(spark, path).append([trial(f"new-{k}"), trial("same")])
            return 1
        except ValueError:
            return 0

    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(same, range(4))) == 1
    store = TrialStore(spark, path)
    assert store.count() == 802 and store.log.size() == 17 and not store.log.put(3, {})


def test_run_from_a_file_and_a_snapshot(spark, tmp_path):
    """The gate, the report's sections, and a manifest that doesn't read the clock."""
    from tickforge.plans.research import read_report, run_snapshot

    store = SnapshotStore(spark, f"file://{tmp_path}/snapshots")
    bars = synthetic_bars(spark, 400)
    meta = SnapshotMeta("MES", "synthetic", "1m", "a", "b", True, "now", continuous={"roll_rule": "volume"})
    good, bad = store.save(bars, meta), store.save(bars, replace(meta, validation_grade=False))
    write = lambda name, text: (tmp_path / name).write_text(text) and tmp_path / name
    run = "run:\n  grid: {window: [5, 10, 20]}\n  bootstrap: 20\n  paths: 20\n"
    with pytest.raises(DataIntegrityError):
        run_snapshot(write("bad.yaml", f"snapshot_hash: {bad}\n{run}"), store, tmp_path / "out")
    with pytest.raises(config.ConfigError):
        run_snapshot(write("odd.yaml", f"snapshot_hash: {good}\nsettings: 1\n{run}"), store, tmp_path / "out")
    path = write("run.yaml", f"snapshot_hash: {good}\n{run}")
    report = run_snapshot(path, store, tmp_path / "out", TrialStore(spark, f"file://{tmp_path}/trials"))
    assert report.manifest.snapshots == [good] and report.trials == 3 and report.manifest.created_at == run_snapshot(path, store, tmp_path / "again").manifest.created_at
    found = read_report(tmp_path / "out" / report.manifest.run_id)
    for title in ("Gates", "Numbers", "Costs", "Survival", "Data", "Trials", "Flags"):
        assert f"## {title}" in found["report.md"]
    html = (tmp_path / "out" / report.manifest.run_id / "report.html").read_text()
    assert html.count("<table>") == 7 and "<pre>" not in html and good in html
    tables = {title: dict((r[0], r[1]) for r in rows) for title, _, rows in report.tables()}
    money = {k: float(v) for k, v in tables["Costs"].items()}
    assert money["gross_pnl_usd"] - sum(money[c] for c in ("commission_usd", "fees_usd", "spread_cost_usd", "slippage_usd")) == pytest.approx(money["net_pnl_usd"], abs=0.05) and money["commission_usd"] > 0
    assert tables["Data"]["features"] == "16" and int(tables["Data"]["labels"]) > 100 and "ci_lo" in tables["Survival"]


def test_vendor_files(spark, tmp_path):
    records = spark.createDataFrame([(1_700_000_000_000_000_000, 34, 1, 5_000_250_000_000, 5_001_000_000_000, 4_999_000_000_000, 5_000_500_000_000, 7)], "ts_event long, rtype int, instrument_id long, open long, high long, low long, close long, volume long")
    r = fixed_point_bars(records, "MES").first()
    assert r["open"] == pytest.approx(5000.25) and r["ts"].timestamp() == 1_700_000_000
    with pytest.raises(Exception, match="lacks a field"):
        fixed_point_bars(records.withColumn("open", F.lit(None).cast("long")), "MES").collect()
    (tmp_path / "defs.json").write_text('[{"raw_symbol": "MESH4", "instrument_id": 1, "expiration": 1710460800000000000}]')
    d = read_definitions(spark, f"file://{tmp_path}/defs.json").first()
    assert str(d["expiry"]) == "2024-03-15" and d["first_trade"] is None
    (tmp_path / "A.csv").write_text("Date,Open,High,Low,Close,Volume,Open Interest\n2024-01-02,1,2,0.5,1.5,10,5\n")
    assert read_daily_csv(spark, f"file://{tmp_path}/A.csv", "A").first()["open_interest"] == 5.0
    (tmp_path / "dev.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-02,1,2,0.5,1.5,1.4,10\n")
    assert read_dev_csv(spark, f"file://{tmp_path}/dev.csv", "A").first()["validation_grade"] is False
    with pytest.raises(NotImplementedError):
        FileProvider(spark, "x", False).list_contracts("A", "", "")


def test_contract_files_are_one_scan(spark, tmp_path):
    """Partitions are files; a filter on contracts opens theirs alone, one on times holds with or without pushdown."""
    from tickforge.sources import contracts

    head = "Date,Open,High,Low,Close,Volume,Open Interest\n"
    day = lambda k: f"2024-01-{k:02d},1,2,0.5,{k},10,5\n"
    (tmp_path / "A.csv").write_text(head + "".join(day(k) for k in range(1, 9)))
    (tmp_path / "B.csv").mkdir()
    for part in (1, 2):
        (tmp_path / f"B.csv/part-{part}").write_text(head + day(part))
    (tmp_path / "B.csv/_SUCCESS").write_text("")
    (tmp_path / "C.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-03,1,2,0.5,3,10\n")
    (tmp_path / "contracts.csv").write_text("symbol\nA\n")
    (tmp_path / "notes.txt").write_text("x")
    rows = lambda df: sorted((r["contract"], r["ts"].day, r["close"], r["open_interest"]) for r in df.collect())
    every = [*(("A", k, float(k), 5.0) for k in range(1, 9)), ("B", 1, 1.0, 5.0), ("B", 2, 2.0, 5.0), ("C", 3, 3.0, None)]
    before = spark.conf.get(contracts.PUSHDOWN, "false")
    try:
        for pushed in ("true", "false"):
            spark.conf.set(contracts.PUSHDOWN, pushed)
            df = contracts.contract_bars(spark, f"file://{tmp_path}")
            assert df.rdd.getNumPartitions() == 4 and rows(df) == every
            some = df.filter("contract IN ('A', 'C') AND ts >= timestamp'2024-01-03' AND ts < timestamp'2024-01-05'")
            assert rows(some) == [("A", 3, 3.0, 5.0), ("A", 4, 4.0, 5.0), ("C", 3, 3.0, None)]
            assert rows(df.filter("contract = 'B'")) == every[8:10] and rows(df.filter("contract = 'Z'")) == []
    finally:
        spark.conf.set(contracts.PUSHDOWN, before)
    r = contracts.FilteredReader({"root": f"file://{tmp_path}"})
    left = list(r.pushFilters([contracts.In(("contract",), ("A", "B")), contracts.EqualTo(("contract",), "B"), contracts.EqualTo(("close",), 1.0)]))
    assert [p.contract for p in r.partitions()] == ["B", "B"] and len(left) == 1
    with pytest.raises(ValueError):
        contracts.ContractReader({})


def test_fetch_saves_all_or_nothing(spark, tmp_path):
    bars, contracts, days = contract_bars(spark)

    class Source:
        def list_contracts(self, root, start, end):
            return contracts

        def fetch_bars(self, contract, start, end, interval):
            return bars.filter(F.col("contract") == contract).drop("contract")

    store = SnapshotStore(spark, f"file://{tmp_path}")
    digest = fetch_snapshot(Source(), store, "X", "2024-01-01", "2024-02-01", "1d", "volume", "ratio", "test", "now")
    back, meta = store.load(digest)
    assert back.count() == 20
    rolled = stitch.rolls(stitch.checked(bars, stitch.ordered(contracts)), "volume").orderBy("seq").collect()
    assert meta.continuous["roll_dates"] == [str(r["roll_ts"].date()) for r in rolled] and meta.continuous["underlying_contracts"] == [r["symbol"] for r in contracts.orderBy("expiry").collect()]


def test_regimes(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.001, 300), rng.normal(0, 0.02, 300)])
    m = hidden.fit_returns(x)
    p = hidden.filtered(m, np.concatenate([[np.nan], x]))
    assert np.isnan(p[0]).all() and np.allclose(p[1:].sum(1), 1)
    assert (p[50:300, 1] < 0.5).mean() > 0.95 and (p[350:, 1] > 0.5).mean() > 0.95
    for few in ([], [1.0], [np.nan]):
        m = hidden.fit_returns(np.array(few))
        assert np.allclose(m.step, 0.5) and np.isfinite(m.mean).all() and (m.var > 0).all()
    y = np.concatenate([np.zeros(30), np.full(30, 5.0)]) + rng.normal(0, 0.1, 60)
    seg = regimes.segments(y, 5.0, 5)
    assert seg[29] == 1 and seg[-1] == 2
    for t_ in (20, 40, 60):  # a plain search over all cuts
        n, best = t_, [(-5.0, 0)] + [(math.inf, 0)] * t_
        for e in range(5, n + 1):
            best[e] = min((best[s][0] + ((y[s:e] - y[s:e].mean()) ** 2).sum() + 5.0, best[s][1] + 1) for s in range(e - 4) if math.isfinite(best[s][0]))
        assert best[n][1] == seg[n - 1]


def test_risk_boundaries():
    limits = config.LiveLimits()
    r = Risk(limits)
    assert r.order(0, 1) == "stale_data" and r.halted  # never ticked
    r = Risk(limits)
    r.tick(0)
    assert r.order(5_000_000, 1) is None and r.order(5_000_001, 1) == "stale_data" and r.order(0, 1) == "halted"
    r = Risk(limits, last_tick=10**15)
    assert [r.order(k, (-1) ** k) for k in range(10)] == [None] * 10 and r.order(59_999_999, 1) == "order_rate" and r.order(60_000_000, 1) is None
    r = Risk(limits, last_tick=10**15)
    assert r.pnl(0, -849.0) is None and r.pnl(1, -1.0) == "daily_loss" and r.order(2, 1) == "halted"
    r = Risk(limits, last_tick=10**15)
    assert [r.order(k, 1) for k in range(6)] == [None] * 5 + ["sizing"]
    r.disconnect()
    assert r.order(9, 1) == "disconnected" and r.queued and r.reconnect() and r.position == 0


def test_netting(spark):
    fills = spark.createDataFrame([("X", 1, 2.0, 10.0), ("X", 2, 2.0, 12.0), ("X", 3, -3.0, 15.0), ("X", 4, -3.0, 9.0), ("Y", 1, -1.0, 5.0), ("Y", 2, 1.0, 4.0)], "instrument string, seq long, qty double, price double")
    got = {r["instrument"]: (r["qty"], r["avg_px"], r["realized"]) for r in reconcile.net_positions(fills).collect()}
    assert got == {"X": (-2.0, 9.0, 3 * 4 + 1 * -2.0), "Y": (0.0, 0.0, 1.0)}
    same = reconcile.reconcile(*(spark.createDataFrame(r, s) for r, s in (([(1, "X", 1)], "fill_id long, instrument string, qty int"),) * 2), *(spark.createDataFrame(r, "instrument string, qty int") for r in ([("X", 1), ("Z", 0)], [("X", 1)])))
    assert same.count() == 0


def test_fill_simulation(spark):
    bars = make_bars(spark, [10, 11, 12], high=[10, 13, 12], low=[10, 9, 12])
    orders = [("m", 0, 1, "market", None, None), ("l", 0, 1, "limit", 9.5, None), ("far", 0, 1, "limit", 8.0, None), ("s", 0, 1, "stop", None, 12.5), ("zero", 0, 0, "market", None, None), ("late", 2, 1, "market", None, None)]
    df = spark.createDataFrame([(o, "S", p, "buy", q, k, li, st) for o, p, q, k, li, st in orders], "order_id string, symbol string, pos long, side string, qty int, type string, limit_px double, stop_px double")
    got = {r["order_id"]: (r["status"], r["fill_px"]) for r in reconcile.simulate_fills(df, bars).collect()}
    no = ("rejected", None)
    assert got == {"m": ("filled", 11.0), "l": ("filled", 9.5), "far": no, "s": ("filled", 12.5), "zero": no, "late": no}


def test_config(tmp_path):
    assert config.parse_grid("a: 1, 2\n\nb: x, 0.5") == {"a": [1, 2], "b": ["x", 0.5]}
    assert config.combinations({"a": [1, 2], "b": [3, 4]}) == [{"a": 1, "b": 3}, {"a": 1, "b": 4}, {"a": 2, "b": 3}, {"a": 2, "b": 4}]
    for bad in ("", "a 1", "a: 1,,2", "a: 1\na: 2"):
        with pytest.raises(config.ConfigError):
            config.parse_grid(bad)
    (tmp_path / "c.yaml").write_text("a: 1\na: 2\n")
    with pytest.raises(config.ConfigError):
        config.read_yaml(tmp_path / "c.yaml")
    with pytest.raises(config.ConfigError):
        config.strict(Costs, {"spread": 1})
    with pytest.raises(config.ConfigError):
        config.Instrument("X", 0.25, 1.0, 5.0)
    (tmp_path / "i.yaml").write_text("MES: {tick_size: 0.25, tick_value: 1.25, multiplier: 5.0}\n")
    assert config.read_instruments(tmp_path / "i.yaml")["MES"].precision() == 2
    assert config.write_yaml(Costs()) == config.write_yaml(Costs())


def test_sweep_keeps_errors_and_first_of_ties(spark):
    bars = synthetic_bars(spark, 200)
    table = t.sweep(spark, bars, "donchian", [{"window": 10}, {"window": 10}, {"window": True}, {}, {"window": 500}], Costs(), MES).orderBy("combo_id").collect()
    assert [r["error"] for r in table] == [0, 0, 1, 1, 0] and table[4]["n_trades"] == 0
    assert t.best_combo(spark.createDataFrame(table[:2] + table[2:4])) == 0


@pytest.mark.parametrize("signal,combos", [("donchian", [{"window": 5}, {"window": 20}, {"window": 5}]), ("ma_cross", [{"fast": 3, "slow": 9, "vol_window": 5, "target": 0.0005}])])
def test_sparse_trades_are_the_dense_ones(spark, signal, combos):
    bars, pairs = synthetic_bars(spark, 150), list(enumerate(combos))
    dense = t.trades(t.causal(t.signal_over_grid(bars, signal, pairs)), MES, 2.0)
    sparse = t.grid_trades(bars, signal, pairs, MES, 2.0)
    order = lambda df: sorted(map(tuple, df.select(dense.columns).collect()))
    assert order(sparse) == order(dense) and dense.count() > 3


def test_research_run(spark, tmp_path):
    from tickforge.config import RunConfig
    from tickforge.plans.research import history, read_report, run_pipeline

    bars, trials = synthetic_bars(spark, 400), TrialStore(spark, f"file://{tmp_path}/trials")
    run = RunConfig(grid={"window": [5, 10, 0]}, bootstrap=40, paths=30, days=5)
    report = run_pipeline(spark, bars, run, trials, created_at="2024-01-01")
    assert report.trials == trials.count("donchian") == 3 and [r["error"] for r in report.table] == [0, 0, 1]
    report.write(tmp_path / "runs" / "a")
    got = read_report(tmp_path / "runs" / "a")
    assert got["verdict.json"]["decision"] == report.verdict.decision and report.verdict.decision in got["report.md"]
    (tmp_path / "runs" / "b").mkdir()
    (tmp_path / "runs" / "b" / "verdict.json").write_text("{broken")
    assert [r["decision"] for r in history(tmp_path / "runs")] == ["incomplete", report.verdict.decision]


def test_verdict_gates():
    from tickforge.plans.research import decide

    assert decide(0.95, 0.5, 0.9, [("SHARPE_IMPLAUSIBLE", "warn")]).decision == "GO"
    for bad in ((0.94, 0.5, 0.9, []), (0.95, 0.51, 0.9, []), (0.95, 0.5, 0.89, []), (1, 0, 1, [("EDGE_FAILS_COSTS", "fail")])):
        assert decide(*bad).decision == "NO-GO"


def test_segments_are_those_of_a_full_search():
    rng = np.random.default_rng(11)
    for k in range(300):
        n, least, jump = int(rng.integers(4, 60)), int(rng.integers(1, 6)), int(rng.choice([1, 1, 1, 3]))
        cost = ("l2", "normal")[k % 2]
        x = np.repeat(rng.normal(0, 3, n), rng.integers(1, 9, n))[:n] + rng.normal(0, 1, n)
        penalty = float(rng.uniform(0.5, 12))
        y = x - x[0]
        s, q = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])
        price = regimes.COSTS[cost]
        best, pieces = {0: -penalty}, {0: 0}
        got = regimes.segments(x, penalty, least, jump, cost)
        for t_ in range(1, n + 1):
            found = [(best[a] + float(price(s, q, np.array([a]), t_)[0]), a) for a in sorted(best) if t_ - a >= least]
            want = 1
            if found:
                low, a = min(found)
                want = pieces[a] + 1
                if t_ % jump == 0:
                    best[t_], pieces[t_] = low + penalty, want
            assert got[t_ - 1] == (want if t_ >= 2 * least else 1), (k, t_)


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_sweeps_over_blocks(spark, monkeypatch, block):
    """Blocks of any size give the changes that window functions over whole symbols give: nulls, ties, short symbols, long windows."""
    rng = np.random.default_rng(block)
    rows = []
    for symbol, n in (("a", 90), ("b", 40), ("c", 1), ("d", 3)):
        close = np.round(100 + np.cumsum(rng.normal(0, 1, n)), 1)
        for k, c in enumerate(close.tolist()):
            rows.append((symbol, k, c - 0.2, None if symbol == "b" and k % 9 == 4 else c + 0.3, c - 0.4, None if symbol == "b" and k % 13 == 6 else c, 1.0))
    bars = spark.createDataFrame(rows, "symbol string, pos long, open double, high double, low double, close double, volume double").withColumn("ts", F.timestamp_seconds(F.col("pos") * 60)).repartition(3)
    combos = [(k, {"window": w}) for k, w in enumerate((1, 2, 3, 5, 8, 13, 20, 20, 33, 89, 500))]
    plain = t.trades(t.causal(t.signal_over_grid(bars, "donchian", combos)), MES)
    monkeypatch.setattr(sweeps.target_changes, "__defaults__", (block,))
    got = t.grid_trades(bars, "donchian", combos, MES)
    assert "Window" not in sweeps.target_changes(bars, combos[:1], sweeps.donchian_changes, 1)._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[1]
    want = sorted(map(tuple, plain.collect()), key=str)
    assert len(want) > 60 and sorted(map(tuple, got.select(*plain.columns).collect()), key=str) == want


def test_long_fractional_weights(spark):
    """Blocks give the weighted sums to 1e-9 for some thousands of weights, and nothing where a value of the window is missing."""
    weights = np.array(features.ffd_weights(0.4, 1e-6))
    rng = np.random.default_rng(2)
    x = 5000 * np.exp(np.cumsum(rng.normal(0, 1e-3, 3 * len(weights))))
    got = features.convolved(x, weights)
    assert len(weights) > 2000 and np.isnan(got[: len(weights) - 1]).all()
    for k in (len(weights) - 1, len(weights), 2 * len(weights) + 7, len(x) - 1):
        assert abs(got[k] - math.fsum(weights * x[k - len(weights) + 1 : k + 1][::-1])) < 1e-9
    close = [float(v) for v in x[:400]]
    close[200] = None
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(close)] + [("t", 0, 1.0)], "symbol string, pos long, close double").repartition(4)
    want = {(r["symbol"], r["pos"]): r["y"] for r in df.select("symbol", "pos", features.frac_diff("close", 0.4, 1e-3).alias("y")).collect()}
    for block in (None, 64, 150):
        made = {(r["symbol"], r["pos"]): r["fracdiff"] for r in features.frac_diff_blocks(df, "close", 0.4, 1e-3, block=block).collect()}
        assert made.keys() == want.keys() and all(v is None if want[k] is None else abs(v - want[k]) < 1e-9 for k, v in made.items())


def plain_netting(rows):
    """Fill by fill."""
    out = {}
    for who, _, q, px in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], r[3])):
        qty, avg, won = out.get(who, (0.0, 0.0, 0.0))
        if q == 0:
            continue
        if qty * q >= 0:
            out[who] = (qty + q, (qty * avg + q * px) / (qty + q), won)
        else:
            won += min(abs(q), abs(qty)) * math.copysign(1, qty) * (px - avg)
            now = qty + q
            out[who] = (now, 0.0 if now == 0 else avg if now * qty > 0 else px, won)
    return out


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_netting_over_blocks(spark, block):
    """Blocks of any size net as fill by fill: adds, cuts, flips, flat positions, ties of seq, null instruments, one hot instrument."""
    rng = random.Random(block)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(200), float(rng.choice([-3, -2, -1, 0, 1, 2, 3])), round(rng.uniform(90, 110), 2)) for _ in range(400)]
    rows += [("flat", 1, 2.0, 10.0), ("flat", 2, -2.0, 12.0), ("zero", 5, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "instrument string, seq long, qty double, price double").repartition(4)
    got = {r["instrument"]: (r["qty"], r["avg_px"], r["realized"]) for r in reconcile.net_positions(df, block).collect()}
    want = plain_netting(rows)
    assert got.keys() == want.keys() and got["flat"] == (0.0, 0.0, 4.0)
    for who, x in want.items():
        assert got[who] == pytest.approx(x, abs=1e-8)
    assert reconcile.net_positions(df.filter("false")).count() == 0
    assert "InArrow" not in reconcile.net_positions(df)._jdf.queryExecution().toString()


def test_extremes_of_windows():
    x = np.array([3.0, np.nan, 1.0, 7.0, 7.0, -2.0, np.nan, np.nan, 4.0, 0.0, 5.0])
    for longest in (1, 2, 5, 11):
        top, low = sweeps.Extremes(x, longest), sweeps.Extremes(x, longest, np.fmin)
        for w in range(1, longest + 1):
            for k in range(len(x)):
                own = x[max(0, k - w + 1) : k + 1]
                for got, of in ((top, np.nanmax), (low, np.nanmin)):
                    want = of(own) if np.isfinite(own).any() else np.nan
                    assert np.array_equal(got.ending(w)[k], want, equal_nan=True)


def test_drifting_series_keep_few_starts():
    """Where a level drifts, or wanders, no start is ruled out by the best cut alone; by their parabolas nearly all are, and the cuts stay
    those of a full search."""
    rng = np.random.default_rng(6)
    for x, penalty in ((np.arange(600) * 0.05 + rng.normal(0, 0.1, 600), 50.0), (np.cumsum(rng.normal(0, 1, 600)), 40.0), (np.full(600, 3.0), 1.0)):
        for least, jump in ((1, 1), (5, 1), (2, 3)):
            live = []
            got = regimes.segments(x, penalty, least, jump, live=live)
            y = x - x[0]
            s, q = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)])
            best, pieces = np.full(601, np.inf), np.zeros(601, int)
            best[0] = -penalty
            for t_ in range(least, 601):
                a = np.arange(0, t_ - least + 1)
                total = best[a] + q[t_] - q[a] - (s[t_] - s[a]) ** 2 / (t_ - a)
                k = int(np.argmin(total))
                assert got[t_ - 1] == (pieces[k] + 1 if t_ >= 2 * least else 1), (least, jump, t_)
                if t_ % jump == 0 and t_ >= least:
                    best[t_], pieces[t_] = total[k] + penalty, pieces[k] + 1
            assert max(live) < 60 and np.mean(live) < 40  # the best cut alone rules out none of 600


def plain_em(x, m, rounds, least_var):
    """Expectation maximisation bar by bar, with the sums of each pair of states written out; gaps cut x into runs."""
    k = len(m.mean)
    for _ in range(rounds):
        runs, likelihood = [], 0.0
        for t, v in enumerate(x):
            if np.isfinite(v):
                if t and np.isfinite(x[t - 1]):
                    runs[-1].append(v)
                else:
                    runs.append([v])
        starts, moves, w, first, second = np.zeros(k), np.zeros((k, k)), np.zeros(k), np.zeros(k), np.zeros(k)
        for run in runs:
            e = [[math.exp(-0.5 * (v - m.mean[s]) ** 2 / m.var[s]) / math.sqrt(2 * math.pi * m.var[s]) for s in range(k)] for v in run]
            a = [np.array([m.start[s] * e[0][s] for s in range(k)])]
            for t in range(1, len(run)):
                a.append(np.array([sum(a[-1][i] * m.step[i][s] for i in range(k)) * e[t][s] for s in range(k)]))
            b = [np.ones(k)]
            for t in range(len(run) - 1, 0, -1):
                b.insert(0, np.array([sum(m.step[s][i] * e[t][i] * b[0][i] for i in range(k)) for s in range(k)]))
            total = a[-1].sum()
            likelihood += math.log(total)
            for t, v in enumerate(run):
                g = a[t] * b[t] / total
                w, first, second = w + g, first + g * v, second + g * v * v
                starts = starts + g if t == 0 else starts
                if t:
                    moves += np.array([[a[t - 1][i] * m.step[i][s] * e[t][s] * b[t][s] / total for s in range(k)] for i in range(k)])
        m = hidden.Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), first / w, np.maximum(second / w - (first / w) ** 2, least_var))
    return m, likelihood


def plain_filter(m, x):
    """Bar by bar: the probabilities of before, moved and weighted."""
    out, p = [], None
    for v in x:
        if not np.isfinite(v):
            p = None
            out.append([np.nan] * len(m.mean))
            continue
        a = (m.start if p is None else p @ m.step) * np.exp(-0.5 * (v - m.mean) ** 2 / m.var) / np.sqrt(m.var)
        p = a / a.sum()
        out.append(p)
    return np.array(out)


def hidden_series(n, seed):
    rng = np.random.default_rng(seed)
    state = np.cumsum(rng.random(n) < 0.03) % 2
    return rng.normal(np.where(state, 0.001, -0.0005), np.where(state, 0.02, 0.004))


def test_hidden_states_are_those_of_plain_steps():
    """Rounds of the scan are those of sums bar by bar, for any place of gaps; the better of two starts wins."""
    x = hidden_series(150, 2)
    x[[0, 40, 41, 99]] = np.nan
    good = x[np.isfinite(x)]
    starts = hidden.first_models(2, len(good), good.mean(), good.var(), 1e-12)
    plain = [plain_em(x, m, 12, 1e-12) for m in starts]
    got = hidden.fit_returns(x, 2, 12, -math.inf, 1e-12)
    want = max(plain, key=lambda f: f[1])[0].ordered()
    for a, b_ in zip((got.start, got.step, got.mean, got.var), (want.start, want.step, want.mean, want.var), strict=True):
        assert np.allclose(a, b_, rtol=1e-7, atol=1e-9)
    assert np.allclose(hidden.filtered(got, x), plain_filter(got, x), atol=1e-10, equal_nan=True)
    more = hidden.fit_returns(x, 2, 100)
    likelihood = lambda m: hidden.expected(m, x, False, m.start, np.ones(2), 0.0)[0]
    assert likelihood(more) >= max(likelihood(m) for m in starts) and likelihood(more) >= likelihood(got) - 1e-3
    three = hidden.fit_returns(np.concatenate([hidden_series(400, 5), np.random.default_rng(1).normal(0, 0.2, 200)]), 3)
    assert (np.diff(three.var) > 0).all() and three.var[2] > 0.02


def test_levels_are_found_too():
    """States of one spread at two levels, which a start by spread alone misses."""
    rng = np.random.default_rng(3)
    state = np.cumsum(rng.random(800) < 0.02) % 2
    m = hidden.fit_returns(rng.normal(np.where(state, 2.0, -2.0), 1.0))
    assert np.allclose(np.sort(m.mean), [-2, 2], atol=0.25) and np.allclose(m.var, 1, atol=0.35)


def test_blocks_give_what_one_pass_gives(spark):
    """Symbols of many blocks, of one, and of too few bars: fit by rounds over blocks and filter with what enters each block."""
    prices, rows = {}, []
    for symbol, n in (("long", 700), ("short", 50), ("two", 2), ("gap", 300)):
        close = 100 * np.exp(np.cumsum(hidden_series(n, n)))
        if symbol == "gap":
            close[[64, 127, 128, 200]] = -1.0
        prices[symbol] = close
        rows += [(symbol, k, float(c)) for k, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "symbol string, pos long, close double").repartition(5)
    d = hidden.HmmDetector(rounds=4, tolerance=-math.inf, block=64).fit(bars)
    models = {r["symbol"]: hidden.Model.unpack(r["model"]) for r in d.models.collect()}
    got = {}
    for r in d.proba(bars).collect():
        got.setdefault(r["symbol"], {})[r["pos"]] = r["proba"]
    for symbol, close in prices.items():
        with np.errstate(all="ignore"):
            x = np.concatenate([[np.nan], np.diff(np.log(close))])
        want = hidden.fit_returns(x, 2, 4, -math.inf, 1e-8)
        for a, b_ in zip((models[symbol].start, models[symbol].step, models[symbol].mean, models[symbol].var), (want.start, want.step, want.mean, want.var), strict=True):
            assert np.allclose(a, b_, rtol=1e-8, atol=1e-12), symbol
        plain = plain_filter(want, x)
        assert sorted(got[symbol]) == list(range(len(x)))
        for k, p in got[symbol].items():
            assert p is None if not np.isfinite(x[k]) else np.allclose(p, plain[k], atol=1e-9)
    other = spark.createDataFrame([("new", 0, 1.0), ("new", 1, 2.0)], "symbol string, pos long, close double")
    assert {(r["regime"]) for r in d.regimes(other).collect()} == {-1} and d.proba(other.filter("false")).count() == 0
    assert hidden.HmmDetector(block=64).fit(bars.filter("symbol = 'long'")).models.count() == 1  # ends by itself


def test_detectors(spark):
    rng = np.random.default_rng(4)
    calm, wild = rng.normal(0, 0.001, 150), rng.normal(0, 0.02, 150)
    close = 100 * np.exp(np.cumsum(np.concatenate([calm, wild, calm])))
    bars = make_bars(spark, close.tolist())
    d = regimes.detector("hmm", states=2)
    with pytest.raises(ValueError):
        d.proba(bars)
    d.fit(bars.filter("pos < 300"))
    got = [(r["regime"], p["proba"]) for r, p in zip(d.regimes(bars).orderBy("pos").collect(), d.proba(bars).orderBy("pos").collect(), strict=True)]
    assert got[0] == (-1, None) and np.mean([g[0] for g in got[20:150]]) < 0.1 and np.mean([g[0] for g in got[170:300]]) > 0.9
    assert all(abs(sum(p) - 1) < 1e-9 for _, p in got[1:])
    prefix = d.regimes(bars.filter("pos < 200")).orderBy("pos").collect()
    assert [r["regime"] for r in prefix] == [g[0] for g in got[:200]]  # the past alone
    c = regimes.detector("change_points", penalty=500.0).fit(bars)
    rows = c.proba(bars).orderBy("pos").collect()
    labels_ = [r["regime"] for r in c.regimes(bars).orderBy("pos").collect()]
    assert [r["proba"].index(1.0) for r in rows] == labels_ and labels_ == (regimes.segments(close, 500.0) - 1).tolist() and max(labels_) > 0
    with pytest.raises(ValueError):
        regimes.register_detector("hmm", None)
    assert regimes.hmm_regimes(bars, 2, 300).count() == 450


def test_block_lengths_use_all_trades(spark):
    rng = np.random.default_rng(8)
    for n, span in ((3, 16), (40, 16), (3000, 200), (20_000, 1 << 16)):
        e = rng.normal(0, 1, n)
        x = np.array([e[max(0, k - 6) : k + 1].sum() for k in range(n)]) + (np.arange(n) > 0.6 * n)
        log = spark.createDataFrame(pd.DataFrame({"idx": np.arange(n), "net_pnl_usd": x})).repartition(3)
        size, cov = account.autocovariances(log, span=span)
        assert size == n
        if n >= 4:
            c = x - x.mean()
            assert np.allclose(cov, [c[: n - k] @ c[k:] / n for k in range(len(cov))], atol=1e-8)
        assert account.block_length(log) == account.default_block(x)
        want = account.optimal_block(x, True)
        assert statistics.bootstrap_block(log) == (max(1, round(want)) if math.isfinite(want) else 1)
    flat = spark.createDataFrame([(k, 1.0) for k in range(30)], "idx long, net_pnl_usd double")
    assert account.block_length(flat) == 1 and account.block_length(flat.filter("false")) == 1


def test_dense_index(spark):
    from tickforge.operators.order import dense_index

    rnd = random.Random(3)
    rows = [(rnd.randrange(50_000), f"s{rnd.randrange(3)}", k) for k in range(500)]
    df = spark.createDataFrame(rows, "entry_pos long, symbol string, k long")
    got = dense_index(df, (F.col("entry_pos") / 4096).cast("long"), ["entry_pos", "symbol", "k"]).orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(500)) and [(r["entry_pos"], r["symbol"], r["k"]) for r in got] == sorted(rows)


def test_signals_can_be_added(spark):
    from tickforge.operators import trading

    up = trading.simple_signal(lambda p: F.when(F.col("close") > p["level"], 1.0).otherwise(0.0), {"level": 0}, fractions=("level",))
    if "above" not in trading.SIGNALS:
        trading.register_signal("above", up)
    with pytest.raises(ValueError):
        trading.register_signal("above", up)
    bars = make_bars(spark, [1, 3, 3, 1, 3, 1])
    raw = trading.signal_over_grid(bars, "above", [(0, {"level": 2.5}), (1, {"level": 9.0})]).orderBy("combo_id", "pos").collect()
    assert [r["raw"] for r in raw] == [0, 1, 1, 0, 1, 0] + [0] * 6
    assert trading.bad_params("above", {}) and trading.bad_params("above", {"level": 1.5}) is None


def test_shared_folder_is_made_on_a_local_master_alone():
    from tickforge import session

    class Conf:
        def __init__(self, path=None):
            self.path = path

        def get(self, key, default=None):
            return self.path

        def set(self, key, value):
            self.path = value

    class Fake:
        def __init__(self, master, path=None):
            self.conf, self.sparkContext = Conf(path), self
            self.master, self.path = master, path

        def getConf(self):
            return Conf(self.path)

    assert session.shared_dir(Fake("local[2]")).startswith("file://")
    assert session.shared_dir(Fake("spark://x", "hdfs://a/b/")) == "hdfs://a/b"
    with pytest.raises(ValueError):
        session.shared_dir(Fake("spark://x"))


def test_meta_model_records(spark, tmp_path):
    from tickforge.operators import metamodel

    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (90, 5))
    rows = spark.createDataFrame([(k, *map(float, v), float(v[0] + 0.3 * rng.normal() > 0), 1.0) for k, v in enumerate(x)] + [(90, None, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)], "pos long, ret_1 double, ret_5 double, ret_20 double, vol_20 double, raw double, y double, weight double")
    folds = crossval.purged_kfold(rows.select("pos", F.col("pos").alias("t0"), F.col("pos").alias("t1")), 91, 3)
    trials = TrialStore(spark, f"file://{tmp_path}/trials")
    got = metamodel.train(rows, folds, "logistic", folder=f"file://{tmp_path}/models", trials=trials, run_id="r1", scheme="PurgedKFold")
    assert [(r["fold"], r["model"]) for r in got.per_fold] == [(k, m) for k in range(3) for m in metamodel.MODELS] and all(r["n_train"] + r["n_test"] == 90 for r in got.per_fold)
    assert got.metrics["logistic"]["auc"] > 0.9 and got.metrics["boosted"]["n"] == 90
    saved = trials.all().first()
    assert saved["trial_id"] == "r1-meta" and saved["metrics"]["logistic_auc"] == pytest.approx(got.metrics["logistic"]["auc"])
    both = [metamodel.predict(m, rows).orderBy("pos").select("p").collect() for m in (got.model, metamodel.load(got.artifact))]
    assert both[0] == both[1] and len(both[0]) == 91
    with pytest.raises(ValueError):
        metamodel.train(rows.withColumn("y", F.lit(1.0)), folds)
    one = folds.filter("role = 'train' OR fold = 0")
    assert {r["fold"] for r in metamodel.train(rows, one).per_fold} == {0}


def test_event_backtest_run(spark, tmp_path):
    from tickforge.plans.backtest import Strategy, backtest_snapshot, three_ways

    store, trials = SnapshotStore(spark, f"file://{tmp_path}/s"), TrialStore(spark, f"file://{tmp_path}/t")
    bars = synthetic_bars(spark, 300)
    cont = {"roll_rule": "volume"}
    good = store.save(bars, SnapshotMeta("MES", "synthetic", "1m", "a", "b", True, "now", continuous=cont))
    bad = store.save(bars, SnapshotMeta("MES", "dev", "1m", "a", "b", False, "now", continuous=cont))
    s = Strategy("donchian", {"window": 10}, 2)
    got = backtest_snapshot(store, good, s, trials=trials, created_at="2024-01-01")
    rows = got.trades.orderBy("entry_pos").collect()
    assert len(rows) == got.metrics["n_trades"] > 3 and got.manifest.trial_ids == [got.trial_id] and got.manifest.snapshots == [good] and trials.count("donchian") == 1
    assert got.metrics["net_pnl"] == pytest.approx(sum(r["net_pnl_usd"] for r in rows)) and got.curve.count() == len(rows)
    eq = 100_000 + np.cumsum([r["net_pnl_usd"] for r in rows])
    assert got.metrics["drawdown_share"] == pytest.approx(float(np.max((np.maximum.accumulate(eq) - eq) / np.maximum.accumulate(eq))))
    with pytest.raises(DataIntegrityError):
        backtest_snapshot(store, bad, s)
    with pytest.raises(ValueError):
        backtest_snapshot(store, good, Strategy("donchian", {}))
    ways = three_ways(bars, s, Costs(), "MES")
    assert ways["gross"].metrics["net_pnl"] == pytest.approx(sum(r["gross_pnl_usd"] for r in rows))
    late = {r["entry_pos"] for r in ways["delayed"].trades.collect()}
    assert late <= {r["entry_pos"] + 1 for r in rows} and len(late) >= len(rows) - 1


def test_nothing_is_drawn_from_an_empty_log(spark):
    log = spark.createDataFrame([], "idx long, net_pnl_usd double")
    assert account.resample(log, 0, 2, 5, 3, 1).collect() == []
    assert account.resample(log, 0, 2, 5, 3, 1, F.pmod(F.col("path_id"), F.lit(0))).collect() == []


@pytest.mark.parametrize("values", [[], [3.0], [1.0, 4.0], [2.0] * 6, [float(k * k % 7) for k in range(12)], [float(k * k % 11) for k in range(25)]])
def test_autocovariances_at_given_lags(spark, values):
    """All lags asked for that the rows have: also of few rows, and of more lags than the rule for blocks needs."""
    log = spark.createDataFrame(list(enumerate(values)), "idx long, net_pnl_usd double")
    n, cov = account.autocovariances(log, span=8, lags=12)
    e = np.array(values) - (sum(values) / len(values) if values else 0.0)
    assert n == len(values) and np.allclose(cov, [e[: len(e) - k] @ e[k:] / len(e) for k in range(min(12, len(e)))], atol=1e-9)


def test_moments_of_few_trades(spark):
    """Skew and kurtosis, the error of the ratio and its deflated form are null where there are too few values, or 0 and 3 by default."""
    values = {1: [5.0], 2: [1.0, 2.0], 3: [1.0, 2.0, 4.0], 4: [1.0, 2.0, 4.0, 9.0], 5: [2.0] * 5}
    df = spark.createDataFrame([(k, v) for k, x in values.items() for v in x], "k long, x double")

    def rows(*undefined):
        m = statistics.moments("x", *undefined)
        flat = df.groupBy("k").agg(t.sharpe("x").alias("sharpe"), *(m[c].alias(c) for c in ("n", "skew", "kurt")))
        return flat, {r["k"]: (r["skew"], r["kurt"]) for r in flat.collect()}

    flat, got = rows((None, None))
    assert got[1] == got[2] == got[5] == (None, None) and got[3][0] == pytest.approx(0.93521953) and got[3][1] is None and got[4] == (pytest.approx(1.33093774), pytest.approx(4.5))
    assert rows()[1][1] == (0.0, 3.0)
    error = flat.select("k", statistics.sharpe_error(F.col("sharpe"), F.col("n"), F.col("skew"), F.col("kurt")).alias("e"))
    assert {r["k"] for r in error.collect() if r["e"] is not None} == {4}
    assert {r["k"] for r in statistics.deflated_sharpe(flat, 4).collect() if r["dsr"] is not None} == {4}


def test_the_best_combination_has_trades(spark, tmp_path):
    """A combination without a trade isn't the best, and without any trade there is none."""
    from tickforge.plans import market

    def best(closes):
        rows = [(k, "click", float(c)) for k, c in enumerate(closes)]
        at = f"{tmp_path}/{len(rows)}"
        spark.createDataFrame(rows, "event_id long, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 3600)).write.parquet(f"{at}/events.parquet")
        return [(r["combo_id"], r["sharpe_net"] < 0) for r in market.sweep_best(spark, at).collect()]

    assert best([3, 3, 3, 3, 3, 9, 8, 2, 3, 7]) == [(0, True)]
    assert best([5.0] * 30) == []


def test_order_rate_by_running_counts(spark):
    """The rows of the key's last span, by a plain count; ties, the row exactly a span before, and times before 1970 too."""
    from tickforge.operators import reconcile

    rnd = random.Random(3)
    rows = [(k, "ab"[k % 2], rnd.randrange(-40, 200) * 500_000) for k in range(600)]
    df = spark.createDataFrame(rows, "id long, k string, us long").withColumn("ts", F.timestamp_micros("us"))
    made = reconcile.order_rate(df, "k", "ts", 10)
    got = {r["id"]: r["n"] for r in made.collect()}
    assert made.columns == ["id", "k", "us", "ts", "n"] and got == {i: sum(1 for _, b, u in rows if a == b and us - 10_000_000 < u <= us) for i, a, us in rows}


def test_meta_model_of_one_class(spark, tmp_path):
    """Labels of one class train no fold: a row of no predictions instead of an error."""
    from tickforge.plans import research

    rows = spark.range(400).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"), F.lit("click").alias("event_type"), (100.0 + F.col("id") % 2).alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = research.meta_model(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["n"] == 0
