"""The whole research run: sweep, validation, survival, verdict and report; and queries over it, models and streams."""

from __future__ import annotations

import html
import json
import math
import uuid
from dataclasses import asdict, dataclass, field, replace
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INSTRUMENTS, PRESETS, Costs, FlagLimits, Gates, RunConfig, combinations, config_hash, read_yaml, strict
from ..operators import account, audit, crossval, features, labels, metamodel, regimes, statistics
from ..operators import trading as t
from ..operators.order import by_entry, dense_index
from ..session import new_path
from ..sources.bars import by_time, event_bars
from ..sources.snapshots import SnapshotStore, require_validation_grade
from ..sources.trials import TrialStore
from ..streaming import live
from .backtest import Strategy, three_ways
from .manifest import FIXED_AT, Manifest, git_sha

@dataclass(frozen=True)
class Gate:
    name: str
    passed: bool
    detail: str


@dataclass(frozen=True)
class Verdict:
    decision: str
    gates: list[Gate]
    fail_flags: list[str]


def decide(dsr: float, pbo: float, p_survival: float, flags: list[tuple[str, str]], gates: Gates = Gates()) -> Verdict:
    """GO if every gate passes and no flag is a failure; warnings change nothing."""
    failed = [code for code, kind in flags if kind == "fail"]
    results = [
        Gate("survival", p_survival >= gates.min_survival, f"{p_survival:.4f}, at least {gates.min_survival:.4f}"),
        Gate("deflated_sharpe", dsr >= gates.min_dsr, f"{dsr:.4f}, at least {gates.min_dsr:.4f}"),
        Gate("pbo", pbo <= gates.max_pbo, f"{pbo:.4f}, at most {gates.max_pbo:.4f}"),
        Gate("no_fail_flags", not failed, ", ".join(failed) or "none"),
    ]
    return Verdict("GO" if all(g.passed for g in results) else "NO-GO", results, failed)


@dataclass
class Report:
    manifest: Manifest
    verdict: Verdict
    best: dict
    numbers: dict
    flags: list[tuple[str, str]]
    trials: int
    trial_hash: str
    table: list[dict]
    #: Further tables of the report: a title, the columns' names and rows of text.
    sections: list[tuple[str, tuple[str, ...], list[tuple[str, ...]]]] = field(default_factory=list)

    def tables(self) -> list[tuple[str, tuple[str, ...], list[tuple[str, ...]]]]:
        gates = [(g.name, "pass" if g.passed else "fail", g.detail) for g in self.verdict.gates]
        flags = sorted(((kind, code) for code, kind in self.flags), key=lambda f: (f[0] != "fail", f[1]))
        return [("Gates", ("gate", "result", "detail"), gates), ("Numbers", ("number", "value"), [(k, str(v)) for k, v in sorted(self.numbers.items())]), *self.sections, ("Flags", ("severity", "flag"), flags or [("none", "")])]

    def summary(self) -> str:
        return f"{json.dumps(self.best, sort_keys=True)} is the best of {self.trials} trials ({self.trial_hash[:12]})"

    def markdown(self) -> str:
        line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|") for c in cells) + " |"
        parts = ["\n".join([f"## {title}", "", line(names), "|" + "-|" * len(names), *map(line, rows)]) for title, names, rows in self.tables()]
        return f"# {self.verdict.decision}\n\n{self.summary()}\n\n" + "\n\n".join(parts) + "\n"

    def html(self) -> str:
        row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in cells) + "</tr>"
        parts = [f"<section><h2>{html.escape(title)}</h2><table><thead>{row(names, 'th')}</thead><tbody>{''.join(row(r, 'td') for r in rows)}</tbody></table></section>" for title, names, rows in self.tables()]
        style = "body{font-family:sans-serif}td,th{text-align:left;padding:.2em .8em;border-bottom:1px solid #ccc}"
        return f"<!doctype html><html lang=en><head><meta charset=utf-8><title>{self.verdict.decision}</title><style>{style}</style></head><body><h1>{self.verdict.decision}</h1><p>{html.escape(self.summary())}</p>{''.join(parts)}</body></html>\n"

    def write(self, folder: str | Path) -> None:
        """report.md, report.html, verdict.json and manifest.json, on the driver."""
        to = Path(folder)
        to.mkdir(parents=True, exist_ok=True)
        (to / "report.md").write_text(self.markdown())
        (to / "report.html").write_text(self.html())
        (to / "verdict.json").write_text(json.dumps(asdict(self.verdict), sort_keys=True, indent=1))
        (to / "manifest.json").write_text(json.dumps(asdict(self.manifest), sort_keys=True, indent=1))


def read_report(folder: str | Path) -> dict:
    """What a run's folder has; parts that are missing or can't be read are None."""
    out = {}
    for name in ("report.md", "verdict.json", "manifest.json"):
        try:
            text = (Path(folder) / name).read_text()
            out[name] = json.loads(text) if name.endswith(".json") else text
        except (OSError, ValueError):
            out[name] = None
    return out


def history(root: str | Path) -> list[dict]:
    """Runs under a folder, newest first by their manifest (else the folder's time); one without a readable verdict is
    incomplete."""
    out = []
    for p in Path(root).iterdir() if Path(root).is_dir() else []:
        if p.is_dir():
            r = read_report(p)
            at = (r["manifest.json"] or {}).get("created_at") or datetime.fromtimestamp(p.stat().st_mtime, UTC).isoformat()
            out.append({"run": p.name, "created_at": at, "decision": (r["verdict.json"] or {}).get("decision", "incomplete")})
    return sorted(out, key=lambda r: r["created_at"], reverse=True)


COSTS = ("gross_pnl_usd", "commission_usd", "fees_usd", "spread_cost_usd", "slippage_usd", "net_pnl_usd")


def features_and_labels(bars: DataFrame, interval: str = "1m", every: int = 200) -> tuple[int, int, int, float]:
    """How many features there are, bars that have all of them, and labels, and the labels' mean uniqueness: barriers at twice the trailing volatility, 60 bars long, at
    about `every` bars of those that have a volatility, evenly placed in each symbol."""
    made = features.build_features(bars, features.FeatureConfig(interval=interval))
    vol = features.trailing_volatility(bars).filter(F.col("vol").isNotNull()).select("symbol", "pos", "vol")
    whole, n = made.na.drop().count(), vol.count()
    if n < 3:
        return len(features.feature_names()), whole, 0, 0.0
    events = vol.filter(F.col("pos") % max(1, n // every) == 0)
    got = labels.triple_barrier(events, bars, 2.0, 2.0, 60)
    row = labels.uniqueness_weights(got, bars).agg(F.count("*").alias("n"), F.avg("weight").alias("weight")).first()
    return len(features.feature_names()), whole, row["n"], float(row["weight"] or 0.0)


@dataclass(frozen=True)
class SnapshotRun:
    """What a run's file says: the snapshot, and the run."""

    snapshot_hash: str
    run: RunConfig = field(default_factory=RunConfig)


def run_snapshot(path: str | Path, store: SnapshotStore, out: str | Path, trials: TrialStore | None = None, confirmations: TrialStore | None = None, created_at: str = FIXED_AT) -> Report:
    """A run from a file (snapshot_hash, and run: the fields of RunConfig) over a stored snapshot, which must be of validation
    grade; the report is written to out/<run_id>."""
    data = dict(read_yaml(path))
    config = strict(SnapshotRun, {**data, "run": strict(RunConfig, data.get("run") or {}, "run")}, str(path))
    bars, meta = store.load(config.snapshot_hash)
    require_validation_grade(meta)
    report = run_pipeline(store.spark, bars, config.run, trials, (config.snapshot_hash,), created_at, confirmations, meta.interval)
    report.write(Path(out) / report.manifest.run_id)
    return report


def run_pipeline(spark: SparkSession, bars: DataFrame, config: RunConfig, trials: TrialStore | None = None, snapshots: tuple[str, ...] = (), created_at: str = FIXED_AT, confirmations: TrialStore | None = None, interval: str = "1h") -> Report:
    """research over cached bars."""
    bars = bars.cache()
    try:
        return research(spark, bars, config, trials, snapshots, created_at, confirmations, interval)
    finally:
        bars.unpersist()


def research(spark: SparkSession, bars: DataFrame, config: RunConfig, trials: TrialStore | None, snapshots: tuple[str, ...], created_at: str, confirmations: TrialStore | None, interval: str) -> Report:
    """A research run over bars: all combinations in one plan, counting the trades that enter in test parts of purged folds;
    the best one event-driven, net, gross and a bar late; and its statistics. Only the sweep's trials count as luck: the
    confirming runs go to confirmations, if given. The driver gets one row for each combination and a few numbers."""
    instrument, costs, rules = INSTRUMENTS[config.instrument], Costs(), PRESETS[config.rules]
    grid = combinations(config.grid)
    run_id = uuid.uuid5(uuid.NAMESPACE_URL, config_hash("FE-TRIALCFG-v1", asdict(config))).hex
    size = bars.agg(F.max("pos") + 1).first()[0]
    n_features, n_whole, n_labels, uniqueness = features_and_labels(bars, interval)
    spans = bars.select("pos").distinct().select("pos", F.col("pos").alias("t0"), F.col("pos").alias("t1"))
    folds = crossval.purged_kfold(spans, size, config.splits, config.embargo)
    tested = bars.select("symbol", "pos").join(folds.filter("role = 'test'").select("pos").distinct(), "pos", "left_semi")
    table = t.sweep(spark, bars, config.strategy, grid, costs, instrument, tested).orderBy("combo_id").toPandas()
    rows = table.to_dict("records")
    if trials is not None:
        trials.append([{
            "trial_id": f"{run_id}-{k}", "run_id": run_id, "strategy_family": config.strategy, "config_hash": config_hash("FE-TRIALCFG-v1", {"signal": config.strategy, "params": p}), "params": p,
            "cv_scheme": crossval.scheme("PurgedKFold", n_splits=config.splits, embargo=config.embargo), "metrics": {m: float(r[m]) for m in (*t.METRICS, "error")}, "seed": config.seed, "data_snapshot_hashes": list(snapshots),
        } for k, (p, r) in enumerate(zip(grid, rows, strict=True))])
    good = [r for r in rows if r["error"] == 0]
    if not good:
        raise ValueError("no combination ran")
    best = max(good, key=lambda r: (r["sharpe_net"], -r["combo_id"]))
    k = int(best["combo_id"])
    runs = three_ways(bars, Strategy(config.strategy, grid[k], config.qty, config.seed, config.balance), costs, config.instrument, snapshots=snapshots, trials=confirmations, created_at=created_at)
    net = runs["net"]
    ran = [(j, p) for j, (p, r) in enumerate(zip(grid, rows, strict=True)) if r["error"] == 0]
    log = t.apply_costs(t.grid_trades(bars, config.strategy, ran, instrument, config.qty), costs, instrument)
    m = statistics.moments("net_pnl_usd")
    flat = net.trades.agg(t.sharpe("net_pnl_usd").alias("sharpe"), *(m[c].alias(c) for c in ("n", "skew", "kurt", "dev")))
    n_trials = trials.count(config.strategy) if trials is not None else len(grid)
    stats = statistics.deflated_sharpe(flat, max(1, n_trials)).first()
    perf = t.slice_performance(log, [j for j, _ in ran], size, config.partitions)
    overfit = statistics.pbo(perf, config.partitions).first()["pbo"] if len(ran) > 1 else 0.0
    drawn = by_entry(net.trades).select("idx", "net_pnl_usd", "exit_ts")
    survived = account.survival(drawn, rules, config.paths, config.days, config.seed).first()
    n = stats["n"]
    ci = statistics.bootstrap_sharpe(drawn.select("idx", F.col("net_pnl_usd").alias("ret")), n, config.bootstrap, 0.95, statistics.bootstrap_block(drawn), config.seed).first() if n > 1 else {"lo": 0.0, "hi": 0.0}
    yearly = math.sqrt(max(1, n))
    ratios = {way: runs[way].metrics["sharpe_net"] for way in runs}
    flagged = statistics.red_flags(spark.createDataFrame([(float(stats["sharpe"]) * yearly, net.metrics["win_rate"], net.metrics["max_drawdown"], float(stats["dev"] or 0.0), ratios["net"], ratios["gross"], ratios["delayed"])], "sharpe double, win_rate double, max_drawdown double, volatility double, sharpe_net double, sharpe_gross double, sharpe_delay1 double"), FlagLimits()).first()
    flags = [(f["code"], f["severity"]) for f in flagged["flags"]]
    numbers = {"dsr": round(float(stats["dsr"]), 6), "pbo": round(float(overfit), 6), "p_survival": round(float(survived["p_survival"]), 6), "sharpe": round(float(stats["sharpe"]), 6), "ci_lo": round(float(ci["lo"] or 0), 6), "ci_hi": round(float(ci["hi"] or 0), 6), "n_trades": n, **{f"sharpe_{way}": round(v, 6) for way, v in ratios.items()}}
    manifest = Manifest(run_id, created_at, git_sha(), config.seed, config_hash("FE-BACKTESTCFG-v1", asdict(config)), list(snapshots), [b.trial_id for b in runs.values()])
    spent = net.trades.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in COSTS)).first()
    survival = {k: v for k, v in survived.asDict().items() if k not in ("contracts", "busts")}
    sections = [
        ("Costs", ("item", "usd"), [(c, f"{spent[c]:.2f}") for c in COSTS]),
        ("Survival", ("item", "value"), [*((k, "-" if v is None else f"{v:.6g}") for k, v in survival.items()), *((f"bust: {why}", f"{share:.4f}") for why, share in (survived.asDict().get("busts") or {}).items())]),
        ("Data", ("item", "value"), [("interval", interval), ("snapshots", ", ".join(snapshots) or "none"), ("features", str(n_features)), ("bars with all features", str(n_whole)), ("labels", str(n_labels)), ("mean uniqueness", f"{uniqueness:.4f}")]),
        ("Trials", ("item", "value"), [("run", run_id), ("family", config.strategy), ("trials", str(n_trials)), ("of them without an error", str(len(good))), ("validation", crossval.scheme("PurgedKFold", n_splits=config.splits, embargo=config.embargo)), ("seed", str(config.seed)), ("git", manifest.git_sha), ("configuration", manifest.config_hash)]),
    ]
    return Report(manifest, decide(numbers["dsr"], numbers["pbo"], numbers["p_survival"], flags), grid[k], numbers, flags, n_trials, trials.list_hash(config.strategy) if trials is not None else config_hash("FE-TRIALLIST-v1", rows), rows, sections)


# Queries ---------------------------------------------------------------------------------------------------------------------


def research_verdict(spark: SparkSession, d: str) -> DataFrame:
    r = run_pipeline(spark, event_bars(spark, d), RunConfig(grid={"window": [5, 10, 20, 40]}, bootstrap=100, paths=100))
    rows = [(r.verdict.decision, g.name, g.passed, g.detail) for g in r.verdict.gates]
    return spark.createDataFrame(rows, "decision string, gate string, passed boolean, detail string")


def lookahead_audit(spark: SparkSession, d: str) -> DataFrame:
    a = audit.Registry()
    a.register("feature.window", lambda b: b.select("symbol", "pos", features.sma("close", 20).alias("sma"), features.stochastic_k(14).alias("stoch")))
    a.register("feature.rsi", lambda b: features.rsi(b).select("symbol", "pos", "rsi"))
    a.register("signal.donchian", lambda b: t.signal_over_grid(b, "donchian", [(0, {"window": 20})]).select("symbol", "pos", "raw"))
    a.register("leaky.next_close", lambda b: b.select("symbol", "pos", F.lead("close").over(by_time()).alias("next_close")))
    return a.run(event_bars(spark, d))


def hmm_regimes(spark: SparkSession, d: str) -> DataFrame:
    return regimes.hmm_regimes(event_bars(spark, d), 2, 200).select("symbol", "pos", "regime", F.round("p_high", 6).alias("p_high"))


def change_point_regimes(spark: SparkSession, d: str) -> DataFrame:
    return regimes.change_points(event_bars(spark, d), 2e5)


def meta_model(spark: SparkSession, d: str) -> DataFrame:
    bars = event_bars(spark, d)
    primary = t.signal_over_grid(bars, "donchian", [(0, {"window": 10})]).select("symbol", "pos", "raw")
    events = features.trailing_volatility(bars, 20).filter(F.col("vol").isNotNull()).select("symbol", "pos", "vol")
    got = labels.model_meta_labels(labels.triple_barrier(events, bars, 0.5, 0.5, 10), primary)
    weights = labels.uniqueness_weights(got, bars).select("symbol", "pos", "weight")
    rows = metamodel.meta_features(bars, primary).join(got.select("symbol", "pos", "end_pos", F.col("meta").cast("double").alias("y")), ["symbol", "pos"]).join(weights, ["symbol", "pos"])
    rows = dense_index(rows.withColumn("t0", F.col("pos")).withColumn("t1", F.col("end_pos")), F.floor(F.col("pos") / 4096), ["pos", "symbol"]).drop("symbol", "pos").withColumnRenamed("idx", "pos")
    at = new_path(spark, "meta-rows")  # made once; fitting reads them again and again
    rows.write.parquet(at)
    rows = spark.read.parquet(at)
    folds = crossval.purged_kfold(rows.select("pos", "t0", "t1"), rows.count(), 3, 0.01)
    try:
        return metamodel.fit(rows.select("pos", *metamodel.FEATURES, "y", "weight"), folds)[1]
    except metamodel.NoFoldError:  # a signal without trades has labels of one class: there is nothing to predict
        return statistics.classifier_metrics(rows.select("y", F.lit(0.0).alias("p")).limit(0)).na.fill(0, ["n"])


def _live_events(stream: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "pnl").when(F.col("event_type").isin("click", "view"), "tick").otherwise("order")
    return stream.select(F.col("user_id").cast("string").alias("account"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.col("event_id").cast("string").alias("order_id"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("qty"), (F.col("value") - 150).alias("value"))


def streaming_risk(spark: SparkSession, d: str) -> DataFrame:
    stream = _live_events(live.event_stream(spark, d))
    return live.run_once(live.risk_decisions(stream, replace_limits()), "risk")


def replace_limits():
    from ..config import LiveLimits

    return replace(LiveLimits(), stale_seconds=864_000.0)


def streaming_disconnects(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on orders while the line of an account goes down and comes back: nothing is approved in between."""
    e = live.event_stream(spark, d)
    k = F.col("event_id")
    kind = F.when(k % 11 == 3, "disconnect").when(k % 11 == 8, "reconnect").when(k % 2 == 0, "tick").otherwise("order")
    rows = e.select(F.col("user_id").cast("string").alias("account"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), k.cast("string").alias("order_id"), F.lit(1).alias("qty"), F.lit(0.0).alias("value"))
    return live.run_once(live.risk_decisions(rows, replace(replace_limits(), stale_seconds=1e9, orders_per_minute=10**6, max_contracts=10**6)), "disconnects").select("account", "order_id", "approved", "reason")


def streaming_monitor(spark: SparkSession, d: str) -> DataFrame:
    e = live.event_stream(spark, d)
    fills = e.select(F.col("user_id").cast("string").alias("strategy"), F.col("event_id").alias("seq"), (F.col("value") % 50 - 25).alias("slippage_usd"), (F.col("value") - 100).alias("pnl_usd"))
    return live.run_once(live.live_monitor(fills), "monitor").select("strategy", "seq", "n", F.round("mean_slippage", 9).alias("mean_slippage"), F.round("sharpe", 9).alias("sharpe"), "shut_down", "reason")


def streaming_unique_orders(spark: SparkSession, d: str) -> DataFrame:
    e = live.event_stream(spark, d).select(F.concat_ws("-", "user_id", "event_type").alias("client_order_id"), F.col("ts").cast("timestamp").alias("ts"))
    return live.run_once(live.unique_orders(e, "3650 days").select("client_order_id"), "orders")


QUERIES = {q.__name__: q for q in (research_verdict, lookahead_audit, hmm_regimes, change_point_regimes, meta_model, streaming_risk, streaming_disconnects, streaming_monitor, streaming_unique_orders)}

SQL = {
    "streaming_disconnects": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS account, ts, CAST(event_id AS VARCHAR) AS order_id, CASE WHEN event_id % 11 = 3 THEN 'disconnect' WHEN event_id % 11 = 8 THEN 'reconnect' WHEN event_id % 2 = 0 THEN 'tick' ELSE 'order' END AS kind FROM events),
        s AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('disconnect', 'reconnect') THEN kind END IGNORE NULLS) OVER w, 'reconnect') = 'disconnect' AS down, count(*) FILTER (WHERE kind = 'tick') OVER w = 0 AS never FROM e WINDOW w AS (PARTITION BY account ORDER BY ts, order_id ROWS UNBOUNDED PRECEDING)),
        h AS (SELECT *, count(*) FILTER (WHERE kind = 'order' AND never AND NOT down) OVER (PARTITION BY account ORDER BY ts, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS halted FROM s),
        r AS (SELECT account, order_id, CASE WHEN down THEN 'disconnected' WHEN halted THEN 'halted' WHEN never THEN 'stale_data' END AS reason FROM h WHERE kind = 'order')
        SELECT account, order_id, reason IS NULL AS approved, reason FROM r""",
    "streaming_unique_orders": "SELECT DISTINCT concat_ws('-', user_id, event_type) AS client_order_id FROM events",
    "streaming_monitor": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS strategy, event_id, value % 50 - 25 AS s, value - 100 AS p FROM events),
        m AS (SELECT strategy, event_id AS seq, CAST(count(*) OVER w AS INTEGER) AS n, avg(abs(s)) OVER w AS slip, avg(p) OVER w AS mean, CASE WHEN count(*) OVER w >= 20 THEN coalesce(avg(p) OVER w / nullif(stddev_pop(p) OVER w, 0), 0.0) END AS sharpe
            FROM e WINDOW w AS (PARTITION BY strategy ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
        r AS (SELECT *, CASE WHEN slip > 40 THEN 'slippage' WHEN sharpe IS NOT NULL AND sharpe < 0.25 THEN 'sharpe' WHEN n >= 20 AND abs(mean * sqrt(n)) > 3 THEN 'drift' END AS reason FROM m)
        SELECT strategy, seq, n, round(slip, 9) AS mean_slippage, round(sharpe, 9) AS sharpe, reason IS NOT NULL AS shut_down, reason FROM r""",
}
