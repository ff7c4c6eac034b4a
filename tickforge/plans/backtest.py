"""The event-driven backtest of one configuration: whole-contract targets, netted round turns, costs, metrics, a trial and a
manifest."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import INSTRUMENTS, Costs, config_hash
from ..operators import trading as t
from ..sources.snapshots import SnapshotStore, require_validation_grade
from ..sources.trials import TrialStore
from .manifest import FIXED_AT, Manifest, git_sha

#: No costs at all.
FREE = Costs(0.0, 0.0, 0.0, 0.0, "fixed", 0.0, 0)


@dataclass(frozen=True)
class Strategy:
    signal: str
    params: dict
    qty: int = 1
    seed: int = 7
    balance: float = 100_000.0


@dataclass
class Backtest:
    """trades are priced; curve has each trade's return and the account's equity after it."""

    trades: DataFrame
    curve: DataFrame
    metrics: dict[str, float]
    manifest: Manifest
    trial_id: str


def event_log(bars: DataFrame, strategy: Strategy, costs: Costs, instrument: str, delay: int = 0) -> DataFrame:
    """Priced trades (combo_id 0) of the causal, rounded targets, filled `delay` bars late; those that the data have no room for
    are left out."""
    spec = INSTRUMENTS[instrument]
    if why := t.bad_params(strategy.signal, strategy.params):
        raise ValueError(why)
    held = t.causal(t.signal_over_grid(bars, strategy.signal, [(0, strategy.params)]))
    log = t.event_trades(held, spec, strategy.qty)
    return t.apply_costs(t.delayed_fill(log, bars, spec, delay) if delay else log, costs, spec)


def totals(log: DataFrame, balance: float) -> dict[str, float]:
    """Over all trades: their number, ratios, win rate, result, and the deepest fall of the account as a share of its peak."""
    one = log.withColumn("combo_id", F.lit(0).cast("long"))
    row = t.metrics(one, ("combo_id",)).join(t.drawdowns(one, ("combo_id",), balance).withColumnRenamed("max_drawdown", "drawdown_share"), "combo_id").first()
    names = ("n_trades", "sharpe_gross", "sharpe_net", "win_rate", "net_pnl", "max_drawdown", "drawdown_share")
    return {n: float(row[n]) if row is not None else 0.0 for n in names}


def backtest(bars: DataFrame, strategy: Strategy, costs: Costs = Costs(), instrument: str = "MES", delay: int = 0, trials: TrialStore | None = None, snapshots: tuple[str, ...] = (), created_at: str = FIXED_AT) -> Backtest:
    """Runs a strategy over bars and records it as one trial, if there is a store."""
    digest = config_hash("FE-BACKTESTCFG-v1", {"strategy": asdict(strategy), "costs": asdict(costs), "delay": delay})
    log = event_log(bars, strategy, costs, instrument, delay)
    metrics = totals(log, strategy.balance)
    sha, trial = git_sha(), f"{digest[:16]}-{(snapshots or ('',))[0][:8]}"
    if trials is not None:
        trials.append([{"trial_id": trial, "run_id": digest[:16], "strategy_family": strategy.signal, "config_hash": digest, "params": strategy.params, "cv_scheme": "event_backtest", "metrics": metrics, "seed": strategy.seed, "git_sha": sha, "data_snapshot_hashes": list(snapshots)}])
    manifest = Manifest(digest[:16], created_at, sha, strategy.seed, digest, list(snapshots), [trial])
    return Backtest(log, t.equity(log, strategy.balance), metrics, manifest, trial)


def backtest_snapshot(store: SnapshotStore, digest: str, strategy: Strategy, **settings) -> Backtest:
    """backtest of a snapshot, which must be of validation grade."""
    bars, meta = store.load(digest)
    require_validation_grade(meta)
    return backtest(bars, strategy, snapshots=(digest,), **settings)


def three_ways(bars: DataFrame, strategy: Strategy, costs: Costs, instrument: str, **settings) -> dict[str, Backtest]:
    """The strategy net of costs, gross, and net with fills a bar late."""
    ways = {"net": (costs, costs.fill_delay_bars), "gross": (FREE, 0), "delayed": (replace(costs, fill_delay_bars=1), 1)}
    return {k: backtest(bars, strategy, c, instrument, d, **settings) for k, (c, d) in ways.items()}
