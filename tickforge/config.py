"""Configuration records: instruments, costs, account rules, gates and live limits; readers and writers of YAML."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any

import yaml


class ConfigError(ValueError):
    """A configuration that isn't valid."""


def strict(kind: type, data: Any, where: str = "") -> Any:
    """A record of `kind` from a mapping; unknown and missing keys are errors."""
    if not isinstance(data, dict):
        raise ConfigError(f"{where or kind.__name__}: a mapping is needed")
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(data) - known):
        raise ConfigError(f"{where or kind.__name__}: unknown keys {', '.join(unknown)}")
    try:
        return kind(**data)
    except TypeError as e:
        raise ConfigError(f"{where or kind.__name__}: {e}") from None


@dataclass(frozen=True)
class Instrument:
    symbol: str
    tick_size: float
    tick_value: float
    multiplier: float

    def __post_init__(self) -> None:
        if min(self.tick_size, self.tick_value, self.multiplier) <= 0:
            raise ConfigError(f"{self.symbol}: sizes must be positive")
        if not math.isclose(self.tick_value, self.multiplier * self.tick_size, rel_tol=1e-9, abs_tol=1e-12):
            raise ConfigError(f"{self.symbol}: tick value isn't multiplier times tick size")

    def precision(self) -> int:
        """Decimals of a price on the tick grid."""
        text = format(self.tick_size, "f").rstrip("0")
        return len(text.partition(".")[2])


@dataclass(frozen=True)
class Costs:
    """Costs of a side in USD and of a round turn in ticks. slippage: fixed ticks, or a share of atr_ticks_at_entry."""

    commission_per_side: float = 0.15
    exchange_fee_per_side: float = 0.35
    nfa_fee_per_side: float = 0.01
    spread_ticks: float = 1.0
    slippage_mode: str = "fixed"
    slippage: float = 1.0
    fill_delay_bars: int = 0

    def __post_init__(self) -> None:
        if min(self.commission_per_side, self.exchange_fee_per_side, self.nfa_fee_per_side, self.spread_ticks, self.slippage) < 0:
            raise ConfigError("costs can't be negative")
        if self.slippage_mode not in ("fixed", "vol_scaled"):
            raise ConfigError(f"unknown slippage mode {self.slippage_mode}")
        if self.fill_delay_bars not in (0, 1):
            raise ConfigError("the fill delay is 0 or 1 bars")


@dataclass(frozen=True)
class AccountRules:
    """Rules of a trading account. drawdown: eod (trails closing balances) or intraday (trails highs)."""

    name: str = ""
    start: float = 50_000.0
    trailing: float = 2_000.0
    target: float = 3_000.0
    drawdown: str = "eod"
    freeze_at_start: bool = False
    daily_loss: float | None = None
    consistency: float | None = None
    min_days: int = 0

    def __post_init__(self) -> None:
        if self.drawdown not in ("eod", "intraday"):
            raise ConfigError(f"unknown drawdown mode {self.drawdown}")
        if min(self.start, self.trailing, self.target) <= 0 or self.min_days < 0:
            raise ConfigError(f"{self.name}: amounts must be positive")


@dataclass(frozen=True)
class Gates:
    min_dsr: float = 0.95
    max_pbo: float = 0.5
    min_survival: float = 0.90


@dataclass(frozen=True)
class FlagLimits:
    sharpe: float = 3.0
    win_rate: float = 0.70
    smoothness: float = 10.0
    retention: float = 0.5


@dataclass(frozen=True)
class LiveLimits:
    daily_loss: float = 1_000.0
    daily_loss_buffer: float = 150.0
    trailing: float = 2_000.0
    start: float = 50_000.0
    trailing_margin: float = 250.0
    stale_seconds: float = 5.0
    orders_per_minute: int = 10
    max_contracts: int = 5
    slippage_usd: float = 40.0
    sharpe_floor: float = 0.25
    sharpe_samples: int = 20
    sharpe_window: int = 50
    drift_z: float = 3.0


#: Fixed values.
INSTRUMENTS = {"MES": Instrument("MES", 0.25, 1.25, 5.0), "MNQ": Instrument("MNQ", 0.25, 0.50, 2.0)}
PRESETS = {
    "topstep_50k": AccountRules("topstep_50k", drawdown="eod", freeze_at_start=True, daily_loss=1_000.0, consistency=0.50, min_days=0),
    "mffu_50k": AccountRules("mffu_50k", drawdown="eod", freeze_at_start=True, daily_loss=None, consistency=0.50, min_days=2),
    "apex_50k": AccountRules("apex_50k", drawdown="intraday", freeze_at_start=False, daily_loss=None, consistency=None, min_days=0),
}


class _UniqueKeys(yaml.SafeLoader):
    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=deep) for k, _ in node.value]
        if len(keys) != len(set(map(str, keys))):
            raise ConfigError("a key occurs twice")
        return super().construct_mapping(node, deep)


def read_yaml(path: str | Path) -> dict:
    data = yaml.load(Path(path).read_text(), Loader=_UniqueKeys)
    if not isinstance(data, dict):
        raise ConfigError(f"{path}: a mapping is needed")
    return data


def write_yaml(config: Any, path: str | Path | None = None) -> str:
    text = yaml.safe_dump(asdict(config) if hasattr(config, "__dataclass_fields__") else config, sort_keys=True)
    if path is not None:
        Path(path).write_text(text)
    return text


def read_instruments(path: str | Path) -> dict[str, Instrument]:
    return {k: strict(Instrument, {"symbol": k, **v}, k) for k, v in read_yaml(path).items()}


def read_rules(path: str | Path) -> dict[str, AccountRules]:
    return {k: strict(AccountRules, {"name": k, **v}, k) for k, v in read_yaml(path).items()}


def parse_grid(text: str) -> dict[str, list[float | int | str]]:
    """A parameter grid from lines "name: v1, v2"; blank lines are skipped."""
    out: dict[str, list] = {}
    for k, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        name, sep, values = line.partition(":")
        name = name.strip()
        if not sep or not name.isidentifier():
            raise ConfigError(f"line {k}: a line is 'name: value, value'")
        if name in out:
            raise ConfigError(f"line {k}: {name} occurs twice")
        items = [v.strip() for v in values.split(",")]
        if not all(items):
            raise ConfigError(f"line {k}: a value is missing")
        out[name] = [_scalar(v) for v in items]
    if not out:
        raise ConfigError("the grid is empty")
    return out


def _scalar(text: str) -> float | int | str:
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def combinations(grid: dict[str, list]) -> list[dict]:
    """All combinations, the last axis fastest."""
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def canonical(data: Any) -> str:
    return json.dumps(data, sort_keys=True, separators=(",", ":"))


def config_hash(tag: str, data: Any) -> str:
    """SHA-256 of a tag and canonical JSON; tags: FE-TRIALCFG-v1, FE-BACKTESTCFG-v1, FE-METACFG-v1."""
    return hashlib.sha256(f"{tag}\n{canonical(data)}".encode()).hexdigest()


@dataclass(frozen=True)
class RunConfig:
    """A research run: what to sweep, validate and decide on."""

    strategy: str = "donchian"
    grid: dict[str, list] = field(default_factory=lambda: {"window": [10, 20]})
    instrument: str = "MES"
    rules: str = "topstep_50k"
    qty: int = 1
    seed: int = 7
    balance: float = 100_000.0
    splits: int = 5
    embargo: float = 0.02
    partitions: int = 8
    bootstrap: int = 500
    paths: int = 300
    days: int = 30

    def __post_init__(self) -> None:
        if self.qty < 1 or self.partitions < 2 or self.partitions % 2 or self.splits < 2 or not 0 <= self.embargo < 1:
            raise ConfigError("qty, partitions, splits or embargo are out of range")
