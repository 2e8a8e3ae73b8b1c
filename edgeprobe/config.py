"""Configuration from TOML; unknown keys are refused."""

from __future__ import annotations

import dataclasses
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .errors import ConfigError
from .operators import execution
from .operators.validation import Split


@dataclass(frozen=True)
class Data:
    path: str = ""
    source: str = "parquet"
    symbol: str = ""
    interval: str = "1h"
    start: str = ""
    end: str = ""
    funding: bool = False
    metrics: bool = False
    funding_path: str = ""
    metrics_path: str = ""
    bars: int = 4000
    seed: int = 0

    @property
    def bars_per_year(self) -> int:
        return execution.bars_in_a_year(self.interval)


# The defaults of labels, costs, sizing and models below.
@dataclass(frozen=True)
class Label:
    kind: str = "triple_barrier"
    horizon: int = 24
    vol_window: int = 72
    upper: float = 1.5
    lower: float = 1.5
    deadband: float = 0.5


@dataclass(frozen=True)
class Cost:
    fee_bps: float = 10.0
    slippage_bps: float = 2.0

    @property
    def rate(self) -> float:
        return (self.fee_bps + self.slippage_bps) / 1e4


@dataclass(frozen=True)
class Sizing:
    long_entry: float = 0.56
    long_exit: float = 0.50
    short_entry: float = 0.44
    short_exit: float = 0.50
    allow_short: bool = True
    min_hold: int = 6
    max_leverage: float = 1.0
    vol_target: float = 0.0


@dataclass(frozen=True)
class Model:
    """``hgb``: boosted trees; ``logistic``: regression, of which only ``l2`` is asked."""

    kind: str = "hgb"
    rounds: int = 300
    depth: int = 4
    step: float = 0.05
    least: int = 200
    l2: float = 1.0
    seed: int = 0

    @property
    def params(self) -> dict[str, Any]:
        return {"l2": self.l2} if self.kind == "logistic" else {"rounds": self.rounds, "depth": self.depth, "step": self.step, "least": self.least, "seed": self.seed}


@dataclass(frozen=True)
class Run:
    name: str = "run"
    data: Data = field(default_factory=Data)
    label: Label = field(default_factory=Label)
    split: Split = field(default_factory=Split)
    cost: Cost = field(default_factory=Cost)
    sizing: Sizing = field(default_factory=Sizing)
    model: Model = field(default_factory=Model)
    strategies: tuple[str, ...] = ("buy_hold",)
    params: dict[str, dict[str, Any]] = field(default_factory=dict)
    ledger: str = "runs"
    prior_trials: int = 0


_SECTIONS = {"data": Data, "label": Label, "split": Split, "cost": Cost, "sizing": Sizing, "model": Model}


def _made(kind, raw: dict, where: str):
    known = {f.name for f in dataclasses.fields(kind)}
    if unknown := sorted(raw.keys() - known):
        raise ConfigError(f"unknown key in {where}: {', '.join(unknown)}")
    return kind(**raw)


def from_dict(raw: dict, name: str = "run") -> Run:
    out = {k: _made(_SECTIONS[k], v, k) if k in _SECTIONS else tuple(v) if k == "strategies" else v for k, v in raw.items()}
    out.setdefault("name", name)
    cfg = _made(Run, out, "the configuration")
    cfg.data.bars_per_year  # noqa: B018  an unknown interval is an error of the configuration
    return cfg


def load(path: str, changes: dict[str, str] | None = None) -> Run:
    """A TOML file, perhaps with changes such as {"sizing.min_hold": "12"}."""
    p = Path(path)
    if not p.is_file():
        raise ConfigError(f"no such file: {path}")
    try:
        raw = tomllib.loads(p.read_text())
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{path}: {e}") from e
    for key, value in (changes or {}).items():
        at = raw
        *sections, last = key.split(".")
        for s in sections:
            at = at.setdefault(s, {})
        try:
            at[last] = tomllib.loads(f"x = {value}")["x"]
        except tomllib.TOMLDecodeError:
            at[last] = value
    return from_dict(raw, p.stem)
