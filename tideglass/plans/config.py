"""Configuration: frozen dataclasses from YAML; files may extend others; unknown keys are errors."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field
from typing import Any, get_type_hints


@dataclass(frozen=True)
class CV:
    initial_train: int = 756
    retrain_every: int = 126
    scheme: str = "expanding"
    rolling_window: int = 1260
    embargo: int = 5
    folds: int = 5
    cpcv_groups: int = 6
    cpcv_tests: int = 2


@dataclass(frozen=True)
class Costs:
    half_spread_bps: float = 1.0
    commission_bps: float = 0.5
    slippage: float = 0.02
    impact: float = 0.1
    aum: float = 1e7
    borrow_bps: float = 30.0


@dataclass(frozen=True)
class Sizing:
    target_vol: float = 0.35
    max_gross: float = 1.5
    scale_window: int = 252
    kelly: float = 0.25


@dataclass(frozen=True)
class Evaluation:
    reps: int = 200
    pbo_blocks: int = 8
    var_window: int = 250
    null_paths: int = 100


@dataclass(frozen=True)
class Config:
    source: str = "synthetic"
    data_dir: str = ""
    work_dir: str = "/tmp/tideglass"
    seed: int = 42
    sessions: int = 1100
    signal: float = 0.3
    lockbox_start: str = "2023-01-03"
    models: tuple[str, ...] = ("hist_mean", "ar", "ridge", "boosted")
    cv: CV = field(default_factory=CV)
    costs: Costs = field(default_factory=Costs)
    sizing: Sizing = field(default_factory=Sizing)
    evaluation: Evaluation = field(default_factory=Evaluation)

    def __post_init__(self):
        if self.cv.embargo < 0:
            raise ValueError("the embargo is not negative")
        if self.cv.initial_train <= 21:
            raise ValueError("the longest label horizon must be below the first training size")


def merged(base: dict, over: dict) -> dict:
    """Dictionaries merge by key, all else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _typed(cls: type, values: dict[str, Any]) -> Any:
    hints = get_type_hints(cls)
    if unknown := set(values) - set(hints):
        raise KeyError(f"unknown keys of {cls.__name__}: {sorted(unknown)}")
    return cls(**{k: _typed(hints[k], v) if dataclasses.is_dataclass(hints[k]) else tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def read(path: str, depth: int = 5) -> dict:
    import yaml

    with open(path) as f:
        values = yaml.safe_load(f) or {}
    parent = values.pop("extends", None)
    if parent is None:
        return values
    if depth == 0:
        raise ValueError("configurations extend each other too deeply")
    return merged(read(os.path.join(os.path.dirname(path), parent), depth - 1), values)


def load(path: str | None = None, **over: Any) -> Config:
    return _typed(Config, merged(read(path) if path else {}, over))


def as_dict(c: Config) -> dict:
    return dataclasses.asdict(c)
