"""Settings of the cleaning, steady-state and resampling operators, with their defaults."""

from __future__ import annotations

import copy
import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Schema:
    manual_time_column: str | None = None
    manual_sensor_columns: list[str] | None = None
    exclude_columns: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Cleaning:
    window_radius: int = 5
    z_threshold: float = 3.0
    absolute_jump_threshold: float = 0.0  # 0: off
    strategy: str = "local_mean"
    clip_max: float | None = None
    nan_policy: str = "interpolate"


@dataclass(frozen=True)
class Characterization:
    method: str = "cubic_spline"
    dense_factor: float = 4


@dataclass(frozen=True)
class Steady:
    steady_window_seconds: float = 60.0
    min_steady_duration_seconds: float | None = 60.0
    min_points_per_window: int = 5
    change_fraction_of_scale: float = 0.15
    std_fraction_of_scale: float = 0.10
    slope_tolerance_per_second: float | None = None
    max_change_in_window: float | None = None
    max_std_in_window: float | None = None
    groups: dict[str, list[str]] | None = None

    @property
    def duration(self) -> float:
        """Least duration of a steady segment: the window, where it is not set or 0."""
        return float(self.min_steady_duration_seconds or self.steady_window_seconds)

    @property
    def points(self) -> int:
        return max(int(self.min_points_per_window), 3)


@dataclass(frozen=True)
class Config:
    schema: Schema = field(default_factory=Schema)
    cleaning: Cleaning = field(default_factory=Cleaning)
    characterization: Characterization = field(default_factory=Characterization)
    steady_state: Steady = field(default_factory=Steady)
    allow_index_time_fallback: bool = True
    analysis_dir: str = "analysis"
    modes: tuple[str, ...] = ("serial", "replicated", "partitioned")
    process_counts: tuple[int, ...] = (1, 2, 4, 8)
    repeat: int = 3
    benchmark: bool = False

    @classmethod
    def of(cls, raw: dict[str, Any] | None) -> Config:
        """From a plain mapping; keys that no operator reads are left out, but an unknown one of characterization is an error."""
        raw = copy.deepcopy(raw or {})
        parts = {"schema": Schema, "cleaning": Cleaning, "characterization": Characterization, "steady_state": Steady}
        made: dict[str, Any] = {}
        for name, kind in parts.items():
            known = {f.name for f in fields(kind)}
            made[name] = kind(**{k: v for k, v in (raw.get(name) or {}).items() if k in known or kind is Characterization})
        for name in ("allow_index_time_fallback", "analysis_dir"):
            if name in raw:
                made[name] = raw[name]
        modes = (raw.get("execution") or {}).get("default_modes") or raw.get("modes")
        if modes:
            made["modes"] = tuple(modes)
        study = raw.get("benchmark") or {}
        # As ``asdict`` gives it, or as a settings file has it.
        study = study if isinstance(study, dict) else {"enabled_by_default": study}
        study = {k: raw[k] for k in ("process_counts", "repeat") if k in raw} | study
        if study.get("process_counts"):
            made["process_counts"] = tuple(int(n) for n in study["process_counts"])
        if study.get("repeat") is not None:
            made["repeat"] = int(study["repeat"])
        made["benchmark"] = bool(study.get("enabled_by_default"))
        return cls(**made)

    def with_window(self, seconds: float | None) -> Config:
        """A steady window that is given on its own is the least duration too."""
        if seconds is None:
            return self
        raw = asdict(self)
        raw["steady_state"] |= {"steady_window_seconds": seconds, "min_steady_duration_seconds": seconds}
        return Config.of(raw)


def load_config(path: str | Path | None) -> Config:
    if path is None:
        return Config()
    return Config.of(json.loads(Path(path).read_text(encoding="utf-8")))


def save_json(path: str | Path, value: Any) -> None:
    Path(path).write_text(json.dumps(value, indent=2, default=str), encoding="utf-8")
