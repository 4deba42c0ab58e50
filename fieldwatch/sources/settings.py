"""Settings: typed registry with defaults, read from YAML or JSON, checked for consistency."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Named settings with their fixed default values."""

    unsettled_nt: float = 20.0
    active_nt: float = 30.0
    minor_storm_nt: float = 100.0
    major_storm_nt: float = 400.0
    severe_storm_nt: float = 800.0
    jump_nt: float = 100.0
    amplitude_window_min: float = 180.0
    amplitude_mode: str = "range"
    amplitude_centered: bool = False
    max_plausible_nt: float = 3000.0
    min_plausible_nt: float = -3000.0
    baseline_window_h: float = 24.0
    baseline_step_h: float = 12.0
    baseline_passes: int = 4
    storm_fraction: float = 0.05
    max_gap_samples: int = 3
    min_coverage: float = 0.90
    max_fill_fraction: float = 0.20
    max_latency_min: float = 90.0
    clock_skew_min: float = 5.0
    min_requested_coverage: float = 0.80
    max_drift_nt: float = 50.0
    max_quiet_rms_nt: float = 30.0
    state_max_age_h: float = 168.0
    alert_level: str = "minor_storm"
    alert_url: str = ""


def problems(s: Settings) -> list[str]:
    """Everything inconsistent in the settings."""
    out = []
    for f in fields(s):
        v = getattr(s, f.name)
        if isinstance(f.default, bool) != isinstance(v, bool) or not isinstance(v, (int, float) if isinstance(f.default, float) else type(f.default)):
            out.append(f"{f.name}: {v!r} is not of type {type(f.default).__name__}")
    if out:
        return out
    tiers = [s.unsettled_nt, s.active_nt, s.minor_storm_nt, s.major_storm_nt, s.severe_storm_nt]
    if sorted(set(tiers)) != tiers or tiers[0] <= 0:
        out.append("every tier needs a higher threshold than the one below it, the lowest more than 0")
    out += [f"{n} must lie in 0..1" for n in ("storm_fraction", "min_coverage", "max_fill_fraction", "min_requested_coverage") if not 0 <= getattr(s, n) <= 1]
    out += [f"{n} must be above 0" for n in ("baseline_step_h", "baseline_window_h", "amplitude_window_min", "jump_nt", "baseline_passes") if not getattr(s, n) > 0]
    out += [f"{f.name} is not a number" for f in fields(s) if isinstance(getattr(s, f.name), float) and getattr(s, f.name) != getattr(s, f.name)]
    if s.baseline_step_h > s.baseline_window_h:
        out.append("the baseline's step exceeds its window")
    if s.min_plausible_nt >= s.max_plausible_nt:
        out.append("min_plausible_nt must be below max_plausible_nt")
    if s.amplitude_mode not in ("range", "hybrid", "max", "instant"):
        out.append(f"unknown amplitude_mode {s.amplitude_mode!r}")
    if s.alert_level not in ("minor_storm", "major_storm", "severe_storm"):
        out.append(f"unknown alert_level {s.alert_level!r}")
    if s.alert_url and not s.alert_url.startswith(("http://", "https://")):
        out.append("alert_url: only http and https are delivered to")
    return out


def _flat(node: dict) -> dict:
    out: dict = {}
    for k, v in node.items():
        out |= _flat(v) if isinstance(v, dict) else {k: v}
    return out


def load(path: str) -> Settings:
    """Settings of a JSON file, or of a YAML file where a YAML reader is installed. Nested sections are flattened, unknown
    names only warned of; inconsistent settings are an error."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text) or {}
    else:
        data = json.loads(text)
    flat, names = _flat(data), {f.name: f.default for f in fields(Settings)}
    for k in sorted(flat.keys() - names.keys()):
        warnings.warn(f"unknown setting {k}", stacklevel=2)
    known = {k: float(v) if isinstance(names[k], float) and isinstance(v, int) and not isinstance(v, bool) else v for k, v in flat.items() if k in names}
    s = replace(Settings(), **known)
    if bad := problems(s):
        raise ValueError("; ".join(bad))
    return s
