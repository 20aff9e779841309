"""Small configuration files, read on the driver: YAML with defaults, named profiles, instruction templates."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class StartProfile:
    """Limits of a start. The defaults are fixed values."""

    min_corridor_width_m: float = 10.0
    min_forward_ray_m: float = 18.0
    max_ground_slope_m: float = 1.2
    min_vertical_clearance_m: float = 5.5
    min_open_ray_sum_m: float = 30.0
    min_drive_feasibility_m: float = 8.0
    search_radius_m: float = 120.0
    sample_step_m: float = 4.0
    max_samples: int = 1200
    min_accept_score: float = 35.0
    prefer_near_anchor_m: float = 80.0
    max_shift_from_anchor_m: float = 0.0


def document(path: str | Path) -> dict[str, Any]:
    """The mapping in a YAML file; a missing or empty file is an empty one, anything but a mapping an error."""
    path = Path(path)
    if not path.is_file():
        return {}
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs PyYAML") from e
    loaded = yaml.safe_load(path.read_text(encoding="utf-8"))
    if loaded is None:
        return {}
    if not isinstance(loaded, dict):
        raise ValueError(f"{path} holds no mapping")
    return loaded


def merged(defaults: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    """defaults with what is given; sections are merged key by key, to any depth."""
    out = dict(defaults)
    for k, v in given.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def start_profile(doc: dict[str, Any], name: str | None = None) -> StartProfile:
    """The named profile of a document, or its default one; unknown names are refused, unknown keys passed over."""
    profiles = doc.get("profiles") or {}
    name = name or doc.get("default_profile", "standard")
    if name not in profiles:
        raise KeyError(f"no profile {name!r}; there are {sorted(profiles)}")
    known = {f.name for f in fields(StartProfile)}
    return replace(StartProfile(), **{k: v for k, v in (profiles[name] or {}).items() if k in known})


def tier_templates(path: str | Path, defaults: dict[str, tuple[str, ...]]) -> dict[str, tuple[str, ...]]:
    """Templates by tier from a file, the defaults for tiers it lacks; an unreadable file gives the defaults."""
    try:
        doc = document(path)
    except Exception:  # a broken file must not stop a batch
        doc = {}
    tiers = doc.get("tiers", doc)
    return {t: tuple(tiers.get(t) or d) for t, d in defaults.items()}
