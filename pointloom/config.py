"""Parameters of all operators as frozen dataclasses, and the loader of their YAML form."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


# The names of the parameters and their defaults, in all classes below.
@dataclass(frozen=True)
class FilterConfig:
    max_range: float = 120.0
    min_intensity: float = 0.0
    spike_kernel: int = 5
    spike_threshold: float = 1.0


@dataclass(frozen=True)
class GroundConfig:
    quantile: float = 0.05
    grid: float = 2.0
    threshold: float = 0.2


@dataclass(frozen=True)
class AttributeConfig:
    reference_range: float = 50.0
    clusters: int = 3
    intensity_min: float = 1.0
    intensity_max: float = 255.0
    rgb_min: float = 0.0
    rgb_max: float = 255.0
    white_balance: bool = False


@dataclass(frozen=True)
class QAConfig:
    density: float = 50.0
    intensity: float = 1.0
    ground_min: float = 0.05
    ground_max: float = 0.95
    rgb_min: float = 0.0
    rgb_max: float = 255.0
    x_range: tuple[float, float] = (-7000.0, 300000.0)
    y_range: tuple[float, float] = (289000.0, 629000.0)
    z_range: tuple[float, float] = (-20.0, 400.0)
    epsg: int = 28992


@dataclass(frozen=True)
class Config:
    provider: str = "unknown"
    tile_size: float = 20.0
    filters: FilterConfig = field(default_factory=FilterConfig)
    ground: GroundConfig = field(default_factory=GroundConfig)
    attributes: AttributeConfig = field(default_factory=AttributeConfig)
    qa: QAConfig = field(default_factory=QAConfig)


def from_dict(kind: type, values: dict[str, Any]):
    """Build ``kind`` from a dict; unknown keys raise ValueError."""
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown keys: {', '.join(sorted(unknown))}")
    blank = kind()
    made = {}
    for k, v in values.items():
        own = getattr(blank, k)
        made[k] = from_dict(type(own), v) if is_dataclass(own) else tuple(v) if isinstance(own, tuple) else v
    return kind(**made)


def load_config(path: str) -> dict[str, Any]:
    """The YAML file as a dict; a missing or malformed file raises."""
    import yaml

    with open(path, encoding="utf-8") as f:
        out = yaml.safe_load(f)
    if out is None:
        return {}
    if not isinstance(out, dict):
        raise ValueError(f"{path} does not hold a mapping")
    return out
