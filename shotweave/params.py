"""Parameters as frozen dataclasses; layers of plain dictionaries or TOML files override the defaults."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


# The defaults of all sections.
@dataclass(frozen=True)
class Shots:
    threshold: float = 0.5
    min_shot_seconds: float = 0.4
    frame_positions: tuple[float, ...] = (0.15, 0.5, 0.85)


@dataclass(frozen=True)
class Grouping:
    clip_weight: float = 0.75
    color_weight: float = 0.25
    clip_floor: float = 0.5
    window_shots: int = 6
    window_seconds: float = 45.0
    distance_penalty: float = 0.01
    coherence_topk: int = 2
    abs_threshold: float = 0.45
    depth_threshold: float = 0.35
    strong_threshold: float = 0.75
    depth_mode: str = "climb"
    min_scene_seconds: float = 6.0

    def __post_init__(self) -> None:
        if self.depth_mode not in ("climb", "window"):
            raise ValueError(f"unknown depth_mode {self.depth_mode!r}")
        if self.clip_weight + self.color_weight <= 0:
            raise ValueError("similarity weights must sum to more than 0")


@dataclass(frozen=True)
class Unique:
    w_clip: float = 2.776
    w_color: float = 3.540
    w_phash: float = 4.089
    bias: float = -7.886
    duplicate_threshold: float = 0.60
    different_threshold: float = 0.35
    phash_neutral: float = 0.60
    linkage: str = "average"
    rep_w_centrality: float = 0.35
    rep_w_sharpness: float = 0.25
    rep_w_duration: float = 0.20
    rep_w_stability: float = 0.10
    rep_w_exposure: float = 0.10

    def __post_init__(self) -> None:
        if self.linkage not in ("average", "single", "complete"):
            raise ValueError(f"unknown linkage {self.linkage!r}")


@dataclass(frozen=True)
class Commercial:
    min_confidence: float = 0.40
    min_relevance: float = 0.45
    context_min_confidence: float = 0.60
    context_min_margin: float = 0.15
    min_evidence: float = 0.10
    environment_min_confidence: float = 0.60


@dataclass(frozen=True)
class Params:
    shots: Shots = field(default_factory=Shots)
    grouping: Grouping = field(default_factory=Grouping)
    unique: Unique = field(default_factory=Unique)
    commercial: Commercial = field(default_factory=Commercial)


def replaced(params: Any, **changes: Any) -> Any:
    """A copy with other values; names that it doesn't have are refused."""
    known = {f.name for f in dataclasses.fields(params)}
    if unknown := sorted(set(changes) - known):
        raise ValueError(f"unknown parameters: {unknown}")
    return dataclasses.replace(params, **{k: tuple(v) if isinstance(v, list) else v for k, v in changes.items()})


def layered(*layers: dict[str, dict[str, Any]] | str | Path) -> Params:
    """Defaults, then each layer over the ones before it: a dictionary of sections or the path of a TOML file."""
    out = Params()
    for layer in layers:
        sections = layer if isinstance(layer, dict) else tomllib.loads(Path(layer).read_text(encoding="utf-8"))
        if unknown := sorted(set(sections) - {f.name for f in dataclasses.fields(out)}):
            raise ValueError(f"unknown sections: {unknown}")
        out = dataclasses.replace(out, **{name: replaced(getattr(out, name), **values) for name, values in sections.items()})
    return out


def fingerprint(params: Any) -> str:
    """A short name for these parameters, for folders of results."""
    return hashlib.sha1(json.dumps(dataclasses.asdict(params), sort_keys=True).encode()).hexdigest()[:10]


def to_toml(params: Params) -> str:
    """These parameters as a TOML text that :func:`layered` reads back."""

    def value(v: Any) -> str:
        return json.dumps(list(v) if isinstance(v, tuple) else v)

    sections = dataclasses.asdict(params)
    return "\n".join(line for name, fields in sections.items() for line in (f"[{name}]", *(f"{k} = {value(v)}" for k, v in fields.items()), "")) + "\n"
