"""Configuration as nested dictionaries: inheritance, merging, overlays, validation."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

try:
    import yaml
except ModuleNotFoundError:  # YAML is optional; JSON files always work
    yaml = None


from ..operators.summarize import PRESETS


class ConfigError(ValueError):
    pass


CHOICES = {
    "preprocess.tone_style": ("old", "new", None), "long_context.strategy": ("extractive", "hierarchical"), "long_context.ranker": ("bm25", "lexrank"),
    "long_context.selection": ("budget", "ratio"), "reduce.factcheck": ("off", "drop"), "strategy": ("auto", "direct", "extractive", "hierarchical"),
}
RANGES = {"long_context.ratio": (0, 1), "long_context.max_tokens": (2, None), "chunks.overlap": (0, None), "reduce.threshold": (0, 1), "stats.confidence": (0, 1)}


def merged(base: dict, over: dict) -> dict:
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _parse(path: Path) -> dict:
    raw = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(raw)
    if yaml is None:
        raise ConfigError("YAML files need PyYAML")
    return yaml.safe_load(raw) or {}


def read_config(path: str | Path, seen: tuple[Path, ...] = ()) -> dict:
    """A file and what it ``extends``, the nearer file winning; a cycle is an error."""
    path = Path(path).resolve()
    if path in seen:
        raise ConfigError("cycle of extends: " + " -> ".join(map(str, [*seen, path])))
    own = _parse(path)
    parent = own.pop("extends", None)
    return merged(read_config(path.parent / parent, (*seen, path)), own) if parent else own


def with_limit(config: dict, limit: int | None) -> dict:
    """A limited run takes the ``smoke`` overlay."""
    if limit is None:
        return config
    if limit < 1:
        raise ConfigError("limit must be at least 1")
    return merged(config, config.get("smoke", {})) | {"limit": limit}


def at(config: dict, dotted: str, default: Any = None) -> Any:
    for k in dotted.split("."):
        if not isinstance(config, dict) or k not in config:
            return default
        config = config[k]
    return config


def validated(config: dict) -> dict:
    for key, allowed in CHOICES.items():
        value = at(config, key, allowed[0])
        if key.endswith("factcheck") and value is False:
            value = "off"
        if value not in allowed:
            raise ConfigError(f"{key} must be one of {allowed}, not {value!r}")
    for key, (low, high) in RANGES.items():
        value = at(config, key)
        if value is not None and (not isinstance(value, (int, float)) or value < low or high is not None and value > high):
            raise ConfigError(f"{key} out of range: {value!r}")
    ratios = at(config, "splits")
    if ratios and abs(sum(ratios.values()) - 1) > 1e-6:
        raise ConfigError("split ratios must add up to 1")
    return config


def selected_systems(config: dict, explicit: list[str] | None = None) -> list[str]:
    """An explicit list overrides what is enabled; unknown names are an error."""
    systems = config.get("systems", {})
    if explicit:
        if lost := [s for s in explicit if s not in systems]:
            raise ConfigError(f"unknown systems: {', '.join(lost)}")
        return list(explicit)
    return [s for s, c in systems.items() if c.get("enabled", True)]


def generation_options(length: str, **more) -> dict:
    """What a generator is told for a length; options that a preset leaves open are not named."""
    if length not in PRESETS:
        raise ConfigError(f"length must be one of {', '.join(PRESETS)}, not {length!r}")
    named = {**PRESETS[length], **more}
    return {k: v for k, v in named.items() if v is not None}
