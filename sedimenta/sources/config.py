"""Configuration from YAML with environment placeholders; driver-side."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any


@dataclass
class Model:
    """A recognition model's endpoint."""

    url: str = ""
    key: str = ""
    name: str = ""
    timeout: int = 60
    max_tokens: int = 1024


@dataclass
class Recognition:
    """How images and pages are recognised: cloud, local, hybrid or slide; anything else counts as cloud."""

    enabled: bool = False
    mode: str = "cloud"
    language: str = "chi_sim+eng"
    model: Model = field(default_factory=Model)
    min_bytes: int = 500
    min_pixels: int = 50
    dpi: int = 150


@dataclass
class Config:
    """All settings with their defaults."""

    recognition: Recognition = field(default_factory=Recognition)
    threshold: float = 0.85
    min_score: int = 30
    max_tags: int = 5
    max_hamming: int = 3


def resolve(value: Any) -> Any:
    """Replaces strings that are one placeholder ``${NAME}`` by the environment's value or an empty string; in mappings, not in lists."""
    if isinstance(value, dict):
        return {k: resolve(v) for k, v in value.items()}
    found = re.fullmatch(r"\$\{(\w+)\}", value) if isinstance(value, str) else None
    return os.environ.get(found.group(1), "") if found else value


def build(raw: dict, target: Any = None) -> Config:
    """Settings from a mapping; unknown keys are ignored, missing ones keep their defaults."""
    target = target if target is not None else Config()
    for item in fields(target):
        if item.name in (raw or {}):
            current = getattr(target, item.name)
            setattr(target, item.name, build(raw[item.name] or {}, current) if is_dataclass(current) else raw[item.name])
    if isinstance(target, Recognition) and target.mode not in ("cloud", "local", "hybrid", "slide"):
        target.mode = "cloud"
    return target


def load(path: str | None = None) -> Config:
    """Settings from a YAML file; defaults where it is missing."""
    file = Path(path or "~/.sedimenta/config.yaml").expanduser()
    if not file.exists():
        return Config()
    import yaml

    return build(resolve(yaml.safe_load(file.read_text(encoding="utf-8")) or {}))
