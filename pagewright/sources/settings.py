"""Settings from a JSON file and the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

from .inventory import SUFFIXES, parse_suffixes

_TRUE, _FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def truth(raw: object, default: bool) -> bool:
    """A flag from any spelling of it."""
    text = str(raw).strip().lower()
    return True if text in _TRUE else False if text in _FALSE else default


def flat_keys(raw: object) -> tuple[str, ...]:
    """Keys from a text with commas, a list or nested lists and tables, each once, in order."""
    if isinstance(raw, str):
        return tuple(dict.fromkeys(x for x in (p.strip() for p in raw.split(",")) if x))
    if isinstance(raw, dict):
        raw = list(raw.values())
    return tuple(dict.fromkeys(x for part in raw or () for x in flat_keys(part)))


@dataclass(frozen=True)
class Settings:
    root: str = "input"
    suffixes: tuple[str, ...] = SUFFIXES
    keys: tuple[str, ...] = ()
    models: tuple[str, ...] = ("default",)
    discover_at_start: bool = False
    detection: dict = field(default_factory=lambda: {"confidence": 0.25, "iou": 0.45, "image_size": 1024})


def load(path: str | None = None, env: dict[str, str] | None = None) -> Settings:
    """Settings of a file, which the environment overrides."""
    env = dict(os.environ) if env is None else env
    raw = json.loads(Path(path).read_text()) if path and Path(path).exists() else {}
    get = lambda name, default: env.get(f"PAGEWRIGHT_{name.upper()}", raw.get(name, default))
    suffixes = get("suffixes", "")
    return Settings(
        root=str(get("root", "input")),
        suffixes=parse_suffixes(suffixes if isinstance(suffixes, str) else ",".join(suffixes)),
        keys=flat_keys(get("keys", ())),
        models=flat_keys(get("models", ())) or ("default",),
        discover_at_start=truth(get("discover_at_start", False), False),
    )


def check_detection(confidence: float, iou: float, image_size: int) -> list[str]:
    """Why detection parameters are not valid; none if they are."""
    return [m for bad, m in ((not 0 <= confidence <= 1, "confidence"), (not 0 <= iou <= 1, "iou"), (image_size < 32, "image_size")) if bad]
