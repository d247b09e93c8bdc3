"""Configuration: JSON or simple YAML files, overlays, and ${NAME:-default} placeholders expanded at load."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

_PLACE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def expanded(value: Any, env: Mapping[str, str] | None = None) -> Any:
    env = os.environ if env is None else env
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, env) for v in value]
    if isinstance(value, str) and _PLACE.search(value):
        text = _PLACE.sub(lambda m: env.get(m[1], m[2] or ""), value)
        return {"true": True, "false": False}.get(text.lower(), text)
    return value


def overlaid(base: dict, over: dict) -> dict:
    """``over`` on ``base``; nested maps are merged, everything else replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = overlaid(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _parsed(path: Path) -> dict:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    import yaml  # only where YAML files are used

    return yaml.safe_load(text) or {}


def load(paths: list[str], overrides: dict | None = None, env: Mapping[str, str] | None = None) -> dict:
    out: dict = {}
    for p in paths:
        out = overlaid(out, _parsed(Path(p)))
    return expanded(overlaid(out, overrides or {}), env)


def problems(config: dict, required: tuple[str, ...] = ()) -> list[str]:
    """Missing sections, and values that look like secrets or private paths."""
    found = [f"missing section: {k}" for k in required if k not in config]

    def walk(value: Any, at: str) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, f"{at}.{k}" if at else k)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, f"{at}[{i}]")
        elif isinstance(value, str):
            if re.search(r"/(?:home|Users)/\w+", value):
                found.append(f"private path: {at}")
            if re.search(r"(?i)(?:key|secret|token)", at) and re.fullmatch(r"[A-Za-z0-9_\-]{20,}", value):
                found.append(f"secret value: {at}")

    walk(config, "")
    return found
