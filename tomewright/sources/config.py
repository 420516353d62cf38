"""Layered settings: defaults, then files in order, then the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping


def merged(base: Mapping, over: Mapping | None) -> dict:
    """``base`` with the entries of ``over``; objects are merged, all else replaced. Neither is changed."""
    out = dict(base)
    for name, value in (over or {}).items():
        held = out.get(name)
        out[name] = merged(held if isinstance(held, Mapping) else {}, value) if isinstance(value, Mapping) else value
    return out


def _stored(path: str) -> dict:
    """The object in a JSON file; a missing or broken one adds nothing."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def load(defaults: Mapping, *paths: str, environment: Mapping[str, str] | None = None, prefix: str = "TOMEWRIGHT_") -> dict:
    """Settings; ``prefix`` with HOST and PORT in the environment come last."""
    out, given = merged({}, defaults), os.environ if environment is None else environment
    for path in paths:
        out = merged(out, _stored(path))
    if host := given.get(f"{prefix}HOST"):
        out["host"] = host
    if port := given.get(f"{prefix}PORT"):
        out["port"] = int(port)
    return out


def save(path: str, patch: Mapping) -> dict:
    """Merges ``patch`` into the file and returns what it then holds."""
    out = merged(_stored(path), patch)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=2, ensure_ascii=False)
    return out
