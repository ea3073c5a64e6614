"""Settings: layered overlay of nested dictionaries, order-independent hashes, fingerprints of inputs."""

from __future__ import annotations

import hashlib
import json
from functools import reduce


def overlay(*layers: dict) -> dict:
    """Later layers win; dictionaries are merged at every depth, other values replaced."""

    def two(a: dict, b: dict) -> dict:
        return a | {k: two(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    return reduce(two, layers, {})


def settings_hash(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()[:12]


def changed_inputs(before: dict[str, str], now: dict[str, str]) -> list[str]:
    """Names of inputs whose fingerprint differs, or which came or went."""
    return sorted(k for k in before.keys() | now.keys() if before.get(k) != now.get(k))


def ensure_unchanged(before: dict[str, str], now: dict[str, str]) -> None:
    """A run is taken up again only on the inputs it began with."""
    if names := changed_inputs(before, now):
        raise ValueError(f"inputs changed since the run began: {', '.join(names)}")


def read_settings(*paths: str) -> dict:
    """Settings files laid over one another in order: JSON, or YAML where its reader is installed."""

    def read(path: str) -> dict:
        with open(path, encoding="utf-8") as f:
            if path.endswith(".json"):
                return json.load(f)
            try:
                import yaml
            except ImportError as e:
                raise ValueError(f"{path}: install a YAML reader or give JSON") from e
            return yaml.safe_load(f) or {}

    return overlay(*map(read, paths))


def document(settings: dict) -> dict:
    """What prompts say of the document: its title, the text for nothing found, and words for it."""
    title = settings.get("title", "the document")
    return {"title": title, "not_found": settings.get("not_found", "Not found in the guideline."), "words": settings.get("words", {"document": "guideline"})}


#: Names of everything a run writes, below its folder.
PATHS = {"manifest": "manifest", "evidence": "evidence", "answers": "answers", "scored": "scored", "scorecard": "scorecard", "tradeoff": "tradeoff", "report": "report", "log": "log"}


def paths_of(folder: str) -> dict[str, str]:
    return {k: f"{folder}/{v}" for k, v in PATHS.items()}
