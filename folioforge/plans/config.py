"""Settings of the engine as frozen dataclasses; loaded from a mapping with environment overrides."""

from __future__ import annotations

import os
import warnings
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Detection:
    """Thresholds of a usable text layer."""

    min_chars: int = 200
    min_alpha_ratio: float = 0.45
    max_replacement_ratio: float = 0.02
    max_word_length: float = 35.0


@dataclass(frozen=True)
class Chunking:
    """Sizes of the greedy packer, in characters."""

    target: int = 1200
    overlap: int = 150
    minimum: int = 250
    version: str = "v2"
    strict_page_boundaries: bool = False


@dataclass(frozen=True)
class Retrieval:
    """Hybrid search: size of the answer, weight of the vector side, constants of BM25 and of rank fusion."""

    top_k: int = 12
    alpha: float = 0.65
    k1: float = 1.2
    b: float = 0.75
    rrf: int = 60

    def __post_init__(self) -> None:
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha must lie between 0 and 1")


@dataclass(frozen=True)
class Queue:
    """Limits and time-outs of the ingest queue, in bytes and seconds."""

    max_active: int = 20
    storage_bytes: int = 1 << 30
    upload_bytes: int = 250 << 20
    reservation_ttl: int = 3600
    failed_upload_ttl: int = 7 * 86400
    retry_after: int = 10
    stale_after: int = 15
    orphan_identity_ttl: int = 300
    direct_identity_ttl: int = 86400


@dataclass(frozen=True)
class Settings:
    detection: Detection = field(default_factory=Detection)
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    queue: Queue = field(default_factory=Queue)


def _merged(base: Any, over: Mapping[str, Any]) -> Any:
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    if unknown := set(over) - set(known):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(base, **{k: _merged(known[k], v) if is_dataclass(known[k]) else type(known[k])(v) if known[k] is not None else v for k, v in over.items()})


def load_settings(values: Mapping[str, Any] | None = None, environment: Mapping[str, str] | None = None, prefix: str = "FOLIOFORGE_") -> Settings:
    """Defaults, then ``values`` (nested), then variables like FOLIOFORGE_CHUNKING__TARGET."""
    out = _merged(Settings(), values or {})
    for key, value in sorted((os.environ if environment is None else environment).items()):
        if key.startswith(prefix) and "__" in key:
            section, _, name = key[len(prefix) :].lower().partition("__")
            out = _merged(out, {section: {name: value}})
    return out


#: Names of sections and settings in older files, and what they are called now.
RENAMED = {"chunks": "chunking", "search": "retrieval", "jobs": "queue", "target_chars": "target", "overlap_chars": "overlap", "min_chars_per_chunk": "minimum"}


def migrated(values: Mapping[str, Any]) -> dict[str, Any]:
    """Settings of an older file under their present names; a name given in both forms is an error."""
    out: dict[str, Any] = {}
    for key, value in values.items():
        name = RENAMED.get(key, key)
        if name in out:
            raise ValueError(f"{name} is given twice, once as {key}")
        if name != key:
            warnings.warn(f"setting {key} is now called {name}", stacklevel=2)
        out[name] = migrated(value) if isinstance(value, Mapping) else value
    return out


def read_env_file(path: Path) -> dict[str, str]:
    """Variables of a file of NAME=value lines; comments and blank lines are skipped, quotes around a value dropped."""
    out = {}
    for line in path.read_text(encoding="utf-8").splitlines() if path.exists() else []:
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def read_settings(path: Path | None = None, env_file: Path | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """Settings of a YAML file (older names are understood), then of an env file, then of the environment; a missing file is an empty one."""
    import yaml

    values = (yaml.safe_load(path.read_text(encoding="utf-8")) or {}) if path and path.exists() else {}
    if not isinstance(values, Mapping):
        raise ValueError(f"{path} holds no settings")
    own = os.environ if environment is None else environment
    return load_settings(migrated(values), {**(read_env_file(env_file) if env_file else {}), **own})


def write_settings(path: Path, settings: Settings | None = None, overwrite: bool = False) -> Path:
    """Writes settings as YAML; a file that is there stays unless ``overwrite``."""
    import yaml

    if overwrite or not path.exists():
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(yaml.safe_dump(asdict(settings or Settings()), sort_keys=False), encoding="utf-8")
    return path
