"""Small JSON and TOML documents of the driver: manifests, health reports, settings."""

from __future__ import annotations

import hashlib
import json
import os
import tomllib
from collections.abc import Callable
from contextlib import contextmanager
from copy import deepcopy
from pathlib import Path
from typing import Any


class DocumentError(ValueError):
    """A document that cannot be read or written."""


def load_json(path: Path) -> dict[str, Any]:
    try:
        got = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise DocumentError(f"{path}: {e}") from e
    if not isinstance(got, dict):
        raise DocumentError(f"{path}: not an object")
    return got


def load_toml(path: Path) -> dict[str, Any]:
    try:
        return tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise DocumentError(f"{path}: {e}") from e


def merge(base: dict[str, Any], *layers: dict[str, Any]) -> dict[str, Any]:
    """Later layers win, table by table."""
    out = deepcopy(base)
    for layer in layers:
        for k, v in layer.items():
            out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def from_environment(prefix: str, environ: dict[str, str] | None = None) -> dict[str, Any]:
    """Settings of variables PREFIX_TABLE__KEY=value; values are JSON where they parse."""
    out: dict[str, Any] = {}
    for name, text in sorted((os.environ if environ is None else environ).items()):
        if not name.startswith(prefix + "_"):
            continue
        *path, last = name[len(prefix) + 1 :].lower().split("__")
        at = out
        for p in path:
            at = at.setdefault(p, {})
            if not isinstance(at, dict):
                raise DocumentError(f"{name}: {p} is a value already")
        try:
            at[last] = json.loads(text)
        except ValueError:
            at[last] = text
    return out


def layered(defaults: dict[str, Any], user: Path | None = None, environment: dict[str, Any] | None = None, flags: dict[str, Any] | None = None) -> dict[str, Any]:
    """Settings by precedence: flags over environment over the user's TOML over defaults.
    A flag that was not given (None) overrides nothing."""
    given = {k: v for k, v in (flags or {}).items() if v is not None}
    return merge(defaults, load_toml(user) if user is not None and user.exists() else {}, environment or {}, given)


def checksum(doc: dict[str, Any]) -> str:
    return hashlib.sha256(json.dumps(doc, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def save_json(path: Path, doc: dict[str, Any]) -> bool:
    """Atomic; does nothing, and says so, where the content is the same."""
    if path.exists() and checksum(load_json(path)) == checksum(doc):
        return False
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(path.suffix + ".new")
    new.write_text(json.dumps(doc, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    os.replace(new, path)
    return True


def backup(path: Path, keep: int = 5, stamp: str = "") -> Path | None:
    """A copy beside the document; the newest `keep` copies stay."""
    if not path.exists():
        return None
    copies = sorted(path.parent.glob(path.name + ".bak.*"), key=lambda p: (p.stat().st_mtime_ns, p.name))
    target = path.with_name(f"{path.name}.bak.{stamp or f'{len(copies):06d}-{checksum(load_json(path))[:8]}'}")
    target.write_bytes(path.read_bytes())
    copies = [c for c in copies if c != target] + [target]
    for old in copies[: max(0, len(copies) - keep)]:
        old.unlink()
    return target


@contextmanager
def transaction(path: Path, on_commit: list[Callable[[], None]] | None = None, on_rollback: list[Callable[[], None]] | None = None):
    """Edit a document in place; it is saved at the end, or left as it was on an error."""
    doc = load_json(path) if path.exists() else {}
    edited = deepcopy(doc)
    try:
        yield edited
        save_json(path, edited)
    except BaseException:
        for f in on_rollback or []:
            f()
        raise
    for f in on_commit or []:
        f()


def migrate_manifest(doc: dict[str, Any], version: int = 1) -> dict[str, Any]:
    """Top-level source fields move below modules.source; unknown keys stay."""
    out = deepcopy(doc)
    modules = out.setdefault("modules", {})
    for k in ("name", "path", "enabled", "target", "last_refresh_at", "last_health"):
        if k in out:
            modules.setdefault("source", {}).setdefault(k, out.pop(k))
    modules.setdefault("db", {})
    out["modules_version"] = max(version, int(out.get("modules_version", 0)))
    return out
