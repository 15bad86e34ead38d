"""Where a tool's own folders are, from its environment."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import PurePosixPath
from typing import NamedTuple

TOOL = "silt"
NATIVE = {
    "macos": {"cache": "Library/Caches", "config": "Library/Application Support", "state": "Library/Logs"},
    "linux": {"cache": ".cache", "config": ".config", "state": ".local/state"},
}


class Folders(NamedTuple):
    cache: str
    config: str
    state: str
    store: str
    logs: str


def folders(env: Mapping[str, str], system: str = "linux") -> Folders:
    """Folders by the environment; a variable that is set but empty counts as unset."""
    home = PurePosixPath(env.get("HOME") or "/")
    native = NATIVE.get(system, NATIVE["linux"])
    found = {k: PurePosixPath(env.get(f"XDG_{k.upper()}_HOME") or home / native[k]) for k in ("cache", "config", "state")}
    store = env.get(f"{TOOL.upper()}_STORE") or found["cache"] / TOOL / "runs"
    logs = env.get(f"{TOOL.upper()}_LOG_DIR") or found["state"] / TOOL / "logs"
    return Folders(*(str(found[k]) for k in ("cache", "config", "state")), str(store), str(logs))
