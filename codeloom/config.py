"""Small files of a workspace and its user: credentials, the answer of an
update check, rules, and the server entry in a client's settings."""

from __future__ import annotations

import json
import os

from .operators.guard import rules_file

#: Seconds for which the answer of an update check holds.
UPDATE_TTL = 12 * 3600


def _read(path: str) -> dict:
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def _write(path: str, value: dict, private: bool = False) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600 if private else 0o644), "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2)


def load_credentials(path: str) -> dict | None:
    """org_id and token, or none if the file lacks either or can't be read."""
    found = _read(path)
    return found if found.get("org_id") and found.get("token") else None


def save_credentials(path: str, org_id: str, token: str) -> None:
    _write(path, {"org_id": org_id, "token": token}, private=True)


def clear_credentials(path: str) -> bool:
    try:
        os.remove(path)
    except FileNotFoundError:
        return False
    return True


def newest_version(path: str, now_s: int, ask) -> str | None:
    """The newest version: of the cached answer while it holds, else of
    ``ask()``, which is then cached; none if it fails."""
    held = _read(path)
    at = held.get("checked_at")
    if isinstance(at, int) and 0 <= now_s - at < UPDATE_TTL:
        return held.get("version")
    try:
        version = ask()
    except OSError:
        return None
    _write(path, {"checked_at": now_s, "version": version})
    return version


def add_server(path: str, name: str, command: list[str]) -> bool:
    """Put a server into a client's settings; its other keys stay.  False if it
    was there as it is."""
    settings = _read(path)
    servers = settings.get("mcpServers") if isinstance(settings.get("mcpServers"), dict) else {}
    entry = {"command": command[0], "args": command[1:]}
    if servers.get(name) == entry:
        return False
    _write(path, {**settings, "mcpServers": {**servers, name: entry}})
    return True


def write_rules(path: str, preset: str | None) -> bool:
    """Write a preset's rules where there are none yet."""
    if os.path.exists(path):
        return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(rules_file(preset))
    return True
