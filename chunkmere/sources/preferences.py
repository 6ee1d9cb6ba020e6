"""Client options of repositories (D10, S22, K19, H5): a JSON list in the repository's own folder."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

from .repository import OWN_FOLDER


@dataclass
class Preference:
    """Where and how one repository is backed up."""

    name: str
    id: str
    storage: str
    encrypted: bool = False
    no_backup: bool = False
    no_restore: bool = False
    nobackup_file: str = ""
    exclude_by_attribute: bool = False
    filters: str = ""
    keys: dict[str, str] = field(default_factory=dict)


def _folder(repository: str) -> str:
    """The folder of the options; a file of that name points to it."""
    own = os.path.join(repository, OWN_FOLDER)
    if os.path.isfile(own):
        with open(own, encoding="utf-8") as f:
            return f.read().strip()
    return own


def load(repository: str) -> list[Preference]:
    path = os.path.join(_folder(repository), "preferences")
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return [Preference(**p) for p in json.load(f)]


def save(repository: str, preferences: list[Preference]) -> None:
    """All at once: a half-written file is never seen."""
    folder = _folder(repository)
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "preferences")
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump([asdict(p) for p in preferences], f, indent=1)
    os.replace(f"{path}.part", path)


def find(preferences: list[Preference], wanted: str = "") -> Preference | None:
    """By name or storage URL; the first without either."""
    if not wanted:
        return preferences[0] if preferences else None
    return next((p for p in preferences if wanted in (p.name, p.storage)), None)


def put(repository: str, preference: Preference) -> list[Preference]:
    """Add an option set, or replace that of the same name (init, add, set)."""
    held = load(repository)
    at = next((i for i, p in enumerate(held) if p.name == preference.name), len(held))
    held[at : at + 1] = [preference]
    save(repository, held)
    return held
