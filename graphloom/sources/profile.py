"""Project profile: which languages and frameworks a project has, and where it is."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Profile:
    languages: tuple[str, ...] = ()
    frameworks: tuple[str, ...] = ()
    project_root: str = "."

    def root(self, base: str | Path) -> Path:
        """The project's folder: absolute as it is, else below base."""
        p = Path(self.project_root)
        return p if p.is_absolute() else (Path(base) / p).resolve()


def load_profile(path: str | Path) -> Profile | None:
    """None where there is no readable profile."""
    try:
        raw = json.loads(Path(path).read_text("utf-8"))
        return Profile(tuple(raw.get("languages") or ()), tuple(raw.get("frameworks") or ()), raw.get("project_root") or ".")
    except (OSError, ValueError, AttributeError):
        return None


def check_profile(profile: Profile, languages: frozenset[str], frameworks: frozenset[str]) -> list[str]:
    """What a profile names that isn't there."""
    return [f"unknown language {x}" for x in profile.languages if x not in languages] + [f"unknown framework {x}" for x in profile.frameworks if x not in frameworks]
