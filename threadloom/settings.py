"""Parameters of a run, passed to operators; nothing is read from the session but the shared folder."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """Every field must be given: a setting that is missing is an error, never a silent default."""

    confidence: float
    batch_size: int
    max_chars: int
    max_private: int
    window_days: int
    pairs_per_entity: int
    event_days: int
    per_type: int
    seed: int


def load(path: str | Path, section: str = "run") -> Settings:
    found = tomllib.loads(Path(path).read_text(encoding="utf-8")).get(section, {})
    names = {f.name for f in fields(Settings)}
    if problems := sorted(names ^ set(found)):
        raise KeyError(f"settings missing or unknown: {', '.join(problems)}")
    return Settings(**found)


def filled(template: str, **values: str) -> str:
    """The template with its {placeholders} filled; names on both sides must be the same."""
    import string

    wanted = {name for _, name, _, _ in string.Formatter().parse(template) if name}
    if wanted != set(values):
        raise KeyError(f"placeholders differ: {sorted(wanted ^ set(values))}")
    return template.format(**values)


def rolling(prompts: Sequence[str], ask, openings: int = 8) -> Iterator[tuple[str, list[str]]]:
    """Groups of `openings` prompts, each asked with the openings that the groups before it gave: sequential by nature."""
    used: list[str] = []
    for i in range(0, len(prompts), openings):
        replies = [ask(p, tuple(used)) for p in prompts[i : i + openings]]
        used += [" ".join(r.split()[:5]) for r in replies]
        yield from ((r, list(used)) for r in replies)
