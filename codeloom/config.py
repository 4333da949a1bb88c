"""Settings, resolved from defaults, files and overrides (O-203)."""

from __future__ import annotations

import json
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from codeloom.plans.research import PRESETS
from codeloom.schemas import LANGUAGES
from codeloom.sources.trees import EXCLUDED, MAX_SIZE


@dataclass(frozen=True)
class Config:
    """Immutable, so that an override for one call never changes the others."""

    languages: tuple[str, ...] = LANGUAGES
    excluded: tuple[str, ...] = EXCLUDED
    max_file_size: int = MAX_SIZE
    class_split_lines: int = 100
    search_limit: int = 10
    context_chunks: int = 5
    max_file_docs: int = 500
    cache_ttl_seconds: int = 604_800
    cache_entries: int = 10_000
    cache_threshold: float = 0.95
    cache_temperature: float = 0.3
    debounce: str = "2 seconds"
    stale_days: int = 0
    preset: str = "default"
    embedding: str = "hash"
    generator: str = "echo"
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        unknown = set(self.languages) - set(LANGUAGES)
        if unknown or self.preset not in PRESETS or not 0 <= self.cache_threshold <= 1 or self.max_file_size <= 0:
            raise ValueError(f"not a valid configuration: {sorted(unknown)} {self.preset} {self.cache_threshold} {self.max_file_size}")

    @property
    def research(self) -> tuple[int, int]:
        """Chunks in all and per question."""
        return PRESETS[self.preset]


_override: ContextVar[Config | None] = ContextVar("config", default=None)
_global: list[Config] = []


def from_mapping(values: dict, base: Config | None = None) -> Config:
    """Known keys over a base; unknown ones are kept in ``extra``."""
    base = base or Config()
    known = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items() if k in asdict(base) and k != "extra"}
    return replace(base, **known, extra={k: v for k, v in values.items() if k not in asdict(base)})


def load(*places: str) -> Config:
    """The first of some JSON files that exists, over the defaults; the defaults if none does."""
    for p in map(Path, places):
        if p.is_file():
            return from_mapping(json.loads(p.read_text(encoding="utf-8")))
    return Config()


def set_global(config: Config | None) -> None:
    _global[:] = [config] if config else []


def current(*places: str) -> Config:
    """The override of the context, else the global one, else that of the files, else the defaults."""
    return _override.get() or (_global[0] if _global else load(*places))


@contextmanager
def override(**values):
    token = _override.set(from_mapping(values, current()))
    try:
        yield _override.get()
    finally:
        _override.reset(token)
