"""Value types of the public API."""

from __future__ import annotations

from dataclasses import dataclass

LONG, DOUBLE, BOOL = "long", "double", "bool"


class RuleError(ValueError):
    """A rule that cannot be defined: its text, names or types are wrong."""


@dataclass(frozen=True)
class Column:
    """A field of a record: 64-bit integer (``long``) or float (``double``)."""

    name: str
    kind: str = LONG

    def __post_init__(self):
        if self.kind not in (LONG, DOUBLE):
            raise RuleError(f"column {self.name}: long or double, not {self.kind}")


@dataclass(frozen=True)
class Tumbling:
    period_ms: int


@dataclass(frozen=True)
class Sliding:
    length_ms: int
    slide_ms: int


Window = Tumbling | Sliding | None


@dataclass(frozen=True)
class EngineConfig:
    """``window_rows``: how many of the latest rows of a record a rule sees;
    ``default_limit``: rows delivered where a rule has no LIMIT; ``chunk_rows``:
    arrivals that one task of an ordered scan takes."""

    window_rows: int = 2048
    default_limit: int = 10
    chunk_rows: int = 1 << 16
    map_literal_keys: int = 1000
    log_level: str = "INFO"


def bounds(window: Window) -> tuple[int, int]:
    """Length and slide of a window in milliseconds."""
    if isinstance(window, Tumbling):
        length = slide = window.period_ms
    elif isinstance(window, Sliding):
        length, slide = window.length_ms, window.slide_ms
    else:
        raise RuleError("a window aggregate needs a tumbling or a sliding window")
    if length <= 0 or slide <= 0:
        raise RuleError("window lengths and slides are positive")
    return length, slide
