"""Query parameters: the dashboard's global filters.

``time_range`` holds two *dates* (hazard: a time of day on ``max`` would
shift the half-open bound used for runs).  ``bu`` and ``env`` are lists of
choices where ``"All"`` switches the filter off; an empty list keeps nothing.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

ALL = "All"
UNMAPPED = "Unmapped"


def _as_date(value) -> dt.date:
    if isinstance(value, dt.datetime):
        raise TypeError("time range bounds are dates, not timestamps")
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(str(value))


@dataclass(frozen=True)
class TimeRange:
    """Inclusive range of calendar days ``[min, max]``."""

    min: dt.date
    max: dt.date

    def __post_init__(self):
        object.__setattr__(self, "min", _as_date(self.min))
        object.__setattr__(self, "max", _as_date(self.max))
        if self.max < self.min:
            raise ValueError(f"empty time range {self.min} > {self.max}")

    @property
    def end_exclusive(self) -> dt.date:
        """First day after the range: runs use ``ts < max + 1 day``."""
        return self.max + dt.timedelta(days=1)


def _choices(values) -> tuple[str, ...]:
    if isinstance(values, str):
        values = [values]
    out = tuple(values)
    for v in out:
        # A NULL inside the choice list makes array_contains NULL in Spark and
        # false elsewhere; refuse it instead of picking one meaning.
        if v is None or not isinstance(v, str):
            raise ValueError(f"filter choices must be non-null strings, got {v!r}")
    return out


@dataclass(frozen=True)
class Params:
    time_range: TimeRange
    bu: tuple[str, ...] = field(default=(ALL,))
    env: tuple[str, ...] = field(default=(ALL,))

    def __post_init__(self):
        if not isinstance(self.time_range, TimeRange):
            object.__setattr__(self, "time_range", TimeRange(*self.time_range))
        object.__setattr__(self, "bu", _choices(self.bu))
        object.__setattr__(self, "env", _choices(self.env))

    def with_(self, **changes) -> "Params":
        values = {"time_range": self.time_range, "bu": self.bu, "env": self.env}
        values.update(changes)
        return Params(**values)
