"""Times given as text: RFC 3339, now, "<n>h ago" and "<n>d ago", and signed durations such as -2h30m."""

from __future__ import annotations

import re
from datetime import UTC, datetime, timedelta

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)")
_RFC = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)")


def duration(text: str) -> timedelta:
    """A signed sum of numbers with units; 0 needs none."""
    sign, rest = (-1, text[1:]) if text[:1] == "-" else (1, text.removeprefix("+"))
    if rest == "0":
        return timedelta()
    parts = _PART.findall(rest)
    if not parts or "".join(a + b for a, b in parts) != rest:
        raise ValueError(f"no duration: {text}")
    return timedelta(seconds=sign * sum(float(a) * _UNITS[b] for a, b in parts))


def parse_time(text: str, now: datetime | None = None) -> datetime:
    """The time in UTC, without a zone, as the engine's columns are."""
    now = now or datetime.now(UTC).replace(tzinfo=None)
    if _RFC.fullmatch(text):
        return datetime.fromisoformat(text).astimezone(UTC).replace(tzinfo=None)
    if text == "now":
        return now
    if m := re.fullmatch(r"(\d+)([hd]) ago", text):
        return now - timedelta(**{"hours" if m[2] == "h" else "days": int(m[1])})
    try:
        return now + duration(text)
    except ValueError:
        raise ValueError(f"unrecognized time format: {text}") from None


def parse_range(start: str | None, end: str | None, now: datetime | None = None) -> tuple[datetime | None, datetime | None]:
    first, last = (parse_time(x, now) if x else None for x in (start, end))
    if first and last and first > last:
        raise ValueError("start is after end")
    return first, last
