"""Relative ages such as '5min' or '1h30min' (F3)."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

# Accepted unit names and shortcuts; months and years are 30 and 365 days.
UNITS = {
    "seconds": timedelta(seconds=1),
    "s": timedelta(seconds=1),
    "minutes": timedelta(minutes=1),
    "min": timedelta(minutes=1),
    "hours": timedelta(hours=1),
    "h": timedelta(hours=1),
    "days": timedelta(days=1),
    "d": timedelta(days=1),
    "weeks": timedelta(weeks=1),
    "w": timedelta(weeks=1),
    "months": timedelta(days=30),
    "mon": timedelta(days=30),
    "years": timedelta(days=365),
    "y": timedelta(days=365),
}
SAME_UNIT = {"s": "seconds", "min": "minutes", "h": "hours", "d": "days", "w": "weeks", "mon": "days", "months": "days", "y": "days", "years": "days"}


def parse_age(text: str) -> timedelta:
    """Sum of count-unit pairs; a unit may appear once (months and years count as days)."""
    pieces = re.findall(r"(\d+)([a-z]+)", text)
    if not pieces or "".join(n + u for n, u in pieces) != text:
        raise ValueError(f"not a time span: {text!r}")
    total, seen = timedelta(), set()
    for count, unit in pieces:
        if unit not in UNITS:
            raise ValueError(f"unknown time unit {unit!r}; known: {', '.join(sorted(UNITS))}")
        base = SAME_UNIT.get(unit, unit)
        if base in seen:
            raise ValueError(f"time unit {base} given twice in {text!r}")
        seen.add(base)
        total += int(count) * UNITS[unit]
    return total


def age_bounds(now: datetime, min_age: str | None = None, max_age: str | None = None) -> tuple[datetime | None, datetime | None]:
    """Update window [min_update, max_update) against one `now`: max_age bounds below, min_age above."""
    return (now - parse_age(max_age) if max_age else None, now - parse_age(min_age) if min_age else None)
