"""The window that a scheduled feed is due for, and a report's date range with the one before it."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

MOST_DAYS = 3660


def feed_window(every: str, now: dt.datetime, day: int = 1, hour: int = 0, minute: int = 0, zone: str = "America/New_York") -> str | None:
    """a token that is the same for all runs of one window, null before the window's time; manual feeds have none."""
    at = now.astimezone(ZoneInfo(zone))
    if every == "hourly":
        return f"{at:%Y-%m-%dT%H%z}"
    due = (at.hour, at.minute) >= (hour, minute)
    if every == "daily":
        return f"{at:%Y-%m-%d}" if due else None
    return f"{at:%Y-%m}" if every == "monthly" and due and at.day >= day else None


def report_range(today: dt.date, first: dt.date | None = None, last: dt.date | None = None) -> tuple[dt.date, dt.date, dt.date, dt.date]:
    """(first, last, first and last of the range of equal length before); twelve months up to today unless given."""
    last = last or today
    if first is None:
        leap = last.month == 2 and last.day == 29
        first = last.replace(year=last.year - 1, day=28 if leap else last.day) + dt.timedelta(days=1)
    if last < first or (last - first).days > MOST_DAYS:
        raise ValueError(f"a range has 1 to {MOST_DAYS + 1} days")
    before = first - dt.timedelta(days=1)
    return first, last, before - (last - first), before
