"""Five-field schedules: lists, ranges, steps; days of month and week are alternatives when both are set."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

BOUNDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def parse(text: str) -> tuple[list[set[int]], bool, bool]:
    """Sets of minutes, hours, days, months and weekdays (0 is Sunday), and whether days and weekdays are restricted."""
    fields = text.split()
    if len(fields) != 5:
        raise ValueError("expected five fields")
    out = []
    for part, (low, high) in zip(fields, BOUNDS):
        values: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            first, _, last = span.partition("-")
            try:
                a, b = (low, high) if span == "*" else (int(first), int(last) if last else high if step else int(first))
                by = int(step) if step else 1
            except ValueError:
                raise ValueError(f"{item!r} can't be read") from None
            if not low <= a <= b <= high or by < 1:
                raise ValueError(f"{item!r} is out of range")
            values.update(range(a, b + 1, by))
        out.append({v % 7 for v in values} if high == 7 else values)
    return out, fields[2] != "*", fields[4] != "*"


def matches(text: str, at: dt.datetime) -> bool:
    (minutes, hours, days, months, weekdays), by_day, by_week = parse(text)
    if at.minute not in minutes or at.hour not in hours or at.month not in months:
        return False
    day, week = at.day in days, (at.weekday() + 1) % 7 in weekdays
    return (day or week) if by_day and by_week else day and week


def next_run(text: str, after: dt.datetime, zone: str = "UTC", years: int = 5) -> dt.datetime | None:
    """The next instant (UTC) whose wall time in the zone matches. Steps run over instants, so skipped wall times don't match and repeated ones match once."""
    tz, minute = ZoneInfo(zone), dt.timedelta(minutes=1)
    at = after.astimezone(dt.timezone.utc).replace(second=0, microsecond=0) + minute
    (minutes, hours, *_), _, _ = parse(text)
    end = at + dt.timedelta(days=366 * years)
    while at < end:
        wall = at.astimezone(tz)
        if not matches(f"* * {' '.join(text.split()[2:])}", wall):
            at = (wall.replace(hour=0, minute=0, fold=0) + dt.timedelta(days=1)).astimezone(dt.timezone.utc)
        elif wall.hour not in hours:
            at += dt.timedelta(minutes=60 - wall.minute)
        elif wall.minute in minutes and not wall.fold:
            return at
        else:
            at += minute
    return None
