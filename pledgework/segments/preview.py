"""How many people an audience has, within a few seconds: the exact number, or an estimate and its interval."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgework.operators.generations import DeadlineExceeded, within

SECONDS = 10.0
#: Of 4096 equal parts of the people, those that an estimate looks at; and the normal quantile of its interval.
PARTS, LOOKED_AT, QUANTILE = 4096, 64, 1.96


@dataclass(frozen=True)
class Preview:
    count: int
    low: int
    high: int
    exact: bool
    seconds: float


def sampled(key: Column, parts: int = LOOKED_AT) -> Column:
    """Whether a person is among the first parts by digest of the id. It reads the key only, so the optimiser moves it to the scans of every table that is joined or grouped by the key: people and facts outside the sample are dropped before any shuffle."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 3), 16, 10).cast("int") < parts


def estimated(hits: int, parts: int = LOOKED_AT) -> tuple[int, int, int]:
    """(estimate, low, high) of the whole by those found among the parts; a Wilson-like interval of a thinned count, wide even for none."""
    share = parts / PARTS
    middle, half = hits + QUANTILE**2 / 2, QUANTILE * math.sqrt(hits * (1 - share) + QUANTILE**2 / 4)
    return round(hits / share), max(hits, math.floor((middle - half) / share)), math.ceil((middle + half) / share)


def preview(members: DataFrame, key: str = "profile_id", seconds: float = SECONDS) -> Preview:
    """The number of rows of an audience. Exact if it is known in time, else its jobs are stopped and a sample of the people is counted, in as much time again; other jobs of the session go on. If that is not enough either, DeadlineExceeded is raised."""
    spark, began = members.sparkSession, time.monotonic()
    try:
        n = within(spark, seconds, members.count)
        return Preview(n, n, n, True, time.monotonic() - began)
    except DeadlineExceeded:
        hits = within(spark, seconds, members.filter(sampled(F.col(key))).count)
        return Preview(*estimated(hits), False, time.monotonic() - began)
