"""Operational reports: merges, open issues, data health, audit pages, advertising results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_day(rows: DataFrame, column: str, start: dt.date, end: dt.date) -> DataFrame:
    """D31."""
    return rows.filter(F.col(column).between(F.lit(start), F.lit(end))).groupBy(F.col(column).alias("day")).agg(F.count("*").alias("rows"))


def open_issues(issues: DataFrame, reviewed: DataFrame) -> DataFrame:
    """By kind, those that nobody reviewed."""
    return issues.join(reviewed.select("id").distinct(), "id", "left_anti").groupBy("kind").agg(F.count("*").alias("open"))


def summary(records: DataFrame) -> DataFrame:
    """One row of counts."""
    return records.agg(F.count("*").alias("records"), F.count_if(F.col("profile_id").isNull()).alias("unattached"), F.count_if(~F.col("resolved")).alias("unresolved"), F.max("updated_at").alias("newest"))


def audit_page(log: DataFrame, before_id: int | None, limit: int = 50, **equal) -> DataFrame:
    """Filters, newest first, from a key on."""
    for k, v in equal.items():
        log = log.filter(F.col(k) == v)
    return (log if before_id is None else log.filter(F.col("id") < before_id)).orderBy(F.desc("id")).limit(limit)


def ad_results(insights: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """Spend and reach by day and set, with the first action, in the given order, that the row reports. insights.actions: array of (type, value)."""
    def first(kind: str):
        return F.try_element_at(F.filter("actions", lambda a: a["type"] == kind), F.lit(1))["value"]

    found = F.coalesce(*[first(k) for k in actions])
    return insights.select("day", "ad_set", "spend", "reach", found.alias("results")).groupBy("day", "ad_set").agg(F.sum("spend").alias("spend"), F.max("reach").alias("reach"), F.sum("results").alias("results"))
