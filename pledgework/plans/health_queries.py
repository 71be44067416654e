"""Operational queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pledgework.operators import health as H
from pledgework.plans.registry import query


@query("records_per_day", "SELECT updated_at AS day, count(*) AS rows FROM source_records WHERE updated_at BETWEEN DATE '2000-01-01' AND DATE '2000-03-31' GROUP BY 1")
def _(v):
    return H.per_day(v.source_records, "updated_at", dt.date(2000, 1, 1), dt.date(2000, 3, 31))


@query("open_issues", "SELECT CASE WHEN email IS NULL THEN 'no_email' ELSE 'unresolved' END AS kind, count(*) AS open FROM source_records WHERE NOT resolved AND id % 4 <> 0 GROUP BY 1")
def _(v):
    issues = v.source_records.filter("NOT resolved").select("id", F.when(F.col("email").isNull(), "no_email").otherwise("unresolved").alias("kind"))
    return H.open_issues(issues, v.source_records.filter("id % 4 = 0"))


@query("data_health", "SELECT count(*) AS records, count(*) FILTER (WHERE profile_id IS NULL) AS unattached, count(*) FILTER (WHERE NOT resolved) AS unresolved, max(updated_at) AS newest FROM source_records")
def _(v):
    return H.summary(v.source_records)


@query("audit_page", "SELECT id, name, day FROM events_in WHERE name = 'error' AND id < 700 ORDER BY id DESC LIMIT 50")
def _(v):
    return H.audit_page(v.events_in.select("id", "name", "day"), 700, 50, name="error")


@query("ad_results", "SELECT day, concat('set', source_id) AS ad_set, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DECIMAL(18,2)) AS spend, max(profile_id) AS reach, CAST(sum(CASE WHEN name = 'purchase' THEN id % 7 WHEN name = 'signup' THEN id % 5 END) AS BIGINT) AS results FROM events_in GROUP BY 1, 2")
def _(v):
    rows = v.events_in.select("day", F.concat(F.lit("set"), F.col("source_id").cast("string")).alias("ad_set"), F.col("value").cast("decimal(14,2)").alias("spend"), F.col("profile_id").alias("reach"), F.array(F.struct(F.col("name").alias("type"), F.when(F.col("name") == "purchase", F.col("id") % 7).otherwise(F.col("id") % 5).alias("value"))).alias("actions"))
    return H.ad_results(rows, ("purchase", "signup")).withColumn("spend", F.col("spend").cast("decimal(18,2)"))
