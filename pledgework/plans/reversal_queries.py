"""Queries of reversed merges, device links and the event tail."""

from __future__ import annotations

from pyspark.sql import functions as F

from pledgework.operators import reversal as R
from pledgework.plans.registry import query
from pledgework.sources.adapter import AS_OF
from pledgework.streaming import devices as D


def merges(v):
    return v.merges.select(F.col("loser_id").alias("merge_id"), "winner_id", "loser_id", F.lit(None).cast("date").alias("undone_at"))


def gifts(v):
    return v.gifts.select("id", "profile_id", F.col("amount").alias("stamp"))


def merged(v):
    """Gifts as they are after the merges."""
    to = v.merges.select(F.col("loser_id").alias("profile_id"), "winner_id")
    return gifts(v).join(to, "profile_id", "left").select("id", F.coalesce("winner_id", "profile_id").alias("profile_id"), "stamp")


@query("unmerge_refusals", "SELECT m.loser_id AS merge_id, CASE WHEN w.is_deleted OR l.is_deleted THEN 'erased' WHEN EXISTS (SELECT 1 FROM gifts g WHERE g.profile_id IN (m.loser_id, m.winner_id) AND g.amount > 480000) THEN 'changed' END AS reason FROM merges m JOIN all_profiles w ON w.id = m.winner_id JOIN all_profiles l ON l.id = m.loser_id")
def _(v):
    # since the merge, large gifts were altered
    now = merged(v).withColumn("stamp", F.when(F.col("stamp") > 480000, F.col("stamp") - 1).otherwise(F.col("stamp")))
    return R.refusals(merges(v), R.record(merges(v), {"gift": gifts(v)}), {"gift": now}, v.all_profiles)


@query("unmerge_repoint", """WITH a AS (SELECT profile_id, updated_at, id FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY updated_at, id) AS n FROM source_records WHERE profile_id IS NOT NULL) WHERE n = 1),
t AS (SELECT winner_id, loser_id, l.id IS NULL OR coalesce(w.updated_at < l.updated_at OR (w.updated_at = l.updated_at AND w.id <= l.id), false) AS kept, (SELECT max(id) FROM all_profiles) + row_number() OVER (ORDER BY loser_id) AS fresh FROM merges m LEFT JOIN a w ON w.profile_id = winner_id LEFT JOIN a l ON l.profile_id = loser_id)
SELECT g.id, coalesce(CASE WHEN g.profile_id = t.winner_id THEN CASE WHEN kept THEN t.winner_id ELSE fresh END WHEN g.profile_id = t.loser_id THEN CASE WHEN kept THEN fresh ELSE t.winner_id END END, g.profile_id) AS profile_id FROM gifts g LEFT JOIN t ON g.profile_id IN (t.winner_id, t.loser_id)""")
def _(v):
    m = merges(v)
    keys = R.ends(m).join(v.source_records.select("profile_id", F.col("updated_at").alias("first_seen"), "id"), "profile_id")
    top = v.all_profiles.agg(F.max("id")).first()[0] or 0
    to = R.targets(m, keys, top)
    return R.repointed(merged(v).drop("stamp"), "gift", R.record(m, {"gift": gifts(v)}), to)


@query("device_expiry", "SELECT 'device' AS key_type, device_key AS device_id, profile_id, min(seen_on) AS first_seen_at, max(seen_on) AS last_seen_at, max(seen_on) + 10 AS expires_at FROM devices WHERE seen_on > DATE '2001-08-01' - 10 GROUP BY ALL")
def _(v):
    seen = v.devices.select(F.lit("device").alias("key_type"), D.device_key(F.col("device_key"), F.lit(False)).alias("device_id"), "profile_id", F.lit(0).alias("source_id"), F.col("seen_on").alias("seen_at"))
    return D.linked(seen, AS_OF).drop("source_id")


@query("event_tail", "SELECT id, type, name, profile_id, occurred_at FROM events_in WHERE source_id = 1 ORDER BY id DESC LIMIT 50")
def _(v):
    return D.tail(v.events_in, 1)
