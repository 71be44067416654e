"""Device links that expire, and the newest accepted events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ("key_type", "device_id", "profile_id")
DAYS = 10


def device_key(value: Column, is_uuid: Column) -> Column:
    """A device's key in its one form, null if it isn't one: a UUID other than zero with hyphens, or 1 to 256 plain characters."""
    hexes = F.regexp_replace(F.lower(F.trim(value)), r"^urn:|uuid:|[{}-]", "")
    uuid = F.concat_ws("-", *[F.substring(hexes, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    good = hexes.rlike("^[0-9a-f]{32}$") & (hexes != "0" * 32)
    return F.when(is_uuid, F.when(good, uuid)).otherwise(F.when(F.trim(value).rlike(r"^[A-Za-z0-9_.:-]{1,256}$"), F.trim(value)))


def sightings(events: DataFrame, uuids: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """(key_type, device_id, profile_id, source_id, seen_at) of events whose profile is known, from their JSON properties."""
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("key_type"), device_key(F.get_json_object("properties", f"$.{k}"), F.lit(k in uuids)).alias("device_id")) for k in (*uuids, *names)])).alias("d")
    rows = events.filter("profile_id IS NOT NULL").select("profile_id", "source_id", F.col("occurred_at").alias("seen_at"), made)
    return rows.select("d.key_type", "d.device_id", "profile_id", "source_id", "seen_at").filter("device_id IS NOT NULL")


def linked(seen: DataFrame, now, days: int = DAYS, links: DataFrame | None = None) -> DataFrame:
    """(KEY, source_id, first_seen_at, last_seen_at, expires_at) of links that are alive at now. links: those of earlier batches, into which seen goes; sightings that have expired already are left out. The source is that of the last sighting, ties by the larger id."""
    rows = seen.select(*KEY, "source_id", F.col("seen_at").alias("first_seen_at"), F.col("seen_at").alias("last_seen_at"))
    if links is not None:
        rows = rows.unionByName(links.select(*rows.columns))
    age = F.expr(f"INTERVAL {days} DAY")
    rows = rows.filter(F.col("last_seen_at") > F.lit(now) - age)
    out = rows.groupBy(*KEY).agg(F.max_by("source_id", F.struct("last_seen_at", "source_id")).alias("source_id"), F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    return out.withColumn("expires_at", F.col("last_seen_at") + age)


def tail(events: DataFrame, source_id: int, limit: int = 50, before: int | None = None) -> DataFrame:
    """The newest events of a source, those before an id for the next page; without payloads, which can hold contact data."""
    if not 1 <= limit <= 100:
        raise ValueError("a page has 1 to 100 events")
    rows = events.filter(F.col("source_id") == source_id)
    if before is not None:
        rows = rows.filter(F.col("id") < before)
    return rows.select("id", "type", "name", "profile_id", "occurred_at").orderBy(F.desc("id")).limit(limit)
