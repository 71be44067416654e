"""Donations that were not returned, by event or by refund, in any spelling of the donation's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the events, fields that name the donation, and what may stand before its message id there.
DONATION, RETURN = "donation", "donation_return"
FIELDS = ("original_donation_id", "original_gift_external_id")
SPELLINGS = ("", "gift:", "donation:", "donation:_event:")


def said(column: str, field: str) -> Column:
    return F.get_json_object(column, f"$.{field}")


def returned(events: DataFrame, gifts: DataFrame) -> DataFrame:
    """(profile_id, source_id, ref): what return events and refunds, which are gifts below zero or marked so, name as the donation."""
    refs = lambda column: F.explode(F.array_compact(F.array(*[said(column, f) for f in FIELDS]))).alias("ref")
    by_event = events.filter(F.col("name") == RETURN).select("profile_id", "source_id", refs("properties"))
    refund = (F.col("amount") < 0) | (said("attributes", "is_refund") == "true")
    return by_event.unionByName(gifts.filter(refund).select("profile_id", "source_id", refs("attributes"))).distinct()


def unreturned(events: DataFrame, gifts: DataFrame) -> DataFrame:
    """Donation events that aren't marked as refunds and that no return of the same person and source names. A return whose reference is unknown takes nothing back. One row of each event goes to the join a spelling, so a person with very many is spread by their ids."""
    given = events.filter((F.col("name") == DONATION) & (F.coalesce(said("properties", "is_refund"), F.lit("false")) != "true"))
    spelled = given.select("id", "profile_id", "source_id", F.explode(F.array(*[F.concat(F.lit(s), F.col("message_id")) for s in SPELLINGS])).alias("ref"))
    back = spelled.join(returned(events, gifts), ["profile_id", "source_id", "ref"]).select("id").distinct()
    return given.join(back, "id", "left_anti")


def last_donation(profiles: DataFrame, events: DataFrame, gifts: DataFrame) -> DataFrame:
    """(profile_id, last_donation_at) of every profile, null without a donation that stands."""
    latest = unreturned(events, gifts).groupBy("profile_id").agg(F.max("occurred_at").alias("last_donation_at"))
    return profiles.select("profile_id").join(latest, "profile_id", "left")
