"""The catalogue of traits, how far each is filled, and a month's first computation."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgework.operators.traits import snapshot


@dataclass(frozen=True)
class Trait:
    key: str
    label: str
    type: str


#: Traits that users see, with their labels and types.
TRAITS = (
    Trait("gift_count_total", "Lifetime gift count", "int"),
    Trait("ltv_total", "Lifetime giving", "numeric"),
    Trait("gift_amount_12m", "Giving in the last 12 months", "numeric"),
    Trait("gift_count_12m", "Gifts in the last 12 months", "int"),
    Trait("first_gift_date", "First gift date", "date"),
    Trait("last_gift_date", "Last gift date", "date"),
    Trait("largest_gift_amount", "Largest gift", "numeric"),
    Trait("avg_gift_amount", "Average gift", "numeric"),
    Trait("is_recurring_active", "Active recurring donor", "bool"),
    Trait("days_since_last_gift", "Days since last gift", "int"),
    Trait("donor_status", "Donor status", "text"),
    Trait("rfm_recency", "RFM recency", "smallint"),
    Trait("rfm_frequency", "RFM frequency", "smallint"),
    Trait("rfm_monetary", "RFM monetary", "smallint"),
    Trait("rfm_score", "RFM score", "text"),
    Trait("event_count_30d", "Events in the last 30 days", "int"),
    Trait("last_event_at", "Last event time", "timestamptz"),
    Trait("video_views_30d", "Video views in the last 30 days", "int"),
    Trait("last_engagement_channel", "Last engagement channel", "text"),
    Trait("source_keys", "Source keys", "text[]"),
    Trait("computed_at", "Traits computed at", "timestamptz"),
)
BY_KEY = {t.key: t for t in TRAITS}


def coverage(traits: DataFrame) -> DataFrame:
    """The catalogue's entries that the table has, with the profiles of which each is filled; an empty list isn't. One aggregate over the table, then a row a trait."""
    kinds = dict(traits.dtypes)
    have = [t for t in TRAITS if t.key in kinds]
    filled = lambda k: F.size(k) > 0 if kinds[k].startswith("array") else F.col(k).isNotNull()
    counts = traits.agg(F.count("*").alias("_all"), *[F.count_if(filled(t.key)).alias(t.key) for t in have])
    rows = F.array(*[F.struct(F.lit(t.key).alias("key"), F.lit(t.label).alias("label"), F.lit(t.type).alias("type"), F.col(t.key).alias("filled"), F.col("_all").alias("profiles")) for t in have])
    return counts.select(F.inline(rows))


def to_compute(profiles: DataFrame, dirty: DataFrame, snapshots: DataFrame, as_of: dt.date) -> DataFrame:
    """profile_id of those to compute: the dirty ones, or all active ones while the month has no snapshot, as a month's snapshot is of everyone. Decided inside the plan, by a subquery of one row."""
    opened = snapshots.filter(F.col("month") == F.lit(as_of.replace(day=1))).exists()
    marked = dirty.select("profile_id").distinct().withColumn("_dirty", F.lit(True))
    return profiles.select(F.col("id").alias("profile_id")).join(marked, "profile_id", "left").filter(F.col("_dirty").isNotNull() | ~opened).select("profile_id")


def month_rows(traits: DataFrame, as_of: dt.date, snapshots: DataFrame, waiting: DataFrame) -> DataFrame:
    """The month's rows that aren't there yet; none while anything waits to be imported or resolved."""
    return snapshot(traits, as_of.replace(day=1), snapshots).filter(~waiting.exists())
