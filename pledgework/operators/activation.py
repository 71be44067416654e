"""Export sets: eligibility, households, funnel, projection, delta."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def judged(people: DataFrame, consents: DataFrame, suppressions: DataFrame, channel: str, required: tuple[str, ...]) -> DataFrame:
    """One row a person with the first reason against them, in order consent, suppressed, missing, household; null is eligible.

    One per household, the least id, is chosen among those who pass everything else.
    """
    said = consents.filter(F.col("channel") == channel).select("profile_id", F.col("status"))
    kinds = suppressions.groupBy("profile_id").agg(F.bool_or(F.col("type") == "deletion").alias("gone"), F.bool_or(F.col("type") == "email").alias("mail"))
    rows = people.join(said, "profile_id", "left").join(kinds, "profile_id", "left")
    stop = F.coalesce(F.col("gone"), F.lit(False)) | (F.lit(channel == "email") & F.coalesce(F.col("mail"), F.lit(False)))
    empty = F.lit(False)
    for c in required:
        empty = empty | (F.coalesce(F.trim(c), F.lit("")) == "")
    rows = rows.withColumn("reason", F.when(F.coalesce("status", F.lit("unknown")) != "opted_in", "consent").when(stop, "suppressed").when(empty, "missing"))
    home = F.coalesce("household_id", F.concat(F.lit("p"), F.col("profile_id").cast("string")))
    first = rows.filter("reason IS NULL").groupBy(home.alias("home")).agg(F.min("profile_id").alias("first"))
    out = rows.withColumn("home", home).join(first, "home", "left")
    return out.withColumn("reason", F.when(F.col("reason").isNull() & (F.col("profile_id") != F.col("first")), "household").otherwise(F.col("reason"))).drop("status", "gone", "mail", "first", "home")


def funnel(rows: DataFrame) -> DataFrame:
    """One pass of counts."""
    r = F.col("reason")
    return rows.agg(F.count("*").alias("selected"), *[F.count_if(r == x).alias(x) for x in ("consent", "suppressed", "missing", "household")], F.count_if(r.isNull()).alias("sent"))


def project(rows: DataFrame, mapping: dict[str, str | Column]) -> DataFrame:
    """Output name -> column, expression, or constant given as a Column; arrays become JSON."""
    cols = []
    for name, of in mapping.items():
        c = F.col(of) if isinstance(of, str) else of
        kind = rows.select(c.alias(name)).schema[0].dataType.typeName()
        cols.append((F.to_json(c) if kind in ("array", "map", "struct") else c).alias(name))
    return rows.select(*cols)


def enrichment_pivot(rows: DataFrame, keys: tuple[str, ...], as_of) -> DataFrame:
    """Unexpired values, the first typed one that is set, a column a key."""
    live = rows.filter(F.col("license_expires_at").isNull() | (F.col("license_expires_at") >= F.lit(as_of)))
    value = F.coalesce("value_text", F.col("value_num").cast("string"), F.col("value_date").cast("string"))
    return live.groupBy("profile_id").agg(*[F.max(F.when(F.col("attribute_key") == k, value)).alias(k) for k in keys])


def delta(work: DataFrame, last: DataFrame) -> DataFrame:
    """Added and removed members."""
    both = work.select("profile_id", F.lit(True).alias("now")).join(last.select("profile_id", F.lit(True).alias("was")), "profile_id", "full")
    return both.filter("now IS NULL OR was IS NULL").select("profile_id", F.when(F.col("was").isNull(), "added").otherwise("removed").alias("change"))
