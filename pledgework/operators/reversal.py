"""Merges taken back, many at once. Tables: merges (merge_id, winner_id, loser_id, undone_at); recorded (merge_id, side, kind, row_id, stamp), written before a merge.

Every step is a join or a group-by on the merge or the row, so a profile with very many rows is compared row by
row, never gathered. A merge that may not be reversed has a reason; callers pass only those without one on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgework.operators.traits import global_rank


def ends(merges: DataFrame) -> DataFrame:
    """(merge_id, side, profile_id): two rows a merge."""
    return merges.select("merge_id", F.explode(F.create_map(F.lit("winner"), "winner_id", F.lit("loser"), "loser_id")).alias("side", "profile_id"))


def rows_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(profile_id, kind, row_id, stamp) of tables (id, profile_id, stamp), by kind; the stamp may be null."""
    parts = [t.select("profile_id", F.lit(kind).alias("kind"), F.col("id").cast("string").alias("row_id"), F.col("stamp").cast("string").alias("stamp")) for kind, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def record(merges: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The rows of both sides, before the merge."""
    return ends(merges).join(rows_of(tables), "profile_id").select("merge_id", "side", "kind", "row_id", "stamp")


def refusals(merges: DataFrame, recorded: DataFrame, tables: dict[str, DataFrame], profiles: DataFrame) -> DataFrame:
    """(merge_id, reason) of every merge: undone, erased, merged (the winner, since), later_merge (the last goes first), changed (rows came, went or were altered), or null."""
    open_ = ends(merges.filter("undone_at IS NULL"))
    last = open_.groupBy("profile_id").agg(F.max("merge_id").alias("last"))
    later = open_.join(last, "profile_id").groupBy("merge_id").agg(F.bool_or(F.col("last") > F.col("merge_id")).alias("later"))
    who = profiles.select(F.col("id").alias("profile_id"), "merged_into_id", "is_deleted")
    state = ends(merges).join(who, "profile_id", "left").groupBy("merge_id").agg(F.bool_or(F.coalesce("is_deleted", F.lit(True))).alias("erased"), F.bool_or((F.col("side") == "winner") & F.col("merged_into_id").isNotNull()).alias("merged"))
    names = ("merge_id", "kind", "row_id", "stamp")
    was = recorded.select(*names, F.lit(1).alias("was"), F.lit(0).alias("still"))
    now = merges.join(rows_of(tables), F.col("winner_id") == F.col("profile_id")).select(*names, F.lit(0).alias("was"), F.lit(1).alias("still"))
    same = was.unionByName(now).groupBy(*names).agg(F.max("was").alias("was"), F.max("still").alias("still"))
    changed = same.groupBy("merge_id").agg(F.bool_or(F.col("was") != F.col("still")).alias("changed"))
    out = merges
    for part in (state, later, changed):
        out = out.join(part, "merge_id", "left")
    reason = F.when(F.col("undone_at").isNotNull(), "undone")
    for flag, name in (("erased", "erased"), ("merged", "merged"), ("later", "later_merge"), ("changed", "changed")):
        reason = reason.when(F.col(flag), name)
    return out.select("merge_id", reason.alias("reason"))


def targets(merges: DataFrame, keys: DataFrame, top: int) -> DataFrame:
    """(merge_id, side, profile_id): the side with the oldest recorded system key (merge_id, side, first_seen, id) keeps the profile, the other gets a new id after top. Without keys the winner keeps it."""
    oldest = [F.min(F.when(F.col("side") == s, F.struct("first_seen", "id"))).alias(s) for s in ("winner", "loser")]
    aged = merges.join(keys.groupBy("merge_id").agg(*oldest), "merge_id", "left")
    numbered = aged.join(global_rank(merges.select("merge_id"), "place", F.asc("merge_id")), "merge_id")
    kept = F.col("loser").isNull() | F.coalesce(F.col("winner") <= F.col("loser"), F.lit(False))
    new = F.col("place") + F.lit(top)
    return numbered.select("merge_id", F.explode(F.create_map(F.lit("winner"), F.when(kept, F.col("winner_id")).otherwise(new), F.lit("loser"), F.when(kept, new).otherwise(F.col("winner_id")))).alias("side", "profile_id"))


def repointed(rows: DataFrame, kind: str, recorded: DataFrame, to: DataFrame) -> DataFrame:
    """A table (id, profile_id, ...) with the recorded rows at their own side's profile."""
    own = recorded.filter(F.col("kind") == kind).join(to, ["merge_id", "side"]).select(F.col("row_id").cast(rows.schema["id"].dataType).alias("id"), F.col("profile_id").alias("to_"))
    return rows.join(own, "id", "left").withColumn("profile_id", F.coalesce("to_", "profile_id")).select(*rows.columns)


def consents(merges: DataFrame, recorded: DataFrame, current: DataFrame, to: DataFrame) -> DataFrame:
    """(profile_id, channel, status): each side's recorded consent (merge_id, side, channel, status); an opt-out of the merged profile holds on both sides."""
    out = current.filter("status = 'opted_out'").join(merges.select("merge_id", F.col("winner_id").alias("profile_id")), "profile_id").select("merge_id", "channel").distinct()
    own = recorded.join(out, ["merge_id", "channel"], "left_anti").join(to, ["merge_id", "side"]).select("profile_id", "channel", "status")
    return own.unionByName(out.join(to, "merge_id").select("profile_id", "channel", F.lit("opted_out").alias("status")))
