"""Consent precedence, set form and pairwise form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def consent_winner(rows: DataFrame) -> DataFrame:
    """By profile and channel: an authoritative opt-in newer than the last opt-out, else an opt-out, an opt-in, unknown; then the newest, then the largest id.

    One aggregate of the newest row of each kind; if any authoritative opt-in is newer than the last opt-out, then the newest of them is.
    """
    row, said = F.struct("captured_at", "id", "status", "source_id"), F.col("status")
    newest = lambda test: F.max(F.when(test, row))
    kinds = rows.groupBy("profile_id", "channel").agg(newest((said == "opted_in") & F.col("authoritative")).alias("strong"), newest(said == "opted_out").alias("out"), newest(said == "opted_in").alias("in"), newest(said.isNull() | ~said.isin("opted_in", "opted_out")).alias("other"))
    last = F.col("out.captured_at")
    best = F.coalesce(F.when(last.isNull() | (F.col("strong.captured_at") > last), F.col("strong")), F.col("out"), F.col("in"), F.col("other"))
    return kinds.select("profile_id", "channel", best.alias("b")).select("profile_id", "channel", "b.status", "b.source_id", "b.captured_at")


def candidate_wins(old: tuple[str, int, bool] | None, new: tuple[str, int, bool]) -> bool:
    """U6, one candidate (status, captured, authoritative) at a time.

    Unknown never clears a decision. An opt-out stays unless a newer authoritative opt-in comes. An opt-out beats an opt-in, an
    authoritative one only if it isn't older. Of two opt-ins an authoritative one keeps its place against one that isn't, else the newer
    wins, and at one time the authoritative. Of two unknowns or opt-outs the newer wins.
    """
    if old is None:
        return True
    later, now = new[1] > old[1], (old[0], new[0])
    if "unknown" in now:
        return new[0] != "unknown" or (old[0] == "unknown" and later)
    if now == ("opted_in", "opted_out"):
        return not old[2] or new[1] >= old[1]
    if now == ("opted_out", "opted_in"):
        return new[2] and later
    if now == ("opted_in", "opted_in"):
        return (new[2] or not old[2]) and (later or (new[1] == old[1] and new[2] and not old[2]))
    return later


def wins(old: Column, new: Column) -> Column:
    """U6 as an expression over structs (status, captured_at, authoritative); a null old one loses, a null new one doesn't win."""
    later, same = new["captured_at"] > old["captured_at"], new["captured_at"] == old["captured_at"]
    was, now = old["status"], new["status"]
    return (
        F.when(new.isNull(), False)
        .when(old.isNull(), True)
        .when(now == "unknown", (was == "unknown") & later)
        .when(was == "unknown", True)
        .when((was == "opted_in") & (now == "opted_out"), ~old["authoritative"] | later | same)
        .when((was == "opted_out") & (now == "opted_in"), new["authoritative"] & later)
        .when(now == "opted_in", (new["authoritative"] | ~old["authoritative"]) & (later | (same & new["authoritative"] & ~old["authoritative"])))
        .otherwise(later)
    )
