"""Merges without MERGE: joins that give the table's next state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_merge(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The later row wins, its nulls inherit earlier values."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old_nulls: bool = True) -> DataFrame:
    """New values over old ones (nulls keep the old if asked); op says inserted, updated or same."""
    cols = [c for c in new.columns if c not in keys]
    a = old.select(*keys, F.struct(*cols).alias("_old"))
    b = new.select(*keys, F.struct(*cols).alias("_new"))
    both = a.join(b, keys, "full")

    def value(c):
        if keep_old_nulls:
            return F.coalesce(F.col("_new")[c], F.col("_old")[c])
        return F.when(F.col("_new").isNull(), F.col("_old")[c]).otherwise(F.col("_new")[c])

    out = both.select(*keys, "_old", "_new", *[value(c).alias(c) for c in cols])
    same = F.col("_new").isNull() | F.struct(*cols).eqNullSafe(F.col("_old"))
    return out.withColumn("op", F.when(F.col("_old").isNull(), "inserted").when(same, "same").otherwise("updated")).drop("_old", "_new")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The newest row of each key, by an ordered struct: one aggregation, no window."""
    cols = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in cols])


def unseen(messages: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """U8: first deliveries that the ledger doesn't have."""
    return messages.dropDuplicates(keys).join(ledger.select(*keys), keys, "left_anti")


def suppressed(rows: DataFrame, suppressions: DataFrame) -> DataFrame:
    """Deletions reject a row, e-mail suppressions opt it out."""
    kinds = suppressions.groupBy("profile_id").agg(F.bool_or(F.col("type") == "deletion").alias("gone"), F.bool_or(F.col("type") == "email").alias("mail"))
    return rows.join(kinds, "profile_id", "left").withColumn("outcome", F.when(F.col("gone"), "rejected").when(F.col("mail"), "opted_out").otherwise("accepted")).drop("gone", "mail")
