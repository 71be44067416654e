"""Imported rows into the table of source records, with attributes, consents and a short cut for rows that haven't changed.

A record is (source_id, external_id), contact fields, attributes (map<string,string>), consent (struct status, captured_at, authoritative; null
without one), raw_hash and updated_at. A batch has the same but updated_at, and seq, the order of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgework.operators.consent import wins

KEYS = ("source_id", "external_id")
FIELDS = ("email", "phone", "first_name", "last_name", "address1", "address2", "city", "region", "postal_code", "country")


def over(under: Column, upper: Column) -> Column:
    """Entries of both maps, those of upper where both have a key; nulls count as empty."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(under, none), F.coalesce(upper, none)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def folded(batch: DataFrame) -> DataFrame:
    """One row of each key. Of a field the last value that isn't null counts, of attributes the last of each name, of consents the one that wins when they are taken in order, and the row's hash is the last one's.

    A key's consents are gathered once by state, so however often a key repeats, what is held of it has few rows: of consents that
    are alike, the first is enough, as a later equal one never wins.
    """
    fields = [c for c in FIELDS if c in batch.columns]
    plain = batch.groupBy(*KEYS).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields], F.max_by("raw_hash", "seq").alias("raw_hash"))
    entries = batch.select(*KEYS, "seq", F.explode("attributes").alias("name", "value")).groupBy(*KEYS, "name").agg(F.max_by("value", "seq").alias("value"))
    attributes = entries.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("attributes"))
    states = batch.filter("consent IS NOT NULL").groupBy(*KEYS, "consent").agg(F.min("seq").alias("seq"))
    ordered = states.groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("seq", "consent"))).alias("all"))
    kind = batch.schema["consent"].dataType.simpleString()
    first = F.lit(None).cast(kind)
    consents = ordered.select(*KEYS, F.aggregate("all", first, lambda old, r: F.when(wins(old, r["consent"]), r["consent"]).otherwise(old)).alias("consent"))
    out = plain.join(attributes, list(KEYS), "left").join(consents, list(KEYS), "left")
    return out.withColumn("attributes", F.coalesce("attributes", F.create_map().cast("map<string,string>")))


def upsert(table: DataFrame, batch: DataFrame, now) -> DataFrame:
    """The table after the batch, with op: inserted, updated or same.

    A row whose raw_hash is the table's own changes nothing, not even updated_at. Else values that aren't null replace the table's,
    attributes are laid over the table's by name, and the table's consent stays unless the batch's wins over it; a consent without a
    time is as old as its row. Keys are never null; a batch is folded first.
    """
    new, fields = folded(batch), [c for c in FIELDS if c in batch.columns]
    a = table.select(*KEYS, F.struct(*fields, "attributes", "consent", "raw_hash", "updated_at").alias("o"))
    b = new.select(*KEYS, F.struct(*fields, "attributes", "consent", "raw_hash").alias("n"))
    both = a.join(b, list(KEYS), "full")
    o, n = F.col("o"), F.col("n")
    op = F.when(o.isNull(), "inserted").when(n.isNull() | n["raw_hash"].eqNullSafe(o["raw_hash"]), "same").otherwise("updated")
    dated = lambda c, at: F.when(c.isNotNull(), F.struct(c["status"].alias("status"), F.coalesce(c["captured_at"], at).alias("captured_at"), F.coalesce(c["authoritative"], F.lit(False)).alias("authoritative")))
    consent = F.when(wins(dated(o["consent"], o["updated_at"]), dated(n["consent"], F.lit(now))), n["consent"]).otherwise(o["consent"])
    merged = {c: F.coalesce(n[c], o[c]) for c in fields} | {"attributes": over(o["attributes"], n["attributes"]), "consent": consent, "raw_hash": n["raw_hash"], "updated_at": F.lit(now)}
    both = both.withColumn("op", op)
    return both.select(*KEYS, *[F.when(F.col("op") == "same", o[c]).otherwise(v).alias(c) for c, v in merged.items()], "op")
