"""The steps around identity components: hash and owner edges, winners, new profiles, moves, attachment by login, conflicts, staging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgework.functions.validation import filled, nickname
from pledgework.operators.traits import global_rank

HASHES = {"email_md5": F.md5, "email_sha256": lambda c: F.sha2(c, 256)}


def hash_edges(found: DataFrame) -> DataFrame:
    """Digests of e-mail edges, as kinds of their own, beside the other edges."""
    mail = found.filter("kind = 'email'")
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), fn(F.col("value")).alias("value")) for k, fn in HASHES.items()])).alias("e")
    return found.unionByName(mail.select("id", "source_id", made).select("id", "source_id", "e.kind", "e.value"))


def pruned(hashed: DataFrame, kept: DataFrame, blocklist: DataFrame) -> DataFrame:
    """I4: hash edges without those of records whose e-mail edge was blocked, and without hashes of blocklisted e-mails."""
    own = hashed.filter(F.col("kind").isin(*HASHES))
    had = hashed.filter("kind = 'email'").select("id").distinct()
    lost = had.join(kept.filter("kind = 'email'").select("id").distinct(), "id", "left_anti")
    listed = blocklist.filter("type = 'email'").select(F.lower("value").alias("v"))
    banned = listed.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), fn(F.col("v")).alias("value")) for k, fn in HASHES.items()])).alias("e")).select("e.*").distinct()
    return own.join(lost, "id", "left_anti").join(banned, ["kind", "value"], "left_anti")


def owner_edges(found: DataFrame, owners: DataFrame, records: DataFrame) -> DataFrame:
    """(id, kind = profile, value): owners of a record's keys (kind, value, profile_id) and of the record itself are nodes of the graph."""
    by_key = found.join(owners.select("kind", "value", "profile_id"), ["kind", "value"]).select("id", "profile_id")
    itself = records.filter("profile_id IS NOT NULL").select("id", "profile_id")
    return by_key.unionByName(itself).distinct().select("id", F.lit("profile").alias("kind"), F.col("profile_id").cast("string").alias("value"))


def winners(owned: DataFrame, masters: DataFrame) -> DataFrame:
    """Of a label's owners (label, profile_id) the one with the oldest master id; ties by id."""
    return owned.join(masters, "profile_id").groupBy("label").agg(F.min_by("profile_id", F.struct("master_id", "profile_id")).alias("winner"))


def moves(owned: DataFrame, won: DataFrame) -> DataFrame:
    """(loser, winner)."""
    return owned.join(won, "label").filter("profile_id <> winner").select(F.col("profile_id").alias("loser"), "winner").distinct()


def assignments(labels: DataFrame, won: DataFrame, top: int) -> DataFrame:
    """(id, profile_id) of every record; labels without an owner get new ids after top, in their order."""
    fresh = labels.select("label").distinct().join(won, "label", "left_anti")
    new = global_rank(fresh, "place", F.asc("label")).select("label", (F.col("place") + F.lit(top)).alias("winner"))
    return labels.join(won.unionByName(new), "label").select("id", F.col("winner").alias("profile_id"))


def agreed_owner(events: DataFrame) -> DataFrame:
    """A message's owner, where all its rows name one."""
    return events.groupBy("source_id", "message_id").agg(F.min("profile_id").alias("profile_id"), F.max("profile_id").alias("other")).filter("profile_id = other").drop("other")


def login_attach(asked: DataFrame, logins: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(id, profile_id) where every login that is supplied belongs to the same one person. asked: id and a column a kind."""
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.trim(k).alias("value")) for k in kinds])).alias("e")
    supplied = asked.select("id", made).select("id", "e.kind", "e.value").filter(filled(F.col("value")))
    known = logins.groupBy("kind", "value").agg(F.min("profile_id").alias("who"), F.max("profile_id").alias("other"))
    both = supplied.join(known, ["kind", "value"], "left")
    sure = F.bool_and(F.coalesce(F.col("who") == F.col("other"), F.lit(False)))
    return both.groupBy("id").agg(sure.alias("sure"), F.min("who").alias("profile_id"), F.max("other").alias("last")).filter("sure AND profile_id = last").select("id", "profile_id")


def conflicting(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs (l, r) of profiles of which some kind of system key has several values."""
    spans = keys.groupBy("profile_id", "kind").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    sides = pairs.select("l", "r", F.explode(F.array("l", "r")).alias("profile_id")).join(spans, "profile_id")
    return sides.groupBy("l", "r", "kind").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("l", "r").distinct()


def unlinked(scored: DataFrame, keys: DataFrame, linked: float = 0.995, review: float = 0.85) -> DataFrame:
    """Bands with the conflict band: pairs that would be linked or reviewed but whose system keys differ."""
    p = F.col("probability")
    bad = conflicting(scored.select("l", "r").distinct(), keys).withColumn("conflict", F.lit(True))
    band = F.when((p >= review) & F.col("conflict"), "conflict").when(p >= linked, "linked").when(p >= review, "review").otherwise("rejected")
    return scored.join(bad, ["l", "r"], "left").withColumn("band", band).drop("conflict")


class RepeatedKeys(ValueError):
    """A batch that names a key more than once."""


def resource_upsert(current: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """The table after the batch: its keys inserted or replaced, all others kept. A batch that repeats a key is refused whole; with order, a column of the batch, the last row of a key counts."""
    if order:
        rest = [c for c in batch.columns if c not in ("key", order)]
        batch = batch.groupBy("key").agg(F.max_by(F.struct(*rest), order).alias("r")).select("key", "r.*")
    elif batch.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        raise RepeatedKeys("a key comes more than once in the batch")
    return batch.unionByName(current.join(batch.select("key"), "key", "left_anti"))


def staged(records: DataFrame, sources: DataFrame) -> DataFrame:
    """For matching, by profile: the best second line and ISO date of birth by priority, newest, id; the long form of the first name."""
    rows = records.filter("profile_id IS NOT NULL").join(sources.select(F.col("id").alias("source_id"), "priority"), "source_id")
    order = F.struct("priority", (-F.unix_date("updated_at")).alias("age"), "id")
    born = F.when(F.col("dob").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_cast(dob AS date)"))
    best = lambda value, has: F.min_by(F.when(has, value), F.when(has, order))
    return rows.groupBy("profile_id").agg(best(F.col("address2"), filled(F.col("address2"))).alias("address2"), best(born, born.isNotNull()).alias("dob"), best(nickname(F.col("first_name")), filled(F.col("first_name"))).alias("nickname"))


def households_of(keyed: DataFrame) -> DataFrame:
    """Households of standardised addresses (profile_id, address_key, last_name); people without a key are in none."""
    whole = keyed.filter(F.col("address_key").isNotNull() & filled(F.col("last_name")))
    key = F.concat(F.lit("hh_"), F.sha2(F.concat_ws("|", "address_key", F.lower(F.trim("last_name"))), 256))
    one = whole.select("profile_id", key.alias("household_id")).distinct()
    return one.join(one.groupBy("household_id").agg(F.count("*").alias("household_size")), "household_id")
