"""Identity resolution: edges, components, conflicts, survivorship, attachment, matching, households."""

from __future__ import annotations

import itertools
import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgework.operators.matching import alike, first_met, greedy
from pledgework.operators.scratch import written

#: Kinds of key that name one person, of which a component may hold one value.
EXCLUSIVE = ("login",)
MOST_RECORDS = 25


def edges(records: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(id, kind, value), one row for each key that a record has. keys: kind -> column."""
    made = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lower(F.trim(col)).alias("value")) for kind, col in keys.items()])
    return records.select("id", "source_id", F.explode(made).alias("e")).select("id", "source_id", "e.kind", "e.value").filter("value IS NOT NULL AND value <> ''")


def blocked(found: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Edges without blocklisted values, wildcards included, and without phones of one repeated digit. Exact values are joined by value, only wildcards are tried by pattern."""
    listed = blocklist.select("type", F.lower("value").alias("pattern")).distinct()
    exact = listed.filter(~F.col("pattern").contains("*")).toDF("kind", "value")
    wild = listed.filter(F.col("pattern").contains("*")).select(F.col("type").alias("kind_"), F.translate(F.regexp_replace("pattern", r"([%_\\])", r"\\$1"), "*", "%").alias("like_"))
    repeated = (F.col("kind") == "phone") & F.col("value").rlike(r"^\+?1?(\d)\1{9}$")
    return found.filter(~repeated).join(exact, ["kind", "value"], "left_anti").join(wild, (F.col("kind") == F.col("kind_")) & F.expr("value LIKE like_"), "left_anti").select(*found.columns)


def high_cardinality(found: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """Values that more than so many records of one source have."""
    return found.groupBy("source_id", "kind", "value").agg(F.count_distinct("id").alias("records")).filter(F.col("records") > most)


def components(found: DataFrame) -> DataFrame:
    """(id, label): the least record id that shared keys reach.

    Labels go from records to keys and back, then jump to their label's label, so rounds follow the logarithm
    of a chain's length. A key with many records takes one row of a minimum, not pairs.
    """
    links = written(found.select("id", F.xxhash64("kind", "value").alias("key"), "kind", "value").distinct().select("id", "kind", "value"), "links")
    labels = written(links.select("id").distinct().withColumn("label", F.col("id")), "labels")
    while True:
        by_key = links.join(labels, "id").groupBy("kind", "value").agg(F.min("label").alias("low"))
        near = links.join(by_key, ["kind", "value"]).groupBy("id").agg(F.min("low").alias("low"))
        far = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        new = written(labels.join(near, "id").join(far, "low", "left").select("id", F.col("label").alias("old"), F.least("label", "low", F.coalesce("far", "low")).alias("label")), "labels")
        done = new.filter("old <> label").limit(1).count() == 0
        labels = new.select("id", "label")
        if done:
            return labels


def conflicts(labels: DataFrame, found: DataFrame, exclusive: tuple[str, ...] = EXCLUSIVE) -> DataFrame:
    """Components with more than one value of an exclusive kind."""
    own = found.filter(F.col("kind").isin(*exclusive)).join(labels, "id")
    return own.groupBy("label", "kind").agg(F.count_distinct("value").alias("values")).filter("values > 1").groupBy("label").agg(F.max("values").alias("values"))


def refined(found: DataFrame, contact: tuple[str, ...] = ("email", "phone")) -> tuple[DataFrame, DataFrame]:
    """Labels after contact edges are cut in conflicted components, and the labels still in conflict (quarantine)."""
    labels = components(found)
    bad = conflicts(labels, found).select("label")
    held = found.join(labels, "id").join(bad.withColumn("bad", F.lit(True)), "label", "left")
    kept = held.filter(F.col("bad").isNull() | ~F.col("kind").isin(*contact)).select("id", "source_id", "kind", "value")
    again = components(kept)
    alone = labels.select("id").join(again, "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    return alone, conflicts(alone, found).select("label")


def survivorship(records: DataFrame, sources: DataFrame) -> DataFrame:
    """I16: e-mail and phone each on their own, names and address as blocks; by priority, newest, id; empty values never win."""
    rows = records.filter("profile_id IS NOT NULL").join(sources.select(F.col("id").alias("source_id"), "priority"), "source_id")
    order = F.struct("priority", (-F.unix_date("updated_at")).alias("age"), "id")

    def best(value: Column, has: Column) -> Column:
        return F.min_by(F.when(has, value), F.when(has, order))

    filled = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    name = best(F.struct(F.nullif("first_name", F.lit("")).alias("first_name"), F.nullif("last_name", F.lit("")).alias("last_name")), filled("first_name") & filled("last_name"))
    address = best(F.struct("address1", "city", "postal_code"), filled("address1"))
    out = rows.groupBy("profile_id").agg(best(F.col("email"), filled("email")).alias("email"), best(F.col("phone"), filled("phone")).alias("phone"), name.alias("n"), address.alias("a"))
    return out.select("profile_id", "email", "phone", "n.first_name", "n.last_name", "a.address1", "a.city", "a.postal_code")


def attach(transactions: DataFrame, owners: DataFrame) -> DataFrame:
    """(id, profile_id) where the best rank of a transaction's keys names exactly one profile. transactions: (id, rank, kind, value)."""
    hits = transactions.join(owners, ["kind", "value"]).groupBy("id", "rank").agg(F.collect_set("profile_id").alias("who"))
    best = hits.groupBy("id").agg(F.min_by("who", "rank").alias("who"))
    return best.filter(F.size("who") == 1).select("id", F.element_at("who", 1).alias("profile_id"))


def alias_chain(aliases: DataFrame, rounds: int = 64) -> DataFrame:
    """(retired_id, survivor_id) at the end of each chain, by pointer jumping; a cycle keeps its last link and ends the rounds."""
    now = written(aliases.select("retired_id", "survivor_id"), "aliases")
    for _ in range(rounds):
        nxt = now.select(F.col("retired_id").alias("survivor_id"), F.col("survivor_id").alias("further"))
        new = written(now.join(nxt, "survivor_id", "left").select("retired_id", F.col("survivor_id").alias("old"), F.when(F.col("further") == F.col("retired_id"), F.col("survivor_id")).otherwise(F.coalesce("further", "survivor_id")).alias("survivor_id")), "aliases")
        moved = new.filter("old <> survivor_id").limit(1).count()
        now = new.select("retired_id", "survivor_id")
        if not moved:
            break
    return now


def lookup(asked: DataFrame, owners: DataFrame, aliases: DataFrame | None = None, active: DataFrame | None = None) -> DataFrame:
    """(place, value) -> status and profile, order and repeats kept. aliases (retired_id, survivor_id) lead an owner to the end of its chain; of owners and survivors, those in active (profile_id) count."""
    if aliases is not None:
        chain = alias_chain(aliases).withColumnRenamed("retired_id", "profile_id")
        owners = owners.join(chain, "profile_id", "left").select("value", F.explode(F.array_distinct(F.array("profile_id", F.coalesce("survivor_id", "profile_id")))).alias("profile_id"))
    if active is not None:
        owners = owners.join(active.select("profile_id"), "profile_id", "left_semi")
    known = owners.groupBy("value").agg(F.min("profile_id").alias("low"), F.max("profile_id").alias("high"))
    status = F.when(F.col("low").isNull(), "not_found").when(F.col("low") == F.col("high"), "matched").otherwise("ambiguous")
    return asked.join(known, "value", "left").select("place", "value", status.alias("status"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("profile_id"))


#: Probabilities of agreement among matches and among others, and of a match before any evidence.
AGREE = {"first_name": (0.9, 0.01), "last_name": (0.9, 0.005), "postal_code": (0.95, 0.001), "phone": (0.9, 0.0001)}
PRIOR, LINKED, REVIEW = 1e-6, 0.995, 0.85
EDITS, LONGEST = 1, 255


BLOCKS = (("address1", "postal_code"), ("phone",), ("last_name", "postal_code"))


def made_of_one(fields: tuple[str, ...] = tuple(AGREE)) -> dict[str, Column]:
    """What a pair needs and depends on one person only: made where they have arrived, so that a pair's own work is small."""
    own = {f"_{c}": F.nullif(F.lower(c) if c.endswith("name") else F.col(c), F.lit("")) for c in fields}
    return own | {f"_short_{c}": F.when(F.length(c) <= LONGEST, F.lower(c)) for c in fields if c.endswith("name")}


def agreement(c: str) -> Column:
    """0 where a side of the pair has no such field, 1 where they agree, 2 where they differ. Names of over 255 characters agree if they are equal."""
    x, y = (F.col(side)[f"_{c}"] for side in ("l", "r"))
    same = x == y
    if c.endswith("name"):
        same = same | (F.levenshtein(F.col("l")[f"_short_{c}"], F.col("r")[f"_short_{c}"], EDITS) >= 0)
    return F.when(x.isNull() | y.isNull(), 0).when(same, 1).otherwise(2)


def match_pairs(people: DataFrame, blocks: tuple[tuple[str, ...], ...] = BLOCKS) -> DataFrame:
    """Pairs that share a block, with the probability of a match by agreeing fields; a null is neutral."""
    used = {c for block in blocks for c in block} | set(AGREE)
    # people alike in all columns are judged as one, then their ids are paired
    both = first_met(alike(people.select("id", *sorted(used))), blocks, made=made_of_one(), itself=True)
    case = F.lit(0)
    for c in AGREE:
        case = case * 3 + agreement(c)
    judged = both.select(F.col("l.ids").alias("ls"), F.col("r.ids").alias("rs"), (F.col("l.id") != F.col("r.id")).alias("apart"), case.alias("case"))
    weights, chances = (F.array(*map(F.lit, values))[F.col("case")] for values in zip(*scores()))
    judged = judged.select("ls", "rs", "apart", weights.alias("weight"), chances.alias("probability"))
    pairs = judged.withColumn("a", F.explode("ls")).withColumn("b", F.explode("rs")).filter("apart OR a < b")
    return pairs.select(F.least("a", "b").alias("l"), F.greatest("a", "b").alias("r"), "weight", "probability")


def scores() -> list[tuple[float, float]]:
    """(weight, probability), rounded, of each case: fields are missing, agree or differ, the first field's digit to the base of three leading."""
    rounded = lambda x: float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    terms = [(0.0, math.log2(m / u), math.log2((1 - m) / (1 - u))) for m, u in AGREE.values()]
    odds = [(sum(t), 2.0 ** sum(t) * (PRIOR / (1 - PRIOR))) for t in itertools.product(*terms)]
    return [(rounded(w), rounded(o / (1 + o))) for w, o in odds]


def bands(scored: DataFrame, keys: DataFrame | None = None, masters: DataFrame | None = None) -> DataFrame:
    """By the thresholds alone, as the queries' SQL has it. With the system keys (profile_id, kind, value) and masters (profile_id, master_id) of the profiles l and r
    it is the whole step: pairs of differing keys are in conflict and those of a profile that a better pair retired are skipped, by falling score (`matching.greedy`)."""
    p = F.col("probability")
    if keys is None:
        return scored.withColumn("band", F.when(p >= LINKED, "linked").when(p >= REVIEW, "review").otherwise("rejected"))
    rejected = scored.filter(p < REVIEW).select("l", "r", "probability", F.lit("rejected").alias("band"))
    return greedy(scored, keys, masters, LINKED, REVIEW).unionByName(rejected)


def households(people: DataFrame) -> DataFrame:
    """hh_ and a digest of address and surname; the size is the number of people with it, whose records with one address count once."""
    key = F.concat(F.lit("hh_"), F.sha2(F.concat_ws("|", F.lower("address1"), "postal_code", F.lower("last_name")), 256))
    keyed = people.filter("address1 IS NOT NULL").select("profile_id", key.alias("household_id")).distinct()
    return keyed.join(keyed.groupBy("household_id").agg(F.count("*").alias("household_size")), "household_id")


def devices(seen: DataFrame, as_of, days: int = 10) -> DataFrame:
    """The last sighting of each device; an authenticated one is preferred; links end after so many days."""
    last = seen.groupBy("device_key").agg(F.max("seen_on").alias("last_seen"), F.max_by("profile_id", F.struct("authenticated", "seen_on", "profile_id")).alias("profile_id"))
    return last.withColumn("expires_on", F.date_add("last_seen", days)).withColumn("live", F.col("expires_on") >= F.lit(as_of))


def bounded(labels: DataFrame, most: int = 500) -> DataFrame:
    """I8: components, least label first, while the running number of records stays within bounds. The running sum is over component sizes cut at the bound, so only the first `most` components can count."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size")).orderBy("label").limit(most)
    from pyspark.sql import Window as W

    return sizes.withColumn("running", F.sum("size").over(W.orderBy("label").rowsBetween(W.unboundedPreceding, 0))).filter(F.col("running") <= most)


def stable_sample(rows: DataFrame, salt: str, n: int) -> DataFrame:
    """The first n by digest of id and day."""
    return rows.withColumn("digest", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(salt)))).orderBy("digest", "id").limit(n)
