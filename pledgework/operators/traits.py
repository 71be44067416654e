"""Per-profile giving and engagement traits, donor lifecycle, quintiles and monthly snapshots."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pledgework.operators.scratch import written

MONEY = "decimal(18,2)"
#: Gifts up to which shuffles are left to adaptive execution, and gifts a task beyond.
MANY, EACH = 2_000_000, 50_000
STATUSES = ("prospect", "new", "reactivated", "active", "lapsing", "lapsed")


def days(n: int, as_of: dt.date) -> Column:
    return F.lit(as_of - dt.timedelta(days=n))


def gift_base(gifts: DataFrame, profiles: DataFrame, as_of: dt.date) -> DataFrame:
    """A1: gifts of active profiles, undated or up to as_of."""
    return gifts.filter(F.col("gift_date").isNull() | (F.col("gift_date") <= F.lit(as_of))).join(profiles.select(F.col("id").alias("profile_id")), "profile_id", "left_semi")


def gift_days(base: DataFrame) -> DataFrame:
    """Gifts by profile and day, undated ones as one day: what a profile's row needs is bounded by days, however many gifts it has, and rows are added up before they are sent."""
    kept = ~F.col("is_refund")
    own = F.when(kept, F.col("amount"))
    return base.groupBy("profile_id", "gift_date").agg(F.count_if(kept).alias("n"), F.sum("amount").alias("total"), F.sum(own).alias("given"), F.max(own).alias("largest"), F.coalesce(F.bool_or(F.col("is_recurring") & kept), F.lit(False)).alias("recurring"))


def spread(gifts: DataFrame) -> DataFrame:
    """Very many gifts are dealt by profile to a number of tasks that grows with them. Adaptive execution joins partitions by their compressed bytes, up to one a core, so what a task adds up, gathers and sorts would grow with the table."""
    rows = gifts.count()
    least = int(gifts.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # joins take over a number of at least this many
    return gifts.repartition(max(least, -(-rows // EACH)), "profile_id") if rows > MANY else gifts


def gift_rollup(days_of: DataFrame, as_of: dt.date) -> DataFrame:
    """Conditional aggregates over gift_days() by profile; the gift before the newest dated one that isn't a refund is the same day's if that day has several."""
    year, had = F.col("gift_date").between(days(364, as_of), F.lit(as_of)), F.col("n") > 0
    recent = F.col("recurring") & F.col("gift_date").between(days(44, as_of), F.lit(as_of))
    newest = F.slice(F.sort_array(F.collect_list(F.when(had & F.col("gift_date").isNotNull(), F.struct("gift_date", "n"))), asc=False), 1, 2)
    rolled = days_of.groupBy("profile_id").agg(
        F.sum("n").alias("gift_count_total"),
        F.coalesce(F.sum(F.when(year, F.col("n"))), F.lit(0)).alias("gift_count_12m"),
        F.sum("total").cast(MONEY).alias("ltv_total"),
        F.coalesce(F.sum(F.when(year, F.col("total"))), F.lit(0)).cast(MONEY).alias("gift_amount_12m"),
        F.min(F.when(had, F.col("gift_date"))).alias("first_gift_date"),
        F.max(F.when(had, F.col("gift_date"))).alias("last_gift_date"),
        F.max("largest").cast(MONEY).alias("largest_gift_amount"),
        F.try_divide(F.sum("given"), F.sum("n")).cast(MONEY).alias("avg_gift_amount"),
        F.coalesce(F.bool_or(recent), F.lit(False)).alias("is_recurring_active"),
        newest.alias("newest"),
    )
    two = F.col("newest")
    return rolled.withColumn("previous_gift_date", F.when(F.try_element_at(two, F.lit(1))["n"] > 1, two[0]["gift_date"]).otherwise(F.try_element_at(two, F.lit(2))["gift_date"])).drop("newest")


def status_of(first: Column, last: Column, previous: Column, at: Column) -> Column:
    """Lifecycle at a day; a year is 365 days, its ends inside."""
    since = F.datediff(at, last)
    return (
        F.when(last.isNull(), "prospect")
        .when((since <= 365) & (first >= F.date_sub(at, 365)), "new")
        .when((since <= 365) & previous.isNotNull() & (F.datediff(last, previous) > 730), "reactivated")
        .when(since <= 365, "active")
        .when(since <= 730, "lapsing")
        .otherwise("lapsed")
    )


def giving_traits(profiles: DataFrame, gifts: DataFrame, as_of: dt.date) -> DataFrame:
    """A2-A8 for every active profile; profiles without gifts are prospects."""
    known = gifts.filter(F.col("gift_date").isNull() | (F.col("gift_date") <= F.lit(as_of)))
    ids = profiles.select(F.col("id").alias("profile_id"))  # the join with them leaves out gifts of others
    rolled = ids.join(gift_rollup(gift_days(spread(known)), as_of), "profile_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint" if "count" in c else MONEY) for c in ("gift_count_total", "gift_count_12m", "ltv_total", "gift_amount_12m")}
    at = F.lit(as_of)
    return rolled.withColumns(zero | {"is_recurring_active": F.coalesce("is_recurring_active", F.lit(False)), "days_since_last_gift": F.datediff(at, F.col("last_gift_date")), "donor_status": status_of(F.col("first_gift_date"), F.col("last_gift_date"), F.col("previous_gift_date"), at)})


def global_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """An exact global row number from 1 without a one-task window: range sort, counts by part, offsets. The parts are written down, so that rows and counts speak of the same ones."""
    ordered = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a part
    offsets = counts.select("_part", ahead.alias("_ahead"))
    return ordered.withColumn("_own", own).join(offsets, "_part").withColumn(name, (F.col("_own") + F.col("_ahead")).cast("bigint")).drop("_own", "_ahead", "_part", "_n")


def tile(rank: Column, rows: int, tiles: int = 5) -> Column:
    """ntile of a row number: the first rows % tiles tiles have one row more."""
    size, more = rows // tiles, rows % tiles
    inside = F.floor((rank - 1) / F.lit(size + 1)) + 1
    return F.when(rank <= more * (size + 1), inside).otherwise(more + F.floor((rank - 1 - more * (size + 1)) / F.lit(max(size, 1))) + 1)


def rfm(traits: DataFrame) -> DataFrame:
    """Quintiles over donors, 5 the best; others get nulls. The three measures are ranked by one range sort, each after the one before: they have a row a donor, so a place in a measure is the place less the rows of those before."""
    donors = written(traits.filter("gift_count_total > 0").select("profile_id", "days_since_last_gift", "gift_count_total", "ltv_total"), "donors")
    n = donors.count()
    key = lambda c: c.cast("decimal(22,2)").alias("key")
    undated = F.coalesce("days_since_last_gift", F.lit(2**31 - 1))  # the last
    measures = F.array(*[F.struct(F.lit(i).alias("measure"), key(c)) for i, c in enumerate((undated, -F.col("gift_count_total"), -F.col("ltv_total")))])
    ranked = global_rank(donors.select("profile_id", F.inline(measures)), "place", F.asc("measure"), F.asc("key"), F.asc("profile_id"))
    tiled = ranked.select("profile_id", "measure", (6 - tile(F.col("place") - F.col("measure").cast("long") * F.lit(n), n)).cast("int").alias("tile"))
    names = ("rfm_recency", "rfm_frequency", "rfm_monetary")
    scores = tiled.groupBy("profile_id").agg(*[F.max(F.when(F.col("measure") == i, F.col("tile"))).alias(name) for i, name in enumerate(names)])
    return traits.select("profile_id").join(scores.withColumn("rfm_score", F.concat(*[F.col(c).cast("string") for c in names])), "profile_id", "left")


def event_rollup(profiles: DataFrame, events: DataFrame, as_of: dt.date, video: tuple[str, ...] = ("Video Watched", "vod_viewed")) -> DataFrame:
    """Thirty days up to as_of; the last event at any time before the day's end."""
    known, recent = F.col("day") <= F.lit(as_of), F.col("day") >= days(29, as_of)
    rolled = events.filter(known).groupBy("profile_id").agg(F.count_if(recent).alias("event_count_30d"), F.max("occurred_at").alias("last_event_at"), F.count_if(recent & F.col("name").isin(*video)).alias("video_views_30d"))
    out = profiles.select(F.col("id").alias("profile_id")).join(rolled, "profile_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("event_count_30d", "video_views_30d")})


def source_keys(profiles: DataFrame, sources: DataFrame, *appearances: DataFrame) -> DataFrame:
    """Sorted distinct keys over all appearances; none is an empty array."""
    seen = appearances[0].select("profile_id", "source_id").distinct()
    for a in appearances[1:]:
        seen = seen.unionByName(a.select("profile_id", "source_id").distinct())
    keyed = seen.join(sources.select(F.col("id").alias("source_id"), "key"), "source_id").groupBy("profile_id").agg(F.array_sort(F.collect_set("key")).alias("source_keys"))
    return profiles.select(F.col("id").alias("profile_id")).join(keyed, "profile_id", "left").withColumn("source_keys", F.coalesce("source_keys", F.array().cast("array<string>")))


def last_channel(profiles: DataFrame, gifts: DataFrame, events: DataFrame, sources: DataFrame, as_of: dt.date) -> DataFrame:
    """Source of the newest dated gift (at midnight, refunds too) or event; ties by id."""
    given = gift_base(gifts, profiles, as_of).filter("gift_date IS NOT NULL").select("profile_id", "source_id", F.col("gift_date").cast("timestamp_ntz").alias("at"), "id")
    done = events.filter(F.col("day") <= F.lit(as_of)).join(profiles.select(F.col("id").alias("profile_id")), "profile_id", "left_semi").select("profile_id", "source_id", F.col("occurred_at").alias("at"), "id")
    newest = given.unionByName(done).groupBy("profile_id").agg(F.max_by("source_id", F.struct("at", "id", "source_id")).alias("source_id"))
    return newest.join(sources.select(F.col("id").alias("source_id"), F.col("key").alias("last_engagement_channel")), "source_id").select("profile_id", "last_engagement_channel")


def full_traits(profiles: DataFrame, gifts: DataFrame, events: DataFrame, records: DataFrame, sources: DataFrame, as_of: dt.date, video: tuple[str, ...]) -> DataFrame:
    """All computed traits, one row a profile."""
    giving = giving_traits(profiles, gifts, as_of)
    return giving.join(rfm(giving), "profile_id", "left").join(event_rollup(profiles, events, as_of, video), "profile_id", "left").join(source_keys(profiles, sources, records, gifts, events), "profile_id", "left").join(last_channel(profiles, gifts, events, sources, as_of), "profile_id", "left")


def incremental_traits(traits: DataFrame, dirty: DataFrame) -> DataFrame:
    """Recompute a subset; ranks stay global."""
    return traits.join(rfm(traits), "profile_id").join(dirty.select("profile_id").distinct(), "profile_id", "left_semi")


def snapshot(traits: DataFrame, month: dt.date, existing: DataFrame | None = None) -> DataFrame:
    """Counts and sums by status; statuses that the month has already aren't written again."""
    made = traits.groupBy("donor_status").agg(F.count("*").alias("profile_count"), F.sum("ltv_total").cast(MONEY).alias("ltv_sum"), F.sum("gift_amount_12m").cast(MONEY).alias("giving_12m_sum")).withColumn("month", F.lit(month))
    return made.join(existing.select("month", "donor_status"), ["month", "donor_status"], "left_anti") if existing is not None else made


def month_spine(as_of: dt.date, months: int = 24) -> list[tuple[dt.date, dt.date]]:
    """(month, end or as_of), oldest first."""
    out, first = [], as_of.replace(day=1)
    for _ in range(months):
        nxt = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
        out.append((first, min(nxt - dt.timedelta(days=1), as_of)))
        first = (first - dt.timedelta(days=1)).replace(day=1)
    return out[::-1]


def backfill(profiles: DataFrame, gifts: DataFrame, as_of: dt.date, months: int = 24) -> DataFrame:
    """Status at each month's end. A profile's days with gifts are gathered once, not more than there are days; the months are array functions over them, so no range join is made."""
    dated = gift_days(spread(gifts.filter(F.col("gift_date").isNotNull() & (F.col("gift_date") <= F.lit(as_of))))).groupBy("profile_id").agg(F.sort_array(F.collect_list(F.struct("gift_date", "n", (F.col("total") * 100).cast("bigint").alias("cents")))).alias("g"))
    at = profiles.select(F.col("id").alias("profile_id")).join(dated, "profile_id", "left").withColumn("g", F.coalesce("g", F.array().cast(dated.schema["g"].dataType)))
    spine = F.array(*[F.struct(F.lit(m).alias("month"), F.lit(e).alias("month_end")) for m, e in month_spine(as_of, months)])
    rows = at.withColumn("m", F.explode(spine)).select("profile_id", "m.month", "m.month_end", F.filter("g", lambda x: x["gift_date"] <= F.col("m.month_end")).alias("g"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, x: acc + x["cents"])
    last = F.try_element_at("kept", F.lit(-1))
    rows = rows.withColumn("kept", F.filter("g", lambda x: x["n"] > 0)).select(
        "month", "month_end", total(F.col("g")).alias("ltv"), total(F.filter("g", lambda x: x["gift_date"] >= F.date_sub("month_end", 364))).alias("year"),
        F.try_element_at("kept", F.lit(1))["gift_date"].alias("first"), last["gift_date"].alias("last"), F.when(last["n"] > 1, last["gift_date"]).otherwise(F.try_element_at("kept", F.lit(-2))["gift_date"]).alias("previous"),
    )
    status = status_of(F.col("first"), F.col("last"), F.col("previous"), F.col("month_end"))
    money = lambda cents: (F.sum(F.col(cents).cast("decimal(20,0)")) / 100).cast(MONEY)
    return rows.groupBy("month", status.alias("donor_status")).agg(F.count("*").alias("profile_count"), money("ltv").alias("ltv_sum"), money("year").alias("giving_12m_sum"))


def unreturned(events: DataFrame, donation: str, returned: str) -> DataFrame:
    """Donation events without a return event of the same person, source and donation id."""
    back = events.filter(F.col("name") == returned).select("profile_id", "source_id", "donation_id").distinct()
    return events.filter(F.col("name") == donation).join(back, ["profile_id", "source_id", "donation_id"], "left_anti")


def last_donation_at(events: DataFrame, donation: str, returned: str) -> DataFrame:
    """A20."""
    return unreturned(events, donation, returned).groupBy("profile_id").agg(F.max("occurred_at").alias("last_donation_at"))


def attribute_winner(records: DataFrame, sources: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """By profile and key the first value that isn't JSON null, by priority, newest, id; then one column a key. Blank stays blank."""
    ranked = records.filter("profile_id IS NOT NULL").join(sources.select(F.col("id").alias("source_id"), "priority"), "source_id")
    order = F.struct("priority", F.datediff(F.lit(dt.date(1970, 1, 1)), F.col("updated_at")).alias("age"), "id")
    winners = []
    for k in keys:
        value = F.get_json_object("attributes", f"$.{k}")
        winners.append(F.min_by(F.when(value.isNotNull(), value), F.when(value.isNotNull(), order)).alias(k))
    return ranked.groupBy("profile_id").agg(*winners)
