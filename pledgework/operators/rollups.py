"""Dashboard rollups, period indicators, retention and cohorts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgework.operators.traits import MONEY, status_of

#: Upper ends (exclusive) and names of the gift sizes.
SIZES = ((0, "Returns"), (25, "$0-24"), (50, "$25-49"), (100, "$50-99"), (250, "$100-249"), (500, "$250-499"), (1000, "$500-999"), (5000, "$1,000-4,999"))
LARGEST = "$5,000+"


def size_bucket(amount: Column) -> Column:
    """nine ordered names; a negative amount is a return."""
    out = F.when(amount < 0, SIZES[0][1])
    for top, name in SIZES[1:]:
        out = out.when(amount < top, name)
    return out.otherwise(LARGEST)


def active(gifts: DataFrame, profiles: DataFrame) -> DataFrame:
    return gifts.join(profiles.select(F.col("id").alias("profile_id")), "profile_id", "left_semi")


def donor_daily(gifts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Active profiles by day, without refunds."""
    kept = active(gifts, profiles).filter("gift_date IS NOT NULL AND NOT is_refund")
    return kept.groupBy("profile_id", F.col("gift_date").alias("day")).agg(F.count("*").alias("gift_count"), F.sum("amount").cast(MONEY).alias("gift_amount"), F.bool_or("is_recurring").alias("is_recurring"))


def donor_patterns(daily: DataFrame) -> DataFrame:
    """Equal histories become one row with their number of donors."""
    history = daily.groupBy("profile_id").agg(F.sort_array(F.collect_list(F.struct("day", "gift_count", "is_recurring"))).alias("h"))
    parts = history.select(F.transform("h", lambda x: x["day"]).alias("days"), F.transform("h", lambda x: x["gift_count"]).alias("gift_counts"), F.transform("h", lambda x: x["is_recurring"]).alias("recurring_flags"))
    return parts.groupBy("days", "gift_counts", "recurring_flags").agg(F.count("*").alias("donors"))


def dashboard_daily(gifts: DataFrame, all_profiles: DataFrame, sources: DataFrame) -> DataFrame:
    """D3: day, source, fund, campaign, channel, active; distinct donors and those whose first gift it is."""
    known = all_profiles.select(F.col("id").alias("profile_id"), (F.col("merged_into_id").isNull() & ~F.col("is_deleted")).alias("active"))
    kept = gifts.filter("gift_date IS NOT NULL").join(known, "profile_id").join(sources.select(F.col("id").alias("source_id"), F.col("key").alias("source")), "source_id")
    first = kept.filter("NOT is_refund").groupBy("profile_id").agg(F.min("gift_date").alias("first_day"))
    rows = kept.join(first, "profile_id", "left")
    own = ~F.col("is_refund")
    return rows.groupBy(F.col("gift_date").alias("day"), "source", "fund", "campaign", "channel", "active").agg(
        F.count_if(own).alias("gift_count"), F.sum("amount").cast(MONEY).alias("gift_amount"), F.count_distinct(F.when(own, F.col("profile_id"))).alias("donors"), F.count_distinct(F.when(own & (F.col("gift_date") == F.col("first_day")), F.col("profile_id"))).alias("new_donors")
    )


def giving_daily(gifts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Day, appeal, size."""
    kept = active(gifts, profiles).filter("gift_date IS NOT NULL")
    return kept.groupBy(F.col("gift_date").alias("day"), "appeal_code", size_bucket(F.col("amount")).alias("bucket")).agg(F.count_if(~F.col("is_refund")).alias("gift_count"), F.sum("amount").cast(MONEY).alias("gift_amount"))


def event_daily(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Day, source, name, type."""
    return events.join(sources.select(F.col("id").alias("source_id"), F.col("key").alias("source")), "source_id").groupBy("day", "source", "name", "type").agg(F.count("*").alias("events"))


def conversions(events: DataFrame, gifts: DataFrame) -> DataFrame:
    """People whose first event day is before their first gift's, by that gift's day."""
    e = events.groupBy("profile_id").agg(F.min("day").alias("event_day"))
    g = gifts.filter("NOT is_refund").groupBy("profile_id").agg(F.min("gift_date").alias("day"))
    return g.join(e, "profile_id").filter("event_day < day").groupBy("day").agg(F.count("*").alias("conversions"))


def by_field(gifts: DataFrame, profiles: DataFrame, field: str, start: dt.date, end: dt.date) -> DataFrame:
    """Amounts by a field; null is '(unspecified)'."""
    kept = active(gifts, profiles).filter(F.col("gift_date").between(F.lit(start), F.lit(end)))
    return kept.groupBy(F.coalesce(field, F.lit("(unspecified)")).alias(field)).agg(F.count_if(~F.col("is_refund")).alias("gifts"), F.sum("amount").cast(MONEY).alias("amount"))


def years_given(gifts: DataFrame, profiles: DataFrame) -> DataFrame:
    """Distinct (profile, year); refund rows count as giving here."""
    return active(gifts, profiles).filter("gift_date IS NOT NULL").select("profile_id", F.year("gift_date").cast("bigint").alias("year")).distinct()


def retention_by_year(years: DataFrame) -> DataFrame:
    """Of a year's donors, those who gave the next year. The next year is looked up in one pass by profile."""
    lists = years.groupBy("profile_id").agg(F.collect_set("year").alias("ys"))
    rows = lists.select(F.explode("ys").alias("year"), "ys").select("year", F.array_contains("ys", F.col("year") + 1).alias("kept"))
    return rows.groupBy("year").agg(F.count_if("kept").alias("retained"), F.count("*").alias("donors")).withColumn("retention_rate", F.round(100.0 * F.col("retained") / F.col("donors"), 6))


def cohorts(years: DataFrame) -> DataFrame:
    """Share of each first-year cohort that gave so many years after."""
    lists = years.groupBy("profile_id").agg(F.collect_set("year").alias("ys")).withColumn("first_year", F.array_min("ys"))
    rows = lists.select("first_year", F.explode("ys").alias("year")).groupBy("first_year", (F.col("year") - F.col("first_year")).alias("years_after_first")).agg(F.count("*").alias("retained"))
    size = rows.filter("years_after_first = 0").select("first_year", F.col("retained").alias("size"))
    return rows.join(size, "first_year").select("first_year", "years_after_first", "retained", F.round(100.0 * F.col("retained") / F.col("size"), 6).alias("retention_pct"))


def month_shift(day: dt.date, months: int) -> dt.date:
    """by calendar months, the day clamped."""
    y, m = divmod(day.year * 12 + day.month - 1 + months, 12)
    last = ((dt.date(y + (m + 1) // 12, (m + 1) % 12 + 1, 1)) - dt.timedelta(days=1)).day
    return dt.date(y, m + 1, min(day.day, last))


def retention_window(end: dt.date) -> tuple[tuple[dt.date, dt.date], tuple[dt.date, dt.date]]:
    """(end-24m, end-12m] and (end-12m, end]."""
    one, two, day = month_shift(end, -12), month_shift(end, -24), dt.timedelta(days=1)
    return (two + day, one), (one + day, end)


def period_facts(patterns: DataFrame, windows: list[tuple[dt.date, dt.date]]) -> DataFrame:
    """Partners and retention for many windows in one scan of the patterns, one row a window."""
    def hits(start, end):
        return F.exists("days", lambda d: d.between(F.lit(start), F.lit(end)))

    rows = []
    for start, end in windows:
        (b0, b1), (r0, r1) = retention_window(end)
        base, recent = hits(b0, b1), hits(r0, r1)
        rows.append(F.struct(F.lit(start).alias("start"), F.lit(end).alias("end"), F.coalesce(F.sum(F.when(hits(start, end), F.col("donors"))), F.lit(0)).alias("active_partners"), F.coalesce(F.sum(F.when(base, F.col("donors"))), F.lit(0)).alias("retention_base"), F.coalesce(F.sum(F.when(base & recent, F.col("donors"))), F.lit(0)).alias("retained")))
    out = patterns.agg(F.array(*rows).alias("w")).select(F.explode("w").alias("w")).select("w.*")
    return out.withColumn("retention_yoy", F.round(F.when(F.col("retention_base") > 0, 100.0 * F.col("retained") / F.col("retention_base")).otherwise(0.0), 6))


def period_giving(gifts: DataFrame, profiles: DataFrame, windows: list[tuple[dt.date, dt.date]]) -> DataFrame:
    """Signed amounts and counts for many windows in one scan."""
    kept, rows = active(gifts, profiles).filter("gift_date IS NOT NULL"), []
    for start, end in windows:
        inside = F.col("gift_date").between(F.lit(start), F.lit(end))
        rows.append(F.struct(F.lit(start).alias("start"), F.lit(end).alias("end"), F.coalesce(F.sum(F.when(inside, F.col("amount"))), F.lit(0)).cast(MONEY).alias("giving"), F.count_if(inside & ~F.col("is_refund")).alias("gifts")))
    return kept.agg(F.array(*rows).alias("w")).select(F.explode("w").alias("w")).select("w.*")


def delta(value: Column, prior: Column) -> tuple[Column, Column]:
    """change and change in percent, null where there was nothing."""
    return value - prior, F.when(prior == 0, F.lit(None)).otherwise(F.round(100.0 * (value - prior) / prior, 6))


def status_at(daily: DataFrame, cut: dt.date) -> DataFrame:
    """Profiles by status at a past day, and recurring ones. More than one gift on the last day isn't a reactivation."""
    seen = daily.filter(F.col("day") <= F.lit(cut)).groupBy("profile_id").agg(
        F.min("day").alias("first"), F.slice(F.sort_array(F.collect_list("day"), asc=False), 1, 2).alias("latest"), F.max_by("gift_count", "day").alias("latest_count"),
        F.bool_or(F.col("is_recurring") & (F.col("day") > F.date_sub(F.lit(cut), 365))).alias("recurring"),
    )
    last = F.element_at("latest", 1)
    previous = F.when(F.col("latest_count") == 1, F.try_element_at("latest", F.lit(2)))
    return seen.groupBy(status_of(F.col("first"), last, previous, F.lit(cut)).alias("status")).agg(F.count("*").alias("partners"), F.count_if("recurring").alias("recurring"))


def grouping_sets(gifts: DataFrame) -> DataFrame:
    """Totals by day and by campaign in one scan."""
    return gifts.sparkSession.sql("SELECT gift_date, campaign, grouping(gift_date) AS g_day, grouping(campaign) AS g_campaign, count(*) AS gifts, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM {g} GROUP BY GROUPING SETS ((gift_date), (campaign))", g=gifts)


def paired_months(gifts: DataFrame, profiles: DataFrame, spans: list[tuple[dt.date, dt.date, dt.date, dt.date]]) -> DataFrame:
    """Each month's days against the days a year before; months without gifts are zero."""
    now = period_giving(gifts, profiles, [(a, b) for a, b, _, _ in spans]).select(F.col("start").alias("month"), F.col("giving").alias("current"))
    past = period_giving(gifts, profiles, [(c, d) for _, _, c, d in spans]).select(F.add_months("start", 12).alias("month"), F.col("giving").alias("prior"))
    return now.join(past, "month")


def overlap(records: DataFrame, profiles: DataFrame, sources: DataFrame) -> DataFrame:
    """People in both of two sources. Each profile's few sources pair within its own row, so nothing is self-joined."""
    keyed = records.join(profiles.select(F.col("id").alias("profile_id")), "profile_id", "left_semi").join(sources.select(F.col("id").alias("source_id"), "key"), "source_id")
    sets = keyed.groupBy("profile_id").agg(F.array_sort(F.collect_set("key")).alias("ks"))
    pairs = sets.select(F.explode("ks").alias("source_a"), "ks").select("source_a", F.explode(F.filter("ks", lambda k: k >= F.col("source_a"))).alias("source_b"))
    return pairs.groupBy("source_a", "source_b").agg(F.count("*").alias("profiles"))
