"""Dashboard queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pledgework.operators import rollups as R
from pledgework.operators.traits import MONEY
from pledgework.plans.registry import query
from pledgework.plans.trait_queries import TRAITS, traits_of
from pledgework.sources.adapter import AS_OF

START, END = dt.date(2000, 8, 2), AS_OF
SPAN = "gift_date BETWEEN DATE '2000-08-02' AND DATE '2001-08-01'"
A = "a AS (SELECT g.* FROM gifts g JOIN profiles p ON p.id = g.profile_id)"
M = "DECIMAL(18,2)"
DAILY = "dd AS (SELECT profile_id, gift_date AS day, count(*) AS gift_count, CAST(sum(amount) AS DECIMAL(18,2)) AS gift_amount, bool_or(is_recurring) AS is_recurring FROM a WHERE gift_date IS NOT NULL AND NOT is_refund GROUP BY ALL)"
BUCKET = "CASE WHEN amount < 0 THEN 'Returns' WHEN amount < 25 THEN '$0-24' WHEN amount < 50 THEN '$25-49' WHEN amount < 100 THEN '$50-99' WHEN amount < 250 THEN '$100-249' WHEN amount < 500 THEN '$250-499' WHEN amount < 1000 THEN '$500-999' WHEN amount < 5000 THEN '$1,000-4,999' ELSE '$5,000+' END"


@query("donor_daily", f"WITH {A}, {DAILY} SELECT * FROM dd")
def _(v):
    return R.donor_daily(v.gifts, v.profiles)


@query("donor_patterns", f"WITH {A}, {DAILY} SELECT days, gift_counts, recurring_flags, count(*) AS donors FROM (SELECT profile_id, list(day ORDER BY day) AS days, list(gift_count ORDER BY day) AS gift_counts, list(is_recurring ORDER BY day) AS recurring_flags FROM dd GROUP BY profile_id) GROUP BY ALL")
def _(v):
    return R.donor_patterns(R.donor_daily(v.gifts, v.profiles))


@query("dashboard_daily", f"""WITH k AS (SELECT g.*, s.key AS source, p.merged_into_id IS NULL AND NOT p.is_deleted AS active FROM gifts g JOIN all_profiles p ON p.id = g.profile_id JOIN sources s ON s.id = g.source_id WHERE gift_date IS NOT NULL),
f AS (SELECT profile_id, min(gift_date) AS first_day FROM k WHERE NOT is_refund GROUP BY profile_id)
SELECT gift_date AS day, source, fund, campaign, channel, active, count(*) FILTER (WHERE NOT is_refund) AS gift_count, CAST(sum(amount) AS {M}) AS gift_amount, count(DISTINCT k.profile_id) FILTER (WHERE NOT is_refund) AS donors,
count(DISTINCT k.profile_id) FILTER (WHERE NOT is_refund AND gift_date = first_day) AS new_donors FROM k LEFT JOIN f USING (profile_id) GROUP BY ALL""")
def _(v):
    return R.dashboard_daily(v.gifts, v.all_profiles, v.sources)


@query("gift_size_distribution", f"WITH {A} SELECT {BUCKET} AS bucket, count(*) FILTER (WHERE NOT is_refund) AS gifts, CAST(sum(amount) AS {M}) AS amount FROM a WHERE {SPAN} GROUP BY 1")
def _(v):
    return R.giving_daily(v.gifts, v.profiles).filter(F.col("day").between(F.lit(START), F.lit(END))).groupBy("bucket").agg(F.sum("gift_count").alias("gifts"), F.sum("gift_amount").cast(MONEY).alias("amount"))


@query("giving_daily", f"WITH {A} SELECT gift_date AS day, appeal_code, {BUCKET} AS bucket, count(*) FILTER (WHERE NOT is_refund) AS gift_count, CAST(sum(amount) AS {M}) AS gift_amount FROM a WHERE gift_date IS NOT NULL GROUP BY ALL")
def _(v):
    return R.giving_daily(v.gifts, v.profiles)


@query("event_daily", "SELECT day, s.key AS source, name, type, count(*) AS events FROM events_in e JOIN sources s ON s.id = e.source_id GROUP BY ALL")
def _(v):
    return R.event_daily(v.events_in, v.sources)


@query("events_by_day", "SELECT day, s.key AS source, count(*) AS events FROM events_in e JOIN sources s ON s.id = e.source_id WHERE day BETWEEN DATE '2000-08-02' AND DATE '2001-08-01' GROUP BY ALL")
def _(v):
    return R.event_daily(v.events_in, v.sources).filter(F.col("day").between(F.lit(START), F.lit(END))).groupBy("day", "source").agg(F.sum("events").alias("events"))


CONVERT = "SELECT g.day, count(*) AS conversions FROM (SELECT profile_id, min(gift_date) AS day FROM gifts WHERE NOT is_refund GROUP BY 1) g JOIN (SELECT profile_id, min(day) - 1500 AS day FROM events_in GROUP BY 1) e USING (profile_id) WHERE e.day < g.day GROUP BY 1"


@query("viewer_to_donor", CONVERT)
def _(v):
    return R.conversions(v.events_in.withColumn("day", F.date_sub("day", 1500)), v.gifts)


@query("conversions_by_month", f"SELECT CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(conversions) AS BIGINT) AS conversions FROM ({CONVERT}) GROUP BY 1")
def _(v):
    return R.conversions(v.events_in.withColumn("day", F.date_sub("day", 1500)), v.gifts).groupBy(F.trunc("day", "month").alias("month")).agg(F.sum("conversions").alias("conversions"))


@query("kpi_scalars", f"""{TRAITS} SELECT (SELECT count(*) FROM profiles) AS profiles, (SELECT count(*) FROM (SELECT c.profile_id FROM consent_rows c JOIN profiles p ON p.id = c.profile_id WHERE c.channel = 'email' GROUP BY 1 HAVING bool_or(status = 'opted_in') AND NOT bool_or(status = 'opted_out'))) AS email_opted_in,
  (SELECT count(*) FROM traits WHERE is_recurring_active) AS recurring_partners, (SELECT count(*) FROM traits WHERE donor_status = 'lapsing') AS lapsing""")
def _(v):
    t = traits_of(v).agg(F.count("*").alias("profiles"), F.count_if("is_recurring_active").alias("recurring_partners"), F.count_if(F.col("donor_status") == "lapsing").alias("lapsing"))
    e = R.active(v.consent_rows.filter("channel = 'email'"), v.profiles).groupBy("profile_id").agg((F.bool_or(F.col("status") == "opted_in") & ~F.bool_or(F.col("status") == "opted_out")).alias("ok")).agg(F.count_if("ok").alias("email_opted_in"))
    return t.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k").drop("k")  # one row each


@query("partner_status", f"{TRAITS} SELECT donor_status AS status, count(*) AS count FROM traits GROUP BY 1")
def _(v):
    return traits_of(v).groupBy(F.col("donor_status").alias("status")).agg(F.count("*").alias("count"))


REC = "r AS (SELECT sr.*, s.key AS source FROM source_records sr JOIN sources s ON s.id = sr.source_id)"


@query("profiles_by_source", f"WITH {REC} SELECT source, count(DISTINCT profile_id) AS profiles FROM r JOIN profiles p ON p.id = r.profile_id GROUP BY 1")
def _(v):
    return R.active(v.source_records, v.profiles).join(v.sources.select(F.col("id").alias("source_id"), F.col("key").alias("source")), "source_id").groupBy("source").agg(F.count_distinct("profile_id").alias("profiles"))


@query("source_overlap", f"WITH {REC}, m AS (SELECT DISTINCT profile_id, source FROM r JOIN profiles p ON p.id = r.profile_id) SELECT a.source AS source_a, b.source AS source_b, count(*) AS profiles FROM m a JOIN m b USING (profile_id) WHERE a.source <= b.source GROUP BY 1, 2")
def _(v):
    return R.overlap(v.source_records, v.profiles, v.sources)


@query("identifier_coverage", f"""WITH {REC}, x AS (SELECT source, count(DISTINCT profile_id) AS profiles, count(DISTINCT profile_id) FILTER (WHERE coalesce(r.email, '') <> '') AS email_profiles, count(DISTINCT profile_id) FILTER (WHERE coalesce(r.phone, '') <> '') AS phone_profiles,
  count(DISTINCT profile_id) FILTER (WHERE coalesce(nullif(address1, ''), nullif(city, ''), '') <> '') AS address_profiles FROM r JOIN profiles p ON p.id = r.profile_id GROUP BY 1)
SELECT *, round(100.0 * email_profiles / profiles, 6) AS email_pct, round(100.0 * phone_profiles / profiles, 6) AS phone_pct, round(100.0 * address_profiles / profiles, 6) AS address_pct FROM x""")
def _(v):
    k = R.active(v.source_records, v.profiles).join(v.sources.select(F.col("id").alias("source_id"), F.col("key").alias("source")), "source_id")
    # one row a profile and source first: then plain counts, no distinct expansion
    per = k.groupBy("source", "profile_id").agg(F.bool_or(F.coalesce("email", F.lit("")) != "").alias("e"), F.bool_or(F.coalesce("phone", F.lit("")) != "").alias("p"), F.bool_or(F.coalesce(F.nullif("address1", F.lit("")), F.nullif("city", F.lit("")), F.lit("")) != "").alias("a"))
    out = per.groupBy("source").agg(F.count("*").alias("profiles"), F.count_if("e").alias("email_profiles"), F.count_if("p").alias("phone_profiles"), F.count_if("a").alias("address_profiles"))
    return out.withColumns({f"{n}_pct": F.round(100.0 * F.col(f"{n}_profiles") / F.col("profiles"), 6) for n in ("email", "phone", "address")})


@query("pending_resolutions", f"WITH {REC} SELECT source, count(*) AS pending FROM r WHERE NOT resolved GROUP BY 1")
def _(v):
    return v.source_records.filter("NOT resolved").join(v.sources.select(F.col("id").alias("source_id"), F.col("key").alias("source")), "source_id").groupBy("source").agg(F.count("*").alias("pending"))


@query("blocklist_hits", "SELECT b.type, count(DISTINCT r.id) AS hits FROM blocklist b JOIN source_records r ON (b.type = 'email' AND lower(r.email) LIKE lower(replace(b.value, '*', '%'))) OR (b.type = 'phone' AND r.phone = b.value) GROUP BY 1")
def _(v):
    listed = v.blocklist.collect()  # a curated list
    mails = [r["value"].replace("*", "%").lower() for r in listed if r["type"] == "email"]
    phones = [r["value"] for r in listed if r["type"] == "phone"]
    hit = F.lit(False)
    for m in mails:
        hit = hit | F.lower("email").like(m)
    kinds = F.array_compact(F.array(F.when(F.coalesce(hit, F.lit(False)), "email"), F.when(F.col("phone").isin(*phones), "phone")))
    return v.source_records.select("id", F.explode(kinds).alias("type")).groupBy("type").agg(F.count("*").alias("hits"))


YEARS = f"{A}, y AS (SELECT DISTINCT profile_id, CAST(year(gift_date) AS BIGINT) AS year FROM a WHERE gift_date IS NOT NULL)"


@query("retention_by_year", f"WITH {YEARS} SELECT x.year, count(b.profile_id) AS retained, count(*) AS donors, round(100.0 * count(b.profile_id) / count(*), 6) AS retention_rate FROM y x LEFT JOIN y b ON b.profile_id = x.profile_id AND b.year = x.year + 1 GROUP BY 1")
def _(v):
    return R.retention_by_year(R.years_given(v.gifts, v.profiles))


@query("cohort_retention", f"WITH {YEARS}, f AS (SELECT profile_id, min(year) AS first_year FROM y GROUP BY 1), n AS (SELECT first_year, count(*) AS size FROM f GROUP BY 1) SELECT first_year, year - first_year AS years_after_first, count(*) AS retained, round(100.0 * count(*) / size, 6) AS retention_pct FROM f JOIN y USING (profile_id) JOIN n USING (first_year) GROUP BY first_year, year, size")
def _(v):
    return R.cohorts(R.years_given(v.gifts, v.profiles))


WINDOWS = [(dt.date(2000, 8, 2), dt.date(2001, 8, 1)), (dt.date(1999, 8, 2), dt.date(2000, 8, 1)), (dt.date(2001, 7, 1), dt.date(2001, 7, 31))]
W_SQL = "w AS (SELECT * FROM (VALUES (DATE '2000-08-02', DATE '2001-08-01', DATE '1999-08-02', DATE '2000-08-01', DATE '2000-08-02'), (DATE '1999-08-02', DATE '2000-08-01', DATE '1998-08-02', DATE '1999-08-01', DATE '1999-08-02'), (DATE '2001-07-01', DATE '2001-07-31', DATE '1999-08-01', DATE '2000-07-31', DATE '2000-08-01')) AS t(start, \"end\", b0, b1, r0))"
FACTS = f"""WITH {A}, {DAILY}, {W_SQL}, x AS (SELECT w.start, w."end", profile_id, bool_or(day BETWEEN w.start AND w."end") AS cur, bool_or(day BETWEEN b0 AND b1) AS base, bool_or(day BETWEEN r0 AND w."end") AS recent FROM dd CROSS JOIN w GROUP BY 1, 2, 3)
SELECT start, "end", count(*) FILTER (WHERE cur) AS active_partners, count(*) FILTER (WHERE base) AS retention_base, count(*) FILTER (WHERE base AND recent) AS retained, round(CASE WHEN count(*) FILTER (WHERE base) > 0 THEN 100.0 * count(*) FILTER (WHERE base AND recent) / count(*) FILTER (WHERE base) ELSE 0 END, 6) AS retention_yoy FROM x GROUP BY 1, 2"""


@query("kpi_retention_yoy", FACTS)
def _(v):
    return R.period_facts(R.donor_patterns(R.donor_daily(v.gifts, v.profiles)), WINDOWS)


@query("kpi_period_compare", f"""WITH {A}, x AS (SELECT CAST(coalesce(sum(amount) FILTER (WHERE {SPAN}), 0) AS {M}) AS giving, CAST(coalesce(sum(amount) FILTER (WHERE gift_date BETWEEN DATE '1999-08-02' AND DATE '2000-08-01'), 0) AS {M}) AS prior FROM a)
SELECT giving, prior, CAST(giving - prior AS {M}) AS change, CASE WHEN prior = 0 THEN NULL ELSE round(100.0 * (CAST(giving AS DOUBLE) - CAST(prior AS DOUBLE)) / CAST(prior AS DOUBLE), 6) END AS change_pct FROM x""")
def _(v):
    w = R.period_giving(v.gifts, v.profiles, WINDOWS[:2])
    one = w.agg(F.max_by("giving", "start").alias("giving"), F.min_by("giving", "start").alias("prior"))
    g, p = F.col("giving").cast("double"), F.col("prior").cast("double")
    return one.select("giving", "prior", (F.col("giving") - F.col("prior")).cast(MONEY).alias("change"), R.delta(g, p)[1].alias("change_pct"))


MONTHS = [(R.month_shift(dt.date(2001, 7, 1), -k), R.month_shift(dt.date(2001, 7, 1), 1 - k) - dt.timedelta(days=1)) for k in range(11, -1, -1)]
SPINE = "months AS (SELECT CAST(m AS DATE) AS month, CAST(m + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS month_end FROM generate_series(TIMESTAMP '2000-08-01', TIMESTAMP '2001-07-01', INTERVAL 1 MONTH) AS t(m))"


@query("kpi_sparkline", f"WITH {A}, {SPINE} SELECT month AS start, month_end AS \"end\", CAST(coalesce(sum(amount), 0) AS {M}) AS giving, count(a.id) FILTER (WHERE NOT is_refund) AS gifts FROM months LEFT JOIN a ON gift_date BETWEEN month AND month_end GROUP BY 1, 2")
def _(v):
    return R.period_giving(v.gifts, v.profiles, MONTHS)


@query("monthly_giving_paired", f"WITH {A}, {SPINE} SELECT month, CAST(coalesce((SELECT sum(amount) FROM a WHERE gift_date BETWEEN month AND month_end), 0) AS {M}) AS current, CAST(coalesce((SELECT sum(amount) FROM a WHERE gift_date BETWEEN CAST(month - INTERVAL 1 YEAR AS DATE) AND CAST(month_end - INTERVAL 1 YEAR AS DATE)), 0) AS {M}) AS prior FROM months")
def _(v):
    return R.paired_months(v.gifts, v.profiles, [(a, b, R.month_shift(a, -12), R.month_shift(b, -12)) for a, b in MONTHS])


@query("status_at_cutoff", f"""WITH {A}, {DAILY}, c AS (SELECT profile_id, min(day) AS f, list(day ORDER BY day DESC) AS ds, max_by(gift_count, day) AS n, bool_or(is_recurring AND day > DATE '2000-12-31' - 365) AS rec FROM dd WHERE day <= DATE '2000-12-31' GROUP BY 1)
SELECT CASE WHEN DATE '2000-12-31' - ds[1] <= 365 AND f >= DATE '2000-12-31' - 365 THEN 'new' WHEN DATE '2000-12-31' - ds[1] <= 365 AND n = 1 AND ds[1] - ds[2] > 730 THEN 'reactivated' WHEN DATE '2000-12-31' - ds[1] <= 365 THEN 'active' WHEN DATE '2000-12-31' - ds[1] <= 730 THEN 'lapsing' ELSE 'lapsed' END AS status, count(*) AS partners, count(*) FILTER (WHERE rec) AS recurring FROM c GROUP BY 1""")
def _(v):
    return R.status_at(R.donor_daily(v.gifts, v.profiles), dt.date(2000, 12, 31))


@query("grouping_sets_giving", f"SELECT gift_date, campaign, CAST(grouping(gift_date) AS TINYINT) AS g_day, CAST(grouping(campaign) AS TINYINT) AS g_campaign, count(*) AS gifts, CAST(sum(amount) AS {M}) AS amount FROM gifts GROUP BY GROUPING SETS ((gift_date), (campaign))")
def _(v):
    return R.grouping_sets(v.gifts)


@query("top_campaigns", f"WITH {A} SELECT campaign, count(*) FILTER (WHERE NOT is_refund) AS gifts, CAST(sum(amount) AS {M}) AS amount FROM a WHERE {SPAN} AND campaign IS NOT NULL GROUP BY 1 ORDER BY amount DESC, gifts DESC, campaign LIMIT 5")
def _(v):
    return R.by_field(v.gifts.filter("campaign IS NOT NULL"), v.profiles, "campaign", START, END).orderBy(F.desc("amount"), F.desc("gifts"), "campaign").limit(5)


@query("top_two_months", f"WITH {A} SELECT CAST(month(gift_date) AS INT) AS month, CAST(sum(amount) AS {M}) AS amount FROM a WHERE gift_date IS NOT NULL GROUP BY 1 ORDER BY amount DESC, month LIMIT 2")
def _(v):
    return R.active(v.gifts, v.profiles).filter("gift_date IS NOT NULL").groupBy(F.month("gift_date").alias("month")).agg(F.sum("amount").cast(MONEY).alias("amount")).orderBy(F.desc("amount"), "month").limit(2)


@query("monthly_giving", f"WITH {A} SELECT CAST(date_trunc('month', gift_date) AS DATE) AS month, CAST(sum(amount) AS {M}) AS amount, count(*) FILTER (WHERE NOT is_refund) AS gifts FROM a WHERE {SPAN} GROUP BY 1")
def _(v):
    return R.active(v.gifts, v.profiles).filter(F.col("gift_date").between(F.lit(START), F.lit(END))).groupBy(F.trunc("gift_date", "month").alias("month")).agg(F.sum("amount").cast(MONEY).alias("amount"), F.count_if(~F.col("is_refund")).alias("gifts"))


@query("new_vs_returning", f"WITH {A}, {DAILY}, f AS (SELECT profile_id, min(day) AS first_day FROM dd GROUP BY 1), m AS (SELECT DISTINCT profile_id, CAST(date_trunc('month', day) AS DATE) AS month FROM dd WHERE day BETWEEN DATE '2000-08-02' AND DATE '2001-08-01') SELECT month, count(*) FILTER (WHERE first_day >= month) AS new_donors, count(*) FILTER (WHERE first_day < month) AS returning_donors FROM m JOIN f USING (profile_id) GROUP BY 1")
def _(v):
    p = R.donor_patterns(R.donor_daily(v.gifts, v.profiles))
    inside = F.filter("days", lambda d: d.between(F.lit(START), F.lit(END)))
    rows = p.select(F.element_at("days", 1).alias("first"), "donors", F.explode(F.array_distinct(F.transform(inside, lambda d: F.trunc(d, "month")))).alias("month"))
    new = F.col("first") >= F.col("month")
    return rows.groupBy("month").agg(F.coalesce(F.sum(F.when(new, F.col("donors"))), F.lit(0)).alias("new_donors"), F.coalesce(F.sum(F.when(~new, F.col("donors"))), F.lit(0)).alias("returning_donors"))


def _field(name: str, field: str):
    @query(name, f"WITH {A} SELECT coalesce({field}, '(unspecified)') AS {field}, count(*) FILTER (WHERE NOT is_refund) AS gifts, CAST(sum(amount) AS {M}) AS amount FROM a WHERE {SPAN} GROUP BY 1")
    def _(v):
        return R.by_field(v.gifts, v.profiles, field, START, END)


_field("giving_by_channel", "channel")
_field("giving_by_fund", "fund")
_field("giving_by_appeal", "appeal_code")


@query("top_event_names", "SELECT name, type, s.key AS source, count(*) AS events FROM events_in e JOIN sources s ON s.id = e.source_id GROUP BY ALL ORDER BY events DESC, name, type, source LIMIT 20")
def _(v):
    return R.event_daily(v.events_in, v.sources).groupBy("name", "type", "source").agg(F.sum("events").alias("events")).orderBy(F.desc("events"), "name", "type", "source").limit(20)


@query("expiring_enrichment", "SELECT license_expires_at AS day, count(*) AS expiring FROM enrichment WHERE license_expires_at BETWEEN DATE '2001-08-01' AND DATE '2001-08-01' + 60 GROUP BY 1")
def _(v):
    return v.enrichment.filter(F.col("license_expires_at").between(F.lit(AS_OF), F.lit(AS_OF + dt.timedelta(days=60)))).groupBy(F.col("license_expires_at").alias("day")).agg(F.count("*").alias("expiring"))


@query("profile_list_page", "SELECT id, email, last_name, region FROM profiles WHERE email IS NOT NULL AND region IS NOT NULL ORDER BY id LIMIT 25 OFFSET 50")
def _(v):
    return v.profiles.filter("email IS NOT NULL AND region IS NOT NULL").select("id", "email", "last_name", "region").orderBy("id").offset(50).limit(25)


@query("profile_360", """WITH g AS (SELECT profile_id, list(id ORDER BY gift_date DESC NULLS LAST, id DESC) AS gift_ids FROM gifts GROUP BY 1), e AS (SELECT profile_id, list(id ORDER BY occurred_at DESC, id DESC) AS event_ids FROM events_in GROUP BY 1), r AS (SELECT profile_id, list(external_id ORDER BY updated_at DESC, id DESC) AS record_ids FROM source_records WHERE profile_id IS NOT NULL GROUP BY 1)
SELECT p.id AS profile_id, p.email, coalesce(gift_ids, []) AS gift_ids, coalesce(event_ids, []) AS event_ids, coalesce(record_ids, []) AS record_ids FROM profiles p LEFT JOIN g ON g.profile_id = p.id LEFT JOIN e ON e.profile_id = p.id LEFT JOIN r ON r.profile_id = p.id""")
def _(v):
    def newest(df, key, value, name):
        held = df.filter("profile_id IS NOT NULL").groupBy("profile_id").agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), "id", F.col(value).alias("v"))), asc=False).alias("x"))
        return held.select("profile_id", F.transform("x", lambda r: r["v"]).alias(name))

    out = v.profiles.select(F.col("id").alias("profile_id"), "email")
    for df, key, value, name in ((v.gifts, "gift_date", "id", "gift_ids"), (v.events_in, "occurred_at", "id", "event_ids"), (v.source_records, "updated_at", "external_id", "record_ids")):
        out = out.join(newest(df, key, value, name), "profile_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>" if name == "record_ids" else "array<bigint>")))
    return out
