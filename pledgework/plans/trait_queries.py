"""Trait queries; the oracles are written from the traits' definitions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pledgework.operators import traits as T
from pledgework.plans.registry import query
from pledgework.sources.adapter import AS_OF

VIDEO = ("view",)
BASE = """base AS (SELECT g.* FROM gifts g JOIN profiles p ON p.id = g.profile_id WHERE g.gift_date IS NULL OR g.gift_date <= DATE '2001-08-01')"""
ROLLUP = """rollup AS (SELECT p.id AS profile_id, count(b.id) FILTER (WHERE NOT b.is_refund) AS gift_count_total,
  count(b.id) FILTER (WHERE NOT b.is_refund AND b.gift_date BETWEEN DATE '2000-08-02' AND DATE '2001-08-01') AS gift_count_12m,
  CAST(coalesce(sum(b.amount), 0) AS DECIMAL(18,2)) AS ltv_total,
  CAST(coalesce(sum(b.amount) FILTER (WHERE b.gift_date BETWEEN DATE '2000-08-02' AND DATE '2001-08-01'), 0) AS DECIMAL(18,2)) AS gift_amount_12m,
  min(b.gift_date) FILTER (WHERE NOT b.is_refund) AS first_gift_date, max(b.gift_date) FILTER (WHERE NOT b.is_refund) AS last_gift_date,
  CAST(max(b.amount) FILTER (WHERE NOT b.is_refund) AS DECIMAL(18,2)) AS largest_gift_amount,
  CAST(((2 * CAST(sum(b.amount * 100) FILTER (WHERE NOT b.is_refund) AS HUGEINT) + count(b.id) FILTER (WHERE NOT b.is_refund)) // nullif(2 * count(b.id) FILTER (WHERE NOT b.is_refund), 0)) / 100.0 AS DECIMAL(18,2)) AS avg_gift_amount,
  coalesce(bool_or(b.is_recurring AND NOT b.is_refund AND b.gift_date BETWEEN DATE '2001-06-18' AND DATE '2001-08-01'), false) AS is_recurring_active
  FROM profiles p LEFT JOIN base b ON b.profile_id = p.id GROUP BY p.id)"""
STATUS = """gaps AS (SELECT profile_id, gift_date, lag(gift_date) OVER (PARTITION BY profile_id ORDER BY gift_date, id) AS previous_gift_date,
  row_number() OVER (PARTITION BY profile_id ORDER BY gift_date DESC, id DESC) AS newest FROM base WHERE gift_date IS NOT NULL AND NOT is_refund),
traits AS (SELECT r.*, CAST(DATE '2001-08-01' - last_gift_date AS INT) AS days_since_last_gift, previous_gift_date,
  CASE WHEN last_gift_date IS NULL THEN 'prospect' WHEN DATE '2001-08-01' - last_gift_date <= 365 AND first_gift_date >= DATE '2000-08-01' THEN 'new'
    WHEN DATE '2001-08-01' - last_gift_date <= 365 AND last_gift_date - previous_gift_date > 730 THEN 'reactivated'
    WHEN DATE '2001-08-01' - last_gift_date <= 365 THEN 'active' WHEN DATE '2001-08-01' - last_gift_date <= 730 THEN 'lapsing' ELSE 'lapsed' END AS donor_status
  FROM rollup r LEFT JOIN gaps ON gaps.profile_id = r.profile_id AND newest = 1)"""
RFM = """rfm AS (SELECT profile_id, rec AS rfm_recency, fre AS rfm_frequency, mon AS rfm_monetary, concat(rec, fre, mon) AS rfm_score FROM (
  SELECT profile_id, CAST(6 - ntile(5) OVER (ORDER BY days_since_last_gift ASC NULLS LAST, profile_id) AS INT) AS rec,
    CAST(6 - ntile(5) OVER (ORDER BY gift_count_total DESC, profile_id) AS INT) AS fre, CAST(6 - ntile(5) OVER (ORDER BY ltv_total DESC, profile_id) AS INT) AS mon
  FROM traits WHERE gift_count_total > 0))"""
TRAITS = f"WITH {BASE}, {ROLLUP}, {STATUS}"
ROLLUP_COLUMNS = "profile_id, gift_count_total, gift_count_12m, ltv_total, gift_amount_12m, first_gift_date, last_gift_date, largest_gift_amount, avg_gift_amount, is_recurring_active"
EVENTS = """ev AS (SELECT p.id AS profile_id, count(e.id) FILTER (WHERE e.day >= DATE '2001-07-03') AS event_count_30d, max(e.occurred_at) AS last_event_at,
  count(e.id) FILTER (WHERE e.day >= DATE '2001-07-03' AND e.name = 'view') AS video_views_30d FROM profiles p LEFT JOIN events_in e ON e.profile_id = p.id AND e.day <= DATE '2001-08-01' GROUP BY p.id)"""
KEYS = """ks AS (SELECT p.id AS profile_id, coalesce(list(DISTINCT s.key ORDER BY s.key) FILTER (WHERE s.key IS NOT NULL), []) AS source_keys FROM profiles p LEFT JOIN (
  SELECT profile_id, source_id FROM source_records UNION ALL SELECT profile_id, source_id FROM gifts UNION ALL SELECT profile_id, source_id FROM events_in) a ON a.profile_id = p.id LEFT JOIN sources s ON s.id = a.source_id GROUP BY p.id)"""
LAST = """le AS (SELECT profile_id, key AS last_engagement_channel FROM (SELECT c.*, row_number() OVER (PARTITION BY profile_id ORDER BY done_at DESC, id DESC, source_id DESC) AS k FROM (
  SELECT profile_id, CAST(gift_date AS TIMESTAMP) AS done_at, id, source_id FROM base WHERE gift_date IS NOT NULL UNION ALL
  SELECT e.profile_id, e.occurred_at, e.id, e.source_id FROM events_in e JOIN profiles p ON p.id = e.profile_id WHERE e.day <= DATE '2001-08-01') c) JOIN sources s ON s.id = source_id WHERE k = 1)"""


def traits_of(v):
    return T.giving_traits(v.profiles, v.gifts, AS_OF)


@query("traits_gift_rollup", f"WITH {BASE}, {ROLLUP} SELECT {ROLLUP_COLUMNS} FROM rollup")
def _(v):
    return traits_of(v).select(*ROLLUP_COLUMNS.split(", "))


@query("traits_donor_status", f"{TRAITS} SELECT profile_id, days_since_last_gift, previous_gift_date, donor_status FROM traits")
def _(v):
    return traits_of(v).select("profile_id", "days_since_last_gift", "previous_gift_date", "donor_status")


@query("traits_rfm", f"{TRAITS}, {RFM} SELECT t.profile_id, rfm_recency, rfm_frequency, rfm_monetary, rfm_score FROM traits t LEFT JOIN rfm USING (profile_id)")
def _(v):
    return T.rfm(traits_of(v))


@query("traits_event_rollup", f"WITH {EVENTS} SELECT * FROM ev")
def _(v):
    return T.event_rollup(v.profiles, v.events_in, AS_OF, VIDEO)


@query("traits_source_keys", f"WITH {KEYS} SELECT * FROM ks")
def _(v):
    return T.source_keys(v.profiles, v.sources, v.source_records.filter("profile_id IS NOT NULL"), v.gifts, v.events_in)


@query("traits_last_channel", f"WITH {BASE}, {LAST} SELECT profile_id, last_engagement_channel FROM le")
def _(v):
    return T.last_channel(v.profiles, v.gifts, v.events_in, v.sources, AS_OF)


@query("profile_traits_full", f"""{TRAITS}, {RFM}, {EVENTS}, {KEYS}, {LAST} SELECT t.*, rfm_recency, rfm_frequency, rfm_monetary, rfm_score, event_count_30d, last_event_at, video_views_30d, source_keys, last_engagement_channel
  FROM traits t LEFT JOIN rfm USING (profile_id) LEFT JOIN ev USING (profile_id) LEFT JOIN ks USING (profile_id) LEFT JOIN le USING (profile_id)""")
def _(v):
    return T.full_traits(v.profiles, v.gifts, v.events_in, v.source_records.filter("profile_id IS NOT NULL"), v.sources, AS_OF, VIDEO)


@query("traits_incremental", f"{TRAITS}, {RFM} SELECT t.profile_id, donor_status, rfm_score FROM traits t LEFT JOIN rfm USING (profile_id) WHERE t.profile_id IN (SELECT profile_id FROM events_in WHERE day >= DATE '2001-07-25')")
def _(v):
    dirty = v.events_in.filter(F.col("day") >= F.lit(dt.date(2001, 7, 25)))
    return T.incremental_traits(traits_of(v), dirty).select("profile_id", "donor_status", "rfm_score")


SNAP = "count(*) AS profile_count, CAST(sum(ltv_total) AS DECIMAL(18,2)) AS ltv_sum, CAST(sum(gift_amount_12m) AS DECIMAL(18,2)) AS giving_12m_sum"


@query("trait_snapshot_month", f"{TRAITS} SELECT DATE '2001-08-01' AS month, donor_status, {SNAP} FROM traits GROUP BY donor_status")
def _(v):
    return T.snapshot(traits_of(v), AS_OF.replace(day=1))


BACKFILL = """WITH months AS (SELECT CAST(m AS DATE) AS month, least(CAST(m + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE), DATE '2001-08-01') AS month_end FROM generate_series(TIMESTAMP '1999-09-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH) AS t(m)),
pm AS (SELECT p.id AS profile_id, month, month_end FROM profiles p CROSS JOIN months),
og AS (SELECT pm.*, g.amount, g.gift_date, g.is_refund, lag(g.gift_date) OVER (PARTITION BY pm.profile_id, month, g.is_refund ORDER BY g.gift_date, g.id) AS prev,
  row_number() OVER (PARTITION BY pm.profile_id, month, g.is_refund ORDER BY g.gift_date DESC, g.id DESC) AS k FROM pm LEFT JOIN gifts g ON g.profile_id = pm.profile_id AND g.gift_date <= pm.month_end),
st AS (SELECT profile_id, month, month_end, coalesce(sum(amount), 0) AS ltv, coalesce(sum(amount) FILTER (WHERE gift_date >= month_end - 364), 0) AS y, min(gift_date) FILTER (WHERE NOT is_refund) AS f, max(gift_date) FILTER (WHERE NOT is_refund) AS l,
  max(prev) FILTER (WHERE NOT is_refund AND k = 1) AS p FROM og GROUP BY ALL),
cs AS (SELECT *, CASE WHEN l IS NULL THEN 'prospect' WHEN month_end - l <= 365 AND f >= month_end - 365 THEN 'new' WHEN month_end - l <= 365 AND l - p > 730 THEN 'reactivated' WHEN month_end - l <= 365 THEN 'active' WHEN month_end - l <= 730 THEN 'lapsing' ELSE 'lapsed' END AS donor_status FROM st)
SELECT month, donor_status, count(*) AS profile_count, CAST(sum(ltv) AS DECIMAL(18,2)) AS ltv_sum, CAST(sum(y) AS DECIMAL(18,2)) AS giving_12m_sum FROM cs GROUP BY month, donor_status"""


@query("trait_snapshot_backfill", BACKFILL)
def _(v):
    return T.backfill(v.profiles, v.gifts, AS_OF)


@query("status_over_time", BACKFILL.replace("SELECT month, donor_status, count", "SELECT month, donor_status AS status, count").replace("FROM cs GROUP", "FROM cs WHERE month BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP"))
def _(v):
    return T.backfill(v.profiles, v.gifts, AS_OF).filter("month BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'").withColumnRenamed("donor_status", "status")


@query("attr_projection", """WITH k AS (SELECT unnest(['plan', 'score', 'vip']) AS key), vals AS (SELECT profile_id, k.key, json_extract_string(attributes, concat('$.', k.key)) AS val, priority, updated_at, r.id
  FROM source_records r JOIN sources s ON s.id = r.source_id CROSS JOIN k WHERE profile_id IS NOT NULL),
w AS (SELECT profile_id, key, val FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, key ORDER BY priority, updated_at DESC, id) AS n FROM vals WHERE val IS NOT NULL) WHERE n = 1)
SELECT p.profile_id, max(val) FILTER (WHERE key = 'plan') AS attr_plan, CAST(nullif(trim(max(val) FILTER (WHERE key = 'score')), '') AS DOUBLE) AS attr_score, CAST(max(val) FILTER (WHERE key = 'vip') AS BOOLEAN) AS attr_vip
FROM (SELECT DISTINCT profile_id FROM source_records WHERE profile_id IS NOT NULL) p LEFT JOIN w USING (profile_id) GROUP BY p.profile_id""")
def _(v):
    won = T.attribute_winner(v.source_records, v.sources, ("plan", "score", "vip"))
    return won.select("profile_id", F.col("plan").alias("attr_plan"), F.expr("try_cast(nullif(trim(score), '') AS double)").alias("attr_score"), F.expr("try_cast(vip AS boolean)").alias("attr_vip"))


@query("last_donation_at", """SELECT profile_id, max(occurred_at) AS last_donation_at FROM events_in e WHERE name = 'purchase' AND NOT EXISTS (SELECT 1 FROM events_in r WHERE r.name = 'error' AND r.profile_id = e.profile_id AND r.source_id = e.source_id AND r.donation_id = e.donation_id) GROUP BY profile_id""")
def _(v):
    return T.last_donation_at(v.events_in, "purchase", "error")
