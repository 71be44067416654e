"""Queries of refreshes, the trait catalogue, fields that may leave, mappings and lookup files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pledgework.operators import catalogue, fields
from pledgework.operators import traits as T
from pledgework.plans.registry import query
from pledgework.plans.segment_queries import LHV, SEEN, SEEN_SQL, TR, context
from pledgework.plans.trait_queries import BASE, EVENTS, KEYS, LAST, RFM, ROLLUP, STATUS, TRAITS, VIDEO, traits_of
from pledgework.segments import lifecycle, templates
from pledgework.segments.templates import definition, group, rule
from pledgework.sources import filedrop
from pledgework.sources.adapter import AS_OF

# three audiences that read each other, refreshed over members of before
KNOWN = {
    1: lifecycle.Audience(1, "lapsed", templates.lifecycle()["lapsed_high_value"], "active"),
    2: lifecycle.Audience(2, "seen", SEEN, "active"),
    3: lifecycle.Audience(3, "seen, not lapsed", definition(group("and", *[{"type": "segment", "segment_id": i, "operator": o} for i, o in ((2, "in"), (1, "not_in"))], rule("profile", "email", "is_not_null"))), "active"),
}
NOW = f"{TR}one AS ({LHV}), two AS (SELECT id AS profile_id FROM profiles WHERE {SEEN_SQL}), cur AS (SELECT 1 AS segment_id, profile_id FROM one UNION ALL SELECT 2, profile_id FROM two UNION ALL SELECT 3, id FROM profiles WHERE email IS NOT NULL AND id IN (SELECT profile_id FROM two) AND id NOT IN (SELECT profile_id FROM one))"


@query("seg_refresh_members", f"{NOW} SELECT CAST(segment_id AS BIGINT) AS segment_id, profile_id FROM cur")
def _(v):
    return lifecycle.stacked(lifecycle.compiled(KNOWN, [3], context(v), cut=True), v.spark)


@query("seg_refresh_counts", f"{NOW}, old AS (SELECT 1 + id % 3 AS segment_id, id AS profile_id FROM profiles) SELECT CAST(coalesce(c.segment_id, o.segment_id) AS BIGINT) AS segment_id, count(c.profile_id) AS members, count(*) FILTER (WHERE o.profile_id IS NULL) AS added, count(*) FILTER (WHERE c.profile_id IS NULL) AS removed FROM cur c FULL JOIN old o ON o.segment_id = c.segment_id AND o.profile_id = c.profile_id GROUP BY 1")
def _(v):
    old = v.profiles.selectExpr("CAST(1 + id % 3 AS BIGINT) AS segment_id", "id AS profile_id")
    return lifecycle.counted(old, lifecycle.stacked(lifecycle.compiled(KNOWN, [3], context(v), cut=True), v.spark))


FULL = f"{TRAITS}, {RFM}, {EVENTS}, {KEYS}, {LAST}, full_traits AS (SELECT t.*, rfm_recency, rfm_frequency, rfm_monetary, rfm_score, event_count_30d, last_event_at, video_views_30d, nullif(len(source_keys), 0) AS source_keys, last_engagement_channel FROM traits t LEFT JOIN rfm USING (profile_id) LEFT JOIN ev USING (profile_id) LEFT JOIN ks USING (profile_id) LEFT JOIN le USING (profile_id))"
HAVE = [t for t in catalogue.TRAITS if t.key != "computed_at"]


@query("trait_coverage", f"{FULL} SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t.key}' AS key, '{t.label}' AS label, '{t.type}' AS type, count({t.key}) AS filled, count(*) AS profiles FROM full_traits" for t in HAVE) + ")")
def _(v):
    return catalogue.coverage(T.full_traits(v.profiles, v.gifts, v.events_in, v.source_records.filter("profile_id IS NOT NULL"), v.sources, AS_OF, VIDEO))


DIRTY = "SELECT profile_id FROM events_in WHERE day >= DATE '2001-07-25'"


@query("traits_month_opening", f"{TRAITS} SELECT 'opens' AS run, profile_id, donor_status FROM traits UNION ALL SELECT 'goes on', profile_id, donor_status FROM traits WHERE profile_id IN ({DIRTY})")
def _(v):
    """The month of AS_OF without a snapshot of it, then with one."""
    dirty = v.events_in.filter(F.col("day") >= F.lit(dt.date(2001, 7, 25)))
    past = T.backfill(v.profiles, v.gifts, AS_OF).select("month")
    traits = traits_of(v).select("profile_id", "donor_status")
    out = [traits.join(catalogue.to_compute(v.profiles, dirty, snapshots, AS_OF), "profile_id").select(F.lit(run).alias("run"), "*") for run, snapshots in (("opens", past.filter(F.col("month") < F.lit(AS_OF.replace(day=1)))), ("goes on", past))]
    return out[0].unionByName(out[1])


SOURCES = "src AS (SELECT id, key, CASE WHEN id <> 1 THEN id <> 2 END AS is_active, id <> 3 AS exportable, CASE WHEN id = 4 THEN DATE '2001-08-01' END AS license_expires_at FROM sources)"
LIVE = "live_src AS (SELECT * FROM src WHERE coalesce(is_active, true) AND exportable AND (license_expires_at IS NULL OR license_expires_at >= DATE '2001-08-01'))"


def sources_of(v):
    return v.sources.selectExpr("id", "key", "CASE WHEN id <> 1 THEN id <> 2 END AS is_active", "id <> 3 AS exportable", "CASE WHEN id = 4 THEN DATE '2001-08-01' END AS license_expires_at")


@query("export_fields_offered", f"WITH {SOURCES}, {LIVE} SELECT s.key AS source, attribute_key AS key, bool_or(e.profile_id % 500 = 3 AND attribute_key = 'band') AS sensitive FROM enrichment e JOIN live_src s ON s.id = e.source_id GROUP BY 1, 2")
def _(v):
    return fields.offered(v.enrichment.withColumn("sensitive", F.expr("profile_id % 500 = 3 AND attribute_key = 'band'")), sources_of(v), AS_OF)


MAPPING = {
    "Mail": {"kind": "profile", "key": "email", "required": True}, "Master": {"kind": "profile", "key": "master_id"}, "Giving": {"kind": "trait", "key": "ltv_total"}, "Status": {"kind": "trait", "key": "donor_status"},
    "Sources": {"kind": "trait", "key": "source_keys"}, "Plan": {"kind": "canonical", "key": "plan"}, "Score": {"kind": "enrichment", "source": "africa", "key": "score"}, "Since": {"kind": "enrichment", "source": "middle east", "key": "since"},
    "Asia": {"kind": "enrichment", "source": "asia", "key": "score"}, "Campaign": {"kind": "constant", "value": "spring"},
}
PICKED = "(SELECT e.profile_id, arg_max(val, imported_at) AS val FROM (SELECT *, coalesce(value_text, CAST(value_num AS VARCHAR), CAST(value_date AS VARCHAR)) AS val FROM enrichment WHERE license_expires_at IS NULL OR license_expires_at >= DATE '2001-08-01') e JOIN live_src s ON s.id = e.source_id WHERE s.key = '{}' AND attribute_key = '{}' GROUP BY 1)"
PLANS = "won AS (SELECT profile_id, plan FROM (SELECT profile_id, json_extract_string(attributes, '$.plan') AS plan, row_number() OVER (PARTITION BY profile_id ORDER BY priority, updated_at DESC, r.id) AS n FROM source_records r JOIN sources s ON s.id = r.source_id WHERE profile_id IS NOT NULL AND json_extract_string(attributes, '$.plan') IS NOT NULL) WHERE n = 1)"


@query("export_mapped", f"""WITH {BASE}, {ROLLUP}, {STATUS}, {KEYS}, {SOURCES}, {LIVE}, {PLANS}
SELECT p.id AS profile_id, coalesce(email, '') = '' AS missing, email AS "Mail", master_id AS "Master", CAST(ltv_total AS VARCHAR) AS "Giving", donor_status AS "Status", CAST(to_json(source_keys) AS VARCHAR) AS "Sources", plan AS "Plan", a.val AS "Score", b.val AS "Since", c.val AS "Asia", 'spring' AS "Campaign"
FROM profiles p JOIN traits t ON t.profile_id = p.id JOIN ks ON ks.profile_id = p.id LEFT JOIN won ON won.profile_id = p.id LEFT JOIN {PICKED.format('africa', 'score')} a ON a.profile_id = p.id LEFT JOIN {PICKED.format('middle east', 'since')} b ON b.profile_id = p.id LEFT JOIN {PICKED.format('asia', 'score')} c ON c.profile_id = p.id""")
def _(v):
    traits = traits_of(v).join(T.source_keys(v.profiles, v.sources, v.source_records.filter("profile_id IS NOT NULL"), v.gifts, v.events_in), "profile_id")
    return fields.mapped(v.profiles, MAPPING, AS_OF, traits, T.attribute_winner(v.source_records, v.sources, ("plan",)), v.enrichment, sources_of(v))


# files of a hundred keys each; of every eleven one has a wrong heading and one an invalid key
LINES = "SELECT id, CAST(floor(id / 100) AS BIGINT) AS file, coalesce(login_id, concat('none', id)) AS value, CASE WHEN floor(id / 100) % 11 = 4 THEN 'login_id' WHEN floor(id / 100) % 2 = 0 THEN 'okta_customer_id' ELSE 'donor_account_numbers' END AS head FROM source_records"


@query("lookup_files", f"WITH li AS ({LINES}), owners AS (SELECT login_id AS value, count(DISTINCT profile_id) AS n, min(profile_id) AS p FROM source_records WHERE login_id IS NOT NULL AND profile_id IS NOT NULL AND source_id IN (0, 1, 2) GROUP BY 1) SELECT concat('f', file, '.csv') AS name, li.value, CASE head WHEN 'okta_customer_id' THEN head ELSE 'donor_account_number' END AS key_type, CASE WHEN head <> 'okta_customer_id' OR coalesce(n, 0) = 0 THEN 'unknown' WHEN n = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 AND head = 'okta_customer_id' THEN p END AS profile_id, count(*) AS times FROM li LEFT JOIN owners USING (value) WHERE file % 11 NOT IN (4, 7) GROUP BY ALL")
def _(v):
    lines = v.source_records.selectExpr("CAST(floor(id / 100) AS BIGINT) AS file", "id", "coalesce(login_id, concat('none', id)) AS value")
    # at most a hundred lines a file
    text = lines.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "value"))), lambda x: x["value"]), "\r\n").alias("lines"))
    head = F.expr("CASE WHEN file % 11 = 4 THEN 'login_id' WHEN file % 2 = 0 THEN 'okta_customer_id' ELSE 'donor_account_numbers' END")
    files = text.select(F.format_string("f%d.csv", "file").alias("name"), F.concat(head, F.lit("\r\n"), "lines", F.expr("CASE WHEN file % 11 = 7 THEN '\r\na,b' ELSE '' END")).cast("binary").alias("content"))
    keys, judged = filedrop.cut(files)
    owners = v.source_records.filter("login_id IS NOT NULL AND profile_id IS NOT NULL AND source_id IN (0, 1, 2)").select(F.lit("okta_customer_id").alias("key_type"), F.col("login_id").alias("value"), "profile_id")
    return filedrop.answered(keys, owners).join(judged.select("name", "digest"), "digest").groupBy("name", "value", "key_type", "status", "profile_id").agg(F.count("*").alias("times"))
