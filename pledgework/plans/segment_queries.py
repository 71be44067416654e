"""Audience queries: definitions on one side, hand-written SQL on the other."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pledgework.operators import traits as T
from pledgework.operators.consent import consent_winner
from pledgework.plans.registry import query
from pledgework.plans.trait_queries import BASE, EVENTS, ROLLUP, STATUS, VIDEO
from pledgework.segments import ast, templates
from pledgework.segments.compiler import Context, compile_segment, membership_diff
from pledgework.segments.templates import attribute, definition, group, rule, trait
from pledgework.sources.adapter import AS_OF

FIELDS = {
    "profile": {"master_id": ("text", None), "first_name": ("text", None), "last_name": ("text", None), "email": ("text", None), "phone": ("text", None), "region": ("text", None), "segment": ("text", None), "postal_code": ("text", None), "first_seen": ("date", None), "last_seen": ("date", None), "last_contact": ("date", None)},
    "trait": {"gift_count_total": ("number", None), "gift_count_12m": ("number", None), "ltv_total": ("number", None), "gift_amount_12m": ("number", None), "first_gift_date": ("date", None), "last_gift_date": ("date", None), "is_recurring_active": ("boolean", None), "days_since_last_gift": ("number", None), "donor_status": ("enum", T.STATUSES), "video_views_30d": ("number", None), "event_count_30d": ("number", None)},
    "attribute": {"plan": ("text", None), "score": ("number", None), "vip": ("boolean", None)},
    "enrichment": {"score": ("number", None), "band": ("text", None), "since": ("date", None)},
}


AUDITED = {"plan": "text", "plan_update": "text", "has_active_email": "boolean", "donor_account": "text", "lifetime_amount": "number", "has_recurring": "boolean", "rfm_frequency": "number", "account_status": "text", "rfm_date": "date", "rfm_recency_score": "number", "donation_likelihood": "number", "wealth_score": "number", "suggested_amount": "number", "sms_optin": "boolean", "call_optin": "boolean", "sms_optout_date": "date", "vod_active": "boolean", "last_seen": "date", "last_contact": "date"}


def context(v) -> Context:
    """Each table is planned when a rule needs it."""

    def attributes():
        won = T.attribute_winner(v.source_records, v.sources, ("plan", "score", "vip"))
        return won.select("profile_id", "plan", F.expr("try_cast(nullif(trim(score), '') AS double)").alias("score"), F.expr("try_cast(vip AS boolean)").alias("vip"))

    return Context(
        AS_OF,
        v.profiles,
        FIELDS,
        lambda: T.giving_traits(v.profiles, v.gifts, AS_OF).join(T.event_rollup(v.profiles, v.events_in, AS_OF, VIDEO), "profile_id"),
        attributes,
        lambda: v.gifts,
        lambda: v.events_in,
        lambda: consent_winner(v.consent_rows),
        lambda: T.source_keys(v.profiles, v.sources, v.source_records.filter("profile_id IS NOT NULL"), v.gifts, v.events_in),
        lambda: v.enrichment.join(v.sources.select(F.col("id").alias("source_id"), F.col("key").alias("source_key")), "source_id"),
        lambda: v.source_codes,
        logins=lambda: v.logins,
        donation="purchase",
        donation_return="error",
        login_kinds=("login_a", "login_b"),
    )


def audience(name: str, root: dict, sql: str, head: str = "WITH ", columns: str = "p.id AS profile_id"):
    """Registers a definition and the condition that the oracle puts on profiles p."""
    made = definition(root)

    @query(name, f"{head}pp AS (SELECT 1) SELECT {columns} FROM profiles p {sql}")
    def _(v):
        return compile_segment(made, context(v))

    return made


TR = f"WITH {BASE}, {ROLLUP}, {STATUS}, {EVENTS}, "
T_JOIN = "JOIN traits t ON t.profile_id = p.id"
L = templates.lifecycle()
CONSENT = """cw AS (SELECT profile_id, channel, status FROM (SELECT c.*, row_number() OVER (PARTITION BY profile_id, channel ORDER BY CASE WHEN status = 'opted_in' AND authoritative AND (last_out IS NULL OR captured_at > last_out) THEN 3 WHEN status = 'opted_out' THEN 2 WHEN status = 'opted_in' THEN 1 ELSE 0 END DESC, captured_at DESC, id DESC) AS n
  FROM (SELECT *, max(captured_at) FILTER (WHERE status = 'opted_out') OVER (PARTITION BY profile_id, channel) AS last_out FROM consent_rows) c) WHERE n = 1), """

audience("seg_lapsed_high_value", L["lapsed_high_value"]["root"], f"{T_JOIN} WHERE donor_status = 'lapsed' AND ltv_total >= 500", TR)
audience("seg_new_partners", L["new_partners"]["root"], f"{T_JOIN} WHERE first_gift_date >= DATE '2001-05-04' AND first_gift_date < DATE '2001-08-02'", TR)
audience("seg_recurring_partners", L["recurring_partners"]["root"], f"{T_JOIN} WHERE is_recurring_active", TR)
audience("seg_top_5_percent", L["top_5_percent"]["root"], "JOIN rk ON rk.profile_id = p.id WHERE rk <= ceil(CAST(n AS DECIMAL(18,2)) * 0.05)", TR + "rk AS (SELECT profile_id, rank() OVER (ORDER BY gift_amount_12m DESC) AS rk, count(*) OVER () AS n FROM traits WHERE gift_amount_12m > 0), ")
audience("seg_engaged_not_giving", L["engaged_not_giving"]["root"], f"{T_JOIN} JOIN ev ON ev.profile_id = p.id WHERE video_views_30d >= 3 AND gift_count_total = 0", TR)
audience("seg_lapsing_opted_in", L["lapsing_opted_in"]["root"], f"{T_JOIN} JOIN cw ON cw.profile_id = p.id AND channel = 'email' AND status = 'opted_in' WHERE gift_count_12m = 0 AND gift_count_total >= 2", TR + CONSENT)
audience("seg_nested_negate", group("and", group("or", rule("profile", "first_name", "eq", "Ann"), rule("profile", "region", "contains", "_1"), negate=True), group("or", trait("gift_count_total", "gt", 3), rule("profile", "phone", "is_null"))), f"{T_JOIN} WHERE NOT (coalesce(first_name = 'Ann', false) OR coalesce(strpos(region, '_1') > 0, false)) AND (gift_count_total > 3 OR phone IS NULL)", TR)
audience("seg_profile_text", rule("profile", "segment", "in", ["BUILDING", "MACHINERY"]), "WHERE segment IN ('BUILDING', 'MACHINERY')")
audience("seg_gift_count", {"type": "gift", "aggregate": "count", "operator": "gte", "value": 3, "where": {"fund": {"operator": "eq", "value": "F"}, "is_recurring": {"operator": "is_false"}}}, "WHERE (SELECT count(*) FROM gifts g WHERE g.profile_id = p.id AND fund = 'F' AND NOT is_recurring) >= 3")
audience("seg_gift_sum_window", {"type": "gift", "aggregate": "sum", "operator": "lt", "value": 100000, "window": {"kind": "last_days", "days": 365}}, "WHERE coalesce((SELECT sum(amount) FROM gifts g WHERE g.profile_id = p.id AND gift_date BETWEEN DATE '2000-08-02' AND DATE '2001-08-01'), 0) < 100000")
audience("seg_gift_min_null", {"type": "gift", "aggregate": "min", "operator": "lt", "value": 20000, "where": {"amount": {"operator": "gt", "value": 0}}}, "WHERE (SELECT min(amount) FROM gifts g WHERE g.profile_id = p.id AND amount > 0) < 20000")
audience("seg_event_count", {"type": "event", "aggregate": "count", "name": "click", "operator": "between", "value": [5, 12]}, "WHERE (SELECT count(*) FROM events_in e WHERE e.profile_id = p.id AND name = 'click') BETWEEN 5 AND 12")
audience("seg_event_exists_prop", templates.done("view", None, {"properties.k": {"operator": "in", "value": ["1", "7", "33"]}}), "WHERE EXISTS (SELECT 1 FROM events_in e WHERE e.profile_id = p.id AND name = 'view' AND json_extract_string(properties, '$.k') IN ('1', '7', '33'))")
audience("seg_resource_filter", {"type": "gift", "aggregate": "exists", "operator": "is_true", "where": {"source_codes.series": {"operator": "in", "value": ["Brand#4", "Brand#17"]}}}, "WHERE EXISTS (SELECT 1 FROM gifts g JOIN source_codes c ON c.key = g.source_code WHERE g.profile_id = p.id AND c.series IN ('Brand#4', 'Brand#17'))")
audience("seg_donor_unreturned", templates.done("purchase", {"kind": "previous_days", "days": 20}), "WHERE EXISTS (SELECT 1 FROM events_in e WHERE e.profile_id = p.id AND name = 'purchase' AND day >= DATE '2001-07-12' AND day < DATE '2001-08-01' AND NOT EXISTS (SELECT 1 FROM events_in r WHERE r.name = 'error' AND r.profile_id = e.profile_id AND r.source_id = e.source_id AND r.donation_id = e.donation_id))")
audience("seg_consent_unknown", {"type": "consent", "channel": "sms", "status": "unknown"}, "LEFT JOIN cw ON cw.profile_id = p.id AND channel = 'sms' WHERE coalesce(status, 'unknown') = 'unknown'", "WITH " + CONSENT)
audience("seg_source_in", group("and", {"type": "source", "source_key": "asia", "operator": "in"}, {"type": "source", "source_key": "europe", "operator": "not_in"}), "WHERE EXISTS (SELECT 1 FROM ap JOIN sources s ON s.id = source_id WHERE profile_id = p.id AND key = 'asia') AND NOT EXISTS (SELECT 1 FROM ap JOIN sources s ON s.id = source_id WHERE profile_id = p.id AND key = 'europe')", "WITH ap AS (SELECT profile_id, source_id FROM source_records UNION ALL SELECT profile_id, source_id FROM gifts UNION ALL SELECT profile_id, source_id FROM events_in), ")
audience("seg_enrichment_unexpired", {"type": "enrichment", "source": "asia", "field": "score", "operator": "gte", "value": 60}, "WHERE EXISTS (SELECT 1 FROM enrichment e JOIN sources s ON s.id = e.source_id WHERE e.profile_id = p.id AND s.key = 'asia' AND attribute_key = 'score' AND value_num >= 60 AND (license_expires_at IS NULL OR license_expires_at >= DATE '2001-08-01'))")
WON = "vals AS (SELECT profile_id, json_extract_string(attributes, '$.plan') AS plan, json_extract_string(attributes, '$.score') AS score, priority, updated_at, r.id FROM source_records r JOIN sources s ON s.id = r.source_id WHERE profile_id IS NOT NULL), wp AS (SELECT profile_id, plan FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY priority, updated_at DESC, id) AS n FROM vals WHERE plan IS NOT NULL) WHERE n = 1), ws AS (SELECT profile_id, CAST(nullif(trim(score), '') AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY priority, updated_at DESC, id) AS n FROM vals WHERE score IS NOT NULL) WHERE n = 1), "
audience("seg_attribute_winner", group("and", attribute("plan", "starts_with", "Up"), attribute("score", "gte", 40)), "JOIN wp ON wp.profile_id = p.id JOIN ws ON ws.profile_id = p.id WHERE plan LIKE 'Up%' AND score >= 40", "WITH " + WON)
audience("seg_ops_number", group("and", trait("gift_count_total", "neq", 2), trait("gift_count_total", "lte", 9), trait("days_since_last_gift", "gt", 30), trait("ltv_total", "between", [1000, 900000.5])), f"{T_JOIN} WHERE gift_count_total <> 2 AND gift_count_total <= 9 AND days_since_last_gift > 30 AND ltv_total BETWEEN 1000 AND 900000.5", TR)
audience("seg_ops_text", group("and", rule("profile", "first_name", "neq", "Ann"), rule("profile", "last_name", "not_in", ["Lee1", "Lee2"])), "WHERE first_name <> 'Ann' AND last_name NOT IN ('Lee1', 'Lee2')")
audience("seg_date_between", rule("profile", "first_seen", "between", ["1997-01-01", "1998-12-31"]), "WHERE first_seen BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
audience("seg_before_after", group("and", rule("profile", "first_seen", "after", "1996-06-30"), rule("profile", "last_seen", "before", "2001-06-01")), "WHERE first_seen > DATE '1996-06-30' AND last_seen < DATE '2001-06-01'")
audience("seg_not_in_last_days", rule("profile", "last_seen", "not_in_last_days", 90), "WHERE last_seen IS NOT NULL AND NOT (last_seen >= DATE '2001-05-04' AND last_seen <= DATE '2001-08-01')")
audience("seg_active_120", group("or", rule("profile", "last_seen", "within_previous_days", 120), rule("profile", "last_contact", "within_previous_days", 120)), "WHERE (last_seen >= DATE '2001-04-03' AND last_seen < DATE '2001-08-01') OR (last_contact >= DATE '2001-04-03' AND last_contact < DATE '2001-08-01')")
audience("seg_text_contains", group("or", rule("profile", "first_name", "contains", "%_"), rule("profile", "email", "starts_with", "p12")), "WHERE strpos(first_name, '%_') > 0 OR starts_with(email, 'p12')")
audience("seg_is_null", group("and", rule("profile", "email", "is_null"), rule("profile", "phone", "is_not_null")), "WHERE email IS NULL AND phone IS NOT NULL")
audience("seg_exists_nonblank", group("and", rule("profile", "first_name", "exists"), trait("is_recurring_active", "exists")), "WHERE nullif(trim(first_name), '') IS NOT NULL")
audience("seg_prev_5_years", {"type": "gift", "aggregate": "exists", "operator": "is_true", "window": {"kind": "previous_years", "years": 5}}, "WHERE EXISTS (SELECT 1 FROM gifts g WHERE g.profile_id = p.id AND gift_date >= DATE '1996-08-01' AND gift_date < DATE '2001-08-01')")
audience("seg_gift_before_after", group("and", {"type": "gift", "aggregate": "exists", "operator": "is_true", "window": {"kind": "before", "date": "1996-01-01"}}, {"type": "gift", "aggregate": "max", "operator": "gt", "value": 300000, "window": {"kind": "after", "date": "1999-12-31"}}), "WHERE EXISTS (SELECT 1 FROM gifts g WHERE g.profile_id = p.id AND gift_date < DATE '1996-01-01') AND (SELECT max(amount) FROM gifts g WHERE g.profile_id = p.id AND gift_date > DATE '1999-12-31') > 300000")

LHV = "SELECT p.id AS profile_id, t.donor_status FROM profiles p JOIN traits t ON t.profile_id = p.id WHERE donor_status = 'lapsed' AND ltv_total >= 500"
NEW = "SELECT profile_id FROM traits WHERE first_gift_date >= DATE '2001-05-04' AND first_gift_date < DATE '2001-08-02'"
SEEN = definition(rule("profile", "last_seen", "within_previous_days", 120))
SEEN_SQL = "last_seen >= DATE '2001-04-03' AND last_seen < DATE '2001-08-01'"


def members(v, made: dict):
    return compile_segment(made, context(v))


@query("seg_in_segment", f"{TR}a AS ({LHV}) SELECT p.id AS profile_id FROM profiles p WHERE p.id IN (SELECT profile_id FROM a) AND p.phone IS NOT NULL")
def _(v):
    c = context(v)
    c.segments[7] = compile_segment(L["lapsed_high_value"], c)
    return compile_segment(definition(group("and", {"type": "segment", "segment_id": 7, "operator": "in"}, rule("profile", "phone", "is_not_null"))), c)


@query("seg_sample_25", f"SELECT id AS profile_id, email, region FROM profiles WHERE {SEEN_SQL} ORDER BY id LIMIT 25")
def _(v):
    ids = members(v, SEEN).orderBy("profile_id").limit(25)
    return v.profiles.select(F.col("id").alias("profile_id"), "email", "region").join(ids, "profile_id")


@query("seg_breakdown_status", f"{TR}x AS (SELECT 1) SELECT donor_status, count(*) AS profiles FROM profiles p JOIN traits t ON t.profile_id = p.id WHERE {SEEN_SQL} GROUP BY 1")
def _(v):
    c = context(v)
    return compile_segment(SEEN, c).join(c.traits.select("profile_id", "donor_status"), "profile_id").groupBy("donor_status").agg(F.count("*").alias("profiles"))


@query("seg_breakdown_source", f"SELECT s.key AS source, count(DISTINCT p.id) AS profiles FROM profiles p JOIN (SELECT profile_id, source_id FROM source_records UNION ALL SELECT profile_id, source_id FROM gifts UNION ALL SELECT profile_id, source_id FROM events_in) a ON a.profile_id = p.id JOIN sources s ON s.id = a.source_id WHERE {SEEN_SQL} GROUP BY 1")
def _(v):
    c = context(v)
    return compile_segment(SEEN, c).join(c.source_keys, "profile_id").select(F.explode("source_keys").alias("source")).groupBy("source").agg(F.count("*").alias("profiles"))


@query("seg_rule_delta", f"{TR}x AS (SELECT 1) SELECT count(*) FILTER (WHERE donor_status = 'lapsed' AND ltv_total >= 500) AS with_rule, count(*) FILTER (WHERE donor_status = 'lapsed') AS without_rule FROM traits")
def _(v):
    full = L["lapsed_high_value"]
    less = ast.without_rule(full, "root.rules[1]")
    c = context(v)
    one, two = (compile_segment(d, c).agg(F.count("*").alias(n), F.lit(1).alias("k")) for d, n in ((full, "with_rule"), (less, "without_rule")))
    return one.join(two, "k").drop("k")  # one row each


@query("seg_membership_diff", f"{TR}a AS ({LHV}), b AS (SELECT p.id AS profile_id FROM profiles p JOIN traits t ON t.profile_id = p.id WHERE donor_status IN ('lapsed', 'lapsing')) SELECT coalesce(a.profile_id, b.profile_id) AS profile_id, CASE WHEN a.profile_id IS NULL THEN 'add' ELSE 'remove' END AS change FROM a FULL JOIN b USING (profile_id) WHERE a.profile_id IS NULL OR b.profile_id IS NULL")
def _(v):
    c = context(v)
    return membership_diff(compile_segment(L["lapsed_high_value"], c), compile_segment(definition(trait("donor_status", "in", ["lapsed", "lapsing"])), c))


@query("seg_members_page", f"SELECT id AS profile_id FROM profiles WHERE {SEEN_SQL} AND id > 500 ORDER BY id LIMIT 51")
def _(v):
    return members(v, SEEN).filter("profile_id > 500").orderBy("profile_id").limit(51)


@query("field_values_typeahead", "SELECT DISTINCT region AS value FROM profiles WHERE starts_with(lower(region), 'a') OR region LIKE '%I%' ORDER BY 1 LIMIT 200")
def _(v):
    return v.profiles.filter(F.lower("region").startswith("a") | F.col("region").contains("I")).select(F.col("region").alias("value")).distinct().orderBy("value").limit(200)


@query("segment_parity", f"{TR}c AS (SELECT 'lapsed_high_value' AS template, (SELECT count(*) FROM ({LHV})) AS counted, 200 AS supplied UNION ALL SELECT 'new_partners', (SELECT count(*) FROM ({NEW})), 0) SELECT template, counted, CAST(supplied AS BIGINT) AS supplied, counted - supplied AS diff, CASE WHEN supplied = 0 THEN NULL ELSE round(100.0 * (counted - supplied) / supplied, 6) END AS diff_pct FROM c")
def _(v):
    c = context(v)
    rows = None
    for name, supplied in (("lapsed_high_value", 200), ("new_partners", 0)):
        one = compile_segment(L[name], c).agg(F.count("*").alias("counted")).select(F.lit(name).alias("template"), "counted", F.lit(supplied).cast("bigint").alias("supplied"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("diff", F.col("counted") - F.col("supplied")).withColumn("diff_pct", F.when(F.col("supplied") != 0, F.round(100.0 * F.col("diff") / F.col("supplied"), 6)))


# the 23 audited audiences, over attributes of their own
FIVE = "DATE '1996-08-01'"
BOUGHT = "EXISTS (SELECT 1 FROM events_in e WHERE e.profile_id = p.id AND name = 'purchase' AND day >= DATE '2001-08-01' - {n} AND day < DATE '2001-08-01' AND NOT EXISTS (SELECT 1 FROM events_in b WHERE b.name = 'error' AND b.profile_id = e.profile_id AND b.source_id = e.source_id AND b.donation_id = e.donation_id))"
PLAN, ACTIVE_DAYS = "a.plan IN ('basic', 'premium_monthly', 'premium_annual')", "{c} >= DATE '2001-08-01' - 120 AND {c} < DATE '2001-08-01'"
CONDITIONS = {
    "all_reference": "p.master_id IS NOT NULL", "has_active_email": "a.has_active_email", "active_120": " OR ".join(f"({ACTIVE_DAYS.format(c='a.' + c)})" for c in ("last_seen", "last_contact")),
    "app_members": PLAN, "free_members": "a.plan = 'basic'", "premium_members": "a.plan IN ('premium_monthly', 'premium_annual')", "upgraders": "a.plan_update LIKE 'Upgrade%'",
    "app_non_donors": f"{PLAN} AND a.donor_account IS NULL AND NOT {BOUGHT.format(n=720)}", "app_donors": f"{PLAN} AND {BOUGHT.format(n=720)}",
    "basic_donors": "a.plan = 'basic' AND a.donor_account IS NOT NULL AND a.lifetime_amount > 0", "basic_recurring": "a.plan = 'basic' AND a.has_recurring", "basic_one_time": "a.plan = 'basic' AND a.rfm_frequency = 1",
    "rfm_all": "a.account_status IS NOT NULL AND a.rfm_date IS NOT NULL", "rfm_lapsed": "a.rfm_recency_score = 0", "partner_non_donors": "a.donor_account IS NOT NULL AND a.rfm_date IS NULL", "past_30_donors": BOUGHT.format(n=30),
    "legacy_prospects": f"a.donation_likelihood > 0.75 AND a.wealth_score > 4 AND a.suggested_amount > 500 AND EXISTS (SELECT 1 FROM events_in e WHERE e.profile_id = p.id AND name = 'purchase' AND day >= {FIVE} AND day < DATE '2001-08-01')",
    "giving_day": "EXISTS (SELECT 1 FROM events_in e WHERE e.profile_id = p.id AND name = 'purchase' AND day = DATE '2001-07-04' AND json_extract_string(properties, '$.source_code') IN ('gd1', 'gd2', 'gd3', 'gd4'))",
    "mobile_subscribed": "a.sms_optin AND coalesce(trim(p.phone), '') <> ''", "call_center_optins": "a.call_optin AND coalesce(trim(p.phone), '') <> ''", "sms_optouts": "a.sms_optout_date IS NOT NULL", "vod_optouts": "NOT a.vod_active",
    "vod_viewers": "EXISTS (SELECT 1 FROM events_in e WHERE e.profile_id = p.id AND name = 'view')",
}


def audited_context(v) -> Context:
    c = context(v)
    c.fields = FIELDS | {"attribute": {k: (t, None) for k, t in AUDITED.items()}}
    c.attributes = v.audit_attributes
    return c


def audited_audience(key: str, made: dict, sql: str):
    @query(f"seg_audited_{key}", f"SELECT p.id AS profile_id FROM profiles p LEFT JOIN audit_attributes a ON a.profile_id = p.id WHERE {sql}")
    def _(v):
        return compile_segment(made, audited_context(v))


for _key, _made in templates.audited("purchase", "view", "2001-07-04").items():
    audited_audience(_key, _made, CONDITIONS[_key])

audience("seg_login_presence", attribute("login_a", "exists"), "WHERE EXISTS (SELECT 1 FROM logins l WHERE l.profile_id = p.id)")
audience("seg_login_of_provider", attribute("login_b", "starts_with", "sys1"), "WHERE EXISTS (SELECT 1 FROM logins l WHERE l.profile_id = p.id AND kind = 'login_b' AND value LIKE 'sys1%')")
