"""Queries of the import rules and of the identity steps that follow them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pledgework.functions import addresses as A
from pledgework.functions import validation as V
from pledgework.operators import identity as I
from pledgework.operators import linking as L
from pledgework.plans.identity_queries import KEYS, REACH, kept
from pledgework.plans.registry import query
from pledgework.sources import mapping as M


def names(*tests: str) -> str:
    """SQL of a sorted list of names whose test holds, joined."""
    return "concat_ws(',', " + ", ".join(tests) + ")"


@query("required_fields_gift", f"SELECT id, {names('CASE WHEN id % 5 = 0 THEN ' + repr('amount') + ' END', 'CASE WHEN gift_date IS NULL THEN ' + repr('gift_date') + ' END')} AS missing FROM gifts")
def _(v):
    g = v.gifts.withColumn("amount", F.expr("CASE WHEN id % 5 <> 0 THEN amount END"))
    return g.select("id", F.array_join(V.required_errors("gift", {"amount": F.col("amount"), "gift_date": F.col("gift_date")}), ",").alias("missing"))


CONSENT_IN = "SELECT id, CASE WHEN id % 7 = 0 THEN 'fax' WHEN id % 11 = 0 THEN '' ELSE channel END AS channel, CASE WHEN id % 5 = 0 THEN 'maybe' ELSE status END AS status, CASE WHEN id % 13 <> 0 THEN captured_at END AS captured_at, CASE WHEN id % 3 <> 0 THEN concat('p', profile_id) END AS external_id FROM consent_rows"


@query("consent_row_errors", f"WITH c AS ({CONSENT_IN}) SELECT id, {names('CASE WHEN channel = ' + repr('') + ' THEN ' + repr('channel') + ' END', 'CASE WHEN captured_at IS NULL THEN ' + repr('captured_at') + ' END', 'CASE WHEN external_id IS NULL THEN ' + repr('identifier') + ' END')} AS missing, {names('CASE WHEN channel = ' + repr('fax') + ' THEN ' + repr('channel') + ' END', 'CASE WHEN status = ' + repr('maybe') + ' THEN ' + repr('status') + ' END')} AS unknown FROM c")
def _(v):
    c = v.consent_rows.selectExpr("id", "CASE WHEN id % 7 = 0 THEN 'fax' WHEN id % 11 = 0 THEN '' ELSE channel END AS channel", "CASE WHEN id % 5 = 0 THEN 'maybe' ELSE status END AS status", "CASE WHEN id % 13 <> 0 THEN captured_at END AS captured_at", "CASE WHEN id % 3 <> 0 THEN concat('p', profile_id) END AS external_id")
    fields = {n: F.col(n) for n in ("channel", "status", "captured_at", "external_id")}
    return c.select("id", F.array_join(V.required_errors("consent", fields), ",").alias("missing"), F.array_join(V.consent_errors(F.col("channel"), F.col("status")), ",").alias("unknown"))


@query("contact_without_content", "SELECT id FROM source_records WHERE email IS NULL AND phone IS NULL AND coalesce(first_name, '') = '' AND login_id IS NULL")
def _(v):
    return v.source_records.filter(V.contact_is_empty(*map(F.col, ("email", "phone", "first_name", "login_id")))).select("id")


@query("model_dates_missing", "SELECT profile_id, concat_ws(',', CASE WHEN rfm_date IS NULL THEN 'rfm_date' END, CASE WHEN profile_id % 2 = 0 THEN 'wealth_score_model_date' END) AS missing FROM audit_attributes")
def _(v):
    a = v.audit_attributes
    pairs = F.map_filter(F.create_map(F.lit("rfm_recency_score"), F.col("rfm_recency_score").cast("string"), F.lit("rfm_date"), F.col("rfm_date").cast("string"), F.lit("wealth_score"), F.col("wealth_score").cast("string"), F.lit("wealth_score_model_date"), F.expr("CASE WHEN profile_id % 2 = 1 THEN '2001-01-01' END")), lambda k, x: x.isNotNull())
    return a.select("profile_id", F.array_join(V.model_date_errors(pairs), ",").alias("missing"))


@query("parse_timestamps", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 500 MINUTE ELSE CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 620 MINUTE END AS at FROM orders")
def _(v):
    text = F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(o_orderdate AS DATE), 'T10:20:00Z') WHEN 1 THEN concat(CAST(o_orderdate AS DATE), ' 10:20') WHEN 2 THEN concat(CAST(o_orderdate AS DATE), 'T10:20:00+02:00') ELSE concat(CAST(o_orderdate AS DATE), ' noon') END")
    return v.orders.select(F.col("o_orderkey").alias("id"), V.parse_timestamp(text).cast("timestamp_ntz").alias("at"))


@query("row_hashes", "SELECT id, sha256('{\"email\":\"' || coalesce(email, '') || '\",\"id\":\"' || id || '\",\"last_name\":\"' || last_name || '\"}') AS raw_hash FROM source_records")
def _(v):
    return v.source_records.select("id", V.row_hash("id", "email", "last_name").alias("raw_hash"))


@query("was_normalized", "SELECT id, coalesce(lower(trim(raw)) <> raw, false) AS changed FROM (SELECT id, CASE WHEN id % 2 = 0 THEN upper(email) ELSE email END AS raw FROM source_records)")
def _(v):
    raw = F.expr("CASE WHEN id % 2 = 0 THEN upper(email) ELSE email END")
    return v.source_records.select("id", V.was_normalized((raw, F.lower(F.trim(raw)))).alias("changed"))


@query("hard_bounce_flags", "SELECT id, id % 6 < 4 AS bounced FROM source_records")
def _(v):
    return v.source_records.select("id", V.is_hard_bounce(F.expr("CASE id % 6 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'ON' WHEN 2 THEN '1' WHEN 3 THEN 'true' WHEN 4 THEN 'no' END")).alias("bounced"))


SHORT = "(VALUES " + ", ".join(f"('{s}', '{n}')" for s, n in V.NICKNAMES.items()) + ") AS nick(short, long)"


@query("nicknames", f"SELECT id, coalesce(long, lower(first)) AS first_name FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'Bob' WHEN 1 THEN 'LIZZY' WHEN 2 THEN 'Jan' ELSE 'cathy' END AS first FROM source_records) LEFT JOIN {SHORT} ON short = lower(first)")
def _(v):
    return v.source_records.select("id", V.nickname(F.expr("CASE id % 4 WHEN 0 THEN 'Bob' WHEN 1 THEN 'LIZZY' WHEN 2 THEN 'Jan' ELSE 'cathy' END")).alias("first_name"))


ADDRESS_IN = """SELECT id, CASE id % 6 WHEN 0 THEN concat(1 + id % 90, ' North Main Street') WHEN 1 THEN concat(1 + id % 90, ' n. main st') WHEN 2 THEN concat(1 + id % 90, ' Main Ave Apt 4b') WHEN 3 THEN 'PO Box 12' WHEN 4 THEN concat(1 + id % 90, ' Oak Road') END AS line1,
 CASE WHEN id % 12 = 4 THEN 'Unit 7' END AS line2, CASE WHEN id % 5 <> 0 THEN 'Illinois' ELSE 'il' END AS region, concat('6', lpad(concat('', id % 1000), 4, '0'), '-1234') AS zip FROM source_records"""


@query("address_keys", f"""WITH a AS ({ADDRESS_IN}), s AS (SELECT id, concat('', 1 + id % 90) AS number, CASE id % 6 WHEN 0 THEN 'N MAIN ST' WHEN 1 THEN 'N MAIN ST' WHEN 2 THEN 'MAIN AVE' WHEN 4 THEN 'OAK RD' END AS street, CASE WHEN id % 6 = 2 THEN '4B' WHEN id % 12 = 4 THEN '7' ELSE '' END AS unit, substr(zip, 1, 5) AS zip5 FROM a)
SELECT id, street, nullif(unit, '') AS unit, CASE WHEN street IS NOT NULL THEN concat('addr_', sha256(concat_ws('|', number, street, unit, 'SPRINGFIELD', 'IL', zip5))) END AS address_key FROM s""")
def _(v):
    a = v.source_records.selectExpr("id", "CASE id % 6 WHEN 0 THEN concat(1 + id % 90, ' North Main Street') WHEN 1 THEN concat(1 + id % 90, ' n. main st') WHEN 2 THEN concat(1 + id % 90, ' Main Ave Apt 4b') WHEN 3 THEN 'PO Box 12' WHEN 4 THEN concat(1 + id % 90, ' Oak Road') END AS line1", "CASE WHEN id % 12 = 4 THEN 'Unit 7' END AS line2", "CASE WHEN id % 5 <> 0 THEN 'Illinois' ELSE 'il' END AS region", "concat('6', lpad(concat('', id % 1000), 4, '0'), '-1234') AS zip")
    a = A.with_parts(a, V.both_lines(F.col("line1"), F.col("line2")), "found")
    got = a.withColumn("x", V.address(F.col("line1"), F.col("line2"), F.lit("Springfield"), F.col("region"), F.col("zip"), F.lit(None), F.col("found")))
    return got.select("id", F.when(F.col("x.address_key").isNotNull(), F.col("x.street")).alias("street"), F.when(F.col("x.address_key").isNotNull(), F.col("x.unit")).alias("unit"), "x.address_key")


@query("meta_rows", "SELECT sha256(CAST(id AS VARCHAR)) AS external_id, CASE WHEN email IS NULL THEN '' ELSE sha256(email) END AS email, CASE WHEN phone IS NULL THEN '' ELSE sha256(ltrim(phone, '+')) END AS phone, sha256('lee') AS ln, sha256('tx') AS st FROM profiles")
def _(v):
    p = v.profiles
    got = V.meta_row(F.col("email"), F.col("phone"), F.col("first_name"), F.col("last_name"), F.col("postal_code"), F.lit("Dallas"), F.lit("Texas"), F.lit("US"), F.col("id"))
    return p.select(*[got[n].alias(n) for n in ("external_id", "email", "phone", "ln", "st")])


# identity steps

HASHED = "he AS (SELECT id, kind, value FROM ed UNION ALL SELECT id, 'email_md5', md5(lower(trim(email))) FROM source_records WHERE coalesce(trim(email), '') <> '' UNION ALL SELECT id, 'email_sha256', sha256(lower(trim(email))) FROM source_records WHERE coalesce(trim(email), '') <> '')"


@query("identity_hash_edges", f"{REACH.split(', nb AS')[0].replace('WITH RECURSIVE', 'WITH')}, {HASHED}, gone AS (SELECT id FROM ed WHERE kind = 'email' EXCEPT SELECT id FROM kept WHERE kind = 'email') SELECT id, kind, value FROM he WHERE kind LIKE 'email_%' AND id NOT IN (SELECT id FROM gone)")
def _(v):
    found = I.edges(v.source_records, KEYS)
    return L.pruned(L.hash_edges(found), I.blocked(found, v.blocklist), v.blocklist).select("id", "kind", "value")


@query("identity_owner_edges", "SELECT DISTINCT id, 'profile' AS kind, CAST(profile_id AS VARCHAR) AS value FROM source_records WHERE profile_id IS NOT NULL UNION SELECT DISTINCT l.id, 'profile', CAST(o.profile_id AS VARCHAR) FROM source_records l JOIN logins o ON o.value = lower(trim(l.login_id))")
def _(v):
    owners = v.logins.select(F.lit("login").alias("kind"), "value", "profile_id")
    return L.owner_edges(kept(v), owners, v.source_records)


OWN = "ow AS (SELECT DISTINCT label, profile_id FROM cc JOIN source_records USING (id) WHERE profile_id IS NOT NULL), wn AS (SELECT label, arg_min(profile_id, (master_id, profile_id)) AS winner FROM ow JOIN all_profiles p ON p.id = profile_id GROUP BY label)"


@query("identity_moves", f"{REACH}, {OWN} SELECT DISTINCT profile_id AS loser, winner FROM ow JOIN wn USING (label) WHERE profile_id <> winner")
def _(v):
    labels = I.components(kept(v))
    return L.moves(*_owned(v, labels))


@query("identity_assignments", f"{REACH}, {OWN}, nw AS (SELECT label, (SELECT max(id) FROM all_profiles) + row_number() OVER (ORDER BY label) AS winner FROM (SELECT DISTINCT label FROM cc EXCEPT SELECT label FROM wn)) SELECT id, winner AS profile_id FROM cc JOIN (SELECT * FROM wn UNION ALL SELECT * FROM nw) USING (label)")
def _(v):
    labels = I.components(kept(v))
    owned, won = _owned(v, labels)
    top = v.all_profiles.agg(F.max("id")).first()[0]
    return L.assignments(labels, won, top or 0)


def _owned(v, labels):
    owned = labels.join(v.source_records.select("id", "profile_id"), "id").filter("profile_id IS NOT NULL").select("label", "profile_id").distinct()
    return owned, L.winners(owned, v.all_profiles.select(F.col("id").alias("profile_id"), "master_id"))


@query("event_owner_agreed", "SELECT source_id, message_id, min(profile_id) AS profile_id FROM events_in GROUP BY 1, 2 HAVING count(DISTINCT profile_id) = 1")
def _(v):
    return L.agreed_owner(v.events_in.select("source_id", "message_id", "profile_id"))


ASKED = "SELECT c_custkey AS id, concat('sys', CAST(floor(c_custkey / 4) AS BIGINT)) AS login_a, CASE WHEN c_custkey % 3 = 0 THEN concat('sys', CAST(floor(c_custkey / 4) AS BIGINT) + c_custkey % 2) END AS login_b FROM customer"


@query("login_attach", f"WITH q AS ({ASKED}), k AS (SELECT id, 'login_a' AS kind, login_a AS value FROM q UNION ALL SELECT id, 'login_b', login_b FROM q WHERE login_b IS NOT NULL), m AS (SELECT k.id, k.kind, count(DISTINCT l.profile_id) AS n, min(l.profile_id) AS who FROM k LEFT JOIN logins l USING (kind, value) GROUP BY 1, 2) SELECT id, min(who) AS profile_id FROM m GROUP BY id HAVING bool_and(n = 1) AND count(DISTINCT who) = 1")
def _(v):
    asked = v.customer.selectExpr("c_custkey AS id", "concat('sys', CAST(floor(c_custkey / 4) AS BIGINT)) AS login_a", "CASE WHEN c_custkey % 3 = 0 THEN concat('sys', CAST(floor(c_custkey / 4) AS BIGINT) + c_custkey % 2) END AS login_b")
    return L.login_attach(asked, v.logins, ("login_a", "login_b"))


@query("system_key_conflicts", "WITH pr AS (SELECT c_custkey AS l, c_custkey + d AS r FROM customer, (SELECT unnest([1, 2, 4]) AS d)) SELECT DISTINCT l, r FROM pr JOIN logins a ON a.profile_id = l JOIN logins b ON b.profile_id = r AND b.kind = a.kind AND b.value <> a.value UNION SELECT l, r FROM pr WHERE EXISTS (SELECT 1 FROM logins a JOIN logins b ON a.profile_id = b.profile_id AND a.kind = b.kind AND a.value <> b.value WHERE a.profile_id IN (l, r))")
def _(v):
    pairs = v.customer.selectExpr("c_custkey AS l", "explode(array(1, 2, 4)) AS d").selectExpr("l", "l + d AS r")
    return L.conflicting(pairs, v.logins)


OLD = "SELECT p_partkey AS key, p_name AS name, p_brand AS series FROM part WHERE p_partkey % 2 = 0"
BATCH = "SELECT p_partkey % 1500 * 3 AS key, concat(p_name, ' new') AS name, p_type AS series, p_partkey AS line FROM part"


@query("resource_upsert", f"WITH o AS ({OLD}), b AS ({BATCH}), n AS (SELECT key, arg_max(name, line) AS name, arg_max(series, line) AS series FROM b GROUP BY key) SELECT key, CASE WHEN n.key IS NULL THEN o.name ELSE n.name END AS name, CASE WHEN n.key IS NULL THEN o.series ELSE n.series END AS series FROM (SELECT key FROM o UNION SELECT key FROM n) k LEFT JOIN o USING (key) LEFT JOIN n USING (key)".replace("CASE WHEN n.key", "CASE WHEN n.name"))
def _(v):
    part = v.part
    old = part.filter("p_partkey % 2 = 0").selectExpr("p_partkey AS key", "p_name AS name", "p_brand AS series")
    batch = part.selectExpr("p_partkey % 1500 * 3 AS key", "concat(p_name, ' new') AS name", "p_type AS series", "p_partkey AS line")
    return L.resource_upsert(old, batch, "line")


#: Gifts as text, of which some values are wrong in each way that the rules know.
RAW_GIFTS = """SELECT id, CASE id % 11 WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN '12.345' WHEN 4 THEN '$1,250.50' WHEN 5 THEN '1000000000000' ELSE concat('', id % 900, '.25') END AS amount,
  CASE id % 7 WHEN 1 THEN 'not a date' WHEN 2 THEN '03/04/2001' WHEN 3 THEN 'Jan 05, 2001' WHEN 4 THEN '04/04/2001' WHEN 5 THEN '' ELSE concat('', gift_date) END AS gift_date,
  CASE id % 5 WHEN 1 THEN 'perhaps' WHEN 2 THEN '' ELSE 'Yes' END AS is_recurring FROM gifts WHERE gift_date IS NOT NULL"""


@query("import_dry_run", f"""WITH g AS ({RAW_GIFTS}), j AS (SELECT id, id % 11 IN (1, 3, 5) AS bad_amount, id % 11 = 2 AS no_amount, id % 7 = 1 AS bad_date, id % 7 = 5 AS no_date, id % 5 = 1 AS bad_flag, CASE id % 7 WHEN 2 THEN 'date_ambiguous' WHEN 3 THEN 'date_fallback_format' WHEN 4 THEN 'date_fallback_format' END AS warning FROM g)
SELECT 'checked' AS kind, '' AS field, count(*) AS n FROM j UNION ALL SELECT 'ok', '', count(*) FROM j WHERE NOT (bad_amount OR no_amount OR bad_date OR no_date OR bad_flag)
UNION ALL SELECT 'error', 'amount', count(*) FROM j WHERE bad_amount OR no_amount HAVING count(*) > 0 UNION ALL SELECT 'error', 'gift_date', count(*) FROM j WHERE bad_date OR no_date HAVING count(*) > 0
UNION ALL SELECT 'error', 'is_recurring', count(*) FROM j WHERE bad_flag HAVING count(*) > 0 UNION ALL SELECT 'warning', concat('gift_date: ', warning), count(*) FROM j WHERE warning IS NOT NULL GROUP BY warning""")
def _(v):
    mod = lambda n, cases, other: f"CASE id % {n} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in cases.items()) + f" ELSE {other} END"
    raw = v.gifts.filter("gift_date IS NOT NULL").select(
        F.expr(mod(11, {1: "abc", 2: "", 3: "12.345", 4: "$1,250.50", 5: "1000000000000"}, "concat('', id % 900, '.25')")).alias("Amount"),
        F.expr(mod(7, {1: "not a date", 2: "03/04/2001", 3: "Jan 05, 2001", 4: "04/04/2001", 5: ""}, "concat('', gift_date)")).alias("Given on"),
        F.expr(mod(5, {1: "perhaps", 2: ""}, "'Yes'")).alias("Recurring?"),
    )
    return M.judged(raw, {"Amount": "amount", "Given on": "gift_date", "Recurring?": "is_recurring"}, "gift", None)


@query("match_staging", "SELECT profile_id, arg_min(city, (priority, -epoch(updated_at), r.id)) FILTER (WHERE coalesce(city, '') <> '') AS address2 FROM source_records r JOIN sources s ON s.id = source_id WHERE profile_id IS NOT NULL GROUP BY 1")
def _(v):
    staged = L.staged(v.source_records.withColumn("address2", F.col("city")).withColumn("dob", F.lit(None).cast("string")), v.sources)
    return staged.select("profile_id", "address2")


@query("households_by_address", "WITH k AS (SELECT DISTINCT profile_id, concat('hh_', sha256(concat('addr_', sha256(concat_ws('|', split_part(address1, ' ', 1), 'MAIN ST', '', upper(city), 'IL', postal_code)), '|', lower(last_name)))) AS household_id FROM source_records WHERE profile_id IS NOT NULL AND address1 IS NOT NULL AND city IS NOT NULL) SELECT profile_id, household_id, count(*) OVER (PARTITION BY household_id) AS household_size FROM k")
def _(v):
    r = v.source_records.filter("profile_id IS NOT NULL AND city IS NOT NULL")
    r = A.with_parts(r, V.both_lines(F.col("address1"), F.lit(None)), "found")
    keyed = r.withColumn("address_key", V.address(F.col("address1"), F.lit(None), F.col("city"), F.lit("Illinois"), F.col("postal_code"), F.lit("US"), F.col("found"))["address_key"])
    return L.households_of(keyed)
