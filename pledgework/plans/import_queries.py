"""Row validation, normalisation, deduplication and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pledgework.functions import normalize as N
from pledgework.operators import records as R
from pledgework.operators import upserts as U
from pledgework.operators.consent import consent_winner
from pledgework.plans.registry import query
from pledgework.plans.segment_queries import CONSENT
from pledgework.sources.adapter import AS_OF

RAW = """SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN concat('  User', c_custkey, '@EX.org ') WHEN 1 THEN concat('a..b', c_custkey, '@ex.org') WHEN 2 THEN 'not an address' WHEN 3 THEN NULL WHEN 4 THEN concat('x+t', c_custkey, '@sub.ex-1.org') WHEN 5 THEN concat('f.l', c_custkey, '@gmail.com') ELSE concat('.a', c_custkey, '@ex.org') END AS email,
  CASE c_custkey % 6 WHEN 0 THEN concat('(202) 555-', lpad(concat('', c_custkey % 10000), 4, '0')) WHEN 1 THEN concat('1-303-555-', lpad(concat('', c_custkey % 10000), 4, '0')) WHEN 2 THEN concat('+1 404.555.', lpad(concat('', c_custkey % 10000), 4, '0'), ' ext. 12') WHEN 3 THEN '555-0100' WHEN 4 THEN '0125550100' ELSE NULL END AS phone,
  CASE c_custkey % 5 WHEN 0 THEN concat('  MARY   ANN') WHEN 1 THEN 'o''brien' WHEN 2 THEN 'McDonald' WHEN 3 THEN '' ELSE 'de la cruz' END AS name,
  CASE c_custkey % 4 WHEN 0 THEN '12345-6789' WHEN 1 THEN ' 0212 ' WHEN 2 THEN 'SW1A  1AA' ELSE NULL END AS postal, CASE WHEN c_custkey % 3 = 0 THEN 'GB' ELSE 'US' END AS country,
  CASE c_custkey % 5 WHEN 0 THEN '2001-03-04' WHEN 1 THEN '03/04/2001' WHEN 2 THEN '12/25/1999' WHEN 3 THEN 'Jan 05, 2000' ELSE 'soon' END AS day,
  CASE c_custkey % 5 WHEN 0 THEN '$1,234.50' WHEN 1 THEN '12' WHEN 2 THEN 'n/a' WHEN 3 THEN '-7.25' ELSE NULL END AS amount, CASE c_custkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN '0' WHEN 2 THEN 'maybe' ELSE NULL END AS flag,
  CASE c_custkey % 4 WHEN 0 THEN '=1+1' WHEN 1 THEN ' @x' WHEN 2 THEN 'plain' ELSE '-5' END AS cell, concat('mail p', c_custkey, '@ex.org or +1 (202) 555-0', 100 + c_custkey % 900, ' soon') AS note,
  CASE c_custkey % 4 WHEN 0 THEN 'Zip-Code' WHEN 1 THEN 'Date of Birth' WHEN 2 THEN 'political_party' ELSE 'HH Income' END AS header FROM customer"""
WITH_RAW = f"WITH raw AS ({RAW})"


def raw(v):
    return v.spark.sql(RAW.replace("FROM customer", "FROM {customer}"), customer=v.customer)


@query("normalize_email", f"""{WITH_RAW}, x AS (SELECT id, lower(trim(email)) AS e FROM raw) SELECT id, CASE WHEN regexp_full_match(e, '[a-z0-9.+_-]+@[a-z0-9-]+([.][a-z0-9-]+)+') AND strpos(e, '..') = 0 AND NOT starts_with(e, '.') AND length(e) <= 254 THEN e END AS email FROM x""")
def _(v):
    return raw(v).select("id", N.email(F.col("email")).alias("email"))


@query("normalize_phone_us", f"""{WITH_RAW}, d AS (SELECT id, right(regexp_replace(split_part(phone, ' ext', 1), '[^0-9]', '', 'g'), 10) AS t, length(regexp_replace(split_part(phone, ' ext', 1), '[^0-9]', '', 'g')) AS n FROM raw) SELECT id, CASE WHEN n IN (10, 11) AND regexp_full_match(t, '[2-9][0-9][0-9][2-9][0-9]*') THEN concat('+1', t) END AS phone FROM d""")
def _(v):
    return raw(v).select("id", N.phone_us(F.col("phone")).alias("phone"))


@query("normalize_external_id", f"{WITH_RAW} SELECT id, CASE WHEN nullif(trim(name), '') IS NOT NULL THEN concat('crm:', trim(name)) END AS external_id FROM raw")
def _(v):
    x = N.external_id(F.lit("crm"), F.col("name"))
    return raw(v).select("id", x.alias("external_id"))


@query("normalize_name", f"{WITH_RAW} SELECT id, CASE id % 5 WHEN 0 THEN 'Mary Ann' WHEN 1 THEN 'O''Brien' WHEN 2 THEN 'McDonald' WHEN 4 THEN 'De La Cruz' END AS name FROM raw")
def _(v):
    return raw(v).select("id", N.name(F.col("name")).alias("name"))


@query("normalize_postal", f"{WITH_RAW} SELECT id, CASE WHEN country = 'GB' THEN regexp_replace(trim(postal), ' +', ' ', 'g') ELSE nullif(regexp_extract(trim(postal), '^([0-9]{{5}})', 1), '') END AS postal FROM raw")
def _(v):
    return raw(v).select("id", N.postal(F.col("postal"), F.col("country")).alias("postal"))


@query("hash_identifiers", f"{WITH_RAW} SELECT id, md5(lower(trim(email))) AS email_md5, sha256(lower(trim(email))) AS email_sha256 FROM raw")
def _(v):
    e = F.lower(F.trim("email"))
    return raw(v).select("id", F.md5(e).alias("email_md5"), F.sha2(e, 256).alias("email_sha256"))


@query("parse_mixed_dates", f"""{WITH_RAW} SELECT id, coalesce(CAST(try_strptime(day, '%Y-%m-%d') AS DATE), CAST(try_strptime(day, '%m/%d/%Y') AS DATE), CAST(try_strptime(day, '%b %d, %Y') AS DATE)) AS day, CASE id % 5 WHEN 1 THEN 'date_ambiguous' WHEN 2 THEN 'date_fallback_format' WHEN 3 THEN 'date_fallback_format' END AS warning FROM raw""")
def _(v):
    found, warning = N.mixed_date(F.col("day"))
    return raw(v).select("id", found.alias("day"), warning.alias("warning"))


@query("typed_convert", f"{WITH_RAW} SELECT id, TRY_CAST(replace(replace(amount, '$', ''), ',', '') AS DOUBLE) AS amount, CASE flag WHEN 'Yes' THEN true WHEN '0' THEN false END AS flag FROM raw")
def _(v):
    return raw(v).select("id", N.number(F.col("amount")).alias("amount"), N.boolean(F.col("flag")).alias("flag"))


@query("refund_sign", "SELECT id, CAST(CASE WHEN is_refund THEN -abs(amount) ELSE amount END AS DECIMAL(14,2)) AS amount FROM gifts")
def _(v):
    return v.gifts.select("id", N.signed_amount(F.col("amount"), F.col("is_refund")).alias("amount"))


@query("import_reject_report", f"""{WITH_RAW} SELECT id, list_filter([CASE WHEN email IS NULL AND phone IS NULL THEN 'no_identifier' END, CASE WHEN id % 5 = 4 THEN 'bad_date' END, CASE WHEN id % 5 = 2 THEN 'bad_amount' END, CASE WHEN coalesce(name, '') = '' THEN 'no_name' END], lambda x: x IS NOT NULL) AS errors FROM raw WHERE (email IS NULL AND phone IS NULL) OR id % 5 IN (2, 3, 4)""")
def _(v):
    day, _ = N.mixed_date(F.col("day"))
    checks = {"no_identifier": F.col("email").isNull() & F.col("phone").isNull(), "bad_date": day.isNull(), "bad_amount": F.col("amount").isNotNull() & N.number(F.col("amount")).isNull(), "no_name": N.name(F.col("name")).isNull()}
    errors = F.array_compact(F.array(*[F.when(c, n) for n, c in checks.items()]))
    return raw(v).select("id", errors.alias("errors")).filter(F.size("errors") > 0)


@query("canonical_alias", f"{WITH_RAW} SELECT id, regexp_replace(lower(header), '[^a-z0-9]', '', 'g') AS field, regexp_matches(header, '(?i)political') AS sensitive FROM raw")
def _(v):
    return raw(v).select("id", N.canonical_key(F.col("header")).alias("field"), N.sensitive(F.col("header")).alias("sensitive"))


@query("derive_external_id", f"{WITH_RAW} SELECT id, concat('auto:', sha256(coalesce(trim(email), trim(phone), concat('row', id)))) AS external_id FROM raw")
def _(v):
    return raw(v).select("id", F.concat(F.lit("auto:"), F.sha2(F.coalesce(F.trim("email"), F.trim("phone"), F.concat(F.lit("row"), F.col("id").cast("string"))), 256)).alias("external_id"))


@query("content_hash_ids", "SELECT id, sha256(concat_ws('|', name, type, message_id, properties)) AS content_id FROM events_in")
def _(v):
    return v.events_in.select("id", F.sha2(F.concat_ws("|", "name", "type", "message_id", "properties"), 256).alias("content_id"))


@query("clamp_event_time", "SELECT id, CASE WHEN occurred_at - to_days(CAST(id % 900 AS INT)) >= TIMESTAMP '2001-08-01' - to_days(730) THEN occurred_at - to_days(CAST(id % 900 AS INT)) ELSE TIMESTAMP '2001-08-01' END AS occurred_at, occurred_at - to_days(CAST(id % 900 AS INT)) < TIMESTAMP '2001-08-01' - to_days(730) AS clamped FROM events_in")
def _(v):
    at = F.col("occurred_at") - F.make_dt_interval((F.col("id") % 900).cast("int"))
    kept, flag = N.clamp_time(at, F.expr("TIMESTAMP_NTZ '2001-08-01 00:00:00'"))
    return v.events_in.select("id", kept.alias("occurred_at"), flag.alias("clamped"))


@query("csv_safe_export", f"{WITH_RAW} SELECT id, CASE WHEN id % 4 = 2 THEN cell ELSE concat('''', cell) END AS cell FROM raw")
def _(v):
    return raw(v).select("id", N.csv_safe(F.col("cell")).alias("cell"))


@query("mask_pii", f"{WITH_RAW} SELECT id, 'mail ***@*** or *** soon' AS note FROM raw")
def _(v):
    return raw(v).select("id", N.mask_pii(F.col("note")).alias("note"))


@query("json_extract_props", "SELECT id, json_extract_string(properties, '$.k') AS k, json_extract_string(properties, '$.missing') AS missing FROM events_in")
def _(v):
    return v.events_in.select("id", F.get_json_object("properties", "$.k").alias("k"), F.get_json_object("properties", "$.missing").alias("missing"))


@query("array_contains_source", "SELECT profile_id, list_contains(list(DISTINCT source_id), 2) AS has_two, CAST(len(list(DISTINCT source_id)) AS INT) AS n FROM gifts GROUP BY 1")
def _(v):
    return v.gifts.groupBy("profile_id").agg(F.collect_set("source_id").alias("s")).select("profile_id", F.array_contains("s", F.lit(2).cast("bigint")).alias("has_two"), F.size("s").alias("n"))


@query("null_semantics", "SELECT id, greatest(first_seen, last_contact) AS later, least(first_seen, last_contact) AS earlier, first_name IS DISTINCT FROM 'Ann' AS not_ann, nullif(first_name, '') AS name FROM profiles")
def _(v):
    return v.profiles.select("id", F.greatest("first_seen", "last_contact").alias("later"), F.least("first_seen", "last_contact").alias("earlier"), (~F.col("first_name").eqNullSafe("Ann")).alias("not_ann"), F.nullif("first_name", F.lit("")).alias("name"))


@query("month_spine", "SELECT CAST(m AS DATE) AS month, CAST(m + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS month_end FROM generate_series(TIMESTAMP '1999-09-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH) AS t(m)")
def _(v):
    s = v.spark.sql("SELECT explode(sequence(DATE '1999-09-01', DATE '2001-08-01', INTERVAL 1 MONTH)) AS month")
    return s.withColumn("month_end", F.last_day("month"))


@query("profile_trigram_search", """WITH q AS (SELECT list_distinct(list_transform(range(1, 6), lambda i: substr('  lee1 ', CAST(i AS INT), 3))) AS g), n AS (SELECT DISTINCT last_name, list_distinct(list_transform(range(1, length(last_name) + 2), lambda i: substr(concat('  ', lower(last_name), ' '), CAST(i AS INT), 3))) AS g FROM profiles)
SELECT last_name, round(len(list_intersect(n.g, q.g)) / len(list_distinct(list_concat(n.g, q.g))), 6) AS similarity FROM n, q WHERE len(list_intersect(n.g, q.g)) / len(list_distinct(list_concat(n.g, q.g))) >= 0.3""")
def _(v):
    s = N.similarity(F.col("last_name"), F.lit("Lee1"))
    return v.profiles.select("last_name").distinct().withColumn("similarity", s).filter("similarity >= 0.3")


@query("incremental_cursor_scan", "SELECT id, profile_id, day FROM events_in WHERE day >= DATE '2001-07-20'")
def _(v):
    return v.events_in.filter("day >= DATE '2001-07-20'").select("id", "profile_id", "day")


@query("gifts_from_events", "SELECT concat('event:', id) AS external_id, profile_id, day AS gift_date, CAST(CASE WHEN name = 'error' THEN -abs(value) ELSE abs(value) END AS DECIMAL(14,2)) AS amount, name = 'error' AS is_refund FROM events_in WHERE name IN ('purchase', 'error')")
def _(v):
    back = F.col("name") == "error"
    return v.events_in.filter(F.col("name").isin("purchase", "error")).select(F.concat(F.lit("event:"), F.col("id").cast("string")).alias("external_id"), "profile_id", F.col("day").alias("gift_date"), F.when(back, -F.abs("value")).otherwise(F.abs("value")).cast("decimal(14,2)").alias("amount"), back.alias("is_refund"))


@query("upsert_source_records", """WITH o AS (SELECT id, email, phone, first_name FROM source_records WHERE id % 3 <> 2), n AS (SELECT id, CASE WHEN id % 2 = 0 THEN concat('new', id) END AS email, phone, first_name FROM source_records WHERE id % 3 <> 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.email, o.email) AS email, coalesce(n.phone, o.phone) AS phone, coalesce(n.first_name, o.first_name) AS first_name, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL OR (coalesce(n.email, o.email) IS NOT DISTINCT FROM o.email AND coalesce(n.phone, o.phone) IS NOT DISTINCT FROM o.phone AND coalesce(n.first_name, o.first_name) IS NOT DISTINCT FROM o.first_name) THEN 'same' ELSE 'updated' END AS op FROM o FULL JOIN n ON o.id = n.id""")
def _(v):
    r = v.source_records.select("id", "email", "phone", "first_name")
    new = r.filter("id % 3 <> 0").withColumn("email", F.when(F.col("id") % 2 == 0, F.concat(F.lit("new"), F.col("id").cast("string"))))
    return U.upsert(r.filter("id % 3 <> 2"), new, ["id"])


@query("batch_merge_records", "SELECT profile_id, arg_max(email, id) FILTER (WHERE email IS NOT NULL) AS email, arg_max(phone, id) FILTER (WHERE phone IS NOT NULL) AS phone FROM source_records WHERE profile_id IS NOT NULL GROUP BY 1")
def _(v):
    return U.batch_merge(v.source_records.filter("profile_id IS NOT NULL").select("profile_id", "email", "phone", "id"), ["profile_id"], "id").drop("id")


#: Consents of records in the table and in a batch, whose rows come in pairs of a key; times tie in places.
STATUS = "CASE {x} % 4 WHEN 0 THEN 'opted_out' WHEN 1 THEN 'unknown' WHEN 2 THEN 'opted_in' END"
RECORDS = {
    "t": f"SELECT source_id, external_id, email, city, concat('p', id % 3) AS plan, {STATUS.format(x='id')} AS status, DATE '2000-01-01' + CAST(id % 5 AS INT) AS captured_at, id % 7 < 3 AS strong, concat('h', id % 4) AS raw_hash FROM source_records WHERE id % 3 <> 2",
    "b": f"SELECT source_id, external_id, CASE WHEN k = 0 THEN concat('new', id) END AS email, CASE WHEN (id + k) % 3 = 0 THEN 'Troy' END AS city, CASE WHEN id % 2 = k THEN concat('q', k) END AS plan, {STATUS.format(x='(id * 7 + k * 5)')} AS status, DATE '2000-01-01' + CAST((id * 3 + k) % 5 AS INT) AS captured_at, (id + k) % 2 = 0 AS strong, concat('h', (id + k) % 5) AS raw_hash, k AS seq FROM source_records CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) AS two WHERE id % 5 <> 4",
}


def _wins(o: str, n: str) -> str:
    later, same = f"{n}.captured_at > {o}.captured_at", f"{n}.captured_at = {o}.captured_at"
    return f"""CASE WHEN {n}.status IS NULL THEN false WHEN {o}.status IS NULL THEN true WHEN {n}.status = 'unknown' THEN {o}.status = 'unknown' AND {later} WHEN {o}.status = 'unknown' THEN true
      WHEN {n}.status = 'opted_out' THEN CASE WHEN {o}.status = 'opted_in' AND {o}.strong THEN {later} OR {same} ELSE {o}.status <> 'opted_out' OR {later} END
      WHEN {o}.status = 'opted_out' THEN {n}.strong AND {later} WHEN {o}.strong AND NOT {n}.strong THEN false ELSE {later} OR ({same} AND {n}.strong AND NOT {o}.strong) END"""


@query("upsert_records", f"""WITH t AS ({RECORDS['t']}), b AS ({RECORDS['b']}), x AS (SELECT * FROM b WHERE seq = 0), y AS (SELECT * FROM b WHERE seq = 1),
n AS (SELECT x.source_id, x.external_id, coalesce(y.email, x.email) AS email, coalesce(y.city, x.city) AS city, coalesce(y.plan, x.plan) AS plan, CASE WHEN {_wins('x', 'y')} THEN y.status ELSE x.status END AS status, CASE WHEN {_wins('x', 'y')} THEN y.captured_at ELSE x.captured_at END AS captured_at, CASE WHEN {_wins('x', 'y')} THEN y.strong ELSE x.strong END AS strong, y.raw_hash FROM x JOIN y ON y.source_id = x.source_id AND y.external_id = x.external_id),
j AS (SELECT coalesce(t.source_id, n.source_id) AS source_id, coalesce(t.external_id, n.external_id) AS external_id, CASE WHEN t.external_id IS NULL THEN 'inserted' WHEN n.external_id IS NULL OR n.raw_hash = t.raw_hash THEN 'same' ELSE 'updated' END AS op, t.email AS e0, n.email AS e1, t.city AS c0, n.city AS c1, t.plan AS p0, n.plan AS p1, t.status AS s0, CASE WHEN {_wins('t', 'n')} THEN n.status ELSE t.status END AS s1 FROM t FULL JOIN n ON t.source_id = n.source_id AND t.external_id = n.external_id)
SELECT source_id, external_id, op, CASE WHEN op = 'same' THEN e0 ELSE coalesce(e1, e0) END AS email, CASE WHEN op = 'same' THEN c0 ELSE coalesce(c1, c0) END AS city, CASE WHEN op = 'same' THEN p0 ELSE coalesce(p1, p0) END AS plan, CASE WHEN op = 'same' THEN s0 ELSE s1 END AS status FROM j""")
def _(v):
    def shaped(df, *more):
        consent = F.when(F.col("status").isNotNull(), F.struct("status", "captured_at", F.col("strong").alias("authoritative")))
        plan = F.map_filter(F.create_map(F.lit("plan"), F.col("plan")), lambda _, x: x.isNotNull())
        return df.select("source_id", "external_id", "email", "city", plan.alias("attributes"), consent.alias("consent"), "raw_hash", *more)

    r = v.source_records
    status = lambda x: STATUS.format(x=x)
    t = r.filter("id % 3 <> 2").selectExpr("source_id", "external_id", "email", "city", "concat('p', id % 3) AS plan", f"{status('id')} AS status", "DATE '2000-01-01' + CAST(id % 5 AS INT) AS captured_at", "id % 7 < 3 AS strong", "concat('h', id % 4) AS raw_hash")
    two = r.filter("id % 5 <> 4").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    b = two.selectExpr("source_id", "external_id", "CASE WHEN k = 0 THEN concat('new', id) END AS email", "CASE WHEN (id + k) % 3 = 0 THEN 'Troy' END AS city", "CASE WHEN id % 2 = k THEN concat('q', k) END AS plan", f"{status('(id * 7 + k * 5)')} AS status", "DATE '2000-01-01' + CAST((id * 3 + k) % 5 AS INT) AS captured_at", "(id + k) % 2 = 0 AS strong", "concat('h', (id + k) % 5) AS raw_hash", "k AS seq")
    made = R.upsert(shaped(t, F.lit(AS_OF).alias("updated_at")), shaped(b, "seq"), AS_OF)
    return made.select("source_id", "external_id", "op", "email", "city", F.col("attributes")["plan"].alias("plan"), F.col("consent.status").alias("status"))


@query("upsert_gifts", "SELECT g.id, CASE WHEN id % 4 = 1 THEN CAST(amount + 1 AS DECIMAL(14,2)) ELSE amount END AS amount, fund, CASE WHEN id % 5 = 0 THEN 'inserted' WHEN id % 4 = 1 THEN 'updated' ELSE 'same' END AS op FROM gifts g")
def _(v):
    g = v.gifts.select("id", "amount", "fund")
    new = g.filter("id % 4 = 1 OR id % 5 = 0 OR id % 7 = 0").withColumn("amount", F.when(F.col("id") % 4 == 1, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(14,2)"))
    return U.upsert(g.filter("id % 5 <> 0"), new, ["id"], keep_old_nulls=False)


@query("dedup_events", "SELECT message_id, source_id, id, name FROM (SELECT *, row_number() OVER (PARTITION BY message_id, source_id ORDER BY occurred_at DESC, id DESC) AS n FROM events_in) WHERE n = 1")
def _(v):
    return U.latest(v.events_in.select("message_id", "source_id", "id", "name", "occurred_at"), ["message_id", "source_id"], "occurred_at", "id").drop("occurred_at")


@query("ingest_dedup", "SELECT DISTINCT message_id FROM events_in WHERE id >= 5000 AND message_id NOT IN (SELECT message_id FROM events_in WHERE id < 5000)")
def _(v):
    e = v.events_in.select("id", "message_id")
    return U.unseen(e.filter("id >= 5000").select("message_id"), e.filter("id < 5000").select("message_id").distinct(), ["message_id"])


@query("latest_enrichment", "SELECT profile_id, attribute_key, value_text, value_num, imported_at FROM (SELECT *, row_number() OVER (PARTITION BY profile_id, attribute_key ORDER BY imported_at DESC, source_id DESC) AS n FROM enrichment) WHERE n = 1")
def _(v):
    return U.latest(v.enrichment.select("profile_id", "attribute_key", "value_text", "value_num", "imported_at", "source_id"), ["profile_id", "attribute_key"], "imported_at", "source_id").drop("source_id")


@query("consent_winner", f"WITH {CONSENT} x AS (SELECT 1) SELECT profile_id, channel, status FROM cw")
def _(v):
    return consent_winner(v.consent_rows).select("profile_id", "channel", "status")


@query("suppression_screen", "SELECT p.id AS profile_id, CASE WHEN EXISTS (SELECT 1 FROM suppressions s WHERE s.profile_id = p.id AND s.type = 'deletion') THEN 'rejected' WHEN EXISTS (SELECT 1 FROM suppressions s WHERE s.profile_id = p.id AND s.type = 'email') THEN 'opted_out' ELSE 'accepted' END AS outcome FROM profiles p")
def _(v):
    return U.suppressed(v.profiles.select(F.col("id").alias("profile_id")), v.suppressions)


@query("hard_bounce_consent", "SELECT id, CASE WHEN email IN (SELECT email FROM source_records WHERE id % 31 = 0) THEN 'opted_out' ELSE 'unknown' END AS status FROM source_records WHERE email IS NOT NULL")
def _(v):
    bounced = v.source_records.filter("id % 31 = 0 AND email IS NOT NULL").select("email").distinct().withColumn("hit", F.lit(True))
    return v.source_records.filter("email IS NOT NULL").join(bounced, "email", "left").select("id", F.when(F.col("hit"), "opted_out").otherwise("unknown").alias("status"))


@query("mapping_import_status", """WITH m AS (SELECT id, email, count(DISTINCT profile_id) OVER (PARTITION BY email) AS owners, profile_id FROM (SELECT id, email, profile_id FROM source_records)) SELECT id, CASE WHEN email IS NULL THEN 'invalid' WHEN owners = 0 THEN 'unmatched' WHEN owners > 1 THEN 'ambiguous' WHEN profile_id IS NOT NULL THEN 'already_linked' ELSE 'linked' END AS status FROM m""")
def _(v):
    owners = v.source_records.filter("email IS NOT NULL").groupBy("email").agg(F.count_distinct("profile_id").alias("owners"))
    s = F.when(F.col("email").isNull(), "invalid").when(F.col("owners") == 0, "unmatched").when(F.col("owners") > 1, "ambiguous").when(F.col("profile_id").isNotNull(), "already_linked").otherwise("linked")
    return v.source_records.select("id", "email", "profile_id").join(owners, "email", "left").select("id", s.alias("status"))


@query("ads_hash_rows", "SELECT id, sha256(lower(trim(email))) AS email, sha256(regexp_replace(lower(first_name), '[^a-z]', '', 'g')) AS first_name, sha256(replace(phone, '+', '')) AS phone FROM profiles")
def _(v):
    return v.profiles.select("id", F.sha2(N.google_email(F.col("email")), 256).alias("email"), F.sha2(N.letters_only(F.col("first_name")), 256).alias("first_name"), F.sha2(F.regexp_replace("phone", r"\+", ""), 256).alias("phone"))


