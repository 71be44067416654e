"""Queries of partner feeds, lead forms and audience previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from pledgework.operators import keys as K
from pledgework.operators import returns, search
from pledgework.plans.registry import query
from pledgework.plans.segment_queries import SEEN, SEEN_SQL, members
from pledgework.segments import preview as P
from pledgework.sources import feeds, pulls

#: Names of events that feeds write in several ways.
EVENT_NAMES = ("donation", "donation_return", "vod_viewed", "email_opened")


@query("feed_canonical", """WITH j AS (SELECT id, feed, CASE WHEN json_valid(body) AND json_type(body) = 'OBJECT' THEN body::JSON END AS b FROM feed_rows),
p AS (SELECT *, b ->> '$.user_id' AS user_id, CASE WHEN feed IN ('people', 'models', 'lookups') THEN 'contact' WHEN feed = 'enrichment' THEN 'enrichment' WHEN feed = 'resources' THEN 'resource' WHEN feed IS NOT NULL THEN 'event' END AS record_type FROM j),
q AS (SELECT *, CASE record_type WHEN 'contact' THEN coalesce(b ->> '$.external_id', user_id, b ->> '$.id', b ->> '$.donor_account_number') WHEN 'enrichment' THEN concat('_enrichment:', b ->> '$.external_id') WHEN 'event' THEN concat('_event:', coalesce(b ->> '$.external_id', b ->> '$.id')) END AS external_id,
  CASE WHEN record_type IN ('enrichment', 'event') THEN coalesce(b ->> '$.contact_external_id', user_id, b ->> '$.okta_customer_id') END AS contact_external_id, CASE record_type WHEN 'resource' THEN coalesce(b ->> '$.key', b ->> '$.id') END AS key FROM p)
SELECT id, record_type, CASE WHEN external_id IN ('_enrichment:', '_event:') OR b IS NULL THEN NULL ELSE external_id END AS external_id, contact_external_id, key,
  CASE record_type WHEN 'resource' THEN b ->> '$.name' WHEN 'event' THEN CASE WHEN b ->> '$.event' = 'Vod-Viewed' THEN 'vod_viewed' ELSE coalesce(b ->> '$.name', b ->> '$.event', b ->> '$.type') END END AS name,
  CASE record_type WHEN 'event' THEN coalesce(b ->> '$.message_id', b ->> '$.external_id', b ->> '$.id') END AS message_id, CASE record_type WHEN 'event' THEN b ->> '$.timestamp' END AS occurred_at,
  CASE record_type WHEN 'contact' THEN coalesce(b ->> '$.attributes.plan', b ->> '$.properties.plan') END AS plan, CASE record_type WHEN 'event' THEN b ->> '$.extra' END AS extra,
  CASE WHEN feed IS NULL THEN 'no feed' WHEN b IS NULL THEN 'no object' WHEN json_type(b, '$.properties') NOT IN ('OBJECT') AND record_type IN ('contact', 'event') THEN 'properties are no object' WHEN record_type = 'contact' AND external_id IS NULL THEN 'no identity'
    WHEN record_type = 'enrichment' AND (b ->> '$.vendor' IS NULL OR b ->> '$.license_id' IS NULL OR b ->> '$.append_date' IS NULL OR contact_external_id IS NULL) THEN 'no evidence or identity' WHEN record_type = 'resource' AND key IS NULL THEN 'no key'
    WHEN record_type = 'event' AND external_id = '_event:' THEN 'no external id' WHEN record_type = 'event' AND contact_external_id IS NULL AND b ->> '$.email' IS NULL AND b ->> '$.phone' IS NULL THEN 'no contact' END AS reason FROM q""")
def _(v):
    made = feeds.canonical(v.feed_rows, EVENT_NAMES).withColumn("external_id", F.when(F.col("record_type") == "enrichment", F.when(F.get_json_object("body", "$.external_id").isNotNull(), F.col("external_id"))).otherwise(F.col("external_id")))
    return made.select("id", "record_type", "external_id", "contact_external_id", "key", "name", "message_id", "occurred_at", F.try_element_at("values", F.when(F.col("record_type") == "contact", "plan").otherwise("")).alias("plan"), F.try_element_at("properties", F.lit("extra")).alias("extra"), "reason")


@query("lead_contacts", """SELECT concat('lead:', c_custkey) AS external_id, concat('p', c_custkey, '@x.org') AS email, '' AS city, CASE WHEN c_custkey % 10 <> 9 THEN TIMESTAMP '2001-05-01 10:00:00' + INTERVAL (c_custkey % 28) DAY END AS captured_at,
  CASE WHEN c_custkey % 7 <> 6 AND c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 4 <> 0 THEN 'opted_in' ELSE 'unknown' END END AS consent_status, CASE WHEN c_custkey % 7 <> 6 AND c_custkey % 3 = 1 THEN c_custkey % 4 = 0 END AS text_changed, CASE WHEN c_custkey % 10 = 9 THEN 'created_time' END AS reason FROM customer""")
def _(v):
    rows = v.lead_rows
    made = pulls.leads(rows, {"email": "email", "town": "city"}, {"field": "ok", "text": "I agree", "form_id": "71", "channel": "email", "yes": ["yes"]})
    return made.select("external_id", "email", "city", F.col("captured_at").cast("timestamp_ntz").alias("captured_at"), "consent_status", F.col("consent_text_changed").alias("text_changed"), "reason")


@query("seg_preview_sample", f"SELECT count(*) AS hits FROM profiles WHERE {SEEN_SQL} AND substr(md5(CAST(id AS VARCHAR)), 1, 3) < '040'")
def _(v):
    return members(v, SEEN).filter(P.sampled(F.col("profile_id"))).agg(F.count("*").alias("hits"))


RETURNED = """ref AS (SELECT profile_id, source_id, properties ->> '$.original_donation_id' AS ref FROM donation_events WHERE name = 'donation_return' UNION SELECT profile_id, source_id, properties ->> '$.original_gift_external_id' FROM donation_events WHERE name = 'donation_return'
UNION SELECT profile_id, source_id, attributes ->> '$.original_donation_id' FROM refund_gifts WHERE amount < 0 OR attributes ->> '$.is_refund' = 'true'),
d AS (SELECT * FROM donation_events e WHERE name = 'donation' AND coalesce(properties ->> '$.is_refund', 'false') <> 'true' AND NOT EXISTS (SELECT 1 FROM ref WHERE ref.profile_id = e.profile_id AND ref.source_id = e.source_id AND ref.ref IN (e.message_id, 'gift:' || e.message_id, 'donation:' || e.message_id, 'donation:_event:' || e.message_id)))"""


@query("donations_unreturned", f"WITH {RETURNED} SELECT id, profile_id, message_id FROM d")
def _(v):
    return returns.unreturned(v.donation_events, v.refund_gifts).select("id", "profile_id", "message_id")


@query("last_donation_standing", f"WITH {RETURNED} SELECT p.id AS profile_id, max(d.occurred_at) AS last_donation_at FROM profiles p LEFT JOIN d ON d.profile_id = p.id GROUP BY 1")
def _(v):
    return returns.last_donation(v.profiles.select(F.col("id").alias("profile_id")), v.donation_events, v.refund_gifts)


JSON_KEYS = """k AS (SELECT DISTINCT id, source_id, kind, value FROM (SELECT id, source_id, unnest([{'kind': 'external', 'value': source_key || ':' || external_id}, {'kind': 'external', 'value': (attributes ->> '$._identity_reference.source_key') || ':' || (attributes ->> '$._identity_reference.contact_external_id')},
  {'kind': 'email', 'value': nullif(trim(email), '')}, {'kind': 'phone', 'value': phone}, {'kind': 'email_md5', 'value': CASE WHEN email IS NOT NULL THEN md5(nullif(trim(email), '')) ELSE lower(trim(attributes ->> '$.email_md5')) END}, {'kind': 'email_sha256', 'value': CASE WHEN email IS NOT NULL THEN sha256(nullif(trim(email), '')) END},
  {'kind': 'donor_account_number', 'value': attributes ->> '$.donor_account_number'}, {'kind': 'zeta_uid', 'value': lower(attributes ->> '$.zeta_uid')}, {'kind': 'user_id', 'value': source_key || ':' || nullif(attributes ->> '$.user_id', '')},
  {'kind': 'anonymous_id', 'value': CASE WHEN id % 3 = 0 THEN attributes ->> '$.anonymous_id' END}], recursive := true) FROM keyed_records) WHERE value IS NOT NULL)"""


@query("identity_keys", f"WITH {JSON_KEYS} SELECT id, source_id, kind, value FROM k")
def _(v):
    return K.keys(v.keyed_records)


@query("identity_keys_guarded", f"WITH {JSON_KEYS}, c AS (SELECT DISTINCT kind, value FROM (SELECT k.source_id, kind, value FROM k JOIN keyed_records r USING (id) WHERE kind IN ('email', 'phone') AND coalesce(record_type, '') <> 'gift' GROUP BY ALL HAVING count(DISTINCT external_id) > 25)) SELECT kind, count(*) AS keys, (SELECT count(*) FROM c) AS blocked FROM k WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.kind = k.kind AND c.value = k.value) GROUP BY kind")
def _(v):
    listed, left = K.guarded(K.keys(v.keyed_records), v.keyed_records, v.blocklist.filter("type = 'none'"))
    return left.groupBy("kind").agg(F.count("*").alias("keys")).crossJoin(listed.agg(F.count("*").alias("blocked")))  # one row


@query("profile_search", """WITH t AS (SELECT id, concat(coalesce(first_name, ''), ' ', last_name, ' ', coalesce(email, '')) AS text FROM profiles), w AS (SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS word FROM t UNION ALL SELECT -1, unnest(['lee7', 'robert', 'org'])),
g AS (SELECT DISTINCT id, substr('  ' || word || ' ', i, 3) AS gram FROM (SELECT id, word, unnest(range(1, len(word) + 2)) AS i FROM w)), n AS (SELECT id, count(*) AS n FROM g GROUP BY 1), q AS (SELECT gram FROM g WHERE id = -1), o AS (SELECT id, count(*) AS c FROM g JOIN q USING (gram) WHERE id >= 0 GROUP BY 1)
SELECT id AS key, round(c / (n + (SELECT count(*) FROM q) - c), 6) AS similarity FROM o JOIN n USING (id) WHERE c / (n + (SELECT count(*) FROM q) - c) >= 0.4""")
def _(v):
    p = v.profiles.select("id", F.concat_ws(" ", F.coalesce("first_name", F.lit("")), "last_name", F.coalesce("email", F.lit(""))).alias("text"))
    return search.search(search.build(p, "id", "text"), v.spark.createDataFrame([(1, "Lee7, Robert org")], "q int, text string"), 0.4).select("key", "similarity")
