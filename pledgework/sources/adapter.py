"""Domain tables over the test tables, each one portable SQL text that Spark and DuckDB read alike.

The same texts serve as common table expressions of the oracles, so query and oracle see equal inputs while
their logic is written twice.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = dt.date(2001, 8, 1)

VIEWS: dict[str, str] = {
    "sources": "SELECT CAST(r_regionkey AS BIGINT) AS id, lower(r_name) AS key, CAST(r_regionkey * 10 AS BIGINT) AS priority, r_regionkey = 0 AS authoritative FROM region",
    "all_profiles": """SELECT c_custkey AS id, concat('mid_', lpad(concat('', c_custkey), 8, '0')) AS master_id,
      CASE WHEN c_custkey % 37 = 36 THEN c_custkey - 1 END AS merged_into_id, c_custkey % 50 = 0 AS is_deleted,
      CASE c_custkey % 6 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Robert' WHEN 2 THEN 'Cat%_x' WHEN 3 THEN 'dan' WHEN 4 THEN '' END AS first_name,
      concat('Lee', c_custkey % 40) AS last_name,
      CASE WHEN c_custkey % 9 <> 8 THEN concat('p', c_custkey, '@ex', c_custkey % 3, '.org') END AS email,
      CASE WHEN c_custkey % 4 <> 3 THEN concat('+1202555', lpad(concat('', c_custkey % 10000), 4, '0')) END AS phone,
      n_name AS region, c_mktsegment AS segment, lpad(concat('', c_custkey % 700), 5, '1') AS postal_code,
      concat('hh', c_custkey % 400) AS household_id,
      CASE WHEN c_custkey % 13 <> 0 THEN DATE '1995-01-01' + CAST(c_custkey % 2404 AS INT) END AS first_seen,
      CASE WHEN c_custkey % 5 <> 0 THEN DATE '2001-08-01' - CAST(c_custkey % 400 AS INT) END AS last_seen,
      CASE WHEN c_custkey % 7 = 0 THEN DATE '2001-08-01' - CAST(c_custkey % 200 AS INT) END AS last_contact
      FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "profiles": "SELECT * FROM all_profiles WHERE merged_into_id IS NULL AND NOT is_deleted",
    "gifts": """SELECT o_orderkey AS id, o_custkey AS profile_id, o_orderkey % 5 AS source_id, concat('g', o_orderkey) AS external_id,
      CAST(CAST(o_totalprice AS DECIMAL(14,2)) * CASE WHEN o_orderkey % 23 = 0 THEN -1 ELSE 1 END AS DECIMAL(14,2)) AS amount,
      CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END AS gift_date, o_orderkey % 23 = 0 AS is_refund,
      o_orderpriority = '1-URGENT' AS is_recurring, o_orderstatus AS fund, o_orderpriority AS channel,
      CASE WHEN o_orderkey % 7 <> 0 THEN concat('c', o_orderkey % 12) END AS campaign,
      CASE WHEN o_orderkey % 6 <> 0 THEN concat('a', o_orderkey % 9) END AS appeal_code,
      CASE WHEN o_orderkey % 3 <> 0 THEN concat('sc', o_orderkey % 15) END AS source_code
      FROM orders WHERE o_custkey % 10 <> 7 AND (o_custkey % 4 <> 0 OR o_orderkey % 4 = 0)""",
    "events_in": """SELECT event_id AS id, user_id AS profile_id, event_id % 5 AS source_id, event_type AS name, CASE WHEN event_type = 'view' THEN 'page' ELSE 'track' END AS type,
      ts - INTERVAL 8217 DAY AS occurred_at, CAST(ts - INTERVAL 8217 DAY AS DATE) AS day, value, props AS properties, concat('m', event_id % 9000) AS message_id,
      concat('d', event_id % 3000) AS donation_id FROM events""",
    "source_codes": "SELECT concat('sc', p_partkey) AS key, p_name AS name, p_brand AS series FROM part WHERE p_partkey < 15",
    "consent_rows": """SELECT c_custkey AS profile_id, ch AS channel, CASE (c_custkey + k * 3) % 4 WHEN 0 THEN 'opted_out' WHEN 1 THEN 'unknown' ELSE 'opted_in' END AS status,
      (c_custkey + k) % 5 AS source_id, (c_custkey * 7 + k) % 5 = 0 AS authoritative, DATE '2000-01-01' + CAST((c_custkey * 31 + k * 17) % 500 AS INT) AS captured_at, c_custkey * 10 + k AS id
      FROM customer CROSS JOIN (SELECT 'email' AS ch, 0 AS k UNION ALL SELECT 'email', 1 UNION ALL SELECT 'email', 2 UNION ALL SELECT 'sms', 3 UNION ALL SELECT 'sms', 4) AS c
      WHERE c_custkey % 8 <> 5""",
    "source_records": """SELECT c_custkey * 3 + k AS id, (c_custkey + k) % 5 AS source_id, concat('x', c_custkey, '-', k) AS external_id,
      CASE WHEN c_custkey % 17 <> 3 THEN c_custkey END AS profile_id,
      CASE WHEN k = 0 AND c_custkey % 9 <> 8 THEN concat('p', c_custkey, '@ex', c_custkey % 3, '.org') WHEN k = 1 THEN concat('s', CAST(floor(c_custkey / 2) AS BIGINT), '@mail.org') WHEN c_custkey % 211 = 5 THEN 'noemail@mail.org' END AS email,
      CASE WHEN k = 0 AND c_custkey % 4 <> 3 THEN concat('+1202555', lpad(concat('', c_custkey % 10000), 4, '0')) WHEN k = 2 THEN concat('+1303555', lpad(concat('', CAST(floor((c_custkey + 1) / 3) AS BIGINT) % 10000), 4, '0')) END AS phone,
      CASE WHEN k = 2 AND c_custkey % 2 = 1 THEN concat('sys', CAST(floor(c_custkey / 4) AS BIGINT)) END AS login_id,
      CASE (c_custkey + k) % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN '' WHEN 2 THEN 'Bob' END AS first_name, concat('Lee', c_custkey % 40) AS last_name,
      CASE WHEN (c_custkey + k) % 3 <> 0 THEN concat(1 + c_custkey % 90, ' Main St') END AS address1, CASE WHEN (c_custkey + k) % 5 <> 0 THEN 'Springfield' END AS city,
      lpad(concat('', c_custkey % 700), 5, '1') AS postal_code, DATE '1999-01-01' + CAST((c_custkey * 13 + k * 101) % 900 AS INT) AS updated_at,
      (c_custkey + k) % 29 <> 0 AS resolved,
      concat('{"plan":"', CASE c_custkey % 4 WHEN 0 THEN 'basic' WHEN 1 THEN 'premium' WHEN 2 THEN 'Upgrade1' ELSE '' END, '","score":', CASE WHEN k = 1 THEN 'null' ELSE concat('', c_custkey % 100) END, ',"vip":', CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END, '}') AS attributes
      FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS r""",
    "enrichment": """SELECT c_custkey AS profile_id, (c_custkey + k) % 5 AS source_id, CASE k WHEN 0 THEN 'score' WHEN 1 THEN 'band' ELSE 'since' END AS attribute_key,
      CASE WHEN k = 1 THEN concat('b', c_custkey % 6) END AS value_text, CASE WHEN k = 0 THEN CAST(c_custkey % 100 AS DECIMAL(14,2)) END AS value_num,
      CASE WHEN k = 2 THEN DATE '1998-01-01' + CAST(c_custkey % 1000 AS INT) END AS value_date,
      CASE WHEN c_custkey % 4 <> 0 THEN DATE '2001-08-01' + CAST(c_custkey % 120 - 40 AS INT) END AS license_expires_at, DATE '2000-06-01' + CAST((c_custkey * 3 + k) % 300 AS INT) AS imported_at
      FROM customer CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) AS e WHERE c_custkey % 3 <> 1""",
    "audit_attributes": """SELECT id AS profile_id, CASE id % 5 WHEN 0 THEN 'basic' WHEN 1 THEN 'premium_monthly' WHEN 2 THEN 'premium_annual' WHEN 3 THEN 'other' END AS plan,
      CASE id % 7 WHEN 1 THEN 'Upgrade to annual' WHEN 2 THEN 'Downgrade' END AS plan_update, id % 3 = 0 AS has_active_email, CASE WHEN id % 4 <> 1 THEN concat('acc', id) END AS donor_account,
      CASE WHEN id % 6 <> 0 THEN CAST(id % 900 AS DOUBLE) END AS lifetime_amount, id % 8 = 0 AS has_recurring, CAST(id % 4 AS DOUBLE) AS rfm_frequency, CASE WHEN id % 9 < 6 THEN 'open' END AS account_status,
      CASE WHEN id % 2 = 0 THEN DATE '2001-01-01' + CAST(id % 150 AS INT) END AS rfm_date, CAST(id % 5 AS DOUBLE) AS rfm_recency_score, CAST(id % 100 AS DOUBLE) / 100 AS donation_likelihood,
      CAST(id % 11 AS DOUBLE) AS wealth_score, CAST(id % 1000 AS DOUBLE) AS suggested_amount, CASE id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS sms_optin, id % 10 = 3 AS call_optin,
      CASE WHEN id % 12 = 5 THEN DATE '2000-05-05' END AS sms_optout_date, CASE id % 4 WHEN 0 THEN false WHEN 1 THEN true END AS vod_active, last_seen, last_contact FROM profiles""",
    "feed_rows": """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN 'people' WHEN 1 THEN 'models' WHEN 2 THEN 'lookups' WHEN 3 THEN 'enrichment' WHEN 4 THEN 'resources' WHEN 7 THEN CASE WHEN c_custkey % 2 = 0 THEN 'people' ELSE 'events' END WHEN 8 THEN CASE c_custkey % 4 WHEN 0 THEN 'resources' WHEN 1 THEN 'enrichment' WHEN 2 THEN 'lookups' END ELSE 'events' END AS feed,
      CASE c_custkey % 9
        WHEN 0 THEN concat('{"id":"', CASE WHEN c_custkey % 2 = 0 THEN 'cdp-' ELSE '' END, c_custkey, '","properties":{"email":"p', c_custkey, '@x.org","plan":"a"},"attributes":{"plan":"b","tags":[1,2]},"city":null}')
        WHEN 1 THEN concat('{"user_id":', c_custkey, ',"score":0.5,"properties":{}}')
        WHEN 2 THEN concat('{"donor_account_number":"d', c_custkey, '","email":"","attributes":{"vip":true}}')
        WHEN 3 THEN concat('{"user_id":"u', c_custkey, '","vendor":"v","license_id":"l","append_date":"2001-01-01","external_id":"x', c_custkey, '","attributes":{"age":', c_custkey % 90, '}}')
        WHEN 4 THEN concat('{"id":', c_custkey, ',"name":"n', c_custkey % 5, '","series":null,"attributes":{"a":1},"colour":"red"}')
        WHEN 5 THEN concat('{"id":"e', c_custkey, '","event":"Vod-Viewed","user_id":"u', c_custkey, '","timestamp":"2001-01-01T00:00:00Z","extra":{"x":1},"properties":{"p":2},"okta_customer_id":"o1"}')
        WHEN 6 THEN concat('{"external_id":"e', c_custkey, '","type":"Page-View","email":"a@b.org","attributes":{}}')
        WHEN 7 THEN CASE c_custkey % 4 WHEN 0 THEN '{"id":' WHEN 1 THEN '[1]' WHEN 2 THEN '{"id":"a","properties":3}' ELSE '{"id":"e","name":"x"}' END
        ELSE CASE c_custkey % 4 WHEN 0 THEN '{"name":"no key"}' WHEN 1 THEN '{"user_id":"u","vendor":"v"}' WHEN 2 THEN '{"email":"a@b.org"}' ELSE '{"id":1}' END END AS body FROM customer""",
    "donation_events": """SELECT event_id AS id, user_id AS profile_id, event_id % 2 AS source_id, CASE event_type WHEN 'purchase' THEN 'donation' WHEN 'view' THEN 'donation' WHEN 'error' THEN 'donation_return' ELSE event_type END AS name, concat('m', event_id % 500) AS message_id, ts - INTERVAL 8217 DAY AS occurred_at,
      CASE WHEN event_type = 'error' THEN concat('{"', CASE WHEN event_id % 3 = 0 THEN 'original_gift_external_id' ELSE 'original_donation_id' END, '":"', CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'gift:' WHEN 2 THEN 'donation:' WHEN 3 THEN 'donation:_event:' ELSE 'other:' END, 'm', event_id * 7 % 500, '"}') WHEN event_id % 11 = 0 THEN '{"is_refund":true}' WHEN event_id % 13 = 0 THEN '{"is_refund":"false"}' ELSE '{}' END AS properties FROM events""",
    "refund_gifts": """SELECT o_orderkey AS id, o_custkey % 150 AS profile_id, o_orderkey % 2 AS source_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN -5 ELSE 5 END AS DECIMAL(14,2)) AS amount,
      concat('{"is_refund":', CASE WHEN o_orderkey % 5 = 0 THEN 'true' ELSE 'false' END, ',"original_donation_id":"', CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'gift:' WHEN 2 THEN 'donation:' ELSE 'nothing:' END, 'm', o_orderkey % 500, '"}') AS attributes FROM orders""",
    "keyed_records": """SELECT r.id, source_id, concat('src', source_id) AS source_key, external_id, CASE WHEN id % 4 = 0 THEN 'office@x.org' WHEN id % 9 = 1 THEN '  ' ELSE email END AS email, phone, CASE WHEN id % 12 = 4 THEN 'gift' WHEN id % 12 = 8 THEN NULL ELSE 'contact' END AS record_type,
      concat('{"email_md5":" ABC', id % 7, '","donor_account_number":"d', id % 50, '","zeta_uid":"U', id % 30, '","user_id":"', CASE WHEN id % 6 = 0 THEN '' ELSE concat('u', id % 40) END, '","anonymous_id":"an', id % 20, '","identify":', CASE id % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '{}' END, CASE WHEN id % 5 = 0 THEN concat(',"_identity_reference":{"source_key":"src1","contact_external_id":"x', id % 100, '-1"}') ELSE '' END, '}') AS attributes FROM source_records r""",
    "lead_rows": """SELECT c_custkey AS id, concat('{"id":"', c_custkey, '","created_time":"2001-05-', lpad(concat('', 1 + c_custkey % 28), 2, '0'), CASE WHEN c_custkey % 10 = 9 THEN 'T10:00:00' ELSE 'T10:00:00+0000' END, '","form_id":"', 70 + c_custkey % 3, '","field_data":[{"name":"email","values":["p', c_custkey, '@x.org"]},{"name":"town","values":[]}],"custom_disclaimer_responses":[',
  CASE WHEN c_custkey % 7 = 6 THEN '' ELSE concat('{"checkbox_key":"ok","is_checked":"', CASE WHEN c_custkey % 5 = 0 THEN 'no' ELSE 'YES' END, '"}') END, '],"questions":[{"key":"ok","label":"', CASE WHEN c_custkey % 4 = 0 THEN 'I agree to everything' ELSE 'I agree' END, '"}]}') AS body FROM customer""",
    "logins": "SELECT profile_id, CASE WHEN id % 4 < 2 THEN 'login_a' ELSE 'login_b' END AS kind, login_id AS value FROM source_records WHERE login_id IS NOT NULL AND profile_id IS NOT NULL",
    "blocklist": "SELECT 'email' AS type, 'noemail@*' AS value, 'seed' AS reason UNION ALL SELECT 'email', '*@test.com', 'seed' UNION ALL SELECT 'email', 'p1*@ex1.org', 'seed' UNION ALL SELECT 'phone', '+12025550007', 'seed'",
    "suppressions": "SELECT CASE WHEN c_custkey % 2 = 0 THEN 'deletion' ELSE 'email' END AS type, c_custkey AS profile_id FROM customer WHERE c_custkey % 19 = 4",
    "merges": "SELECT c_custkey AS loser_id, c_custkey - 1 AS winner_id FROM customer WHERE c_custkey % 37 = 36",
    "aliases": "SELECT concat('k', c_custkey) AS retired_id, concat('k', c_custkey + 1) AS survivor_id FROM customer WHERE c_custkey % 6 IN (1, 2, 3)",
    "devices": "SELECT concat('dev', event_id % 900) AS device_key, user_id AS profile_id, CAST(ts - INTERVAL 8217 DAY AS DATE) AS seen_on, event_id % 7 = 0 AS authenticated FROM events",
}
BASE = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations embeddings".split()


def needs(sql: str) -> list[str]:
    """Names of domain views that a text reads, each after those that it reads itself."""
    found: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(VIEWS[name])
                if name not in found:
                    found.append(name)

    visit(sql)
    return found


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view, or a test table of that name."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    read = {n: view(spark, sf_dir, n) for n in [*BASE, *VIEWS] if n != name and re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql)}
    for n in read:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{n}\b", rf"\1 {{{n}}}", sql)
    if not read:
        return spark.sql(sql)
    sql = re.sub(r"'[^']*'", lambda text: text[0].replace("{", "{{").replace("}", "}}"), sql)  # braces in texts are no names
    return spark.sql(sql, **read)


def with_views(sql: str) -> str:
    """The oracle's text with the views that it reads as common table expressions."""
    names = needs(sql)
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    if not names:
        return sql
    head = sql.lstrip()
    if head.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {head[len('WITH RECURSIVE') :]}"
    return f"WITH {ctes}, {head[4:]}" if head.upper().startswith("WITH ") else f"WITH {ctes} {head}"
