"""Partner feeds of each shape, and malformed ones kept as rejects."""

import json

from pledgework.sources import feeds


def canonical(spark, *rows):
    made = spark.createDataFrame([(i, f, b if b is None or isinstance(b, str) else json.dumps(b)) for i, (f, b) in enumerate(rows)], "id int, feed string, body string")
    return [r for r in sorted(feeds.canonical(made, ("vod_viewed",)).collect(), key=lambda r: r["id"])]


def test_people(spark):
    a, b, c, d, e, f = canonical(
        spark,
        ("people", {"id": "cdp-1", "properties": {"x": 1, "y": 1, "z": None}, "attributes": {"y": 2, "w": {"k": [1]}}, "y": 3}),
        ("people", {"user_id": "7", "id": "8"}),
        ("lookups", {"id": "cdp-2", "zeta_uid": "u"}),
        ("models", {"external_id": "", "user_id": "7"}),
        ("models", {"user_id": "7", "attributes": {"enrichment": 1}}),
        ("people", {"hubspot_record_id": 55}),
    )
    assert (a["record_type"], a["external_id"], a["values"], a["reason"]) == ("contact", "cdp-1", {"x": "1", "y": "3", "w": '{"k":[1]}', "zeta_cdp_id": "cdp-1"}, None)
    assert (b["external_id"], b["values"]) == ("7", {"zeta_uid": "7"}) and (c["external_id"], c["values"]) == ("u", {"zeta_uid": "u"})
    assert d["reason"] == "no identity" and e["reason"] == "enrichment without evidence" and (f["external_id"], f["values"]) == ("55", {"hubspot_record_id": "55"})


def test_enrichments_and_resources(spark):
    whole = {"vendor": "v", "license_id": "l", "append_date": "2024-01-01", "user_id": "u", "attributes": {"vendor": "x", "age": 3}}
    a, b, c, d, e, f, g = canonical(
        spark,
        ("enrichment", whole),
        ("enrichment", {**whole, "append_date": ""}),
        ("enrichment", dict(reversed(whole.items()))),
        ("resources", {"source_code": "s", "attributes": {"k": 1, "j": 1}, "k": 2, "series": "x"}),
        ("resources", {"key": "k" * 201}),
        ("resources", {"id": 4, "name": 5}),
        ("resources", {"id": 4, "attributes": []}),
    )
    assert a["external_id"].startswith("_enrichment:") and a["external_id"] == c["external_id"] and a["contact_external_id"] == "u"
    assert a["values"] == {"vendor": "v", "license_id": "l", "append_date": "2024-01-01", "age": "3"} and b["reason"] == "no evidence or identity"
    assert (d["key"], d["values"], d["reason"]) == ("s", {"k": "2", "j": "1", "series": "x", "source_code": "s"}, None)
    assert [r["reason"] for r in (e, f, g)] == ["no key", "name or series is no text", "attributes are no object"]


def test_events_and_rejects(spark):
    a, b, *bad = canonical(
        spark,
        ("tracks", {"id": 9, "event": "VOD viewed!", "user_id": "u", "timestamp": "t", "okta_customer_id": "o", "more": {"x": 1}, "properties": {"more": 0, "p": 1}, "attributes": {"c": 1}}),
        ("tracks", {"external_id": "e", "message_id": "m", "type": "page", "phone": "1"}),
        (None, "{}"), ("people", None), ("people", "nope"), ("people", "[1]"), ("tracks", {"id": "e", "user_id": "u", "properties": None}), ("tracks", {"user_id": "u"}), ("tracks", {"id": "e"}),
    )
    assert (a["external_id"], a["message_id"], a["name"], a["type"], a["contact_external_id"], a["occurred_at"]) == ("_event:9", "9", "vod_viewed", None, "u", "t")
    assert a["properties"] == {"more": '{"x":1}', "p": "1"} and a["values"] == {"c": "1", "okta_customer_id": "o"}
    assert (b["message_id"], b["name"], b["type"], b["reason"]) == ("m", "page", "page", None)
    assert [r["reason"] for r in bad] == ["no feed", "no object", "no object", "no object", "properties are no object", "no external id", "no contact"]
    assert bad[2]["body"] == "nope"
