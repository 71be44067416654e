"""Search by trigrams against a scan, returns in every spelling, keys of every kind and the guard over them."""

import random

import pytest
from pyspark.sql import functions as F

from pledgework.functions import normalize as N
from pledgework.operators import keys as K
from pledgework.operators import returns, search


def test_search_equals_the_scan(spark):
    rng = random.Random(3)
    part = lambda: "".join(rng.choice("abé1") for _ in range(rng.randint(1, 5)))
    texts = [(i, " ".join(part() for _ in range(rng.randint(1, 3)))) for i in range(400)] + [(900, None), (901, ""), (902, " - "), (903, "Ab")]
    rows = spark.createDataFrame(texts, "id long, text string")
    asked = spark.createDataFrame([(1, "ab1 bé"), (2, "AB"), (3, ""), (4, None), (5, "zzz"), (6, "a b 1")], "q int, text string")
    index = search.build(rows, "id", "text")
    a, b = N.trigrams(F.col("x")), N.trigrams(F.col("text"))
    scan = rows.crossJoin(asked.withColumnRenamed("text", "x")).select("q", "id", (F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))).alias("s")).collect()
    for least in (0.05, 0.3, 0.5, 0.8, 1.0):
        want = sorted((r["q"], r["id"], round(r["s"], 6)) for r in scan if r["s"] is not None and r["s"] >= least and r["s"] > 0)
        assert sorted(map(tuple, search.search(index, asked, least).collect())) == want
    few = search.candidates(index, asked, 0.8).count()
    assert few < 0.1 * 400 * 4
    for bad in (0, 1.1):
        with pytest.raises(ValueError):
            search.search(index, asked, bad)


def test_returns_in_every_spelling(spark):
    at = "2024-01-0{}"
    events = spark.createDataFrame(
        [(1, 1, 1, "donation", "a", at.format(1), "{}"), (2, 1, 1, "donation", "b", at.format(2), None), (3, 1, 1, "donation", "c", at.format(3), '{"is_refund":"true"}'), (4, 1, 1, "donation", "d", at.format(4), '{"is_refund":false}'), (5, 1, 1, "donation", "e", at.format(5), "{}"), (6, 1, 2, "donation", "a", at.format(6), "{}"), (7, 2, 1, "donation", "a", at.format(7), "{}"), (8, 3, 1, "donation", None, at.format(8), "{}"),
         (9, 1, 1, "donation_return", "x", at.format(9), '{"original_gift_external_id":"gift:a"}'), (10, 1, 1, "donation_return", "y", at.format(9), '{"original_donation_id":"donation:_event:b"}'), (11, 1, 1, "donation_return", "z", at.format(9), "{}")],
        "id long, profile_id long, source_id long, name string, message_id string, occurred_at string, properties string",
    )
    gifts = spark.createDataFrame([(1, 1, -5.0, '{"original_donation_id":"donation:e"}'), (1, 1, 5.0, '{"original_donation_id":"d"}'), (2, 1, 5.0, '{"is_refund":true,"original_gift_external_id":"zz"}'), (3, 1, -1.0, None)], "profile_id long, source_id long, amount double, attributes string")
    assert sorted(r["id"] for r in returns.unreturned(events, gifts).collect()) == [4, 6, 7, 8]
    last = {r["profile_id"]: r["last_donation_at"] for r in returns.last_donation(spark.createDataFrame([(1,), (2,), (9,)], "profile_id long"), events, gifts).collect()}
    assert last == {1: at.format(6), 2: at.format(7), 9: None}


def test_keys_of_every_kind_and_the_guard(spark):
    rows = [(1, 1, "s", " e1 ", "A@x.org ", "+1", '{"user_id":" u ","anonymous_id":"an","identify":{"a":1},"okta_customer_id":"o","zeta_uid":"UP"}'), (2, 1, "s", "", None, None, '{"email_sha256":"AB","anonymous_id":"an","identify":0,"user_id":"' + "x" * 201 + '"}'), (3, 1, "s", "e3", None, None, None)]
    records = spark.createDataFrame(rows, "id long, source_id long, source_key string, external_id string, email string, phone string, attributes string")
    verified = spark.createDataFrame([(1, "app", "page"), (2, "app2", "page2")], "id long, app_user_id string, page_user_id string")
    got = {}
    for r in K.keys(records, verified).collect():
        got.setdefault(r["id"], {})[r["kind"]] = r["value"]
    assert {k: v for k, v in got[1].items() if not k.startswith("email_")} == {"external": "s:e1", "email": "a@x.org", "phone": "+1", "okta_customer_id": "o", "zeta_uid": "up", "user_id": "s:u", "anonymous_id": "an", "app_user_id": "app", "page_user_id": "page"}
    assert got[2] == {"email_sha256": "ab", "app_user_id": "app2"} and got[3] == {"external": "s:e3"}
    many = spark.range(80).select("id", (F.col("id") % 2).alias("source_id"), F.concat(F.lit("e"), (F.col("id") / 2).cast("int") % 26).alias("external_id"), F.lit("email").alias("kind"), F.when(F.col("id") < 60, "a@x").otherwise("b@x").alias("value"), F.when(F.col("id") == 3, "gift").alias("record_type"))
    found, people = many.select("id", "source_id", "kind", "value"), many.select("id", "external_id", "record_type")
    listed, left = K.guarded(found, people, spark.createDataFrame([("email", "z", "seed")], "type string, value string, reason string"))
    assert sorted(r["value"] for r in listed.collect()) == ["a@x", "z"] and left.count() == 20
    assert K.crowded(found, people, 26).collect() == []
