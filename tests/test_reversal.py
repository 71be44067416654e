"""Reversed merges, mappings, device links and ranges on small rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pledgework.operators import reversal as R
from pledgework.operators.ranges import feed_window, report_range
from pledgework.sources import mapping as M
from pledgework.streaming import devices as D

MERGE = "merge_id long, winner_id long, loser_id long, undone_at date"
ROW = "id long, profile_id long, stamp string"


def test_refusals(spark):
    merges = spark.createDataFrame([(1, 10, 11, None), (2, 20, 21, None), (3, 20, 22, None), (4, 30, 31, None), (5, 40, 41, dt.date(2024, 1, 1)), (6, 50, 51, None), (7, 60, 61, None)], MERGE)
    before = spark.createDataFrame([(100, 10, "a"), (101, 11, None), (102, 30, "a"), (103, 61, "a")], ROW)
    after = spark.createDataFrame([(100, 10, "a"), (101, 10, None), (102, 30, "b"), (103, 60, "a")], ROW)
    profiles = spark.createDataFrame([(i, 9 if i == 60 else None, i == 51) for w in (10, 20, 30, 40, 50, 60) for i in (w, w + 1, w + 2)], "id long, merged_into_id long, is_deleted boolean")
    got = {r["merge_id"]: r["reason"] for r in R.refusals(merges, R.record(merges, {"gift": before}), {"gift": after}, profiles).collect()}
    assert got == {1: None, 2: "later_merge", 3: None, 4: "changed", 5: "undone", 6: "erased", 7: "merged"}
    empty = merges.limit(0)
    assert R.refusals(empty, R.record(empty, {"gift": before}), {"gift": after}, profiles).count() == 0


def test_reversal_gives_each_side_its_rows(spark):
    merges = spark.createDataFrame([(1, 10, 11, None), (2, 20, 21, None), (3, 30, 31, None)], MERGE)
    keys = spark.createDataFrame([(1, "winner", 5, 1), (1, "loser", 5, 2), (2, "winner", 5, 1), (2, "loser", 4, 9)], "merge_id long, side string, first_seen long, id long")
    to = R.targets(merges, keys, 100)
    assert {(r["merge_id"], r["side"]): r["profile_id"] for r in to.collect()} == {(1, "winner"): 10, (1, "loser"): 101, (2, "winner"): 102, (2, "loser"): 20, (3, "winner"): 30, (3, "loser"): 103}
    recorded = R.record(merges, {"gift": spark.createDataFrame([(100, 10, None), (101, 11, None), (102, 21, None)], ROW)})
    now = spark.createDataFrame([(100, 10), (101, 10), (102, 20), (103, 77)], "id long, profile_id long")
    assert sorted(map(tuple, R.repointed(now, "gift", recorded, to).collect())) == [(100, 10), (101, 101), (102, 20), (103, 77)]
    had = spark.createDataFrame([(1, "winner", "email", "opted_in"), (1, "loser", "email", "opted_out"), (1, "loser", "sms", "opted_in")], "merge_id long, side string, channel string, status string")
    merged = spark.createDataFrame([(10, "email", "opted_out"), (10, "sms", "opted_in")], "profile_id long, channel string, status string")
    assert sorted(map(tuple, R.consents(merges, had, merged, to).collect())) == [(10, "email", "opted_out"), (101, "email", "opted_out"), (101, "sms", "opted_in")]


def test_mappings(spark):
    assert M.suggest(["E-Mail", "Gift_Amt", "DATE", "odd"], "gift") == {"E-Mail": "email", "Gift_Amt": "amount", "DATE": "gift_date"}
    assert M.suggest(["amount", "Event"], "event") == {"amount": "properties.amount", "Event": "name"}
    assert M.suggest(["Hard bounce", "Plan", "Shoe size"], "contact", frozenset({"plan"})) == {"Hard bounce": "attributes.hard_bounce", "Plan": "attributes.plan"}
    assert M.mapping_errors({"a": "email", "b": "amount"}, "gift", ["a", "b"]) == []
    assert len(M.mapping_errors({"a": "email", "b": "email", "c": "shoe", "d": "attributes.x"}, "gift", ["a", "b", "c"])) == 4
    assert M.mapping_errors({"a": "email", "b": {"enrichment": "x", "data_type": "number"}}, "enrichment", ["a", "b"]) == []
    assert M.mapping_errors({"a": "status"}, "consent", ["a"]) == ["exactly one identifier is needed"]
    with pytest.raises(ValueError):
        M.targets("shoe")
    rows = spark.createDataFrame([("5", "2024-01-01"), ("", "2024-01-01"), (None, None)], "`Gift.Amt` string, Date string")
    got = M.dry_run(rows, {"Gift.Amt": "amount", "Date": "gift_date"}, "gift").first()
    assert (got["rows_checked"], got["rows_ok"], got["rows_rejected"], got["errors"]) == (3, 1, 2, {"amount": 2, "gift_date": 1})
    assert M.dry_run(rows.limit(0), {"Gift.Amt": "amount", "Date": "gift_date"}, "gift").first()["rows_checked"] == 0


def test_devices_expire(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    key = "{0B5F9E0A-1111-4222-8333-123456789ABC}"
    rows = spark.createDataFrame([(7, 1, at(20), f'{{"ad":"{key}","cookie":"x y"}}'), (7, 2, at(22), f'{{"ad":"{key.lower()[1:-1]}"}}'), (7, 1, at(2), '{"cookie":"old"}'), (None, 1, at(22), '{"cookie":"n"}'), (8, 1, at(22), '{"ad":"00000000-0000-0000-0000-000000000000","cookie":"c"}')], "profile_id long, source_id int, occurred_at timestamp, properties string")
    first = D.linked(D.sightings(rows, ("ad",), ("cookie",)), at(25))
    got = {(r["key_type"], r["device_id"], r["profile_id"]): (r["source_id"], r["first_seen_at"], r["expires_at"]) for r in first.collect()}
    assert got == {("ad", "0b5f9e0a-1111-4222-8333-123456789abc", 7): (2, at(20), dt.datetime(2024, 2, 1)), ("cookie", "c", 8): (1, at(22), dt.datetime(2024, 2, 1))}
    none = rows.limit(0)
    assert D.linked(D.sightings(none, ("ad",), ("cookie",)), dt.datetime(2024, 2, 1), links=first).count() == 0
    assert D.linked(D.sightings(rows, ("ad",), ("cookie",)), at(26), links=first).count() == 2


def test_tail(spark):
    rows = spark.range(20).select("id", F.lit("track").alias("type"), F.lit("n").alias("name"), F.lit(1).alias("profile_id"), F.lit(None).cast("timestamp").alias("occurred_at"), (F.col("id") % 2).alias("source_id"), F.lit("x").alias("properties"))
    page = D.tail(rows, 1, 3)
    assert [r["id"] for r in page.collect()] == [19, 17, 15] and "properties" not in page.columns
    assert [r["id"] for r in D.tail(rows, 1, 3, 15).collect()] == [13, 11, 9]
    with pytest.raises(ValueError):
        D.tail(rows, 1, 0)


def test_ranges():
    now = dt.datetime(2024, 3, 2, 4, 30, tzinfo=dt.timezone.utc)  # 23:30 of the day before in New York
    assert feed_window("hourly", now) == "2024-03-01T23-0500" and feed_window("daily", now, hour=23) == "2024-03-01"
    assert feed_window("monthly", now) == "2024-03" and feed_window("monthly", now, day=2) is None and feed_window("daily", now, hour=23, minute=31) is None and feed_window("manual", now) is None
    assert report_range(dt.date(2024, 2, 29)) == (dt.date(2023, 3, 1), dt.date(2024, 2, 29), dt.date(2022, 2, 28), dt.date(2023, 2, 28))
    assert report_range(dt.date(2024, 2, 29), dt.date(2024, 2, 1), dt.date(2024, 2, 1))[2:] == (dt.date(2024, 1, 31), dt.date(2024, 1, 31))
    for bad in ((dt.date(2024, 2, 2), dt.date(2024, 2, 1)), (dt.date(2004, 2, 2), dt.date(2024, 2, 1))):
        with pytest.raises(ValueError):
            report_range(dt.date(2024, 2, 2), *bad)
