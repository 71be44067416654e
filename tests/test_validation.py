"""Import rules and identity steps on small rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pledgework.functions import validation as V
from pledgework.operators import linking as L
from pledgework.sources import mapping as M


def column(spark, values, made):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(made(F.col("x"))).collect()]


def test_timestamps(spark):
    got = column(spark, ["2024-01-02T03:04:05Z", "2024-01-02", "2024-01-02 03:04", "2024-01-02T03:04:05+02:00", "2024-13-02", "noon", "", None], lambda c: V.parse_timestamp(c).cast("timestamp_ntz"))
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4), dt.datetime(2024, 1, 2, 1, 4, 5), None, None, None, None]


def test_timestamps_without_a_zone_are_utc_in_any_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = column(spark, ["2024-01-02 03:04", "2024-01-02", "2024-07-02T03:04:05.25", "2024-01-02T03:04:05-0500"], lambda c: F.unix_micros(V.parse_timestamp(c)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    at = lambda *x: int(dt.datetime(*x, tzinfo=dt.timezone.utc).timestamp() * 1_000_000)
    assert got == [at(2024, 1, 2, 3, 4), at(2024, 1, 2), at(2024, 7, 2, 3, 4, 5, 250_000), at(2024, 1, 2, 8, 4, 5)]


def test_resources_are_inserted_or_replaced_and_others_kept(spark):
    kind = "key string, name string, line int"
    table = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "key string, name string")
    put = lambda rows, order=None: {r["key"]: r["name"] for r in L.resource_upsert(table, spark.createDataFrame(rows, kind) if order else spark.createDataFrame(rows, kind).drop("line"), order).collect()}
    assert put([("1", "x", 1), ("9", None, 2)]) == {"1": "x", "2": "b", "3": "c", "9": None}
    assert put([]) == {"1": "a", "2": "b", "3": "c"}
    with pytest.raises(L.RepeatedKeys):
        put([("1", "x", 1), ("1", "y", 2)])
    assert put([("1", "x", 2), ("1", "y", 1), ("2", "z", 3)], "line") == {"1": "x", "2": "z", "3": "c"}


def test_a_dry_run_judges_values(spark):
    rows = spark.createDataFrame([("abc", "not a date", "maybe"), ("$1,200.5", "01/02/2024", "yes"), ("12.345", "2024-02-30", ""), ("1000000000000", "Jan 05, 2024", None), (None, None, None), ("-3.10", "2024-01-01", "0")], "`A``m` string, d string, r string")
    got = M.dry_run(rows, {"A`m": "amount", "d": "gift_date", "r": "is_recurring"}, "gift").first()
    assert got["errors"] == {"amount": 4, "gift_date": 3, "is_recurring": 1} and got["warnings"] == {"gift_date: date_ambiguous": 1, "gift_date: date_fallback_format": 1}
    assert (got["rows_checked"], got["rows_ok"], got["rows_rejected"]) == (6, 2, 4)
    events = spark.createDataFrame([("x", "2024-01-01T00:00:00", "{}"), ("x", "noon", "[1]"), ("", "2024-01-01", "no")], "n string, t string, p string")
    assert M.dry_run(events, {"n": "name", "t": "occurred_at", "p": "properties"}, "event").first()["errors"] == {"name": 1, "occurred_at": 1, "properties": 2}
    scores = spark.createDataFrame([("e", "v", "l", "2024-01-01", "7"), ("", "v", "", "01/01/2024", "x")], "i string, v string, l string, a string, s string")
    columns = {"i": "email", "v": "vendor", "l": "license_id", "a": "append_date", "s": {"enrichment": "score", "data_type": "number"}}
    assert M.dry_run(scores, columns, "enrichment").first()["errors"] == {"append_date": 1, "identifier": 1, "license_id": 1, "score": 1}
    assert M.dry_run(spark.createDataFrame([("", " "), ("a", "")], "e string, n string"), {"e": "email", "n": "first_name"}, "contact").first()["errors"] == {"content": 1}


def test_required_and_vocabulary(spark):
    rows = spark.createDataFrame([("email", "maybe", None, ""), ("", None, "x", "a@b.c"), ("fax", "unknown", "x", None)], "channel string, status string, captured_at string, email string")
    fields = {n: F.col(n) for n in rows.columns}
    got = rows.select(V.required_errors("consent", fields), V.consent_errors(F.col("channel"), F.col("status"))).collect()
    assert [tuple(r) for r in got] == [(["captured_at", "identifier"], ["status"]), (["channel", "status"], []), (["identifier"], ["channel"])]
    assert rows.select(V.required_errors("contact", fields)).first()[0] == [] and rows.select(V.required_errors("gift", {})).first()[0] == ["amount", "gift_date"]


def test_model_dates(spark):
    rows = spark.createDataFrame([({"rfm_score": "1"},), ({"rfm_score": "1", "rfm_date": "2024"},), ({"rfm_date": "2024"},), ({"amt_suggested": "5", "wealth_score": "1"},), ({},)], "a map<string,string>")
    assert [r[0] for r in rows.select(V.model_date_errors(F.col("a"))).collect()] == [["rfm_date"], [], [], ["donation_ask_model_date", "wealth_score_model_date"], []]


def test_addresses(spark):
    def key(line1, line2=None, city="Troy", region="New York", postal="12180-1", country=None):
        row = spark.createDataFrame([(line1, line2, city, region, postal, country)], "a string, b string, c string, d string, e string, f string")
        return row.select(V.address(*map(F.col, "abcdef")).alias("x")).first()["x"]

    one = key("12 North Main Street", "Apt. 4b")
    assert (one["number"], one["street"], one["unit"], one["state"], one["zip5"]) == ("12", "N MAIN ST", "4B", "NY", "12180")
    assert one["address_key"] == key("12 n main st # 4B", region="ny", country="usa")["address_key"] != key("12 n main st")["address_key"]
    for bad in (key("PO Box 9"), key("Main Street"), key("12 Main St", region="Nowhere"), key("12 Main St", postal="12"), key("12 Main St", country="DE"), key(None)):
        assert bad["address_key"] is None


def test_names_and_words(spark):
    assert column(spark, ["Bob", " lizzy ", "Jan", None], V.nickname) == ["robert", "elizabeth", "jan", None]
    assert column(spark, ["Yes", "1", "no", None], V.is_hard_bounce) == [True, True, False, False]


def test_assignments_and_conflicts(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (9, 9)], "id long, label long")
    owned = spark.createDataFrame([(1, 70), (1, 60)], "label long, profile_id long")
    won = L.winners(owned, spark.createDataFrame([(70, "a"), (60, "b")], "profile_id long, master_id string"))
    assert [tuple(r) for r in L.moves(owned, won).collect()] == [(60, 70)]
    assert sorted(map(tuple, L.assignments(labels, won, 100).collect())) == [(1, 70), (2, 70), (5, 101), (9, 102)]
    scored = spark.createDataFrame([(1, 2, 0.999), (3, 4, 0.999), (3, 5, 0.9), (4, 5, 0.1)], "l long, r long, probability double")
    keys = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "a", "z"), (5, "b", "z")], "profile_id long, kind string, value string")
    assert {(r["l"], r["r"]): r["band"] for r in L.unlinked(scored, keys).collect()} == {(1, 2): "conflict", (3, 4): "linked", (3, 5): "review", (4, 5): "rejected"}


def test_staging(spark):
    rows = spark.createDataFrame([(1, 7, 1, "", "2000-01-02", "Bob", dt.date(2024, 1, 1)), (2, 7, 2, "Flat 2", "01/02/2000", "Rob", dt.date(2024, 2, 1)), (3, 7, 2, "Flat 3", None, None, dt.date(2023, 2, 1))], "id long, profile_id long, source_id long, address2 string, dob string, first_name string, updated_at date")
    got = L.staged(rows, spark.createDataFrame([(1, 10), (2, 20)], "id long, priority long")).first()
    assert (got["address2"], got["dob"], got["nickname"]) == ("Flat 2", dt.date(2000, 1, 2), "robert")
