"""Fields that may leave, mappings and their columns; a folder of lookups."""

import datetime as dt
from decimal import Decimal

import pytest

from pledgework.operators import fields as X
from pledgework.sources import filedrop as D

DAY = dt.date(2024, 12, 31)


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(1, "crm", True, None, None), (2, "gone", False, None, None), (3, "ended", None, None, dt.date(2024, 12, 30)), (4, "kept", None, False, None), (5, "last", None, None, DAY)]
    return spark.createDataFrame(rows, "id long, key string, is_active boolean, exportable boolean, license_expires_at date")


@pytest.fixture(scope="module")
def values(spark):
    d = dt.date
    rows = [(1, 1, "score", None, Decimal("7.50"), None, d(2024, 1, 1)), (1, 1, "score", None, Decimal("9.00"), None, d(2024, 1, 2)), (1, 5, "since", None, None, None, d(2024, 1, 1)), (2, 5, "since", "x", None, DAY, d(2024, 1, 1)), (2, 1, "score", None, Decimal(1), d(2024, 12, 30), d(2024, 1, 1)), (3, 2, "score", None, Decimal(1), None, d(2024, 1, 1))]
    return spark.createDataFrame(rows, "profile_id long, source_id long, attribute_key string, value_text string, value_num decimal(10,2), license_expires_at date, imported_at date")


def test_offered_fields_follow_licence_and_name(spark, sources):
    rows = [(s, k, f) for s in (1, 2, 3, 4, 5) for k, f in (("score", False), ("Political_lean", None))] + [(1, "income", False), (1, "income", True)]
    got = X.offered(spark.createDataFrame(rows, "source_id long, attribute_key string, sensitive boolean"), sources, DAY)
    assert sorted(tuple(r) for r in got.collect()) == [("crm", "Political_lean", True), ("crm", "income", True), ("crm", "score", False), ("last", "Political_lean", True), ("last", "score", False)]
    allowed = X.registry(got, {"plan": False, "inmate": True, "address2": False})
    assert allowed["enrichment", "crm", "score"].pii and allowed["canonical", None, "address2"].pii and not allowed["trait", None, "ltv_total"].pii
    assert not any(f.sensitive for f in X.registry(got, {"inmate": True}, "viewer").values())
    assert "canonical:inmate" not in X.everything(allowed) and X.everything(allowed, labels=True)["computed__enrichment__crm__score"] == {"kind": "enrichment", "key": "score", "source": "crm"}
    assert X.sensitive({"a": {"kind": "canonical", "key": "inmate"}, "b": {"kind": "trait", "key": "ltv_total"}}, allowed) == ["canonical:inmate"]


def test_mappings_that_may_not_leave():
    allowed = X.registry(None, {"inmate": True})
    ok = {"Mail": {"kind": "profile", "key": "email", "required": True}, "Kind": {"kind": "constant", "value": "x"}}
    assert X.validated(ok, allowed) == ok
    jail = {"a": {"kind": "canonical", "key": "inmate"}}
    assert X.validated(jail, allowed, chosen=("canonical:inmate",)) == jail
    email = {"kind": "profile", "key": "email"}
    bad = [{}, [], {" ": email}, {"a\n": email}, {"x" * 101: email}, {"a": 1}, {"a": email | {"more": 1}}, {"a": {"kind": 1}}, {"a": {"kind": "profile", "key": 5}}, {"a": email | {"required": 1}}, {"a": {"kind": "constant", "value": 1}}, {"a": {"kind": "constant", "value": "x" * 2001}}, {"a": {"kind": "profile", "key": "secret"}}, {"a": {"kind": "enrichment", "source": "no", "key": "x"}}, jail]
    for mapping in bad:
        with pytest.raises(X.MappingError):
            X.validated(mapping, allowed)
    for mapping in (ok, {"k": {"kind": "constant", "value": "x"}}, {"m": email}):
        with pytest.raises(X.MappingError):
            X.validated(mapping, allowed, include_pii=False)


def test_mapped_columns(spark, sources, values):
    people = spark.createDataFrame([(1, "a@x.org"), (2, ""), (3, None)], "id long, email string")
    traits = spark.createDataFrame([(1, Decimal("5.00"), ["a", "b"]), (2, None, [])], "profile_id long, ltv_total decimal(18,2), source_keys array<string>")
    mapping = {"mail": {"kind": "profile", "key": "email", "required": True}, "city": {"kind": "profile", "key": "city"}, "ltv": {"kind": "trait", "key": "ltv_total"}, "keys": {"kind": "trait", "key": "source_keys"}, "score": {"kind": "enrichment", "source": "crm", "key": "score"}, "since": {"kind": "enrichment", "source": "last", "key": "since"}, "off": {"kind": "enrichment", "source": "gone", "key": "score"}, "id": {"kind": "constant", "value": "c"}}
    got = sorted(tuple(r) for r in X.mapped(people, mapping, DAY, traits, None, values, sources).collect())
    assert got == [(1, False, "a@x.org", None, "5.00", '["a","b"]', "9.00", None, None, "c"), (2, True, "", None, None, "[]", None, "x", None, "c"), (3, True, None, None, None, None, None, None, None, "c")]
    assert X.mapped(people.filter("false"), mapping, DAY, traits, None, values, sources).collect() == []


FILES = {
    "good.csv": b'\xef\xbb\xbfdonor_account_numbers\r\nd1\r\n\r\n d2 \r\n"d,""3"\r\n=d4\r\nd1\r\n',
    "other.csv": b"okta_customer_id\nd1\n",
    "head.csv": b"email\na@x.org\n",
    "two.csv": b"donor_account_number\nd1,d2\n",
    "blank.csv": b"donor_account_number\nd1\n  \n",
    "none.csv": b"donor_account_number\n",
    "empty.csv": b"",
    "bytes.csv": b"donor_account_number\n\xff\xfe\n",
    "open.csv": b'donor_account_number\n"d1\nd2"\n',
    "long.csv": b"donor_account_number\n" + b"x" * 513,
    "many.csv": b"donor_account_number\n" + b"d\n" * 10_001,
    ".hidden.csv": b"donor_account_number\nd1\n",
    "a b.csv": b"donor_account_number\nd1\n",
}


def test_a_folder_of_lookups(spark, tmp_path):
    inbox, outbox = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    for name, content in FILES.items():
        (inbox / name).write_bytes(content)
    kind = "donor_account_number"
    owners = spark.createDataFrame([(kind, "d1", 1), (kind, "d1", 1), (kind, "d2", 1), (kind, "d2", 2), (kind, 'd,"3', 3), ("okta_customer_id", "d9", 4)], "key_type string, value string, profile_id long")
    masters = spark.createDataFrame([(1, "m1"), (2, "m2"), (3, "m3")], "profile_id long, master_id string")
    got = {r["name"]: (r["rows"], r["outcome"], r["reason"], r["digest"]) for r in D.poll(spark, str(inbox), str(outbox), owners, masters).collect()}
    assert {n: v[1:3] for n, v in got.items()} == {
        "good.csv": ("published", None), "other.csv": ("published", None), "head.csv": ("refused", "not one column of keys"), "two.csv": ("refused", "an invalid key"), "blank.csv": ("refused", "an invalid key"),
        "none.csv": ("refused", "no key"), "empty.csv": ("refused", "not one column of keys"), "bytes.csv": ("refused", "not UTF-8"), "open.csv": ("refused", "an invalid key"), "long.csv": ("refused", "an invalid key"), "many.csv": ("refused", "too many rows"),
    }
    answer = outbox / f"{got['good.csv'][3]}.lookup.csv"
    assert answer.read_bytes().decode().split("\r\n") == ["key_type,key_value,master_id,status", f"{kind},d1,m1,matched", f"{kind},d2,,ambiguous", f'{kind},"d,""3",m3,matched', f"{kind},'=d4,,unknown", f"{kind},d1,m1,matched", ""]
    assert (outbox / f"{got['other.csv'][3]}.lookup.csv").read_text().split() == ["key_type,key_value,master_id,status", "okta_customer_id,d1,,unknown"]
    answer.write_text("kept")  # an answer is never written again
    (inbox / "other.csv").write_bytes(b"okta_customer_id\nd9\n")
    again = {r["name"]: r["outcome"] for r in D.poll(spark, str(inbox), str(outbox), owners, masters).collect()}
    assert again["good.csv"] == "skipped" and again["other.csv"] == "published" and answer.read_text() == "kept"
    assert len([p for p in outbox.iterdir() if p.name.endswith(".lookup.csv")]) == 3


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    owners = spark.createDataFrame([], "key_type string, value string, profile_id long")
    masters = spark.createDataFrame([], "profile_id long, master_id string")
    assert D.poll(spark, str(tmp_path / "in"), str(tmp_path / "out"), owners, masters).collect() == []
