"""Identity queries over all records, against brute force on few rows and by what they must reach."""

import itertools
import os

import pytest

from pledgework.operators import identity, keys
from pledgework.plans import catalog
from pledgework.sources.adapter import view

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't there")


def test_household_counts_people_not_records(spark):
    rows = [(1, "1 Main St", "10001", "Lee"), (1, "1 MAIN ST", "10001", "lee"), (2, "1 Main St", "10001", "Lee"), (3, None, "10001", "Lee")]
    got = identity.households(spark.createDataFrame(rows, "profile_id long, address1 string, postal_code string, last_name string")).collect()
    assert sorted((r["profile_id"], r["household_size"]) for r in got) == [(1, 2), (2, 2)]


@here
def test_whole_queries_reach_every_record(spark):
    records = view(spark, SF, "source_records").collect()
    pairs = {(r["l"], r["r"]) for r in catalog.queries()["match_pair_scores_all"](spark, SF).collect()}
    blocks = (("address1", "postal_code"), ("phone",), ("last_name", "postal_code"))
    want = {(a["id"], b["id"]) for a, b in itertools.combinations(sorted(records, key=lambda r: r["id"]), 2) if any(all(a[c] is not None and a[c] == b[c] for c in block) for block in blocks)}
    assert pairs == want and any(a // 3 == b // 3 for a, b in pairs)
    reached = {r["profile_id"] for r in catalog.queries()["households_all"](spark, SF).collect()}
    assert reached == {r["profile_id"] for r in records if r["profile_id"] is not None and r["address1"] is not None}
    assert catalog.queries()["master_lookup_all"](spark, SF).count() == len(records)


def test_lookup_follows_aliases_to_active_profiles(spark):
    asked = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c"), (3, "a")], "place long, value string")
    owners = spark.createDataFrame([("a", 1), ("b", 1), ("b", 3), ("c", 9)], "value string, profile_id long")
    aliases = spark.createDataFrame([(1, 2), (2, 3)], "retired_id long, survivor_id long")
    active = spark.createDataFrame([(3,)], "profile_id long")
    got = {r["place"]: (r["status"], r["profile_id"]) for r in identity.lookup(asked, owners, aliases, active).collect()}
    assert got == {0: ("matched", 3), 1: ("matched", 3), 2: ("not_found", None), 3: ("matched", 3)}


def test_keys_of_a_record_are_told_apart_in_its_row(spark):
    rows = [(1, 1, "src1", "x1", " A@x.org", "+1", '{"_identity_reference":{"source_key":"src1","contact_external_id":"x1"}}')]
    found = keys.keys(spark.createDataFrame(rows, "id long, source_id int, source_key string, external_id string, email string, phone string, attributes string"))
    assert sorted(r["kind"] for r in found.collect()) == ["email", "email_md5", "email_sha256", "external", "phone"]
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
