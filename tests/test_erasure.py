"""Erasure over a graph of tables: nothing names an erased profile afterwards, others keep everything, and a rerun changes nothing."""

import hashlib
import json

import pytest

from pledgework.operators import erasure as E
from pledgework.operators import generations as G

GRAPH = {
    "profiles": E.Refers(key="id", people=("id",), emptied=("merged_into_id",), identifiers={"email": "email"}),
    "merges": E.Refers(people=("loser_id", "winner_id")),
    "source_records": E.Refers(key="id", people=("profile_id",), identifiers={"email": "email", "phone": "phone"}, documents=("attributes",)),
    "gifts": E.Refers(key="id", people=("profile_id",), rows={"source_record_id": ("source_records", "id")}),
    "diagnostics": E.Refers(rows={"gift_id": ("gifts", "id")}),
    "jobs": E.Refers(documents=("payload",)),
}


def tables(spark):
    doc = {"note": 3, "profile_id": 3, "deep": [{"profile_ids": [1, 3, "4"], "amount": 3}, {"winner_id": "3", "x": [{"loser_id": 4}]}], "other_id": 3}
    return {
        "profiles": spark.createDataFrame([(1, None, "a@x"), (2, None, "b@x"), (3, 2, "c@x"), (4, 3, ""), (5, 2, None), (6, None, None)], "id long, merged_into_id long, email string"),
        "merges": spark.createDataFrame([(3, 2), (4, 3)], "loser_id long, winner_id long"),
        "source_records": spark.createDataFrame([(10, 1, "a@x", "1", None), (11, 3, "c@y", None, None), (12, None, "z@z", "9", json.dumps(doc)), (13, 6, None, None, '{"profile_id":33}')], "id long, profile_id long, email string, phone string, attributes string"),
        "gifts": spark.createDataFrame([(20, 1, 10), (21, None, 11), (22, 4, None), (23, 6, 13)], "id long, profile_id long, source_record_id long"),
        "diagnostics": spark.createDataFrame([(20, "x"), (21, "y"), (22, "z"), (None, "w")], "gift_id long, said string"),
        "jobs": spark.createDataFrame([(1, '{"profile_id":1}'), (2, '{"a":{"profile_id":2}}'), (3, 'no json "profile_id": 2'), (4, None)], "id long, payload string"),
        "rates": spark.createDataFrame([(1, 2.0)], "id long, rate double"),
    }


def test_no_table_names_an_erased_profile(spark, tmp_path):
    root = str(tmp_path / "pub")
    before = G.publish(spark, root, tables(spark))
    asked = spark.createDataFrame([(4,)], "profile_id long")
    snapshot, counts = E.erase(spark, root, GRAPH, asked)
    got = {n: sorted(map(tuple, snapshot.table(n).collect()), key=str) for n in snapshot.tables}
    assert got["profiles"] == [(1, None, "a@x"), (5, None, None), (6, None, None)]  # 2, 3 and 4 are one person; 5 was merged into it
    assert got["merges"] == [] and [r[0] for r in got["source_records"]] == [10, 12, 13]
    assert [r[0] for r in got["gifts"]] == [20, 23] and got["diagnostics"] == [(20, "x"), (None, "w")]
    left = json.loads(got["source_records"][1][4])
    assert left == {"note": 3, "deep": [{"profile_ids": [1], "amount": 3}, {"x": [{}]}], "other_id": 3}
    assert got["source_records"][2][4] == '{"profile_id":33}'
    assert got["jobs"] == [(1, '{"profile_id":1}'), (2, '{"a":{}}'), (3, 'no json "profile_id": 2'), (4, None)]
    digest = lambda v: hashlib.sha256(v.encode()).hexdigest()
    assert set(got["suppressions"]) == {("email", digest(v), "deletion_request") for v in ("b@x", "c@x", "c@y")}
    assert counts == {"profiles": 4, "merges": 2, "source_records": 2, "gifts": 2, "diagnostics": 2, "jobs": 2}
    assert got["rates"] == [(1, 2.0)] and before.table("gifts").count() == 4
    again, counts = E.erase(spark, root, GRAPH, asked)
    assert {n: sorted(map(tuple, again.table(n).collect()), key=str) for n in again.tables} == got
    assert not any(counts.values())


def test_what_the_graph_must_say(spark, tmp_path):
    root = str(tmp_path / "pub")
    G.publish(spark, root, tables(spark))
    asked = spark.createDataFrame([(1,)], "profile_id long")
    with pytest.raises(ValueError, match="doesn't know"):
        E.erase(spark, root, {k: v for k, v in GRAPH.items() if k != "gifts" and k != "diagnostics"}, asked)
    with pytest.raises(ValueError, match="aren't there"):
        E.erase(spark, root, {**GRAPH, "jobs": E.Refers(documents=("nothing",))}, asked)
    with pytest.raises(ValueError, match="circle"):
        E.in_order({"a": E.Refers(rows={"x": ("b", "id")}), "b": E.Refers(rows={"x": ("a", "id")})})
    assert G.current(spark, root).number == 1
    none, counts = E.erase(spark, root, GRAPH, asked.limit(0))
    assert not any(counts.values()) and none.number == 2
