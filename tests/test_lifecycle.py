"""Audiences through their states, refreshes that are published at once, plans; the catalogue and a month's first computation."""

import datetime as dt
from dataclasses import replace

import pytest

from pledgework.operators.catalogue import BY_KEY, TRAITS, coverage, month_rows, to_compute
from pledgework.operators.generations import Conflict, current, publish
from pledgework.segments import lifecycle as L
from pledgework.segments.ast import SegmentError
from pledgework.segments.compiler import Context
from pledgework.segments.templates import definition, group, rule

DAY = dt.date(2024, 12, 31)


def reads(i, how="in"):
    return {"type": "segment", "segment_id": i, "operator": how}


def context(spark, rows):
    return Context(DAY, spark.createDataFrame(rows, "id long, region string"), {"profile": {"region": ("text", None)}})


@pytest.fixture
def known():
    texas = L.Audience(1, "texas", definition(rule("profile", "region", "eq", "TX")), "active")
    others = L.Audience(2, "others", definition(reads(1, "not_in")), "active")
    both = L.Audience(3, "both", definition(group("and", reads(2), rule("profile", "region", "is_not_null"))), "draft")
    return {a.id: a for a in (texas, others, both, L.Audience(4, "old", definition(rule("profile", "region", "eq", "OK")), "archived"))}


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_references_follow_states(known):
    assert L.checked(known[2], known) == known[2]
    for bad in (definition(reads(4)), definition(reads(9)), definition(reads(3)), definition(reads(2))):
        with pytest.raises(SegmentError):
            L.checked(replace(known[2], definition=bad), known)
    L.checked(replace(known[2], definition=definition(reads(3)), status="draft"), {**known, 3: replace(known[3], definition=known[1].definition)})
    with pytest.raises(SegmentError, match="cycle"):
        L.checked(replace(known[1], status="draft", definition=definition(reads(3))), known)


def test_bulk_holds_for_all_or_none(spark, known):
    c = context(spark, [(1, "TX")])
    after, jobs = L.bulk(known, [3, 3], "activate", c, "ann")
    assert jobs == [3] and (after[3].status, after[3].schedule, after[3].owner) == ("active", "daily", "ann") and known[3].status == "draft"
    paused = {**known, 1: replace(known[1], status="draft"), 2: replace(known[2], status="draft")}
    assert L.bulk(paused, [1, 2], "activate", c)[1] == [1, 2]  # at once, though one reads the other
    for names, action in (([2], "activate"), ([1, 2], "refresh"), ([4], "pause"), ([9], "pause")):
        with pytest.raises(SegmentError):
            L.bulk(paused, names, action, c)
    with pytest.raises(SegmentError, match="pause it too"):
        L.bulk(known, [1], "pause", c)
    after, jobs = L.bulk(known, [1, 2], "pause", c)
    assert jobs == [] and {after[1].status, after[2].status} == {"draft"}
    with pytest.raises(ValueError):
        L.bulk(known, [1], "delete", c)
    unfit = {**known, 3: replace(known[3], definition=definition(rule("profile", "nothing", "eq", "x")))}
    with pytest.raises(SegmentError, match="isn't a field"):
        L.bulk(unfit, [3], "activate", c)


def test_refresh_publishes_members_and_history_at_once(spark, known, tmp_path):
    root = str(tmp_path / "audiences")
    known = {**known, 3: replace(known[3], status="active")}
    first = L.refresh(spark, root, known, [3], context(spark, [(1, "TX"), (2, "OK"), (3, None)]))
    assert [ids(L.members(first, i)) for i in (1, 2, 3)] == [[1], [2, 3], [2]]
    second = L.refresh(spark, root, known, [2], context(spark, [(1, "OK"), (2, "TX"), (4, "OK")]))
    assert [ids(L.members(second, i)) for i in (1, 2, 3)] == [[2], [1, 4], [2]]  # the third wasn't asked for
    assert [ids(L.members(first, i)) for i in (1, 2, 3)] == [[1], [2, 3], [2]]  # a reader keeps what it opened
    history = sorted(tuple(r) for r in second.table("history").collect())
    assert history == [(1, 1, 1, 0, DAY), (1, 1, 1, 1, DAY), (2, 2, 2, 0, DAY), (2, 2, 2, 2, DAY), (3, 1, 1, 0, DAY)]
    empty = L.refresh(spark, root, known, [1], context(spark, []))
    assert (1, 0, 0, 1, DAY) in [tuple(r) for r in empty.table("history").collect()] and ids(L.members(empty, 1)) == []
    with pytest.raises(SegmentError):
        L.members(empty, 4)
    with pytest.raises(SegmentError):
        L.refresh(spark, root, {**known, 1: replace(known[1], status="draft")}, [2], context(spark, []))
    with pytest.raises(Conflict):
        publish(spark, root, {"history": empty.table("history")}, second)
    assert current(spark, root).number == 3
    assert len(L.sweep(spark, root, [empty], 0)) == 3 and ids(L.members(empty, 3)) == [2]


def test_counts_of_changes(spark):
    was = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 5)], L.MEMBERS)
    now = spark.createDataFrame([(1, 2), (1, 3), (1, 3)], L.MEMBERS)
    assert sorted(tuple(r) for r in L.counted(was, now).collect()) == [(1, 2, 1, 1), (2, 0, 0, 1)]
    assert L.counted(L.stacked({}, spark), L.stacked({}, spark)).collect() == []


def test_explained_plans_run_no_job(spark):
    c = context(spark, [(1, "TX")])
    said = L.explained(definition(rule("profile", "region", "eq", "TX")), c)
    assert said["shuffles"] == 0 and said["broadcasts"] == 0 and said["bytes"] > 0 and said["plan"]["plans"]
    c.segments[1] = spark.range(5).selectExpr("id AS profile_id")
    more = L.explained(definition(reads(1)), c)
    assert more["shuffles"] + more["broadcasts"] >= 1


def test_catalogue_and_its_coverage(spark):
    assert len(TRAITS) == len(BY_KEY) == 21
    rows = spark.createDataFrame([(1, "new", 0, ["crm"]), (2, None, None, []), (3, "lapsed", 5, None)], "profile_id long, donor_status string, event_count_30d int, source_keys array<string>")
    assert {r["key"]: (r["filled"], r["profiles"]) for r in coverage(rows).collect()} == {"donor_status": (2, 3), "event_count_30d": (2, 3), "source_keys": (1, 3)}
    assert {r["filled"] for r in coverage(rows.filter("false")).collect()} == {0}


def test_a_month_opens_with_everyone(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    dirty = spark.createDataFrame([(2,), (2,), (9,)], "profile_id long")
    past = spark.createDataFrame([(dt.date(2024, 11, 1), "new")], "month date, donor_status string")
    assert ids(to_compute(people, dirty, past, DAY)) == [1, 2, 3]
    assert ids(to_compute(people, dirty, past, dt.date(2024, 11, 30))) == [2]
    assert ids(to_compute(people, dirty.filter("false"), past, dt.date(2024, 11, 30))) == []
    traits = spark.createDataFrame([(1, "new", 5, 1), (2, "lapsed", 7, 0)], "profile_id long, donor_status string, ltv_total int, gift_amount_12m int")
    waiting = people.filter("false")
    assert {r["donor_status"] for r in month_rows(traits, DAY, past, waiting).collect()} == {"new", "lapsed"}
    assert {r["donor_status"] for r in month_rows(traits, dt.date(2024, 11, 5), past, waiting).collect()} == {"lapsed"}
    assert month_rows(traits, DAY, past, people).collect() == []


def test_queries_of_a_refresh_make_each_audience_once(spark):
    """What is stacked are tables: an audience that others read isn't planned again inside them."""
    from pledgework.plans import catalog

    plan = catalog.queries()["seg_refresh_members"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Relation [") == 3
