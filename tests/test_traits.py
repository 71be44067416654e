"""Traits of profiles with several gifts a day, undated ones and refunds; quintiles against a plain ranking; consent winners against a sort."""

import datetime as dt
import itertools
import random
from decimal import Decimal

from pledgework.operators import traits as T
from pledgework.operators.consent import consent_winner

DAY = dt.date(2024, 12, 31)


def test_days_give_what_gifts_gave(spark):
    chance = random.Random(3)
    gifts = [(i, chance.randrange(8), Decimal(chance.randrange(1, 9000)) / 100, None if chance.random() < 0.1 else DAY - dt.timedelta(chance.randrange(-3, 1200, 40)), chance.random() < 0.2, chance.random() < 0.3) for i in range(200)]
    frame = spark.createDataFrame(gifts, "id long, profile_id long, amount decimal(14,2), gift_date date, is_refund boolean, is_recurring boolean")
    people = spark.range(9)
    got = {r["profile_id"]: r for r in T.giving_traits(people, frame, DAY).collect()}
    assert sorted(got) == list(range(9))
    for p in range(9):
        mine = [g for g in gifts if g[1] == p and (g[3] is None or g[3] <= DAY)]
        own = [g for g in mine if not g[4]]
        year = lambda rows: [g for g in rows if g[3] and g[3] >= DAY - dt.timedelta(364)]
        dated = sorted(g[3] for g in own if g[3])
        r = got[p]
        assert (r["gift_count_total"], r["gift_count_12m"]) == (len(own), len(year(own)))
        assert (r["ltv_total"], r["gift_amount_12m"]) == (sum(g[2] for g in mine), sum(g[2] for g in year(mine)))
        assert (r["first_gift_date"], r["last_gift_date"], r["previous_gift_date"]) == (dated[0] if dated else None, dated[-1] if dated else None, dated[-2] if len(dated) > 1 else None)
        assert r["largest_gift_amount"] == max((g[2] for g in own), default=None)
        assert r["avg_gift_amount"] == ((sum(g[2] for g in own) / len(own)).quantize(Decimal("0.01"), "ROUND_HALF_UP") if own else None)
        assert r["is_recurring_active"] == any(g[5] and g[3] and g[3] >= DAY - dt.timedelta(44) for g in own)


def test_very_many_gifts_are_dealt_to_more_tasks_with_the_same_traits(spark, monkeypatch):
    """The tasks that add up and gather a profile's days are as many as the gifts ask for, which adaptive execution doesn't reduce."""
    gifts = spark.range(400).selectExpr("id", "id % 60 AS profile_id", "CAST(id % 9 AS decimal(14,2)) AS amount", "date_sub(DATE '2024-12-31', CAST(id % 700 AS int)) AS gift_date", "id % 7 = 0 AS is_refund", "id % 3 = 0 AS is_recurring")
    people = spark.range(50)
    want = sorted(map(tuple, T.giving_traits(people, gifts, DAY).collect()))
    monkeypatch.setattr(T, "MANY", 100)
    monkeypatch.setattr(T, "EACH", 1)
    assert T.gift_rollup(T.gift_days(T.spread(gifts)), DAY).rdd.getNumPartitions() == 400
    assert sorted(map(tuple, T.giving_traits(people, gifts, DAY).collect())) == want


def test_quintiles_against_a_plain_ranking(spark):
    chance = random.Random(5)
    rows = [(i, chance.choice([None, 1, 2, 3, 50]), chance.randrange(0, 4), Decimal(chance.randrange(-5, 30))) for i in range(83)]
    frame = spark.createDataFrame(rows, "profile_id long, days_since_last_gift int, gift_count_total long, ltv_total decimal(18,2)")
    donors = [r for r in rows if r[2] > 0]
    want = {r[0]: [] for r in donors}
    for key in (lambda r: (r[1] is None, r[1] or 0, r[0]), lambda r: (-r[2], r[0]), lambda r: (-r[3], r[0])):
        size, more = divmod(len(donors), 5)
        tiles = list(itertools.chain(*([t] * (size + (t <= more)) for t in range(1, 6))))
        for r, t in zip(sorted(donors, key=key), tiles, strict=True):
            want[r[0]].append(6 - t)
    got = {r[0]: r for r in T.rfm(frame).collect()}
    assert len(got) == 83
    for i, r in got.items():
        assert list(r[1:4]) == want.get(i, [None] * 3) and r["rfm_score"] == ("".join(map(str, want[i])) if i in want else None)
    assert all(r["rfm_score"] is None for r in T.rfm(frame.filter("gift_count_total = 0")).collect())


def test_consent_winners_against_a_sort(spark):
    chance = random.Random(7)
    rows = [(i, i % 60, "email", chance.choice(["opted_in", "opted_in", "opted_out", "unknown", None]), i % 3, chance.choice([True, False, None]), chance.choice([None, *(DAY - dt.timedelta(d) for d in range(4))])) for i in range(240)]
    frame = spark.createDataFrame(rows, "id long, profile_id long, channel string, status string, source_id long, authoritative boolean, captured_at date")
    early = dt.date(1, 1, 1)
    for r in consent_winner(frame).collect():
        mine = [x for x in rows if x[1] == r["profile_id"]]
        last = max((x[6] for x in mine if x[3] == "opted_out" and x[6]), default=None)

        def place(x, last=last):
            strong = x[3] == "opted_in" and x[5] and (last is None or (x[6] is not None and x[6] > last))
            return (3 if strong else {"opted_out": 2, "opted_in": 1}.get(x[3], 0), x[6] or early, x[0])

        best = max(mine, key=place)
        assert (r["status"], r["source_id"], r["captured_at"]) == (best[3], best[4], best[6])
