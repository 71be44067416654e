"""Consents one at a time and in sets, batches folded by key, upserts with attributes and the hash short cut."""

import datetime as dt
import itertools
import random

from pyspark.sql import functions as F

from pledgework.operators import records as R
from pledgework.operators.consent import candidate_wins, wins

CONSENT = "struct<status:string,captured_at:date,authoritative:boolean>"
day = lambda n: dt.date(2024, 1, 1 + n)


def test_each_branch_of_a_candidate():
    out, known, yes, strong = ("opted_out", 5, False), ("unknown", 5, False), ("opted_in", 5, False), ("opted_in", 5, True)
    assert candidate_wins(None, known)
    for old in (out, yes, strong):
        assert not candidate_wins(old, ("unknown", 9, True)) and candidate_wins(known, (old[0], 1, False))
    assert candidate_wins(known, ("unknown", 6, False)) and not candidate_wins(known, ("unknown", 5, True))
    assert candidate_wins(yes, ("opted_out", 1, False)) and candidate_wins(strong, ("opted_out", 5, False)) and not candidate_wins(strong, ("opted_out", 4, True))
    assert candidate_wins(out, ("opted_in", 6, True)) and not candidate_wins(out, ("opted_in", 5, True)) and not candidate_wins(out, ("opted_in", 9, False))
    assert candidate_wins(out, ("opted_out", 6, False)) and not candidate_wins(out, ("opted_out", 5, True))
    assert candidate_wins(yes, ("opted_in", 6, False)) and not candidate_wins(yes, ("opted_in", 5, False)) and candidate_wins(yes, ("opted_in", 5, True))
    assert not candidate_wins(strong, ("opted_in", 9, False)) and candidate_wins(strong, ("opted_in", 6, True)) and not candidate_wins(strong, ("opted_in", 5, True))


def test_the_expression_says_the_same(spark):
    every = [None, *itertools.product(("opted_in", "opted_out", "unknown"), (0, 1, 2), (False, True))]
    pairs = [(a, b) for a in every for b in every if b]
    shown = lambda c: c and (c[0], day(c[1]), c[2])
    rows = spark.createDataFrame([(i, shown(a), shown(b)) for i, (a, b) in enumerate(pairs)], f"i int, a {CONSENT}, b {CONSENT}")
    got = {r["i"]: r["w"] for r in rows.select("i", wins(F.col("a"), F.col("b")).alias("w")).collect()}
    assert [got[i] for i in range(len(pairs))] == [candidate_wins(a, b) for a, b in pairs]
    assert spark.createDataFrame([(shown(every[1]), None)], f"a {CONSENT}, b {CONSENT}").select(wins(F.col("a"), F.col("b"))).first()[0] is False


BATCH = f"source_id int, external_id string, email string, city string, attributes map<string,string>, consent {CONSENT}, raw_hash string, seq int"


def test_batches_fold_in_order(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        c = (rng.choice(["opted_in", "opted_out", "unknown"]), rng.randint(0, 3), rng.random() < 0.5) if rng.random() < 0.8 else None
        a = {k: str(i) for k in "xyz" if rng.random() < 0.4} if rng.random() < 0.9 else None
        rows.append((1, f"e{rng.randint(0, 30)}", rng.choice([None, f"m{i}"]), rng.choice([None, "c"]), a, c, f"h{i}", i))
    want = {}
    for _, key, email, city, a, c, h, _ in rows:
        old = want.get(key, (None, None, {}, None, None))
        kept = c if c and candidate_wins(old[3], c) else old[3]
        want[key] = (email if email is not None else old[0], city if city is not None else old[1], {**old[2], **(a or {})}, kept, h)
    df = spark.createDataFrame([(*r[:5], r[5] and (r[5][0], day(r[5][1]), r[5][2]), *r[6:]) for r in rows], BATCH).repartition(5)
    got = {r["external_id"]: (r["email"], r["city"], r["attributes"], r["consent"] and (r["consent"]["status"], r["consent"]["captured_at"].day - 1, r["consent"]["authoritative"]), r["raw_hash"]) for r in R.folded(df).collect()}
    assert got == want


def test_upserts(spark):
    table = spark.createDataFrame([(1, "a", "old", "T", {"x": "1", "y": "1"}, ("opted_out", None, None), "h", day(3)), (1, "b", "old", None, {}, ("opted_in", day(1), True), "h", day(3)), (1, "c", "old", None, None, None, None, day(3)), (2, "a", "other", None, {}, None, "h", day(3))], BATCH.replace("seq int", "updated_at date"))
    batch = spark.createDataFrame([(1, "a", None, "U", {"y": "2", "z": None}, ("opted_in", day(2), True), "g", 1), (1, "b", "new", "V", {"q": "1"}, ("opted_out", day(9), False), "h", 1), (1, "c", None, None, None, ("unknown", None, None), None, 1), (1, "d", "e", None, {"k": "v"}, None, "h", 1)], BATCH)
    got = {(r["source_id"], r["external_id"]): r for r in R.upsert(table, batch, day(20)).collect()}
    assert {k: r["op"] for k, r in got.items()} == {(1, "a"): "updated", (1, "b"): "same", (1, "c"): "same", (1, "d"): "inserted", (2, "a"): "same"}
    a = got[1, "a"]
    assert (a["email"], a["city"], a["attributes"], a["consent"]["status"], a["raw_hash"], a["updated_at"]) == ("old", "U", {"x": "1", "y": "2", "z": None}, "opted_out", "g", day(20))  # the opt-out is as old as its row, the third
    b = got[1, "b"]
    assert (b["email"], b["city"], b["consent"]["status"], b["updated_at"]) == ("old", None, "opted_in", day(3))
    assert got[1, "d"]["attributes"] == {"k": "v"} and got[2, "a"]["email"] == "other"
    assert R.upsert(table, batch.limit(0), day(20)).filter("op <> 'same'").count() == 0
