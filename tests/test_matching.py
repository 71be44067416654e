"""Pairs of blocks of any size and greedy matching in rounds, against plain loops."""

import random

from pyspark.sql import functions as F

from pledgework.operators import identity as I
from pledgework.operators import matching as M


def test_pairs_of_blocks_equal_all_pairs(spark):
    """Blocks below and above the chunk's size, ids that repeat, and people without a block."""
    rng = random.Random(4)
    rows = [(i, "hot" if i < 130 else f"b{rng.randint(0, 30)}" if i % 5 else None, rng.choice(["x", None])) for i in range(300)]
    people = spark.createDataFrame(rows, "id long, block string, other string")
    want = sorted((a, b) for a, x, _ in rows for b, y, _ in rows if a < b and x == y and x is not None)
    for chunk in (7, 20, 1000):
        assert sorted(map(tuple, M.block_pairs(people, ("block",), chunk).collect())) == want
    both = sorted((a, b) for a, x, u in rows for b, y, v in rows if a < b and x == y and u == v and x and u)
    assert sorted(map(tuple, M.block_pairs(people, ("block", "other"), 10).collect())) == both
    assert M.block_pairs(people.limit(0), ("block",)).collect() == []
    twice = spark.createDataFrame([(1, "b"), (1, "b"), (2, "b")], "id long, block string")
    assert set(map(tuple, M.block_pairs(twice, ("block",)).collect())) == {(1, 2)}


def test_a_block_of_a_hundred_thousand_spreads_evenly(spark):
    """The pairs of its cells are counted, not made."""
    dealt = M.chunked(spark.range(100_000).withColumn("block", F.lit("hot")), ("block",))
    sizes = {r["chunk"]: r["n"] for r in dealt.groupBy("chunk").agg(F.count("*").alias("n")).collect()}
    assert len(sizes) == 200 and max(sizes.values()) <= M.CHUNK
    left, right = M.cells(dealt.filter("id % 50 = 0"), ("block",))
    assert left.groupBy("i", "j").count().agg(F.max("count")).first()[0] <= M.CHUNK and left.select("i", "j").distinct().count() == 200 * 201 // 2
    assert right.count() + left.count() == dealt.filter("id % 50 = 0").count() * 201


def test_people_of_a_common_block_are_sent_once_a_side(spark):
    """1,500 people of one block: all pairs, from 3,000 rows."""
    people = spark.range(1500).withColumn("block", F.lit("hot"))
    left, right = M.cells(M.chunked(people, ("block",), M.MEET), ("block",))
    assert left.count() + right.count() == 3000
    assert M.first_met(people, (("block",),)).count() == 1500 * 1499 // 2


def test_long_names_are_no_fuzzy_matches(spark):
    rows = [(1, "a" * 300, "Lee", "1", "p", "s"), (2, "a" * 299 + "b", "Lee", "1", "p", "s"), (3, "A" * 300, "Lee", "1", "p", "s")]
    got = {(r["l"], r["r"]): r["weight"] for r in I.match_pairs(spark.createDataFrame(rows, "id long, first_name string, last_name string, postal_code string, phone string, address1 string")).collect()}
    assert got[1, 3] > got[1, 2] == got[2, 3]


def plain(scored, keys, masters, linked, review):
    owned, gone, out = {}, set(), {}
    for p, kind, v in keys:
        owned.setdefault(p, set()).add((kind, v))
    for l, r, p in sorted(scored, key=lambda e: (-e[2], e[0], e[1])):  # noqa: E741
        if p < review:
            continue
        if l in gone or r in gone:
            out[l, r] = "skipped"
            continue
        both = owned.get(l, set()) | owned.get(r, set())
        if len({k for k, _ in both}) < len(both):
            out[l, r] = "conflict"
        elif p >= linked:
            out[l, r] = "linked"
            loser, winner = (l, r) if (masters[l], l) > (masters[r], r) else (r, l)
            gone.add(loser)
            owned[winner] = both
        else:
            out[l, r] = "review"
    return out


def test_rounds_equal_the_pass_by_score(spark):
    """Random graphs with ties, chains, conflicts that only a merge brings about, and retired profiles."""
    for seed in range(4):
        rng = random.Random(seed)
        n = 24
        scored = [(a, b, rng.choice([0.84, 0.86, 0.9, 0.995, 0.996, 0.999])) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.15]
        keys = [(rng.randrange(n), rng.choice("ab"), rng.choice("xyz")) for _ in range(14)]
        masters = {i: f"m{rng.randint(0, 9)}" for i in range(n)}
        got = M.greedy(spark.createDataFrame(scored, "l long, r long, probability double"), spark.createDataFrame(keys, "profile_id long, kind string, value string"), spark.createDataFrame(list(masters.items()), "profile_id long, master_id string"))
        found = [((r["l"], r["r"]), r["band"]) for r in got.collect()]
        assert len(found) == len(dict(found)) and dict(found) == plain(scored, keys, masters, 0.995, 0.85)


def test_no_pairs(spark):
    none = spark.createDataFrame([], "l long, r long, probability double")
    assert M.greedy(none, spark.createDataFrame([], "profile_id long, kind string, value string"), spark.createDataFrame([], "profile_id long, master_id string")).collect() == []


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_are_made_once_and_never_sent(spark):
    rows = [(i, ("Ann", "Anne", "", None, "Bob")[i % 5], f"Lee{i % 3}", f"{i % 4}", (None, f"+1{i % 6}")[i % 2], (None, f"{i % 5} Main")[i % 3 > 0]) for i in range(60)]
    people = spark.createDataFrame(rows, "id long, first_name string, last_name string, postal_code string, phone string, address1 string")
    blocks = (("address1", "postal_code"), ("phone",), ("last_name", "postal_code"))
    for chunk in (5, 1000):
        got = sorted(tuple(sorted((r["a"], r["b"]))) for r in M.first_met(people, blocks, chunk).selectExpr("l.id AS a", "r.id AS b").collect())
        named = [dict(zip(people.columns, r)) for r in rows]
        shared = lambda x, y: any(all(x[c] is not None and x[c] == y[c] for c in block) for block in blocks)
        assert got == [(x["id"], y["id"]) for x in named for y in named if x["id"] < y["id"] and shared(x, y)]
    plan = plan_of(I.match_pairs(people))
    assert plan.count("Join") - plan.count("Join LeftOuter") == len(blocks) and "Aggregate" not in plan and "Distinct" not in plan


def test_both_sides_of_a_block_read_what_was_sent_once(spark):
    """Of three blocks three exchanges, whose rows have no more columns than the people."""
    rows = [(i, "Ann", f"Lee{i % 3}", f"{i % 4}", f"+1{i % 6}", f"{i % 5} Main") for i in range(60)]
    people = spark.createDataFrame(rows, "id long, first_name string, last_name string, postal_code string, phone string, address1 string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = I.match_pairs(people)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    reused = [line for line in plan.splitlines() if "ReusedExchange" in line and "hashpartitioning" in line]
    assert len(reused) == 3 and plan.count("Exchange hashpartitioning") == 3 + len(reused)  # the text of a reused one names its exchange
    assert not any("_short" in line or "_phone" in line for line in reused)


def test_common_blocks_meet_in_cells_beside_small_ones(spark):
    """Sent rows are the people's own columns; what is made of them is there on both sides, in cells and in small blocks."""
    rows = [(i, "hot" if i < 40 else f"b{i % 7}", f"N{i}") for i in range(90)]
    people = spark.createDataFrame(rows, "id long, block string, name string")
    got = M.first_met(people, (("block",),), 10, {"low": F.lower("name")}).selectExpr("l.id AS a", "r.id AS b", "l.low AS x", "r.low AS y").collect()
    assert sorted(tuple(sorted((r["a"], r["b"]))) for r in got) == [(a, b) for a, x, _ in rows for b, y, _ in rows if a < b and x == y]
    assert all((r["x"], r["y"]) == (f"n{r['a']}", f"n{r['b']}") for r in got)


def test_people_alike_are_judged_as_one(spark):
    """120 people of two kinds that share every block make three joined rows; their ids are paired after that."""
    rows = [(i, "Ann" if i % 3 else None, "Lee", "1", "+1", "1 Main") for i in range(120)]
    people = spark.createDataFrame(rows, "id long, first_name string, last_name string, postal_code string, phone string, address1 string")
    one = {r["first_name"]: r["ids"] for r in M.alike(people).collect()}
    assert {k: sorted(v) for k, v in one.items()} == {"Ann": [i for i in range(120) if i % 3], None: list(range(0, 120, 3))}
    blocks = (("address1", "postal_code"), ("phone",), ("last_name", "postal_code"))
    assert M.first_met(M.alike(people), blocks, itself=True).count() == 3
    dealt = M.alike(people, 10).collect()
    assert sorted(i for r in dealt for i in r["ids"]) == list(range(120)) and len(dealt) > 12 and all(r["id"] == min(r["ids"]) for r in dealt)
    got = {(r["l"], r["r"]): r["weight"] for r in I.match_pairs(people).collect()}
    assert sorted(got) == [(a, b) for a in range(120) for b in range(a + 1, 120)] and len({w for (a, b), w in got.items() if a % 3 and b % 3}) == 1
    assert got[1, 2] > got[0, 1] == got[0, 3]


def test_bands_with_keys_are_the_whole_step(spark):
    """A conflict by keys, a link that retires a profile, its later pair skipped, one for review, and one rejected; thresholds alone without keys."""
    scored = spark.createDataFrame([(1, 2, 0.999), (2, 3, 0.998), (3, 4, 0.997), (5, 6, 0.9), (5, 7, 0.2)], "l long, r long, probability double")
    keys = spark.createDataFrame([(3, "login", "x"), (4, "login", "y")], "profile_id long, kind string, value string")
    masters = spark.createDataFrame([(i, f"m{i}") for i in range(1, 8)], "profile_id long, master_id string")
    got = {(r["l"], r["r"]): r["band"] for r in I.bands(scored, keys, masters).collect()}
    assert got == {(1, 2): "linked", (2, 3): "skipped", (3, 4): "conflict", (5, 6): "review", (5, 7): "rejected"}
    assert [r["band"] for r in I.bands(scored).orderBy("l", "r").collect()] == ["linked", "linked", "linked", "review", "rejected"]
