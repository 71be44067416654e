"""Anonymous events get their owner whenever the identify event comes; any order of deliveries ends in one table."""

import datetime as dt
import json
import random

import pytest

from pledgework.streaming import ingest, stitch

START = dt.datetime(2024, 1, 1)


def events(rng, n):
    out = []
    for i in range(n):
        anon, user = rng.choice(["a", "b", "c", "d", None]), rng.choice([None, None, "u1", "u2"])
        kind = "identify" if rng.random() < 0.2 else "track"
        if kind == "identify" and anon in ("a", "b"):
            user = f"owner-{anon}"
        out.append((rng.choice(["s", "t"]), kind, "n", f"m{i}", user, anon, START + dt.timedelta(hours=rng.randint(0, 200)), "{}"))
    return out


def rows_of(df):
    return sorted((r["source"], r["messageId"], r["user"] or "", str(r["occurred_at"])) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_deliveries_ends_in_one_table(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = events(rng, 60)
    known = {}
    for r in rows:
        if r[1] == "identify" and r[4] and r[5]:
            known.setdefault(r[5], set()).add(r[4])
    want = sorted((r[0], r[3], r[4] or (next(iter(known[r[5]])) if len(known.get(r[5], ())) == 1 else ""), str(r[6])) for r in rows)
    sent = rows + rng.sample(rows, 15)
    rng.shuffle(sent)
    root = str(tmp_path / "table")
    for k in range(3):
        stitch.take_in(spark.createDataFrame(sent[k::3], stitch.EVENT), k, root)
        if k == 1:
            half = rows_of(stitch.table(spark, root))
            stitch.take_in(spark.createDataFrame(sent[:5], stitch.EVENT), k, root)  # a batch that runs again
            assert rows_of(stitch.table(spark, root)) == half
    assert rows_of(stitch.table(spark, root)) == want
    batch = ingest.stitch(spark.createDataFrame(rows, stitch.EVENT)).withColumnRenamed("userId", "user")
    assert rows_of(batch) == want
    stitch.swept(spark, root, keep=1)
    assert rows_of(stitch.table(spark, root)) == want


def test_only_dirty_days_are_written_again(spark, tmp_path):
    root, day = str(tmp_path / "table"), lambda d: START + dt.timedelta(days=d)
    made = lambda *rows: spark.createDataFrame([("s", k, "n", m, u, a, day(d), "{}") for k, m, u, a, d in rows], stitch.EVENT)
    stitch.take_in(made(("track", "1", None, "a", 0), ("track", "2", None, "b", 1), ("track", "3", "x", None, 2)), 0, root)
    first = stitch.state(spark, root)["parts"]
    stitch.take_in(made(("identify", "4", "u", "a", 5)), 1, root)
    second = stitch.state(spark, root)["parts"]
    assert {p for p in second if p.startswith("day=") and second[p] != first.get(p)} == {"day=2024-01-01", "day=2024-01-06"}
    user = lambda: {r["messageId"]: r["user"] for r in stitch.table(spark, root).collect()}
    assert user() == {"1": "u", "2": None, "3": "x", "4": "u"}
    stitch.take_in(made(("identify", "5", "v", "a", 1)), 2, root)  # two users: nobody's
    assert user() == {"1": None, "2": None, "3": "x", "4": "u", "5": "v"}
    stitch.take_in(made().limit(0), 3, root)
    assert stitch.state(spark, root)["batch"] == 3


def test_a_stream_keeps_the_table(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put = lambda name, **e: (folder / name).write_text(json.dumps({"source": "s", "type": "track", "occurred_at": "2024-01-01T00:00:00Z", "anonymousId": "a", **e}))
    put("1.json", messageId="1")

    def run():
        stitch.stitched(spark.readStream.schema(stitch.EVENT).json(str(folder)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
        return {r["messageId"]: r["user"] for r in stitch.table(spark, str(tmp_path / "t")).collect()}

    assert run() == {"1": None}
    put("2.json", messageId="2", type="identify", userId="u", occurred_at="2024-03-01T00:00:00Z")
    assert run() == {"1": "u", "2": "u"}
