"""Sessions and device links as streaming state: the same as the batch functions, whatever the order of deliveries; keys that end leave the state."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from pledgework.streaming import devices, ingest, state

START = dt.datetime(2024, 1, 1)


def iso(t):
    return t.isoformat() + "Z"


def written(folder, batches):
    folder.mkdir()
    for k, rows in enumerate(batches):
        path = folder / f"{k:03d}.json"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        import os

        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken by age


def plain(df, *cols):
    return sorted(tuple(str(x) for x in r) for r in df.select(*cols).collect())


@pytest.fixture()
def stateful(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    yield state.configured(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


EVENT = "source string, type string, name string, messageId string, userId string, anonymousId string, occurred_at timestamp, properties string"


def event(i, minutes, who, **clicks):
    return {"messageId": f"m{i:04d}", "anonymousId": who, "occurred_at": iso(START + dt.timedelta(minutes=minutes)), "properties": json.dumps(clicks)}


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_equal_the_batch_in_any_order(stateful, tmp_path, seed):
    rng = random.Random(seed)
    rows = [event(i, rng.randint(0, 5000), rng.choice("abcde"), **{c: f"{c}{i}" for c in state.CLICKS if rng.random() < 0.3}) for i in range(120)]
    rows += [event(900, 50, None), {**event(901, 60, None, fbp="u"), "userId": "user"}, event(902, 70, "tie", fbp="x"), event(903, 70, "tie", fbp="y")]
    sent = rows + rng.sample(rows, 40)
    rng.shuffle(sent)
    written(tmp_path / "in", [sent[i::4] for i in range(4)])
    stream = stateful.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    state.write_updates(state.session_updates(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = state.applied(stateful.read.parquet(str(tmp_path / "out")), ["session"])
    want = ingest.sessions(stateful.createDataFrame([(r.get("messageId"), r.get("userId"), r.get("anonymousId"), dt.datetime.fromisoformat(r["occurred_at"][:-1]), r["properties"]) for r in rows], "messageId string, userId string, anonymousId string, occurred_at timestamp, properties string"))
    cols = ("session", *state.CLICKS, "last_at", "expires_at")
    assert plain(got, *cols) == plain(want, *cols)


SIGHT = "key_type string, device_id string, profile_id long, source_id int, seen_at timestamp"


def test_links_end_and_leave_the_state(stateful, tmp_path):
    day = lambda d, dev, who=1, source=1: {"key_type": "k", "device_id": dev, "profile_id": who, "source_id": source, "seen_at": iso(START + dt.timedelta(days=d))}
    batches = [[day(2, "a", source=5), day(0, "a"), day(2, "a", source=7), day(1, "b"), day(1, "b")], [day(1.5, "a"), day(3, "c", None)], [day(14, "c", None), day(14, "d")], [day(14.2, "b"), day(1, "late")], [day(15, "d")]]
    written(tmp_path / "in", batches)
    stream = stateful.readStream.schema(SIGHT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    state.write_updates(state.link_updates(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    updates = stateful.read.parquet(str(tmp_path / "out"))
    assert {r["device_id"] for r in updates.filter("expired").collect()} == {"a"}  # b came again before its end was told
    got = state.applied(updates, list(devices.KEY))
    live = {(r["device_id"], r["profile_id"]): r for r in got.collect()}
    assert set(live) == {("b", 1), ("c", None), ("d", 1)}
    utc = lambda d: START + dt.timedelta(days=d)
    assert (live["b", 1]["first_seen_at"], live["b", 1]["last_seen_at"]) == (utc(14.2), utc(14.2))  # a new life
    rows = updates.filter("device_id = 'a' AND NOT expired").collect()
    assert max((r["batch"], r["source_id"], r["first_seen_at"]) for r in rows)[1:] == (7, utc(0))
    now = utc(15)
    seen = stateful.createDataFrame([("k", r["device_id"], r["profile_id"], r["source_id"], dt.datetime.fromisoformat(r["seen_at"][:-1])) for b in batches for r in b], SIGHT).filter("device_id <> 'late'")
    batch = devices.linked(seen, now).filter("device_id = 'd'")
    cols = (*devices.KEY, "source_id", "first_seen_at", "last_seen_at", "expires_at")
    assert plain(got.filter("device_id = 'd'"), *cols) == plain(batch, *cols)


def test_a_stream_goes_on_from_its_checkpoint(stateful, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    written(folder, [[event(1, 0, "a", fbp="x")]])

    def run():
        stream = stateful.readStream.schema(EVENT).json(str(folder))
        state.write_updates(state.session_updates(stream), out, check).awaitTermination()
        return [(r["fbp"], r["fbc"]) for r in state.applied(stateful.read.parquet(out), ["session"]).collect()]

    assert run() == [("x", None)]
    (folder / "more.json").write_text(json.dumps(event(2, 5, "a", fbc="y")))
    assert run() == [("x", "y")]
