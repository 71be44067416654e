"""Generations and the cache over them, previews with a deadline, pulls as a stream, deliveries with commit and abort."""

import datetime as dt
import hashlib
import hmac
import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from pledgework.operators import generations as G
from pledgework.segments import preview as P
from pledgework.sources import deliveries as D
from pledgework.sources import pulls


def numbers(spark, n, v):
    return spark.range(n).select("id", F.lit(v).alias("v"))


# ---- generations


def test_readers_keep_the_generation_that_they_opened(spark, tmp_path):
    root = str(tmp_path / "pub")
    assert G.current(spark, root) is None
    G.publish(spark, root, {"a": numbers(spark, 3, 1), "b": numbers(spark, 5, 1)})
    old = G.current(spark, root)
    G.publish(spark, root, {"a": numbers(spark, 4, 2), "b": numbers(spark, 6, 2)})
    new = G.current(spark, root)
    assert (old.number, new.number) == (1, 2)
    assert (old.table("a").count(), old.table("b").count(), new.table("a").count(), new.table("b").count()) == (3, 5, 4, 6)
    assert {r["v"] for r in old.table("a").collect()} == {1}
    with pytest.raises(KeyError):
        new.table("c")


def test_a_reader_during_many_refreshes_never_mixes_generations(spark, tmp_path):
    root = str(tmp_path / "pub")
    publish = lambda k: G.publish(spark, root, {"a": numbers(spark, 10, k), "b": numbers(spark, 10, k)})
    publish(0)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            s = G.current(spark, root)
            seen.append({r["v"] for t in ("a", "b") for r in s.table(t).select("v").distinct().collect()})

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 4):
        publish(k)
    stop.set()
    reader.join()
    assert seen and all(len(s) == 1 for s in seen)


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "pub")
    G.publish(spark, root, {"a": numbers(spark, 3, 1)})
    with pytest.raises(Exception):  # noqa: B017
        G.publish(spark, root, {"a": numbers(spark, 9, 2), "b": spark.range(3).select(F.raise_error(F.lit("crash")).alias("x"))})
    assert G.current(spark, root).number == 1 and G.current(spark, root).table("a").count() == 3
    left = [n for n in os.listdir(root) if n.startswith("g-")]
    assert len(left) == 2
    assert G.vacuum(spark, root) == []  # it might be at work still
    assert len(G.vacuum(spark, root, idle=-1.0)) == 1
    assert G.current(spark, root).table("a").count() == 3


def test_of_two_writers_from_one_generation_one_wins(spark, tmp_path):
    root = str(tmp_path / "pub")
    base = G.publish(spark, root, {"a": numbers(spark, 1, 1)})
    G.publish(spark, root, {"a": numbers(spark, 2, 2)}, base)
    with pytest.raises(G.Conflict):
        G.publish(spark, root, {"a": numbers(spark, 3, 3)}, base)
    assert G.current(spark, root).table("a").count() == 2
    assert not G.Files(spark, root).put_new(f"_commits/{2:020d}", "{}")
    for k in range(3):
        G.publish(spark, root, {"a": numbers(spark, k, k)})
    assert len(G.vacuum(spark, root, keep=2)) == 3
    assert G.current(spark, root).number == 5


def test_stale_results_are_served_while_new_ones_are_made(spark, tmp_path):
    root, now = str(tmp_path / "pub"), [1000.0]
    cache = G.Cache(spark, root, str(tmp_path / "cache"), clock=lambda: now[0])
    with pytest.raises(LookupError):
        cache.get("k", lambda s: s.table("a"))
    G.publish(spark, root, {"a": numbers(spark, 3, 1)})
    builds = []

    def build(s):
        builds.append(s.number)
        return s.table("a").agg(F.count("*").alias("n"))

    first = lambda got: (got[0].first()["n"], got[1])
    assert first(cache.get("k", build)) == (3, True) and first(cache.get("k", build)) == (3, True)
    assert builds == [1]
    G.publish(spark, root, {"a": numbers(spark, 7, 2)})
    assert first(cache.get("k", build)) == (3, False)
    cache.settle()
    assert first(cache.get("k", build)) == (7, True) and builds == [1, 2]
    now[0] += 61
    assert first(cache.get("k", build)) == (7, False)
    cache.settle()
    assert builds == [1, 2, 2] and first(cache.get("k", build)) == (7, True)

    def broken(s):
        raise ValueError

    now[0] += 61
    assert first(cache.get("k", broken)) == (7, False)
    cache.settle()
    assert first(cache.get("k", build)) == (7, False)
    cache.settle()


def slow(batches):
    for b in batches:
        time.sleep(60)
        yield b


def test_a_build_that_takes_too_long_is_stopped(spark, tmp_path):
    root = str(tmp_path / "pub")
    G.publish(spark, root, {"a": numbers(spark, 3, 1)})
    cache = G.Cache(spark, root, str(tmp_path / "cache"), deadline=2.0)
    began = time.monotonic()
    with pytest.raises(G.DeadlineExceeded):
        cache.get("k", lambda s: s.table("a").mapInArrow(slow, "id long, v int"))
    assert time.monotonic() - began < 30
    assert cache.get("k", lambda s: s.table("a"))[1]


# ---- previews


def test_a_preview_in_time_is_exact(spark):
    got = P.preview(spark.range(500).toDF("profile_id"))
    assert got.exact and got.count == got.low == got.high == 500


def test_an_endless_preview_is_stopped_and_others_go_on(spark):
    """People outside the sample take a twentieth of a second each."""
    outside = F.udf(lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:3], 16) < P.LOOKED_AT or time.sleep(0.05) is None, "boolean")
    whole = spark.range(0, 40_000, 1, 2).toDF("profile_id").filter(outside("profile_id"))
    other = {}
    beside = threading.Thread(target=lambda: other.update(n=spark.range(200_000).selectExpr("sum(id) s").first()["s"]))
    began = time.monotonic()
    beside.start()
    got = P.preview(whole, seconds=5.0)
    beside.join()
    assert time.monotonic() - began < 40
    assert not got.exact and got.low <= 40_000 <= got.high and other["n"] == 199_999 * 100_000


def test_the_interval_holds_the_whole(spark):
    for n in (0, 40, 5000, 60_000):
        hits = spark.range(n).filter(P.sampled(F.col("id"))).count()
        _, low, high = P.estimated(hits)
        assert low <= n <= high
    plan = spark.range(10).toDF("profile_id").join(spark.range(10).select(F.col("id").alias("profile_id"), F.lit(1).alias("x")).groupBy("profile_id").agg(F.sum("x")), "profile_id").filter(P.sampled(F.col("profile_id")))
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("md5") == 2  # on both sides, below the aggregation


# ---- pulls


def at_now(options):
    return int(open(options["now"]).read())


def test_pulls_go_on_from_their_checkpoint(spark, tmp_path):
    """Rows of the overlap come twice and are kept once, in their latest state; the newest two minutes wait."""
    folder, out, check = tmp_path / "remote", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    minute = 60_000
    now = tmp_path / "now"
    options = {"client": "pledgework.sources.pulls.Recorded", "folder": str(folder), "rows": "7", "slice": str(20 * minute), "clock": f"{__name__}.at_now", "now": str(now)}

    def run(minutes):
        now.write_text(str(minutes * minute))
        pulls.pull(spark, options, out, check).awaitTermination()
        return {r["id"]: (r["modified"], json.loads(r["body"])["v"]) for r in pulls.kept(spark, out).collect()}

    (folder / "a").write_text("".join(json.dumps({"id": f"c{i:03d}", "modified": i * minute, "v": 1}) + "\n" for i in range(100)))
    got = run(62)
    assert sorted(got) == [f"c{i:03d}" for i in range(60)]
    (folder / "b").write_text(json.dumps({"id": "c003", "modified": 58 * minute, "v": 2}) + "\n" + json.dumps({"id": "late", "modified": 57 * minute, "v": 1}) + "\n")
    got = run(102)
    assert sorted(got) == [*(f"c{i:03d}" for i in range(100)), "late"]
    assert got["c003"] == (58 * minute, 2) and got["late"] == (57 * minute, 1)
    assert run(102) == got
    assert sum(1 for r in spark.read.parquet(out).filter("id = 'c058'").collect()) == 2  # in both windows


def test_slices_cover_the_window_without_gaps():
    r = pulls.PullReader({"slice": "1000", "client": "x.y"})
    for start, end in ((0, 1), (400_000, 405_500), (0, 10**12)):
        parts = r.partitions({"until": start}, {"until": end})
        assert parts[0].since == max(0, start - pulls.OVERLAP) and parts[-1].until == end and len(parts) <= max(pulls.MOST_SLICES, 306)
        assert all(a.until == b.since for a, b in zip(parts, parts[1:]))
    assert r.partitions({"until": 5}, {"until": 0}) == []


def lead(i, at="2024-01-02T03:04:05+0000", form="77", box="Yes", label="I agree", **more):
    said = {"id": i, "created_time": at, "form_id": form, "field_data": [{"name": "email", "values": ["a@b.org"]}, {"name": "first", "values": []}], "custom_disclaimer_responses": [{"checkbox_key": "ok", "is_checked": box}], "questions": [{"key": "ok", "label": label}], **more}
    return (json.dumps(said),)


def test_leads_and_their_consent(spark):
    rows = [lead("1"), lead("1"), lead("2", box="no"), lead("3", label="I agree to all"), lead("4", form="78"), lead("5", at="2024-01-02T03:04:05"), lead("6", custom_disclaimer_responses=[]), lead("7", label=None), lead(None), ("not json",), lead("8", field_data=None)]
    consent = {"field": "ok", "text": " I agree ", "form_id": "77", "channel": "email", "yes": ["YES", "true"]}
    got = {r["external_id"]: r for r in pulls.leads(spark.createDataFrame(rows, "body string"), {"email": "email", "first": "first_name", "none": "city"}, consent).collect()}
    status = {k: r["consent_status"] for k, r in got.items()}
    assert status == {"lead:1": "opted_in", "lead:2": "unknown", "lead:3": "unknown", "lead:4": None, "lead:5": "opted_in", "lead:6": None, "lead:7": "opted_in", None: status[None], "lead:8": "opted_in"}
    assert got["lead:3"]["consent_text_changed"] and not got["lead:1"]["consent_text_changed"]
    assert (got["lead:1"]["email"], got["lead:1"]["first_name"], got["lead:1"]["city"], got["lead:8"]["email"]) == ("a@b.org", "", None, None)
    assert got["lead:1"]["captured_at"] == dt.datetime(2024, 1, 2, 3, 4, 5) and got["lead:1"]["reason"] is None
    assert got["lead:5"]["reason"] == "created_time" and got[None]["reason"] == "id"


# ---- deliveries


def people(spark, n):
    return spark.range(n).select(F.col("id").alias("profile_id"), F.concat(F.lit("m"), "id").alias("master_id"), F.lit("é").alias("name")).repartition(3)


def bodies(folder):
    out = {}
    for name in sorted(os.listdir(folder)):
        said = json.loads((folder / name).read_text())
        out[said["headers"]["Idempotency-Key"]] = (said["headers"], json.loads(said["body"]), said["body"])
    return out


def fails_once(url, body, headers):
    """The first try of the second batch fails after its delivery, as if the answer were lost with the task."""
    D.into_folder(url, body, headers)
    if headers["Idempotency-Key"].endswith("-2"):
        try:
            os.close(os.open(f"{os.path.dirname(url)}/failed", os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return 200
        return 400
    return 200


def never(seconds):
    pass


OPTIONS = {"url": "", "secret": "s", "send": f"{__name__}.fails_once", "sleep": f"{__name__}.never"}


def test_a_failed_task_and_a_rerun_leave_one_delivery_a_batch(spark, tmp_path):
    folder, receipt = tmp_path / "sink", tmp_path / "receipt"
    folder.mkdir()
    run = lambda: D.delivered("webhook", people(spark, 23), "profile_id", "r1", size=10, **{**OPTIONS, "url": str(folder)}, facts=json.dumps({"mode": "full"}), receipt=str(receipt))
    with pytest.raises(Exception, match="refused with status 400"):  # local mode doesn't try a task again
        run()
    assert not receipt.exists()
    before = {k: b for k, (_, _, b) in bodies(folder).items()}
    assert run() == 3
    got = bodies(folder)
    assert sorted(got) == ["r1-1", "r1-2", "r1-3"] and all(got[k][2] == b for k, b in before.items())
    assert [r["profile_id"] for k in sorted(got) for r in got[k][1]["added"]] == list(range(23))
    for headers, said, body in got.values():
        assert said["batches"] == 3 and said["mode"] == "full" and said["removed"] == []
        assert headers["X-Signature"] == "sha256=" + hmac.new(b"s", body.encode(), hashlib.sha256).hexdigest()
    assert json.loads(receipt.read_text()) == {"run": "r1", "batches": 3, "rows": 23}


def test_deltas_send_new_and_removed_members(spark, tmp_path):
    folder = tmp_path / "sink"
    folder.mkdir()
    rows = D.changes(people(spark, 4), people(spark, 6).filter("profile_id > 1").select("profile_id", "master_id"))
    D.delivered("webhook", rows, "profile_id", "d", str(folder), "s", send="pledgework.sources.deliveries.into_folder")
    said = bodies(folder)["d-1"][1]
    assert said["added"] == [{"profile_id": i, "master_id": f"m{i}", "name": "é"} for i in (0, 1)]
    assert said["removed"] == [{"profile_id": i, "master_id": f"m{i}"} for i in (4, 5)]


def test_an_audience_is_replaced_only_when_all_of_it_was_sent(spark, tmp_path):
    folder = tmp_path / "sink"
    folder.mkdir()
    rows = spark.range(25).select(*[F.sha2(F.concat(F.lit(c), "id"), 256).alias(c) for c in D.AUDIENCE[:-1]], F.lit(None).cast("string").alias("zip2"), F.sha2(F.col("id").cast("string"), 256).alias("external_id")).drop("zip2")
    send = {**OPTIONS, "url": str(folder)}
    with pytest.raises(Exception, match="refused"):
        D.delivered("audience", rows, "external_id", "s", size=10, **send)
    assert not any(b["session"]["last_batch_flag"] for _, b, _ in bodies(folder).values())
    assert D.delivered("audience", rows, "external_id", "s", size=10, **send) == 3
    sessions = [b["session"] for _, b, _ in bodies(folder).values()]
    assert sessions == [{"session_id": "s", "batch_seq": i, "last_batch_flag": i == 4} for i in (1, 2, 3, 4)]
    assert sum(len(b["payload"]["data"]) for _, b, _ in bodies(folder).values()) == 25
    D.delivered("audience", rows.limit(0), "external_id", "empty", size=10, **send)
    assert bodies(folder)["empty-1"][1]["session"]["last_batch_flag"]
    with pytest.raises(Exception, match="digests only"):
        D.delivered("audience", rows.withColumn("email", F.lit("a@b.org")), "external_id", "x", **send)


def test_attempts_and_refusals():
    waits = []

    def sends(*statuses):
        left = list(statuses)

        def send(url, body, headers):
            s = left.pop(0)
            if s is None:
                raise OSError
            return s

        return send

    D.deliver("u", {}, "k", "s", send=sends(500, None, 429, 204), sleep=waits.append)
    assert waits == [2, 4, 8]
    with pytest.raises(D.DeliveryError, match="5 attempts"):
        D.deliver("u", {}, "k", "s", send=sends(*[503] * 5), sleep=waits.append)
    for status in (301, 404):
        with pytest.raises(D.DeliveryError, match="refused"):
            D.deliver("u", {}, "k", "s", send=sends(status), sleep=waits.append)
    with pytest.raises(D.DeliveryError, match="8 MiB"):
        D.deliver("u", {"x": "y" * (9 << 20)}, "k", "s", send=sends(), sleep=waits.append)
    for headers in ({"Idempotency-Key": "x"}, {"A": "b\r\nc"}, {"x-signature": "z"}):
        with pytest.raises(D.DeliveryError, match="headers"):
            D.deliver("u", {}, "k", "s", headers, send=sends(200))
    with pytest.raises(D.DeliveryError, match="https"):
        D.post("http://x.org", b"", {})
