"""Boundaries of single operators on hand rows."""

import datetime as dt
import hashlib
import hmac
import gzip
import json

import pytest
from pyspark.sql import functions as F

from pledgework.functions import normalize as N
from pledgework.operators import identity, rollups, schedule, traits, upserts
from pledgework.operators.consent import candidate_wins, consent_winner
from pledgework.sources import files
from pledgework.sources.paged import PagedSource
from pledgework.streaming import ingest

D = dt.date


def one(spark, column, kind="string", *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(column).collect()]


@pytest.mark.parametrize("since,first,gap,status", [(None, None, None, "prospect"), (365, 365, None, "new"), (365, 366, None, "active"), (10, 2000, 731, "reactivated"), (10, 2000, 730, "active"), (366, 900, None, "lapsing"), (730, 900, None, "lapsing"), (731, 900, None, "lapsed")])
def test_status_edges(spark, since, first, gap, status):
    at = D(2024, 12, 31)
    back = lambda n, start=at: None if n is None else start - dt.timedelta(days=n)
    last = back(since)
    row = spark.createDataFrame([(back(first), last, back(gap, last) if last else None)], "f date, l date, p date")
    assert row.select(traits.status_of(F.col("f"), F.col("l"), F.col("p"), F.lit(at))).first()[0] == status


@pytest.mark.parametrize("n", [1, 4, 5, 7, 12, 23])
def test_tiles_equal_ntile(spark, n):
    from pyspark.sql import Window

    df = spark.range(n).withColumn("k", (F.col("id") * 7) % 5)
    ranked = traits.global_rank(df, "r", F.asc("k"), F.asc("id")).withColumn("mine", traits.tile(F.col("r"), n))
    ranked = ranked.withColumn("theirs", F.ntile(5).over(Window.orderBy("k", "id")))
    assert ranked.filter("mine <> theirs").count() == 0


def test_month_helpers():
    assert rollups.month_shift(D(2024, 3, 31), -1) == D(2024, 2, 29) and rollups.month_shift(D(2024, 2, 29), -60) == D(2019, 2, 28)
    assert rollups.retention_window(D(2001, 8, 1)) == ((D(1999, 8, 2), D(2000, 8, 1)), (D(2000, 8, 2), D(2001, 8, 1)))
    assert traits.month_spine(D(2001, 8, 1), 2) == [(D(2001, 7, 1), D(2001, 7, 31)), (D(2001, 8, 1), D(2001, 8, 1))]


def test_normalisers(spark):
    assert one(spark, N.email(F.col("x")), "string", " A.b+t@Ex.org ", "a..b@x.org", "a@b", None, "x@-b.org") == ["a.b+t@ex.org", None, None, None, None]
    assert one(spark, N.phone_us(F.col("x")), "string", "(202) 555-0123 x9", "1-202-555-0123", "0202555123", "") == ["+12025550123", "+12025550123", None, None]
    assert one(spark, N.name(F.col("x")), "string", "  o'BRIEN ", "O'BRIEN", "mary  ann", "McDonald", " ") == ["o'BRIEN", "O'Brien", "Mary Ann", "McDonald", None]
    assert one(spark, N.ip_prefix(F.col("x")), "string", "10.1.2.3", "2001:0db8:85a3:8d3::1", "fe80::1") == ["10.1.2.0", "2001:db8:85a3::", "fe80::"]
    assert one(spark, N.csv_safe(F.col("x")), "string", "=1", " -x", "ok", None) == ["'=1", "' -x", "ok", None]
    assert one(spark, N.number(F.col("x")), "string", "$1,200.5", "abc", "NaN") == [1200.5, None, None]
    key = b"k" * 80
    assert one(spark, N.hmac_sha256(key, F.col("x")), "string", "abc") == [hmac.new(key, b"abc", hashlib.sha256).hexdigest()]
    ids = one(spark, N.master_id(F.lit(1_700_000_000_000), F.col("x")), "string", "a", "a", "b")
    assert ids[0] == ids[1] != ids[2] and all(len(i) == 30 and i.startswith("mid_") for i in ids)
    day, warning = N.mixed_date(F.col("x"))
    got = spark.createDataFrame([("2001-03-04",), ("03/04/2001",), ("12/25/1999",), ("Jan 05, 2000",), ("soon",)], "x string").select(day, warning).collect()
    assert [tuple(r) for r in got] == [(D(2001, 3, 4), None), (D(2001, 3, 4), "date_ambiguous"), (D(1999, 12, 25), "date_fallback_format"), (D(2000, 1, 5), "date_fallback_format"), (None, None)]


def test_consent_forms(spark):
    rows = [(1, "email", "opted_out", 1, False, D(2000, 1, 2), 1), (1, "email", "opted_in", 1, True, D(2000, 1, 3), 2), (2, "email", "opted_out", 1, False, D(2000, 1, 2), 3), (2, "email", "opted_in", 1, False, D(2000, 1, 3), 4), (3, "sms", "unknown", 1, False, D(2000, 1, 9), 5), (3, "sms", "opted_in", 1, False, D(2000, 1, 1), 6)]
    got = consent_winner(spark.createDataFrame(rows, "profile_id long, channel string, status string, source_id int, authoritative boolean, captured_at date, id long"))
    assert {r["profile_id"]: r["status"] for r in got.collect()} == {1: "opted_in", 2: "opted_out", 3: "opted_in"}
    assert candidate_wins(("opted_out", 1, False), ("opted_in", 2, True)) and not candidate_wins(("opted_out", 1, False), ("opted_in", 2, False))
    assert not candidate_wins(("opted_in", 1, False), ("unknown", 9, True)) and candidate_wins(None, ("unknown", 0, False))


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id long, p string, q string")
    new = spark.createDataFrame([(1, None, "z"), (2, "b", "x"), (3, "c", None)], "id long, p string, q string")
    assert sorted(tuple(r) for r in upserts.upsert(old, new, ["id"]).collect()) == [(1, "a", "z", "updated"), (2, "b", "x", "same"), (3, "c", None, "inserted")]


def test_components_of_chains_and_hubs(spark):
    chain = [(i, 0, "e", f"k{i // 2}") for i in range(40)] + [(i, 0, "p", f"q{(i + 1) // 2}") for i in range(40)]
    hub = [(100 + i, 0, "e", "hub") for i in range(50)] + [(200, 0, "e", "alone")]
    got = {r["id"]: r["label"] for r in identity.components(spark.createDataFrame(chain + hub, "id long, source_id int, kind string, value string")).collect()}
    assert all(got[i] == 0 for i in range(40)) and all(got[100 + i] == 100 for i in range(50)) and got[200] == 200


def test_conflict_is_cut_then_quarantined(spark):
    rows = [(1, 0, "email", "e"), (2, 0, "email", "e"), (1, 0, "login", "a"), (2, 0, "login", "b"), (3, 0, "login", "c"), (3, 0, "login", "d")]
    labels, held = identity.refined(spark.createDataFrame(rows, "id long, source_id int, kind string, value string"))
    assert {r["id"]: r["label"] for r in labels.collect()} == {1: 1, 2: 2, 3: 3} and [r["label"] for r in held.collect()] == [3]


def test_alias_cycle_ends(spark):
    got = identity.alias_chain(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "retired_id string, survivor_id string"))
    assert {r["retired_id"]: r["survivor_id"] for r in got.filter("retired_id < 'm'").collect()} == {"a": "c", "b": "c"}


def test_schedule():
    utc = dt.timezone.utc
    assert schedule.matches("*/15 9-17 * * 1-5", dt.datetime(2024, 12, 31, 9, 45)) and not schedule.matches("0 0 1 * 1", dt.datetime(2024, 12, 31))
    assert schedule.matches("0 0 13 * 5", dt.datetime(2024, 12, 13)) and schedule.matches("0 0 13 * 5", dt.datetime(2024, 12, 20))
    assert schedule.next_run("30 2 * * *", dt.datetime(2024, 3, 10, 5, tzinfo=utc), "America/New_York") == dt.datetime(2024, 3, 11, 6, 30, tzinfo=utc)
    for bad in ("* * * *", "61 * * * *", "a * * * *", "5-1 * * * *"):
        with pytest.raises(ValueError):
            schedule.parse(bad)


def test_paged_source(spark):
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").option("fetch", "pledgework.sources.paged.counted").option("pages", "2").option("columns", "page int, row int").load()
    assert df.count() == 6


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y,z\n")
    rows, bad = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in rows.collect()] == [("1", "x")] and bad.select("id").collect()[0][0] == "2"
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n[1]\nnope\n{"a": 2}\n')
    good, rejected = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and rejected.count() == 2
    assert files.readonly_query("SELECT a, b FROM s.t") and files.detect("gifts.csv", ["amount", "gift_date"]) == "gifts"
    for q in ("select f(x) from t", "select a from t; drop t", "select a from t where b = 'c'"):
        with pytest.raises(ValueError):
            files.readonly_query(q)
    for header in (["a", " A"], ["a", ""]):
        with pytest.raises(files.HeaderError):
            files.check_header(header)
    manifest = files.write_packaged(spark.range(10), str(tmp_path / "out"))
    assert manifest.agg(F.sum("rows")).first()[0] == 10


def test_stream_equals_batch(spark, tmp_path):
    def message(i, **k):
        return json.dumps({"type": "track", "name": "n", "messageId": f"m{i}", "userId": "u", "timestamp": "2024-01-05T00:00:00Z", "receivedAt": "2024-01-06T00:00:00Z", "ip": "10.0.0.9", "properties": "{}"} | k)

    source, out, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join([message(1), message(1), message(2, type="x"), message(3, timestamp="1990-01-01T00:00:00Z")]))
    ingest.ingest(spark, source, out, point).awaitTermination()
    (tmp_path / "in/2.json").write_text("\n".join([message(1), message(4)]))
    ingest.ingest(spark, source, out, point).awaitTermination()
    events = spark.read.parquet(f"{out}/events")
    assert sorted(r["messageId"] for r in events.collect()) == ["m1", "m3", "m4"]
    assert events.filter("clamped").first()["occurred_at"] == dt.datetime(2024, 1, 6) and events.first()["ip"] == "10.0.0.0"
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{out}/rejects").select("messageId", "reason").collect()] == [("m2", "type")]


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_global_rank_of_a_million(spark, parts):
    """Wide and narrow rows, many ties: the row numbers are 1 to n in order."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = spark.range(1_000_000).selectExpr("id AS profile_id", "cast(hash(id) % 1000 AS int) AS v", *(["repeat(cast(id AS string), 5) AS wide"] if parts == 8 else []))
        got = traits.global_rank(rows, "place", F.desc("v"), F.asc("profile_id"))
        out = got.select("place", "v", "profile_id").toPandas().sort_values(["v", "profile_id"], ascending=[False, True])
        assert (out["place"].to_numpy() == range(1, 1_000_001)).all()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_csv_header_as_it_stands(spark, tmp_path):
    for k, head in enumerate(("id,name,name", "id,,b", "id,ID")):
        (tmp_path / f"h{k}.csv").write_text(f"{head}\n1,2,3\n")
        with pytest.raises(files.HeaderError):
            files.read_csv(spark, str(tmp_path / f"h{k}.csv"))
    (tmp_path / "w.csv").write_text('id,"a b"\n1\n2,"x\ny"\n3,z,more\n')
    (tmp_path / "m.csv").write_text('\ufeff"i\nd",name\n1,x\n2,"y\nz"\n')
    rows, bad = files.read_csv(spark, str(tmp_path / "m.csv"))
    assert rows.columns == ["i\nd", "name"] and bad.count() == 0
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "x"), ("2", "y\nz")]
    folder = tmp_path / "folder"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.csv").write_text(f"id,name\n{k},x\n")
    with gzip.open(folder / "3.csv.gz", "wt") as f:
        f.write("id,name\n3,x\n")
    assert files.read_csv(spark, str(folder))[0].count() == 4
    (folder / "4.csv").write_text("name,id\nx,4\n")
    with pytest.raises(files.HeaderError):
        files.read_csv(spark, str(folder))
    rows, bad = files.read_csv(spark, str(tmp_path / "w.csv"))
    assert sorted(tuple(r) for r in rows.collect()) == [("1", None), ("2", "x\ny")] and [r["id"] for r in bad.collect()] == ["3"]


def test_receipts_are_of_a_source(spark, tmp_path):
    def message(source, i):
        return json.dumps({"source": source, "type": "track", "name": "n", "messageId": f"m{i}", "userId": "u", "timestamp": "2024-01-05T00:00:00Z", "receivedAt": "2024-01-06T00:00:00Z", "properties": "{}"})

    source, out, point = (str(tmp_path / x) for x in ("in", "out", "point"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join([message("a", 1), message("b", 1), message("a", 1)]))
    ingest.ingest(spark, source, out, point).awaitTermination()
    (tmp_path / "in/2.json").write_text("\n".join([message("b", 1), message("c", 1)]))
    ingest.ingest(spark, source, out, point).awaitTermination()
    assert sorted((r["source"], r["messageId"]) for r in spark.read.parquet(f"{out}/events").collect()) == [("a", "m1"), ("b", "m1"), ("c", "m1")]
