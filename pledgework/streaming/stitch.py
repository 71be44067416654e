"""An event table in which a late identify event reaches the anonymous events that were written before it.

The table is kept in parts: events by day, and for each bucket of anonymous ids the users that identify events tie to them and the
days on which they were seen. A batch finds the days that it makes dirty: those of its own events, and those of the anonymous ids
whose owner it changes. Only these parts are read and written anew, in folders of their own, and one commit (see
operators.generations) names for each part the folder that counts. Readers see the table before a batch or after it; a batch that
runs again after its commit does nothing. What a day's rows say depends on the events delivered so far only, not on their order. A message that is delivered again has
the same time, so its day tells where the first delivery is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pledgework.operators.generations import Conflict, Files
from pledgework.operators.scratch import written

BUCKETS = 64
EVENT = "source string, type string, name string, messageId string, userId string, anonymousId string, occurred_at timestamp, properties string"
OWNERS = "anonymousId string, lo string, hi string, days array<string>"


def state(spark: SparkSession, root: str) -> dict:
    """What the last commit says: its number, the batch that it has taken in last, and the folder of each part."""
    files = Files(spark, root)
    names = files.names("_commits")
    return {"number": int(names[-1]), **json.loads(files.read(f"_commits/{names[-1]}"))} if names else {"number": 0, "batch": -1, "parts": {}}


def _parts(spark: SparkSession, root: str, folders: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def table(spark: SparkSession, root: str) -> DataFrame:
    """All events of the last commit; user is the event's own, or the one whom its anonymous id belongs to."""
    parts = state(spark, root)["parts"]
    return _parts(spark, root, [f for p, f in sorted(parts.items()) if p.startswith("day=")], EVENT + ", user string, day string")


def bucket(c: str):
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("string")


def deduplicated(events: DataFrame) -> DataFrame:
    """One row of each (source, message); of rows that differ, always the same one."""
    rest = [c for c in events.columns if c not in ("source", "messageId")]
    return events.groupBy("source", "messageId").agg(F.min(F.struct(*rest)).alias("r")).select("source", "messageId", "r.*").select(*events.columns)


def owners_of(events: DataFrame) -> DataFrame:
    """OWNERS by anonymous id: the least and the largest user of its identify events, and the days of all its events."""
    told = F.when((F.col("type") == "identify"), F.col("userId"))
    return events.filter("anonymousId IS NOT NULL").groupBy("anonymousId").agg(F.min(told).alias("lo"), F.max(told).alias("hi"), F.collect_set("day").alias("days"))


def merged_owners(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new).groupBy("anonymousId").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("days")))).alias("days"))


def take_in(batch: DataFrame, number: int, root: str) -> None:
    """A batch of events (EVENT) into the table; for foreachBatch. One writer at a time: of two, one raises Conflict and changes nothing."""
    spark, root = batch.sparkSession, root.rstrip("/")
    was = state(spark, root)
    if number <= was["batch"]:
        return
    new = written(deduplicated(batch.filter("messageId IS NOT NULL AND occurred_at IS NOT NULL").select("source", "type", "name", "messageId", "userId", "anonymousId", "occurred_at", "properties")).withColumn("day", F.date_format("occurred_at", "yyyy-MM-dd")), "new-events")
    fresh = written(owners_of(new).withColumn("bucket", bucket("anonymousId")), "fresh-owners")
    touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS
    before = _parts(spark, root, [was["parts"][f"owners={b}"] for b in touched if f"owners={b}" in was["parts"]], OWNERS)
    merged = written(merged_owners(before, fresh.drop("bucket")).withColumn("bucket", bucket("anonymousId")), "owners")
    one = lambda t: F.when(F.col(f"{t}.lo") == F.col(f"{t}.hi"), F.col(f"{t}.lo"))
    changed = merged.alias("n").join(before.alias("o"), "anonymousId", "left").filter(~one("n").eqNullSafe(one("o"))).select(F.explode("n.days").alias("day"))
    days = [r["day"] for r in changed.unionByName(new.select("day")).distinct().collect()]  # at most a row a day of the calendar
    old = _parts(spark, root, [was["parts"][f"day={d}"] for d in days if f"day={d}" in was["parts"]], EVENT + ", user string, day string").drop("user")
    # owners of these days' anonymous ids are in any bucket; their parts are read, not written
    known = merged.drop("bucket").unionByName(_parts(spark, root, [f for p, f in was["parts"].items() if p.startswith("owners=") and p[7:] not in touched], OWNERS))
    sure = known.filter("lo = hi").select("anonymousId", F.col("lo").alias("owner"))
    rows = deduplicated(old.unionByName(new.select(*old.columns)))
    rows = rows.join(sure, "anonymousId", "left").withColumn("user", F.coalesce("userId", "owner")).drop("owner")
    made, folder = dict(was["parts"]), f"p-{uuid.uuid4().hex}"
    if days:
        rows.select(*[c.split()[0] for c in EVENT.split(", ")], "user", "day", F.col("day").alias("part")).repartition("part").write.partitionBy("part").parquet(f"{root}/{folder}/day")
        made |= {f"day={d}": f"{folder}/day/part={d}" for d in days}
    if touched:
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/{folder}/owners")
        made |= {f"owners={b}": f"{folder}/owners/bucket={b}" for b in touched}
    said = {"batch": number, "parts": made}
    if not Files(spark, root).put_new(f"_commits/{was['number'] + 1:020d}", json.dumps(said)):
        raise Conflict("another writer took the same step")


def stitched(stream: DataFrame, root: str, checkpoint: str):
    """A query that keeps the table from a stream of EVENT; it ends when the source is read."""
    return stream.writeStream.foreachBatch(lambda b, n: take_in(b, n, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def swept(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Removes parts that none of the last commits names, and older commits. Not while a batch is being taken in."""
    files = Files(spark, root)
    commits = files.names("_commits")
    used = {f for n in commits[-keep:] for f in json.loads(files.read(f"_commits/{n}"))["parts"].values()}
    for folder in [n for n in files.names("") if n.startswith("p-")]:
        for kind in files.names(folder):
            for part in [n for n in files.names(f"{folder}/{kind}") if "=" in n]:
                if f"{folder}/{kind}/{part}" not in used:
                    files.drop(f"{folder}/{kind}/{part}")
    for n in commits[:-keep]:
        files.drop(f"_commits/{n}")
