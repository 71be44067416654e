"""Sessions and device links as streaming state, with timers that end them.

The state of a key is what the batch functions (ingest.sessions, devices.linked) say about its events so far. Each field keeps
the largest (time, message) that gave it a value, so the order of deliveries and repeats don't matter. A timer of event time fires
when the watermark has passed the key's expiry: the key leaves the state and a last row, marked expired, tells the table that it is
gone. Events later than the watermark are dropped, so `delay` is how late a delivery may come.

State is kept by the RocksDB provider, on executors and in the checkpoint; use configured() on the session first.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pledgework.streaming.devices import DAYS, KEY

CLICKS = ("fbclid", "fbp", "fbc")
SESSION_DAYS = 90
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configured(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class Expiring(StatefulProcessor):
    """State of the fields in KIND, which merge() brings up to date; ends `days` after the field last_us."""

    KIND = StructType([])

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.KIND)

    def merge(self, old: dict | None, row: Row) -> dict:
        raise NotImplementedError

    def result(self, key: tuple, state: dict, expired: bool) -> Row:
        raise NotImplementedError

    def ends(self, state: dict) -> int:
        """In milliseconds, rounded up, as timers have no finer ones."""
        return -(-state["last_us"] // 1000) + self.days * 86_400_000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.KIND.names
        old = dict(zip(names, self.state.get())) if self.state.exists() else None
        if old is not None and self.ends(old) <= timerValues.getCurrentWatermarkInMs():  # its timer would fire after these rows: they begin a new life
            self.handle.deleteTimer(self.ends(old))
            self.state.clear()
            old = None
        new = old
        for row in rows:
            new = self.merge(new, row)
        if self.ends(new) <= timerValues.getCurrentWatermarkInMs():  # over before it was delivered
            return
        self.state.update(tuple(new[n] for n in names))
        if old is None or self.ends(old) != self.ends(new):
            if old is not None:
                self.handle.deleteTimer(self.ends(old))
            self.handle.registerTimer(self.ends(new))
        yield self.result(key, new, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = dict(zip(self.KIND.names, self.state.get()))
        self.state.clear()
        yield self.result(key, state, True)

    def close(self) -> None:
        pass


def later(a: tuple, b: tuple) -> bool:
    """Whether a is after b; what is missing is before all else."""
    return tuple((x is not None, x if x is not None else 0) for x in a) > tuple((x is not None, x if x is not None else 0) for x in b)


def at(us: int) -> datetime:
    return datetime.fromtimestamp(0, timezone.utc) + timedelta(microseconds=us)


class Sessions(Expiring):
    KIND = StructType([f for c in CLICKS for f in (StructField(c, StringType()), StructField(f"{c}_us", LongType()), StructField(f"{c}_id", StringType()))] + [StructField("last_us", LongType())])
    OUT = "session string, fbclid string, fbp string, fbc string, last_at timestamp, expires_at timestamp, expired boolean"

    def merge(self, old, row):
        new = dict(old or {n: None for n in self.KIND.names})
        for c in CLICKS:
            stamp = (row["us"], row["messageId"] or "")
            if row[c] is not None and (new[c] is None or stamp > (new[f"{c}_us"], new[f"{c}_id"])):
                new |= {c: row[c], f"{c}_us": stamp[0], f"{c}_id": stamp[1]}
        new["last_us"] = max(row["us"], new["last_us"] if new["last_us"] is not None else row["us"])
        return new

    def result(self, key, state, expired):
        return Row(session=key[0], **{c: state[c] for c in CLICKS}, last_at=at(state["last_us"]), expires_at=at(state["last_us"]) + timedelta(days=self.days), expired=expired)


class Links(Expiring):
    KIND = StructType([StructField(n, LongType()) for n in ("source_id", "first_us", "last_us")])
    OUT = "key_type string, device_id string, profile_id long, source_id long, first_seen_at timestamp, last_seen_at timestamp, expires_at timestamp, expired boolean"

    def merge(self, old, row):
        if old is None:
            return {"source_id": row["source_id"], "first_us": row["us"], "last_us": row["us"]}
        source = row["source_id"] if later((row["us"], row["source_id"]), (old["last_us"], old["source_id"])) else old["source_id"]
        return {"source_id": source, "first_us": min(old["first_us"], row["us"]), "last_us": max(old["last_us"], row["us"])}

    def result(self, key, state, expired):
        return Row(**dict(zip(KEY, key)), source_id=state["source_id"], first_seen_at=at(state["first_us"]), last_seen_at=at(state["last_us"]), expires_at=at(state["last_us"]) + timedelta(days=self.days), expired=expired)


def _kept(rows: DataFrame, keys: tuple[str, ...], time: str, processor: Expiring, delay: str) -> DataFrame:
    stream = rows.filter(F.col(time).isNotNull()).withWatermark(time, delay).withColumn("us", F.unix_micros(time))
    return stream.groupBy(*keys).transformWithState(processor, processor.OUT, outputMode="Update", timeMode="EventTime")


def session_updates(events: DataFrame, days: int = SESSION_DAYS, delay: str = "7 days") -> DataFrame:
    """Of a stream of events, each session's newest click ids whenever they or its last event change, and once when it ends."""
    made = {c: F.get_json_object("properties", f"$.{c}") for c in CLICKS}
    rows = events.withColumns(made | {"session": F.coalesce("anonymousId", "userId")}).filter("session IS NOT NULL").select("session", "occurred_at", "messageId", *CLICKS)
    return _kept(rows, ("session",), "occurred_at", Sessions(days), delay)


def link_updates(seen: DataFrame, days: int = DAYS, delay: str = "1 day") -> DataFrame:
    """Of a stream of sightings (devices.sightings), each device link whenever it changes, and once when it ends."""
    rows = seen.select(*KEY, F.col("source_id").cast("long").alias("source_id"), "seen_at")
    return _kept(rows, KEY, "seen_at", Links(days), delay)


def write_updates(updates: DataFrame, out: str, checkpoint: str):
    """A query that writes each batch's updates to its own folder, so that a rerun leaves the same rows; it ends when the source is read."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return updates.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def applied(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The table that written updates lead to: the last word of each key, unless it is that the key ended. A batch has one word a key."""
    rest = [c for c in updates.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch").cast("long")).alias("r"))
    return last.select(*keys, "r.*").filter("NOT expired").drop("expired", "batch")
