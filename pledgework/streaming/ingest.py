"""Event ingestion with Structured Streaming: validate, split off rejects, deduplicate for ever, write once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pledgework.functions.normalize import clamp_time, ip_prefix

BUCKETS = 256
SCHEMA = "source string, type string, name string, messageId string, userId string, anonymousId string, timestamp timestamp, receivedAt timestamp, ip string, properties string"
TYPES = ("track", "identify", "page")
LARGEST = 32 * 1024
KEEP_FOREVER = ("donation", "donation_return")


def validated(raw: DataFrame) -> DataFrame:
    """Reason is null for a good message; event time clamped to its receipt, address truncated."""
    reason = (
        F.when(F.col("messageId").isNull() | (F.length("messageId") > 200), "message_id")
        .when(~F.coalesce(F.col("type").isin(*TYPES), F.lit(False)), "type")
        .when((F.col("type") == "track") & (F.coalesce(F.trim("name"), F.lit("")) == ""), "name")
        .when(F.col("userId").isNull() & F.col("anonymousId").isNull(), "identity")
        .when(F.octet_length("properties") > LARGEST, "size")
    )
    at, flag = clamp_time(F.col("timestamp"), F.col("receivedAt"))
    return raw.withColumn("reason", reason).withColumn("occurred_at", at).withColumn("clamped", flag).withColumn("ip", ip_prefix(F.col("ip")))


def accept(batch: DataFrame, ledger: DataFrame | None) -> DataFrame:
    """First deliveries by source and message only; receipts never expire, so a watermark alone wouldn't do."""
    fresh = batch.filter("reason IS NULL").withColumn("source", F.coalesce("source", F.lit(""))).dropDuplicates(["source", "messageId"])
    return fresh if ledger is None else fresh.join(ledger.select("source", "messageId"), ["source", "messageId"], "left_anti")


def bucket():
    return F.pmod(F.xxhash64("source", "messageId"), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # no batch has been written yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def write_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """Each batch overwrites its own folder, so a rerun leaves the same rows. The ledger has receipts (source, message) only, dealt to hash buckets: a batch reads those of its own messages, without this batch's earlier try."""
    spark = batch.sparkSession
    rows = validated(batch)
    rows.persist()
    ledger = _read(spark, f"{out}/receipts")
    if ledger is not None:
        own = [r[0] for r in rows.filter("reason IS NULL").withColumn("source", F.coalesce("source", F.lit(""))).select(bucket()).distinct().collect()]  # at most BUCKETS
        ledger = ledger.filter(F.col("bucket").isin(own) & (F.col("batch") != batch_id))
    good = accept(rows, ledger).drop("reason").withColumn("event_month", F.date_format("occurred_at", "yyyy-MM"))
    good.write.mode("overwrite").parquet(f"{out}/events/batch={batch_id}")
    receipts = spark.read.parquet(f"{out}/events/batch={batch_id}").select("source", "messageId", bucket().alias("bucket"))
    receipts.write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/receipts/batch={batch_id}")
    rows.filter("reason IS NOT NULL").select("messageId", "reason").write.mode("overwrite").parquet(f"{out}/rejects/batch={batch_id}")
    rows.unpersist()


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str, available_now: bool = True):
    """A query over a folder of JSON lines; with available_now it ends when the folder is read."""
    stream = spark.readStream.schema(SCHEMA).json(source)
    writer = stream.writeStream.foreachBatch(lambda b, i: write_batch(b, i, out)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 minutes")).start()


def stitch(events: DataFrame) -> DataFrame:
    """Anonymous events get the user whom an identify event ties to their anonymous id, if only one."""
    known = events.filter("type = 'identify' AND userId IS NOT NULL AND anonymousId IS NOT NULL").groupBy("anonymousId").agg(F.min("userId").alias("one"), F.max("userId").alias("two")).filter("one = two").select("anonymousId", "one")
    return events.join(known, "anonymousId", "left").withColumn("userId", F.coalesce("userId", "one")).drop("one")


def sessions(events: DataFrame, days: int = 90) -> DataFrame:
    """The newest click ids by session; older values fill what newer lack; sessions end after so many days."""
    p = lambda k: F.get_json_object("properties", f"$.{k}")
    cols = {k: p(k) for k in ("fbclid", "fbp", "fbc")}
    rows = events.withColumns(cols | {"session": F.coalesce("anonymousId", "userId")}).filter("session IS NOT NULL")
    newest = rows.groupBy("session").agg(*[F.max_by(k, F.when(F.col(k).isNotNull(), F.struct("occurred_at", "messageId"))).alias(k) for k in cols], F.max("occurred_at").alias("last_at"))
    return newest.withColumn("expires_at", F.col("last_at") + F.expr(f"INTERVAL {days} DAY"))


def retained(events: DataFrame, as_of, days: int) -> DataFrame:
    """Events of the last days, and all donations."""
    return events.filter((F.col("occurred_at") >= F.date_sub(F.lit(as_of), days)) | F.col("name").isin(*KEEP_FOREVER))


def daily(events: DataFrame) -> DataFrame:
    """The calendar-day rollup, also as a streaming aggregation."""
    return events.groupBy(F.window("occurred_at", "1 day").alias("w"), "name").agg(F.count("*").alias("events")).select(F.col("w.start").cast("date").alias("day"), "name", "events")
