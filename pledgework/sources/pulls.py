"""A contact system read as a stream, window by window, and lead forms turned into contacts with consent.

The remote side is a class named by the option client; it is made with the options and has

    page(since_ms, until_ms, after) -> list of (id, modified_ms, body)

the rows of a window after an id, in the order of their ids, empty at its end. An offset is the end of the last window. A batch reads from
OVERLAP before the last end, as remote indexes lag and times tie, up to LAG before now, as the newest rows aren't stable yet. A
window is cut into slices, which are partitions: each is paged through by one task, and a lost task pages its slice again.
Rows of the overlap come again, so what is kept is the latest row by id: see kept().
"""

from __future__ import annotations

import importlib
import json
import os
import time
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

OVERLAP, LAG, SLICE, MOST_SLICES = 300_000, 120_000, 3_600_000, 256


def named(dotted: str):
    module, _, name = dotted.rpartition(".")
    return getattr(importlib.import_module(module), name)


class Slice(InputPartition):
    def __init__(self, since: int, until: int):
        self.since, self.until = since, until


class PullReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.clock = named(options["clock"]) if "clock" in options else lambda _: int(time.time() * 1000)

    def initialOffset(self) -> dict:
        return {"until": int(self.options.get("since", 0))}

    def latestOffset(self) -> dict:
        return {"until": max(1, self.clock(self.options) - LAG)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        """The window in slices that end where the next begins; a first, long window has wider ones."""
        since, until = max(0, start["until"] - OVERLAP), end["until"]
        wide = max(int(self.options.get("slice", SLICE)), -(-(until - since) // MOST_SLICES))
        return [Slice(at, min(at + wide, until)) for at in range(since, until, wide)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        client, after = named(self.options["client"])(self.options), None
        while rows := client.page(partition.since, partition.until, after):
            if after is not None and rows[-1][0] <= after:
                raise RuntimeError("paging did not advance")
            yield from rows
            after = rows[-1][0]

    def commit(self, end: dict) -> None:
        pass  # offsets are in the checkpoint


class Pull(DataSource):
    """Options client, and perhaps since (ms), slice (ms) and clock (dotted name of a function of the options, for tests and replays)."""

    @classmethod
    def name(cls) -> str:
        return "pull"

    def schema(self) -> str:
        return "id string, modified long, body string"

    def streamReader(self, schema) -> PullReader:
        return PullReader(self.options)


class Recorded:
    """A client over a folder of JSON lines with id and modified, as a recording of a remote system; option folder, and rows a page."""

    def __init__(self, options: dict):
        self.folder, self.rows = options["folder"], int(options.get("rows", 100))

    def page(self, since: int, until: int, after: str | None) -> list[tuple]:
        found = []
        for name in sorted(os.listdir(self.folder)):
            with open(f"{self.folder}/{name}", encoding="utf-8") as lines:
                found += [(r["id"], r["modified"], json.dumps(r)) for r in map(json.loads, lines) if since <= r["modified"] < until and (after is None or r["id"] > after)]
        return sorted(found)[: self.rows]


def pull(spark: SparkSession, options: dict, out: str, checkpoint: str):
    """A stream of windows into out: each batch is written to its own folder, so that a rerun leaves the same rows. It ends when the window up to now is read; started again with its checkpoint it goes on from there."""
    spark.dataSource.register(Pull)

    def put(batch: DataFrame, number: int) -> None:
        newest(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.format("pull").options(**options).load()
    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(rows: DataFrame) -> DataFrame:
    """The latest row of each id; equal times go by the body, so that the result doesn't depend on the order."""
    return rows.groupBy("id").agg(F.max(F.struct("modified", "body")).alias("r")).select("id", "r.*")


def kept(spark: SparkSession, out: str) -> DataFrame:
    """What the pulls have gathered: the latest row by id over all windows."""
    return newest(spark.read.parquet(out).select("id", "modified", "body"))


#: Leads as they are read: the form's fields, the answers to its consent boxes, and the questions that the form asks now.
LEAD = """id string, created_time string, form_id string, field_data array<struct<name string, values array<string>>>,
  custom_disclaimer_responses array<struct<checkbox_key string, is_checked string, value string>>, questions array<struct<key string, label string>>"""


def leads(rows: DataFrame, fields: dict[str, str], consent: dict | None = None) -> DataFrame:
    """A contact and its consent from each lead. fields: the form's names -> columns of the contact; of rows that repeat an id one stays.

    consent: field, text, form_id, channel and yes (values that affirm). Only leads of that form that answer the field have a consent. It is
    opted in if the answer affirms and the form still asks in the words that the consent was set up with; if the words have changed,
    or the answer is another, it is unknown, never opted out. Leads whose time has no zone, or without an id, are rejected: reason says why.
    """
    lead = rows.select(F.from_json("body", LEAD).alias("r")).select("r.*")
    lead = lead.groupBy("id").agg(F.max_by(F.struct(*[c for c in lead.columns if c != "id"]), "created_time").alias("r")).select("id", "r.*")
    answers = F.concat(
        F.transform(F.coalesce("field_data", F.array()), lambda f: F.struct(f["name"].alias("name"), F.coalesce(F.get(f["values"], F.lit(0)), F.lit("")).alias("value"))),
        F.transform(F.coalesce("custom_disclaimer_responses", F.array()), lambda f: F.struct(f["checkbox_key"].alias("name"), F.coalesce(f["is_checked"], f["value"], F.lit("")).alias("value"))),
    )

    def answer(name: str) -> Column:
        """The last answer of that name counts; null without one."""
        return F.try_element_at(F.transform(F.filter("answers", lambda a: a["name"] == name), lambda a: a["value"]), F.lit(-1))

    zoned = F.col("created_time").rlike(r"([zZ]|[+-]\d{2}:?\d{2})$")
    at = F.when(zoned, F.try_to_timestamp(F.regexp_replace("created_time", r"([+-]\d{2})(\d{2})$", "$1:$2")))
    out = lead.withColumn("answers", F.array_compact(answers)).withColumn("captured_at", at)
    columns = [answer(name).alias(target) for name, target in fields.items()]
    reason = F.when(F.coalesce(F.trim("id"), F.lit("")) == "", "id").when(F.col("captured_at").isNull(), "created_time")
    made = []
    if consent:
        label = F.get(F.transform(F.filter(F.coalesce("questions", F.array()), lambda q: q["key"] == consent["field"]), lambda q: q["label"]), F.lit(0))
        said, text = answer(consent["field"]), F.coalesce(F.nullif(label, F.lit("")), F.lit(consent["text"]))
        asked = F.size(F.filter("answers", lambda a: a["name"] == consent["field"])) > 0
        changed = F.trim(text) != consent["text"].strip()
        yes = F.lower(F.trim(said)).isin(*[v.strip().lower() for v in consent["yes"]])
        has = asked & (F.col("form_id") == consent["form_id"])
        made = [F.when(has, c).alias(n) for n, c in (("consent_channel", F.lit(consent["channel"])), ("consent_status", F.when(yes & ~changed, "opted_in").otherwise("unknown")), ("consent_text", text), ("consent_text_changed", changed))]
    return out.select(F.concat(F.lit("lead:"), "id").alias("external_id"), "form_id", "captured_at", *columns, *made, reason.alias("reason"))
