"""A folder of files of keys in, a file of master ids out for each.

A file has one column, named by a kind of key. It is answered whole or refused whole. An answer's name is the digest of the
file's name and bytes, so that a file that was answered is left alone and a changed one is answered anew. Answers are written
aside and put in place by a rename that fails if the name is taken: a pass that dies leaves nothing half written, and of two
passes at once the first one counts. Files are read, cut and matched by Spark; only names and renames pass the driver.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pledgework.functions.normalize import csv_safe
from pledgework.operators.generations import Files
from pledgework.operators.identity import lookup
from pledgework.operators.scratch import written

#: The largest file, its most rows, the longest key, names of files that are read, columns and the kinds of key they hold.
LARGEST, MOST_ROWS, LONGEST = 8 << 20, 10_000, 512
NAMES = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,180}\.csv$"
KINDS = ("hubspot_record_id", "okta_customer_id", "fusionauth_user_id", "donor_account_number")
COLUMNS = {k + s: k for k in KINDS for s in ("", "s")}
ONE_FIELD = r'^([^",][^,]*|"([^"]|"")*")$'


def digest(name: str = "name", content: str = "content"):
    return F.sha2(F.concat(F.col(name).cast("binary"), F.lit(bytearray(b"\0")), F.col(content)), 256)


def cut(files: DataFrame, columns: dict[str, str] = COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(name, content as bytes) -> rows (digest, place, key_type, value) of files that hold, and (name, digest, rows, reason) of all; reason is null for those that hold.

    As keys hold no control characters, a line is a record. Empty lines don't count, a lone blank is no key. No file: no rows.
    Null content is an empty file.
    """
    text = F.regexp_replace(F.col("content").cast("string"), "^﻿", "")
    read = files.withColumn("content", F.coalesce("content", F.lit(bytearray(b"")))).select("name", digest().alias("digest"), F.is_valid_utf8(F.col("content").cast("string")).alias("valid"), F.split(text, r"\r\n|\n|\r").alias("lines"), F.octet_length("content").alias("bytes"))
    unquote = lambda c: F.when(c.startswith('"') & c.rlike(ONE_FIELD), F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    known = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
    head = read.withColumn("key_type", F.try_element_at(known, unquote(F.col("lines")[0])))
    lines = head.select("name", "digest", "valid", "bytes", "key_type", F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1)))).alias("place", "line")).filter("line <> ''")
    value = F.trim(unquote(F.col("line")))
    keys = lines.withColumn("value", value).withColumn("bad", ~F.col("line").rlike(ONE_FIELD) | (F.col("value") == "") | (F.length("value") > LONGEST) | F.col("value").rlike(r"[\x00-\x1f]"))
    counts = keys.groupBy("name", "digest").agg(F.count("*").alias("rows"), F.bool_or("bad").alias("bad"))
    rows = F.coalesce("rows", F.lit(0))
    judged = head.select("name", "digest", "valid", "bytes", "key_type").join(counts, ["name", "digest"], "left").select(
        "name", "digest", rows.alias("rows"),
        F.when(F.col("bytes") > LARGEST, "too large").when(~F.col("valid"), "not UTF-8").when(F.col("key_type").isNull(), "not one column of keys").when(rows == 0, "no key").when(rows > MOST_ROWS, "too many rows").when(F.col("bad"), "an invalid key").alias("reason"),
    )
    held = judged.filter("reason IS NULL").select("digest").distinct()
    return keys.join(held, "digest", "left_semi").select("digest", "place", "key_type", "value"), judged


def answered(keys: DataFrame, owners: DataFrame, aliases: DataFrame | None = None, active: DataFrame | None = None) -> DataFrame:
    """(digest, place, key_type, value) with status matched, unknown or ambiguous and profile_id, by owners (key_type, value, profile_id); a key of two people is never guessed. aliases and active as of lookup()."""
    whole = lambda df: F.concat_ws("\x1f", df["key_type"], df["value"])
    asked = keys.select(F.struct("digest", "place", "key_type", "value").alias("place"), whole(keys).alias("value"))
    found = lookup(asked, owners.select(whole(owners).alias("value"), "profile_id"), aliases, active)
    return found.select("place.*", F.when(F.col("status") == "not_found", "unknown").otherwise(F.col("status")).alias("status"), "profile_id")


def lines_of(answers: DataFrame, masters: DataFrame) -> DataFrame:
    """(digest, place, value as a line) of each answer with its heading at place -1; masters: profile_id, master_id."""
    rows = answers.join(masters, "profile_id", "left")
    quoted = lambda c: F.when(c.rlike('[",]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    line = F.concat_ws(",", "key_type", quoted(csv_safe(F.col("value"))), F.coalesce("master_id", F.lit("")), "status")
    head = answers.select("digest").distinct().select("digest", F.lit(-1).alias("place"), F.lit("key_type,key_value,master_id,status").alias("value"))
    return rows.select("digest", "place", line.alias("value")).unionByName(head)


def poll(spark: SparkSession, inbox: str, outbox: str, owners: DataFrame, masters: DataFrame, aliases: DataFrame | None = None, active: DataFrame | None = None) -> DataFrame:
    """One pass over a folder: (name, digest, rows, reason, outcome), outcome published, skipped or refused. Both folders must be on the file system that all executors see."""
    out = Files(spark, outbox)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(inbox).withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).filter(F.col("name").rlike(NAMES))
    inside = Files(spark, inbox)
    empty = [x.getPath().getName() for x in inside.fs.listStatus(inside.path("")) if x.isFile() and x.getLen() == 0]  # Spark's sources pass over them
    refused = spark.createDataFrame([(n,) for n in empty], "name string").filter(F.col("name").rlike(NAMES)).withColumn("reason", F.lit("not one column of keys"))
    refused = refused.unionByName(files.filter(F.col("length") > LARGEST).select("name", F.lit("too large").alias("reason")))
    refused = refused.select("name", F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("rows"), "reason")
    small = files.filter(F.col("length") <= LARGEST).select("name", "content")
    done = [n.removesuffix(".lookup.csv") for n in out.names("") if n.endswith(".lookup.csv")]
    ready = written(small.withColumn("_digest", digest()), "drop")
    past = spark.createDataFrame([(d,) for d in done], "_digest string")
    keys, judged = cut(ready.join(past, "_digest", "left_anti").drop("_digest"))
    skipped = ready.join(past, "_digest", "left_semi").select("name", F.col("_digest").alias("digest"), F.lit(0).cast("long").alias("rows"), F.lit(None).cast("string").alias("reason"), F.lit("skipped").alias("outcome"))
    aside = f"_parts/{uuid.uuid4().hex}"
    lines = lines_of(answered(keys, owners, aliases, active), masters)
    lines.repartition("digest").sortWithinPartitions("digest", "place").drop("place").write.partitionBy("digest").option("lineSep", "\r\n").text(f"{out.root}/{aside}")
    for folder in out.names(aside):
        if folder.startswith("digest="):
            parts = [n for n in out.names(f"{aside}/{folder}") if n.startswith("part-")]
            out.place_new(f"{aside}/{folder}/{parts[0]}", f"{folder.removeprefix('digest=')}.lookup.csv")
    out.drop(aside)
    rest = judged.unionByName(refused).withColumn("outcome", F.when(F.col("reason").isNull(), "published").otherwise("refused"))
    return written(rest.unionByName(skipped), "drop-report")
