"""File sources and sinks: delimited and line-delimited JSON in, safe CSV and manifests out."""

from __future__ import annotations

import csv
import io
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pledgework.functions.normalize import csv_safe

MORE = "_more"
LINE_BYTES = 1 << 20
HEAD = 1 << 16
FORBIDDEN_SQL = re.compile(r"[();'\"`]|--|/\*|\b(insert|update|delete|merge|drop|alter|create|call|copy|grant|into|union|with)\b", re.I)


class HeaderError(ValueError):
    """A header that can't be used."""


def check_header(names: list[str]) -> list[str]:
    """Trimmed names; empty or repeated ones raise."""
    out = [n.strip().lstrip("﻿") for n in names]
    if any(not n for n in out):
        raise HeaderError("a column has no name")
    if len({n.lower() for n in out}) < len(out):
        raise HeaderError("two columns have one name")
    return out


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The header of each file that has one; only the first HEAD bytes of a file are read, unpacked where its name says so."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def head(file: str) -> list[str] | None:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        stream = at.getFileSystem(conf).open(at)
        try:
            codec = codecs.getCodec(at)
            data = bytes((codec.createInputStream(stream) if codec else stream).readNBytes(HEAD))
        finally:
            stream.close()
        text = io.StringIO(data.decode("utf-8-sig", "ignore" if len(data) == HEAD else "strict"), newline="")
        names = next(csv.reader(text), None)
        if names is not None and len(data) == HEAD and text.tell() == HEAD:
            raise HeaderError("the header is too long")
        return None if names is None else check_header(names)

    files = spark.read.text(path).inputFiles()
    with ThreadPoolExecutor(16) as pool:
        return {f: h for f, h in zip(files, pool.map(head, files)) if h is not None}


def read_csv(spark: SparkSession, path: str, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects). All columns are text; rows wider than the header are rejected whole, of narrower ones the rest is null.

    The header is each file's first record as it stands, so that empty and repeated names are seen, and names may hold line
    ends; the files of a folder must have the same one. With multiline, fields may hold line ends, and a file is one task;
    without, large files are split.
    """
    found = headers(spark, path)
    if len({tuple(h) for h in found.values()}) > 1:
        raise HeaderError(f"the files have {len({tuple(h) for h in found.values()})} different headers")
    names = next(iter(found.values()), [])
    if MORE in names:
        raise HeaderError(f"{MORE} is not a column's name")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, MORE])
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).option("multiLine", multiline).option("escape", '"').csv(path)
    return rows.filter(F.col(MORE).isNull()).drop(MORE), rows.filter(F.col(MORE).isNotNull())


def preview(df: DataFrame, rows: int = 50) -> DataFrame:
    """S2."""
    return df.limit(rows)


def read_jsonl(spark: SparkSession, path: str, schema: str, pattern: str = "*") -> tuple[DataFrame, DataFrame]:
    """(parsed objects, rejected lines). Lines of over 1 MiB or that aren't objects are rejected."""
    lines = spark.read.option("pathGlobFilter", pattern).text(path).filter(F.trim("value") != "")
    ok = (F.octet_length("value") <= LINE_BYTES) & F.trim("value").startswith("{") & F.get_json_object("value", "$").isNotNull()
    ok = F.coalesce(ok, F.lit(False))
    return lines.filter(ok).select(F.from_json("value", schema).alias("r")).select("r.*"), lines.filter(~ok)


def readonly_query(text: str) -> str:
    """One plain SELECT without functions, literals or other statements."""
    flat = " ".join(text.split())
    if not re.match(r"(?i)^select [\w.,* ]+ from [\w.]+( where [\w.]+ is (not )?null)?$", flat) or FORBIDDEN_SQL.search(flat[6:]):
        raise ValueError("only a plain SELECT of columns from one table is allowed")
    return flat


def since(df: DataFrame, cursor: str, value) -> DataFrame:
    """The high-water mark is read again, so that ties aren't missed; the filter reaches the scan."""
    return df if value is None else df.filter(F.col(cursor) >= F.lit(value))


@dataclass(frozen=True)
class FeedKind:
    name: str
    columns: frozenset[str]
    hint: str


#: What each kind of export must have, and what its file name says.
FEEDS = (
    FeedKind("gifts", frozenset({"amount", "gift_date"}), "gift"),
    FeedKind("consents", frozenset({"channel", "status"}), "consent"),
    FeedKind("events", frozenset({"name", "occurred_at"}), "event"),
    FeedKind("enrichment", frozenset({"vendor", "license_id"}), "score"),
    FeedKind("contacts", frozenset({"email"}), "contact"),
)


def detect(filename: str, columns: list[str]) -> str | None:
    """By columns; the file name decides between several."""
    have = {c.lower() for c in columns}
    fit = [f for f in FEEDS if f.columns <= have]
    named = [f for f in fit if f.hint in filename.lower()]
    return (named or fit)[0].name if fit else None


def aliases(df: DataFrame, *columns: str) -> DataFrame:
    """A row for each distinct identifier."""
    return df.withColumn("identifier", F.explode(F.array_distinct(F.array_compact(F.array(*columns)))))


def split_children(df: DataFrame, column: str, schema: str, key: str) -> DataFrame:
    """Nested objects as rows of their own."""
    return df.select(key, F.explode(F.from_json(column, f"array<struct<{schema}>>")).alias("c")).select(key, "c.*")


def write_csv(df: DataFrame, path: str) -> None:
    """Text columns made safe for spreadsheets; parts stay distributed."""
    cols = [csv_safe(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.option("header", True).option("compression", "none").csv(path)


def write_packaged(df: DataFrame, path: str) -> DataFrame:
    """Gzip parts, then a manifest of rows, bytes and digests by file, written last: its presence says that the package is whole."""
    spark = df.sparkSession
    write = df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.option("compression", "gzip")
    write.text(f"{path}/data")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(f"{path}/data").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = spark.read.text(f"{path}/data").groupBy(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file")).agg(F.count("*").alias("rows"))
    manifest = files.join(lines, "file", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    manifest.coalesce(1).write.json(f"{path}/_manifest")
    return spark.read.json(f"{path}/_manifest")


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """A batch number, so that a sink sends about size rows at once; keyed by digest, so a retry sends the same batches."""
    n = max(1, -(-df.count() // size))
    return df.withColumn("batch", F.pmod(F.xxhash64(key), F.lit(n)).cast("int"))


def list_sync(wanted: DataFrame, remote: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a remote list must add and remove."""
    return wanted.join(remote, wanted.columns, "left_anti"), remote.join(wanted, remote.columns, "left_anti")
