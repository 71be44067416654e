"""Helpers shared by the corpus operators: Arrow mapping in small slices, scratch tables, guarded broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE = 256
DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names. Where none is set, a local session gets a folder of its own; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="pledgework-")
        spark.sparkContext.setCheckpointDir(named)
    return f"{named.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended
        pass


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as the query that wrote them has ended, not when the driver collects garbage."""
    before = spark.conf.get(DROPPED)
    spark.conf.set(DROPPED, "true")
    try:
        yield
    finally:
        spark.conf.set(DROPPED, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a table into the shared folder and read it again; it outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch = path
    return written


def release(written: DataFrame) -> None:
    """Removes a table of materialize() that nothing reads any more; other frames stay as they are."""
    if path := getattr(written, "scratch", None):
        _remove(written.sparkSession, path)


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType, slice_rows: int = SLICE) -> DataFrame:
    """mapInArrow in slices of a few hundred rows, so memory doesn't follow Spark's batch size.

    make() runs once a task and returns the function for a slice; if that has an attribute flush, it is
    called at the end of the task and its batches follow.
    """
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_rows):
                out = fn(batch.slice(at, slice_rows))
                if out is not None and len(out):
                    yield _as(out, arrow)
        for out in getattr(fn, "flush", lambda: ())():
            if len(out):
                yield _as(out, arrow)

    return df.mapInArrow(mapped, kind)


class Columns(dict):
    """Columns by name; the length is the number of rows."""

    def __len__(self) -> int:
        return len(next(iter(self.values()))) if dict.__len__(self) else 0


def _as(out, arrow: pa.Schema) -> pa.RecordBatch:
    if isinstance(out, pa.RecordBatch):
        return out.cast(arrow) if out.schema != arrow else out
    return pa.RecordBatch.from_arrays([out[f.name] if isinstance(out[f.name], pa.Array) and out[f.name].type == f.type else pa.array(out[f.name], f.type) for f in arrow], schema=arrow)


def broadcast_if_small(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """Broadcast only below a checked number of rows; else Spark joins by shuffling."""
    return F.broadcast(df) if rows <= most else df


def crc_bucket(col: str = "doc_id", parts: int = 10):
    """crc32 of the id as text, modulo parts; a null id counts as the text 'null'."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("null")).cast("binary")), F.lit(parts))
