"""Tables that are published together, readers that keep what they opened, and results served stale while they are made anew.

A generation is a folder of tables that no one changes once it is written. What makes it the current one is a commit, a small file
named by its number, which is put in place by a rename that fails if the number is taken: of several writers one wins, the
others raise Conflict. A reader takes the highest commit once and reads that generation's tables only, whatever is published
meanwhile. A writer that dies before its commit leaves a folder that nothing names; vacuum() removes it.

Works on any file system that Spark writes to, as all file operations go through Hadoop's interface.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Seconds that a cached result is fresh, and that a reader waits for one that isn't there yet.
TTL, DEADLINE = 60.0, 15.0
CONTRACT = "v1"


class Conflict(RuntimeError):
    """Another generation was published since the one that this was built from."""


class DeadlineExceeded(TimeoutError):
    """No result yet; its computation was stopped."""


class Files:
    """The few operations on the shared file system that a commit needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.none = spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        self.none[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.NONE

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """The whole file or nothing, and only if none has the name."""
        part = self.path(f"_parts/{uuid.uuid4().hex}")
        stream = self.fs.create(part, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        return self.place_new(f"_parts/{part.getName()}", name)

    def place_new(self, part: str, name: str) -> bool:
        """Gives a written file its name, only if none has it; else the file goes."""
        to = self.path(name)
        self.fs.mkdirs(to.getParent())
        try:
            self.context.rename(self.path(part), to, self.none)
            return True
        except Exception as e:
            self.fs.delete(self.path(part), False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Snapshot:
    """One generation, as its reader opened it."""

    spark: SparkSession
    root: str
    number: int
    generation: str
    tables: tuple[str, ...]
    facts: dict

    def table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"generation {self.number} has no table {name}")
        return self.spark.read.parquet(f"{self.root}/{self.generation}/{name}")


def current(spark: SparkSession, root: str) -> Snapshot | None:
    """The generation that was published last, None if none was."""
    files = Files(spark, root)
    for name in reversed(files.names("_commits")):
        said = json.loads(files.read(f"_commits/{name}"))
        return Snapshot(spark, files.root, int(name), said["generation"], tuple(said["tables"]), said["facts"])
    return None


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], base: Snapshot | None = None, facts: dict | None = None) -> Snapshot:
    """Writes the tables, then makes them current all at once. base: the generation that they were built from; if another was published since, Conflict is raised and readers see nothing of these."""
    files = Files(spark, root)
    generation = f"g-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{files.root}/{generation}/{name}")
    last = max(map(int, files.names("_commits")), default=0)
    said = {"generation": generation, "tables": sorted(tables), "facts": facts or {}}
    number = (base.number if base else last) + 1
    if number <= last or not files.put_new(f"_commits/{number:020d}", json.dumps(said)):
        files.drop(generation)
        raise Conflict(f"generation {number} of {root} was published by another writer")
    return Snapshot(spark, files.root, number, generation, tuple(sorted(tables)), facts or {})


def vacuum(spark: SparkSession, root: str, keep: int = 2, idle: float = 86400.0) -> list[str]:
    """Removes all but the newest generations and folders without a commit that are older than idle seconds, which a writer may still be at; gives their names. Readers of removed generations fail, so keep those that may still be read."""
    files = Files(spark, root)
    commits = files.names("_commits")
    kept = {json.loads(files.read(f"_commits/{n}"))["generation"] for n in commits[-keep:]}
    named = {json.loads(files.read(f"_commits/{n}"))["generation"] for n in commits[:-keep]}
    gone = []
    for status in files.fs.listStatus(files.path("")) if files.fs.exists(files.path("")) else []:
        name = status.getPath().getName()
        abandoned = status.getModificationTime() / 1000 < time.time() - idle
        if name.startswith("g-") and name not in kept and (name in named or abandoned):
            files.drop(name)
            gone.append(name)
    for n in commits[:-keep]:
        files.drop(f"_commits/{n}")
    return gone


def within(spark: SparkSession, seconds: float, work: Callable[[], object]):
    """What work gives, run in a thread under a job tag of its own; its jobs and their tasks are stopped, and others left alone, when the time is over. (A session's tags are seen by the thread that added them only, so the context's are used.)"""
    context, tag, out = spark.sparkContext, f"deadline-{uuid.uuid4().hex}", {}

    def run() -> None:
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        try:
            out["value"] = work()
        except Exception as e:  # handed to the caller below
            out["error"] = e
        finally:
            context.removeJobTag(tag)

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(seconds)
    if worker.is_alive():

        def reap() -> None:
            while worker.is_alive():  # a job that begins after the first call is stopped too
                context.cancelJobsWithTag(tag)
                worker.join(0.2)

        threading.Thread(target=reap, daemon=True).start()
        worker.join(1.0)
        if "value" not in out:
            raise DeadlineExceeded(f"stopped after {seconds:g} seconds")
    if "error" in out:
        raise out["error"]
    return out["value"]


class Cache:
    """Results by key, each built from one generation of the tables in root and kept as a generation of its own under store.

    A result that is there is served at once. If it is older than ttl, or its tables have been published anew, it is made again in the
    background, by one thread a key; a build that fails, or whose tables were replaced meanwhile, is dropped and the stale one stays.
    """

    def __init__(self, spark: SparkSession, root: str, store: str, ttl: float = TTL, deadline: float = DEADLINE, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.store, self.ttl, self.deadline, self.clock = spark, root, store.rstrip("/"), ttl, deadline, clock
        self.busy: dict[str, threading.Thread] = {}
        self.lock = threading.Lock()

    def place(self, key) -> str:
        """A folder by key and by the contract of the results, so that a new release doesn't serve what an old one made."""
        return f"{self.store}/{hashlib.sha256(json.dumps([CONTRACT, key], sort_keys=True, default=str).encode()).hexdigest()}"

    def get(self, key, build: Callable[[Snapshot], DataFrame]) -> tuple[DataFrame, bool]:
        """(result, whether it is fresh)."""
        now = current(self.spark, self.root)
        if now is None:
            raise LookupError(f"nothing has been published in {self.root}")
        found = current(self.spark, self.place(key))
        if found is None:
            found = within(self.spark, self.deadline, lambda: self.made(key, build, now))
            return found.table("result"), True
        fresh = found.facts["generation"] == now.generation and self.clock() - found.facts["at"] < self.ttl
        if not fresh:
            self.refresh(key, build, now)
        return found.table("result"), fresh

    def made(self, key, build: Callable[[Snapshot], DataFrame], of: Snapshot) -> Snapshot:
        at, before = self.clock(), current(self.spark, self.place(key))
        result = build(of)
        try:
            return publish(self.spark, self.place(key), {"result": result}, before, {"generation": of.generation, "number": of.number, "at": at})
        except Conflict:  # another reader was faster; its result counts
            return current(self.spark, self.place(key))

    def refresh(self, key, build: Callable[[Snapshot], DataFrame], of: Snapshot) -> threading.Thread:
        place = self.place(key)

        def run() -> None:
            try:
                within(self.spark, self.deadline, lambda: self.made(key, build, of))
                vacuum(self.spark, place)
            except Exception:  # the stale result stays and the next reader tries again
                self.failed = place
            finally:
                with self.lock:
                    self.busy.pop(place, None)

        with self.lock:
            if place in self.busy:
                return self.busy[place]
            worker = self.busy[place] = threading.Thread(target=run, daemon=True)
        worker.start()
        return worker

    def settle(self) -> None:
        """Waits for the refreshes that run."""
        for worker in list(self.busy.values()):
            worker.join()
