"""States of audiences, the plans of their definitions, and refreshes that are published together.

A refresh makes the audiences that were asked for and all that they read, each after those it reads, which it then finds as
written tables. Members are written to a folder of their own by audience; one small generation names the folders that are
current, so only refreshed audiences are written and readers see all of a refresh or nothing of it.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pledgework.operators.generations import Files, Snapshot, current, publish
from pledgework.operators.scratch import written
from pledgework.segments.ast import SegmentError, order_of, references
from pledgework.segments.compiler import Context, compile_segment

STATES = ("draft", "active", "archived")
MEMBERS = "segment_id long, profile_id long"
HISTORY = "segment_id long, members long, added long, removed long, as_of date"


@dataclass(frozen=True)
class Audience:
    id: int
    name: str
    definition: dict
    status: str = "draft"
    schedule: str | None = None
    owner: str | None = None


def checked(audience: Audience, known: dict[int, Audience]) -> Audience:
    """The audience, if all that it reads is there and not archived, an active one reads active ones only, and nothing reads itself."""
    for i in sorted(references(audience.definition)):
        other = known.get(i) if i != audience.id else audience
        if other is None or other.status == "archived":
            raise SegmentError(f"segment {audience.id}", f"segment {i} doesn't exist or is archived")
        if audience.status == "active" and other.status != "active":
            raise SegmentError(f"segment {audience.id}", f"an active audience can't read {other.name!r}, which isn't active")
    order_of(_reach({**known, audience.id: audience}, [audience.id]))
    return audience


def _reach(known: dict[int, Audience], ids: list[int]) -> dict[int, dict]:
    """Definitions of the audiences and of all that they read."""
    found: dict[int, dict] = {}
    todo = list(ids)
    while todo:
        i = todo.pop()
        if i not in found and i in known:
            found[i] = known[i].definition
            todo += references(known[i].definition)
    return found


def bulk(known: dict[int, Audience], ids: list[int], action: str, context: Context, actor: str = "system") -> tuple[dict[int, Audience], list[int]]:
    """(all audiences after the action, ids to refresh). It holds for all of ids or, with an error, for none.

    activate: active and refreshed daily; each is checked after all have changed, so audiences that read each other's
    results may be activated at once, and compiled. pause: a draft again; members and history stay. refresh: of active ones only.
    """
    if action not in ("activate", "pause", "refresh"):
        raise ValueError(f"{action!r} isn't an action")
    chosen = sorted(set(ids))
    if gone := [i for i in chosen if i not in known]:
        raise SegmentError(f"segment {gone[0]}", "there is no such segment")
    if gone := [i for i in chosen if known[i].status == "archived"]:
        raise SegmentError(f"segment {gone[0]}", "archived audiences can't be changed")
    after = dict(known)
    if action == "pause":
        for a in known.values():
            if a.status == "active" and a.id not in chosen and references(a.definition) & set(chosen):
                raise SegmentError(f"segment {a.id}", f"the active audience {a.name!r} reads one of these: pause it too")
        after |= {i: replace(known[i], status="draft") for i in chosen}
        return after, []
    if action == "refresh":
        if idle := [i for i in chosen if known[i].status != "active"]:
            raise SegmentError(f"segment {idle[0]}", "activate it before it is refreshed")
        return after, chosen
    after |= {i: replace(known[i], status="active", schedule="daily", owner=known[i].owner or actor) for i in chosen}
    for i in chosen:
        checked(after[i], after)
    compiled(after, chosen, context)
    return after, chosen


def compiled(known: dict[int, Audience], ids: list[int], context: Context, cut: bool = False) -> dict[int, DataFrame]:
    """profile_id by audience, for ids and all that they read, in that order; all must be active. cut: each is written before others read it."""
    out: dict[int, DataFrame] = {}
    kept = context.segments
    for i in order_of(_reach(known, ids)):
        if known[i].status != "active":
            raise SegmentError(f"segment {i}", "only active audiences are refreshed")
        context.segments = kept | out
        made = compile_segment(known[i].definition, context)
        out[i] = written(made, f"segment-{i}") if cut else made
    context.segments = kept
    return out


def stacked(members: dict[int, DataFrame], spark: SparkSession) -> DataFrame:
    """(segment_id, profile_id) of several audiences."""
    out = None
    for i, df in members.items():
        one = df.select(F.lit(i).cast("long").alias("segment_id"), F.col("profile_id").cast("long").alias("profile_id"))
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], MEMBERS) if out is None else out


def counted(before: DataFrame, now: DataFrame) -> DataFrame:
    """Members, added and removed by audience; one shuffle by audience and profile, then sums by audience that are taken before they are sent."""
    both = before.select("segment_id", "profile_id", F.lit(1).alias("was")).unionByName(now.select("segment_id", "profile_id", F.lit(2).alias("was")))
    one = both.groupBy("segment_id", "profile_id").agg(F.bit_or("was").alias("is"))
    return one.groupBy("segment_id").agg(F.count_if(F.col("is") >= 2).alias("members"), F.count_if(F.col("is") == 2).alias("added"), F.count_if(F.col("is") == 1).alias("removed"))


def refresh(spark: SparkSession, root: str, known: dict[int, Audience], ids: list[int], context: Context) -> Snapshot:
    """Makes the audiences and all that they read, and publishes members and history at once. Members of other audiences stay as they are; a refresh of the same root that ended meanwhile raises Conflict."""
    base = current(spark, root)
    places = dict(base.facts["members"]) if base else {}
    made = compiled(known, ids, context, cut=True)
    fresh = {}
    for i, df in made.items():
        fresh[str(i)] = f"members/{i}-{uuid.uuid4().hex}"
        df.write.parquet(f"{root.rstrip('/')}/{fresh[str(i)]}")
    now = {i: spark.read.parquet(f"{root.rstrip('/')}/{fresh[str(i)]}") for i in made}
    was = {i: spark.read.parquet(f"{root.rstrip('/')}/{places[str(i)]}") for i in made if str(i) in places}
    ran = spark.createDataFrame([(i,) for i in made], "segment_id long")  # an empty audience has its row too
    rows = ran.join(counted(stacked(was, spark), stacked(now, spark)), "segment_id", "left").select("segment_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("members", "added", "removed")], F.lit(context.as_of).alias("as_of"))
    history = base.table("history").unionByName(rows) if base else rows
    return publish(spark, root, {"history": history}, base, {"members": places | fresh})


def members(of: Snapshot, segment_id: int) -> DataFrame:
    """profile_id of an audience as of a refresh."""
    if str(segment_id) not in of.facts["members"]:
        raise SegmentError(f"segment {segment_id}", "it was never refreshed")
    return of.spark.read.parquet(f"{of.root}/{of.facts['members'][str(segment_id)]}")


def sweep(spark: SparkSession, root: str, keep: list[Snapshot], idle: float = 86400.0) -> list[str]:
    """Removes folders of members that none of the snapshots to keep names and that are older than idle seconds, which a writer may still be at."""
    files, gone = Files(spark, root), []
    named = {p for s in keep for p in s.facts["members"].values()}
    for name in files.names("members"):
        at = f"members/{name}"
        if at not in named and files.fs.getFileStatus(files.path(at)).getModificationTime() / 1000 <= time.time() - idle:
            files.drop(at)
            gone.append(at)
    return gone


def explained(definition: dict, context: Context) -> dict:
    """The physical plan as a tree of nodes, the optimiser's estimate of its bytes, and what decides its costs: shuffles, broadcasts and scans. No job runs."""
    run = compile_segment(definition, context)._jdf.queryExecution()
    plan = run.executedPlan()
    tree = _node(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan)
    flat: list[dict] = []
    todo = [tree]
    while todo:
        flat.append(todo.pop())
        todo += flat[-1]["plans"]
    count = lambda text: sum(text in n["node"] for n in flat)
    return {"plan": tree, "bytes": int(str(run.optimizedPlan().stats().sizeInBytes())), "shuffles": count("Exchange") - count("BroadcastExchange"), "broadcasts": count("BroadcastExchange"), "scans": [n["detail"] for n in flat if n["node"].startswith(("Scan", "FileScan"))]}


def _node(plan) -> dict:
    children = plan.children()
    return {"node": plan.nodeName(), "detail": plan.simpleString(100), "plans": [_node(children.apply(i)) for i in range(children.size())]}
