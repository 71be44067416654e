"""People erased from every table at once.

The tables are stated as a graph: which columns name a profile, which name a row of another table, which hold JSON. A request's profiles are
first widened to all that merges tie to them. Then the graph is walked from the tables that name people to those that name their rows;
each table loses the rows that name something erased, columns that may stay empty are emptied, and references in JSON are cut out
wherever they are nested. Digests of what identified the people stay behind as suppressions, so that imports don't bring them back.
All tables are published as one generation: readers see everything from before or everything from after.

Every step is a join with the erased keys; nothing is gathered but counts, one a table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pledgework.operators.generations import Snapshot, publish
from pledgework.operators.identity import components
from pledgework.operators.scratch import written

#: Names under which JSON refers to profiles.
PROFILE_KEYS = ("profile_id", "profile_ids", "winner_id", "loser_id", "left_id", "right_id", "merged_into_id", "new_profile_id")


@dataclass(frozen=True)
class Refers:
    """How a table refers to others. key: its own key, where others name it. people: columns that name a profile, rows with an erased one go. emptied: the same, but
    the column is set to null and the row stays. rows: column -> (table, key) whose erased rows take this one along. documents: columns of JSON. identifiers: column -> kind of suppression."""

    key: str | None = None
    people: tuple[str, ...] = ()
    emptied: tuple[str, ...] = ()
    rows: dict[str, tuple[str, str]] = field(default_factory=dict)
    documents: tuple[str, ...] = ()
    identifiers: dict[str, str] = field(default_factory=dict)


def in_order(graph: dict[str, Refers]) -> list[str]:
    """Tables after those whose rows they name; a circle raises."""
    left, out = {n: {t for t, _ in r.rows.values()} - {n} for n, r in graph.items()}, []
    while left:
        ready = sorted(n for n, needs in left.items() if needs <= set(out))
        if not ready:
            raise ValueError(f"these tables name each other in a circle: {sorted(left)}")
        out += ready
        left = {n: needs for n, needs in left.items() if n not in ready}
    return out


def widened(asked: DataFrame, merges: DataFrame) -> DataFrame:
    """(profile_id): the profiles asked for and all that merges (loser_id, winner_id) tie to them, over any number of steps and either way."""
    pairs = merges.select(F.xxhash64("loser_id", "winner_id").cast("string").alias("value"), F.explode(F.array("loser_id", "winner_id")).alias("id"))
    tied = components(pairs.select("id", F.lit(0).alias("source_id"), F.lit("merge").alias("kind"), "value"))
    groups = tied.join(asked.select(F.col("profile_id").alias("id")), "id", "left_semi").select("label").distinct()
    return written(asked.select("profile_id").unionByName(tied.join(groups, "label", "left_semi").select(F.col("id").alias("profile_id"))).distinct(), "erased")


def scrubbed(value, gone: set[str]):
    """JSON without references to what is gone: fields of PROFILE_KEYS are left out, their lists lose the ids; other numbers stay."""
    if isinstance(value, dict):
        out = {}
        for k, v in value.items():
            if k in PROFILE_KEYS:
                if isinstance(v, list):
                    v = [x for x in v if str(x) not in gone]
                elif str(v) in gone:
                    continue
            out[k] = scrubbed(v, gone)
        return out
    return [scrubbed(v, gone) for v in value] if isinstance(value, list) else value


def scrub_column(df: DataFrame, column: str, erased: DataFrame) -> tuple[DataFrame, int]:
    """The table with references cut out of a column of JSON, and the number of rows changed. Only rows that name an erased profile under one of the keys are parsed."""
    keys = "|".join(PROFILE_KEYS)
    named = F.flatten(F.transform(F.expr(rf"regexp_extract_all({column}, '\"({keys})\"\\s*:\\s*(\\[[^\\]]*\\]|\"?[0-9]+\"?)', 2)"), lambda t: F.regexp_extract_all(t, F.lit(r"([0-9]+)"), F.lit(1))))
    marked = written(df.withColumn("_row", F.monotonically_increasing_id()), "documents")
    hits = marked.select("_row", F.explode(F.array_distinct(named)).alias("id")).join(erased.select(F.col("profile_id").cast("string").alias("id")), "id", "left_semi")
    gone = written(hits.groupBy("_row").agg(F.collect_list("id").alias("_gone")), "references")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [json.dumps(scrubbed(json.loads(t), set(g)), separators=(",", ":"), ensure_ascii=False) if g is not None and _is_json(t) else t for t, g in zip(b["text"].to_pylist(), b["gone"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["_row"], pa.array(texts, pa.string())], names=["_row", "_text"])

    changed = marked.join(gone, "_row").select("_row", F.col(column).alias("text"), F.col("_gone").alias("gone")).mapInArrow(cut, "_row long, _text string")
    out = marked.join(changed, "_row", "left").withColumn(column, F.coalesce("_text", column)).select(*df.columns)
    return out, gone.count()


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def erased_from(tables: dict[str, DataFrame], graph: dict[str, Refers], profiles: DataFrame) -> tuple[dict[str, DataFrame], DataFrame, dict[str, int]]:
    """(tables after the erasure, suppressions (type, value_hash, reason) of what was erased, rows removed or changed by table). profiles: (profile_id), as widened() gives it."""
    after, counts, lost, stones = {}, {}, {}, None
    for name in in_order(graph):
        df, refers = tables[name], graph[name]
        mark = F.lit(False)
        wide = df
        for k, (column, keys, key) in enumerate([(c, profiles, "profile_id") for c in refers.people] + [(c, lost[t], key) for c, (t, key) in refers.rows.items() if t in lost]):
            wide = wide.join(keys.select(F.col(key).alias(f"_k{k}")).distinct().withColumn(f"_h{k}", F.lit(True)), F.col(column) == F.col(f"_k{k}"), "left")
            mark = mark | F.coalesce(F.col(f"_h{k}"), F.lit(False))
        wide = written(wide.withColumn("_gone", mark).select(*df.columns, "_gone"), "marked")
        gone = wide.filter("_gone").drop("_gone")
        counts[name] = gone.count()
        if refers.key:
            lost[name] = gone.select(refers.key)
        for column, kind in refers.identifiers.items():
            made = gone.filter(F.trim(F.col(column).cast("string")) != "").select(F.lit(kind).alias("type"), F.sha2(F.col(column).cast("string"), 256).alias("value_hash"))
            stones = made if stones is None else stones.unionByName(made)
        rest = wide.filter("NOT _gone").drop("_gone")
        for column in refers.emptied:
            own = profiles.select(F.col("profile_id").alias("_p"), F.lit(True).alias("_h"))
            rest = written(rest.join(own, F.col(column) == F.col("_p"), "left"), "emptied")
            counts[name] += rest.filter("_h").count()
            rest = rest.withColumn(column, F.when(F.col("_h").isNull(), F.col(column))).select(*df.columns)
        for column in refers.documents:
            rest, n = scrub_column(rest, column, profiles)
            counts[name] += n
        after[name] = rest
    none = profiles.sparkSession.createDataFrame([], "type string, value_hash string")
    return after, (none if stones is None else stones.distinct()).withColumn("reason", F.lit("deletion_request")), counts


def erase(spark: SparkSession, root: str, graph: dict[str, Refers], asked: DataFrame, merges: str = "merges", suppressions: str = "suppressions") -> tuple[Snapshot, dict[str, int]]:
    """Erases the profiles asked for from the tables that are published in root, and publishes all of them anew. A second call with the same profiles removes nothing. If another writer has published meanwhile, Conflict is raised and nothing is changed."""
    from pledgework.operators.generations import current

    base = current(spark, root)
    tables = {n: base.table(n) for n in base.tables}
    if missing := [c for n, r in graph.items() for c in (*r.people, *r.emptied, *r.rows, *r.documents, *r.identifiers) if n not in tables or c not in tables[n].columns]:
        raise ValueError(f"the graph names columns that aren't there: {missing}")
    if unknown := [n for n in tables if n not in graph and n != suppressions and re.search("profile_id", " ".join(tables[n].columns))]:
        raise ValueError(f"tables with profiles that the graph doesn't know: {unknown}")
    after, stones, counts = erased_from(tables, graph, widened(asked, tables[merges]))
    if suppressions in tables:
        old = tables[suppressions]
        after[suppressions] = old.unionByName(stones.join(old, ["type", "value_hash"], "left_anti"), allowMissingColumns=True)
    else:
        after[suppressions] = stones
    return publish(spark, root, {**tables, **after}, base), counts
