"""Chat formatting by minimum-cost role repair.

A legal conversation is: an optional system turn, then user and assistant turns in alternation, user first.
Each turn of the input is kept, relabelled or merged into the turn before, and empty turns may be inserted
before it; each has a cost, and the cheapest way is found by dynamic programming over the automaton's states
(start, system, user, assistant: the last turn written). Within a block, ties go to the first action in
order keep, merge, relabel, insert; which of several ways of equal cost is taken may differ with the block size.

One turn is a min-plus matrix over the states, so a run of turns is a product of matrices: long
conversations are cut into blocks, each block gives its matrix, a pass over the matrices finds the state at
each block's start, and the blocks are then traced back independently. No conversation is ever held whole.
The result has one row per turn with the text it renders; in order of `place` these join to the transcript.

Defined cases: null texts are empty; in a text, "<|im_" becomes "<\\|im_", so that no text opens or closes a turn; null or unknown roles have no label of their own, any relabelling costs the
same; a null turn comes first; ties of turn are ordered by role and text; rows that repeat are turns of their
own; a null conv_id is one conversation; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pledgework.llm.common import Columns, map_slices, materialize

STATES = ("start", "system", "user", "assistant")
ROLES = STATES[1:]
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}  # states that may follow
COSTS = {"keep": 0.0, "merge": 1.0, "relabel": 1.5, "insert": 2.0, "unknown": 0.5}
BLOCK = 512
ROW = "<|im_start|>{role}\n"
CLOSE = "<|im_end|>\n"


def _steps() -> dict[str, list]:
    """By role of a turn: [(cost, order, from, to, action, inserted roles, role written)]."""
    found = {}
    for label in (*ROLES, ""):
        options = []
        for s in range(4):
            if s and (label == ROLES[s - 1] or not label):
                options.append((COSTS["merge"] if label else COSTS["merge"] + COSTS["unknown"], 1, s, s, "merge", (), ROLES[s - 1]))
            elif s:
                options.append((COSTS["merge"] + COSTS["relabel"], 1, s, s, "merge", (), ROLES[s - 1]))
            todo = [((), s)]
            for _ in range(3):  # inserting more never helps
                longer = []
                for inserted, at in todo:
                    for to in NEXT[at]:
                        role = ROLES[to - 1]
                        own = COSTS["keep"] if role == label else COSTS["unknown"] if not label else COSTS["relabel"]
                        action = "keep" if role == label else "relabel"
                        options.append((own + COSTS["insert"] * len(inserted), 0 if action == "keep" and not inserted else 2 + len(inserted), s, to, action, inserted, role))
                        longer.append(((*inserted, role), to))
                todo = longer
        best: dict = {}
        for o in sorted(options, key=lambda o: (o[0], o[1])):
            best.setdefault((o[2], o[3]), o)
        found[label] = list(best.values())
    return found


STEPS = _steps()
MATRICES = {}
for _label, _options in STEPS.items():
    MATRICES[_label] = np.full((4, 4), np.inf)
    for _o in _options:
        MATRICES[_label][_o[2], _o[3]] = _o[0]


def label_of(role: str | None) -> str:
    low = (role or "").strip().lower()
    return low if low in ROLES else ""


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product."""
    return (a[:, :, None] + b[None, :, :]).min(axis=1)


def forward(cost: np.ndarray, labels: list[str]) -> list[np.ndarray]:
    """Least costs of each state before the first turn and after every turn."""
    out = [cost]
    for label in labels:
        out.append((out[-1][:, None] + MATRICES[label]).min(axis=0))
    return out


def trace(labels: list[str], start: int, end: int) -> list[tuple]:
    """The cheapest steps from one state to another."""
    cost = np.full(4, np.inf)
    cost[start] = 0.0
    costs, at, steps = forward(cost, labels), end, []
    for k in range(len(labels) - 1, -1, -1):
        ways = [(costs[k][o[2]] + o[0], o[1], o) for o in STEPS[labels[k]] if o[3] == at]
        step = min(ways, key=lambda w: (w[0], w[1], w[2][2]))[2]
        steps.append(step)
        at = step[2]
    return steps[::-1]


def repair(roles: list[str | None]) -> tuple[float, list[tuple]]:
    """Cost and steps for one conversation held in memory."""
    labels = [label_of(r) for r in roles]
    last = forward(np.array([0.0, np.inf, np.inf, np.inf]), labels)[-1]
    end = int(np.argmin(last))
    return float(last[end]), trace(labels, 0, end) if labels else []


def numbered(turns: DataFrame, per_part: int = 20_000) -> DataFrame:
    """place: the turn's position in its conversation from 0. A large conversation is dealt over ranges of its turns."""
    keyed = turns.select("conv_id", "turn", "role", "text").withColumn("tie", F.monotonically_increasing_id())
    parts = max(1, -(-keyed.count() // per_part))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text", "tie")]
    dealt = keyed.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt, "turns")
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), ahead.alias("ahead"))
    own = F.row_number().over(W.partitionBy("part", "conv_id").orderBy(*order[1:])) - 1
    return dealt.withColumn("own", own).join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select("conv_id", "turn", "role", "text", (F.col("ahead") + F.col("own")).cast("long").alias("place"))


def _by_block(rows: DataFrame, of_block, schema: str) -> DataFrame:
    """of_block(list of rows as dicts) -> Columns, for the sorted rows of each (conv_id, block)."""
    names = rows.columns

    def make():
        held: list = []

        def gather(batch: pa.RecordBatch):
            done: list = []
            for row in zip(*(batch[n].to_pylist() for n in names)):
                row = dict(zip(names, row))
                if held and (held[0]["conv_id"], held[0]["block"]) != (row["conv_id"], row["block"]):
                    done += of_block(held)
                    held.clear()
                held.append(row)
            return _columns(done) if done else None

        gather.flush = lambda: [_columns(of_block(held))] if held else []
        return gather

    return map_slices(rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place"), make, schema, 1024)


def _columns(rows: list[dict]) -> Columns:
    return Columns({n: [r[n] for r in rows] for n in rows[0]}) if rows else Columns()


def chain(group: list[dict]) -> list[dict]:
    """States at the start and end of each matrix of a run; from the start state to the cheapest, or as given."""
    first, last = group[0].get("first") or 0, group[0].get("last")
    cost = np.full(4, np.inf)
    cost[first] = 0.0
    costs, mats = [cost], [np.array(r["cells"]).reshape(4, 4) for r in group]
    for m in mats:
        costs.append((costs[-1][:, None] + m).min(axis=0))
    at, out = int(np.argmin(costs[-1])) if last is None else last, []
    for k in range(len(mats) - 1, -1, -1):
        before = int(np.argmin(costs[k] + mats[k][:, at]))
        out.append({"conv_id": group[k]["conv_id"], "place": group[k]["place"], "first": before, "last": at})
        at = before
    return out


def block_ends(matrices: DataFrame, fan: int = BLOCK) -> DataFrame:
    """(conv_id, place, first, last) of each matrix (conv_id, place, cells).

    Runs of fan matrices are multiplied, level by level, until a conversation has fan of them at most; then
    the states go down the levels again, so that a task never holds more than fan matrices of a conversation.
    """
    kind = "conv_id long, place long, first int, last int"
    top = matrices.agg(F.max("place")).first()[0]
    if top is None or top < fan:
        return _by_block(matrices.select("conv_id", F.lit(0).alias("block"), "place", "cells"), chain, kind)

    def product(group: list[dict]) -> list[dict]:
        m = np.array(group[0]["cells"]).reshape(4, 4)
        for r in group[1:]:
            m = times(m, np.array(r["cells"]).reshape(4, 4))
        return [{"conv_id": group[0]["conv_id"], "place": group[0]["block"], "cells": m.ravel().tolist()}]

    run = matrices.withColumn("block", F.floor(F.col("place") / F.lit(fan)).cast("long")).select("conv_id", "block", "place", "cells")
    upper = materialize(_by_block(run, product, "conv_id long, place long, cells array<double>"), "upper")
    ends = block_ends(upper, fan).select(F.col("conv_id").alias("c"), F.col("place").alias("b"), "first", "last")
    within = run.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")
    return _by_block(within, chain, kind)


def escaped(text: str | None) -> str:
    """The text without control tokens."""
    return (text or "").replace("<|im_", "<\\|im_")


def format_chats(turns: DataFrame, block: int = BLOCK, fan: int = BLOCK) -> DataFrame:
    """conv_id, place, turn, role, new_role, action, inserted (roles of empty turns before it), rendered."""
    rows = materialize(numbered(turns).withColumn("block", F.floor(F.col("place") / F.lit(block)).cast("long")), "placed")

    def matrix(group: list[dict]) -> list[dict]:
        m = MATRICES[label_of(group[0]["role"])]
        for r in group[1:]:
            m = times(m, MATRICES[label_of(r["role"])])
        return [{"conv_id": group[0]["conv_id"], "block": group[0]["block"], "cells": m.ravel().tolist()}]

    blocks = materialize(_by_block(rows.select("conv_id", "block", "place", "role"), matrix, "conv_id long, block long, cells array<double>"), "matrices")
    ends = block_ends(blocks.withColumnRenamed("block", "place"), fan).select(F.col("conv_id").alias("c"), F.col("place").alias("b"), "first", "last")
    joined = rows.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).drop("c", "b")

    def render(group: list[dict]) -> list[dict]:
        out = []
        for r, step in zip(group, trace([label_of(r["role"]) for r in group], group[0]["first"], group[0]["last"])):
            _, _, came_from, _, action, inserted, role = step
            text = escaped(r["text"])
            if action == "merge":
                rendered = "\n" + text
            else:
                rendered = (CLOSE if came_from else "") + "".join(ROW.format(role=x) + CLOSE for x in inserted) + ROW.format(role=role) + text
            out.append({"conv_id": r["conv_id"], "place": r["place"], "turn": r["turn"], "role": r["role"], "new_role": role, "action": action, "inserted": list(inserted), "rendered": rendered})
        return out

    done = _by_block(joined.select("conv_id", "block", "place", "turn", "role", "text", "first", "last"), render, "conv_id long, place long, turn long, role string, new_role string, action string, inserted array<string>, rendered string")
    last = rows.groupBy("conv_id").agg(F.max("place").alias("end")).select(F.col("conv_id").alias("c"), "end")
    closed = done.join(last, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("rendered", F.concat("rendered", F.when(F.col("place") == F.col("end"), F.lit(CLOSE)).otherwise("")))
    return closed.drop("c", "end")
