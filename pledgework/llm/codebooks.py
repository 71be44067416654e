"""Vector code compression: product codes whose codebooks come from Lloyd rounds that are kept up by differences.

A vector's components become integers, its parts are each coded by the nearest entry of the part's codebook. Each round writes every
vector's new codes beside its former ones. Only parts whose code changed are then added to the sums of the new entry and
taken from those of the old one; what is shuffled is these differences, summed within each task. The running sums are whole
numbers of any size, so codebooks are exact and don't depend on the order of tasks. Codebooks and sums have PARTS * ENTRIES rows,
whatever the number of vectors; nothing else reaches the driver.

Defined cases: vectors that are null or hold a null, a NaN, an infinity or a number beyond the range of floats are dropped, as are
those of another length than the first kept one by id; a length that PARTS doesn't divide is filled up with zeros; fewer than
ENTRIES vectors give fewer entries; ids that are null come last, equal ids are ordered by their vectors, and rows that repeat stay;
an error or a label's sum that passes 64 bits is null; no vectors give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgework.llm.common import Columns, broadcast_if_small, map_slices, materialize, release

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: The largest finite number of 32 bits.
LARGEST = 3.4028234663852886e38
#: Beyond this product of sizes, 64-bit floats may not hold a squared distance exactly, and Python's integers are used.
EXACT = 1 << 51
LIMB = 62


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """Rows vec_id, label, x (array of doubles) of the vectors that are whole and finite."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return rows.where(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) <= LARGEST)))


def parts_of(x: pa.Array, width: int) -> np.ndarray:
    """Integers of shape (rows, PARTS, width): of 64 bits where their squares can't overflow, else of any size."""
    flat = x.flatten().to_numpy(zero_copy_only=False)
    rows = np.floor(flat * SCALE).reshape(len(x), -1)
    rows = np.pad(rows, ((0, 0), (0, PARTS * width - rows.shape[1]))).reshape(len(x), PARTS, width)
    if rows.size and np.abs(rows).max() ** 2 * 4 * width >= EXACT:
        return np.array([int(v) for v in rows.ravel()], object).reshape(rows.shape)
    return rows.astype(np.int64)


def small(a: np.ndarray) -> bool:
    return a.dtype != object and (not a.size or int(np.abs(a).max()) ** 2 * 4 * a.shape[-1] < EXACT)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and part the index of the nearest entry (the lower of equals) and the squared distance."""
    n = len(parts)
    codes, errors = np.zeros((n, PARTS), np.uint8), np.zeros((n, PARTS), np.int64 if small(parts) and small(entries) else object)
    for p in range(PARTS):
        if errors.dtype == object:
            for i in range(n):
                far = [sum((int(a) - int(b)) ** 2 for a, b in zip(parts[i, p], e)) for e in entries[p]]
                errors[i, p] = min(far)
                codes[i, p] = far.index(errors[i, p])
        else:
            a, e = parts[:, p].astype(np.float64), entries[p].astype(np.float64)
            far = (a * a).sum(1)[:, None] - 2 * (a @ e.T) + (e * e).sum(1)[None]
            codes[:, p] = far.argmin(1)
            errors[:, p] = far[np.arange(n), codes[:, p]]
    return codes, errors


def assigned(rows: DataFrame, entries: np.ndarray, last: bool = False) -> DataFrame:
    """Each vector with its codes and former codes (null at first); the last time with its error in place of the vector."""
    width = entries.shape[2]

    def make():
        def assign(batch: pa.RecordBatch):
            codes, errors = nearest(parts_of(batch["x"], width), entries)
            out = Columns(vec_id=batch["vec_id"], label=batch["label"], codes=pa.array([c.tobytes() for c in codes], pa.binary()))
            if last:
                sums = [int(e) for e in errors.sum(1)]
                return Columns(out, error=pa.array([e if e < 1 << 63 else None for e in sums], pa.int64()))
            return Columns(out, x=batch["x"], was=batch["codes"])

        return assign

    label = rows.schema["label"].dataType.simpleString()
    vec_id = rows.schema["vec_id"].dataType.simpleString()
    more = "error long" if last else "x array<double>, was binary"
    columns = ["vec_id", "label", "x", "codes"]
    return map_slices(rows.select(*columns), make, f"vec_id {vec_id}, label {label}, codes binary, {more}", 1024)


def differences(rows: DataFrame, width: int) -> DataFrame:
    """Sums of what changed parts add to their new entries and take from their old ones: part, entry, place, high, low, n."""
    schema = "part int, entry int, place int, high decimal(38,0), low decimal(38,0), n long"

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((PARTS, 256, width), np.int64), np.zeros((PARTS, 256), np.int64)  # a task has fewer than 2 ** 38 rows
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                parts = parts_of(batch["x"], width)
                new = np.frombuffer(b"".join(batch["codes"].to_pylist()), np.uint8).reshape(-1, PARTS)
                old = [w or b"" for w in batch["was"].to_pylist()]
                had = np.array([len(w) > 0 for w in old], bool)
                old = np.frombuffer(b"".join(w or bytes(PARTS) for w in old), np.uint8).reshape(-1, PARTS)
                for p in range(PARTS):
                    changed = ~had | (new[:, p] != old[:, p])
                    for rows_, to, sign in ((changed, new, 1), (changed & had, old, -1)):
                        if parts.dtype == object and sums.dtype != object:
                            sums = sums.astype(object)
                        np.add.at(sums[p], to[rows_, p], sign * parts[rows_, p])
                        counts[p] += sign * np.bincount(to[rows_, p], minlength=256)
        touched = [(p, e) for p in range(PARTS) for e in range(256) if counts[p, e] or (sums[p, e] != 0).any()]
        out = [(p, e, k, *divmod(int(sums[p, e, k]), 1 << LIMB), int(counts[p, e])) for p, e in touched for k in range(width)]
        if out:
            part, entry, place, high, low, n = zip(*out)
            exact = [pa.array([Decimal(v) for v in c], pa.decimal128(38, 0)) for c in (high, low)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(place, pa.int32()), *exact, pa.array(n, pa.int64())], names=["part", "entry", "place", "high", "low", "n"])

    changed = rows.where(F.col("was").isNull() | (F.col("was") != F.col("codes")))
    parts = changed.select("x", "codes", "was").mapInArrow(summed, schema)
    return parts.groupBy("part", "entry", "place").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n"))


def first_entries(rows: DataFrame, entries: int) -> np.ndarray | None:
    """The codebooks at the start: the parts of the kept vectors of least id; bounded by their number."""
    found = rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()
    if not found:
        return None
    length = len(found[0]["x"])
    width = -(-length // PARTS)
    found = [r["x"] for r in rows.where(F.size("x") == length).orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(entries).collect()]
    parts = parts_of(pa.array(found, pa.list_(pa.float64())), width)
    return np.ascontiguousarray(parts.transpose(1, 0, 2)), length


def codebooks(rows: DataFrame, entries: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """The codebooks after the rounds and the written vectors with the codes of the last one; entries: (PARTS, number, width)."""
    width = entries.shape[2]
    entries, sums, counts = entries.astype(object), np.zeros(entries.shape, object), np.zeros(entries.shape[:2], object)
    for k in range(rounds):
        before = rows
        rows = materialize(assigned(before, _compact(entries)), f"codes-{k}")
        release(before)
        for r in differences(rows, width).collect():  # at most one row an entry's component
            sums[r["part"], r["entry"], r["place"]] += (int(r["high"]) << LIMB) + int(r["low"])
            if r["place"] == 0:
                counts[r["part"], r["entry"]] += r["n"]
        for p, e in zip(*np.nonzero(counts)):
            entries[p, e] = [s // counts[p, e] for s in sums[p, e]]
    return _compact(entries), rows


def _compact(entries: np.ndarray) -> np.ndarray:
    big = any(abs(v) >= 1 << 62 for v in entries.ravel())
    return entries if big else entries.astype(np.int64)


def compress(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept vector; see the module's text."""
    rows = kept_vectors(vectors)
    started = first_entries(rows, entries)
    if started is None:
        return rows.select("vec_id", *(F.lit(None).cast(t).alias(n) for n, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
    first, length = started
    final, rows = codebooks(rows.where(F.size("x") == length).withColumn("codes", F.lit(None).cast("binary")), first, rounds)
    coded = materialize(assigned(rows, final, last=True), "coded")
    release(rows)
    digest = hashlib.sha256(",".join(str(int(v)) for v in final.ravel()).encode()).hexdigest()
    by_label = materialize(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "label-errors")
    sums = broadcast_if_small(by_label.withColumnRenamed("label", "its_label"), by_label.count())
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("its_label")))
    return joined.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """The same in DuckDB's SQL, for vectors of one length that PARTS divides: one assignment and one mean a round."""
    assign = "a{k} AS MATERIALIZED (SELECT rid, p, e, d FROM (SELECT v.rid, v.p, c.e, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT AS d FROM v JOIN c{k} c ON v.p = c.p) QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, e) = 1)"
    mean = "c{n} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (SELECT p, e, list(q ORDER BY i) AS x FROM (SELECT a.p, a.e, i, (sum(v.x[i]) - ((sum(v.x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS q FROM a{k} a JOIN v ON v.rid = a.rid AND v.p = a.p, (SELECT unnest(range(1, (SELECT max(len(x)) FROM v) + 1)) AS i) GROUP BY ALL) GROUP BY p, e) m ON m.p = c.p AND m.e = c.e)"
    steps = [x.format(k=k, n=k + 1) for k in range(ROUNDS) for x in (assign, mean)] + [assign.format(k=ROUNDS)]
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda y: floor({SCALE} * y::DOUBLE)::HUGEINT) AS x FROM {{vectors}}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), v AS MATERIALIZED (
  SELECT rid, vec_id, label, p, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] AS x FROM kept, (SELECT unnest(range({PARTS})) AS p)
), c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x FROM v WHERE rid <= {ENTRIES}),
{(", ").join(steps)},
coded AS (
  SELECT a.rid, string_agg(printf('%02x', e::INT), '' ORDER BY a.p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} a GROUP BY a.rid
), digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT k.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN kept k USING (rid), digest
"""


ORACLE_SQL = _sql()
