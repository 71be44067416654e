"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source gets a mean repetition rate = target share of the output / its rows. A uniform number from a
hash of (seed, doc_id) is put through the inverse Poisson distribution with that mean, the document is
exploded by the count, and the copies are dealt to partitions by a hash of (seed, doc_id, copy) and sorted by it
there: a global shuffle in one exchange, without the sampling pass of a total order, that any rerun with the same
partitions repeats. The inverse stops at mean + 12 standard deviations + 40, where the distribution is 1
beyond the 52 bits of the uniform number, so nothing is cut off.

Defined cases: null sources form one source; a null doc_id hashes as 'null'; rows that repeat a doc_id get
the same count; a count of 0 drops the document; an empty table stays empty; further columns pass through.
Columns named like the added ones (copy, n_copies, rate, shuffle_key) are replaced, any other name is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgework.llm.common import broadcast_if_small

ALPHA = 0.5
SEED = "mix-1"
ADDED = ("copy", "n_copies", "rate", "shuffle_key")


def hashed_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def uniform(key: Column) -> Column:
    """52 bits of an md5 in hex, as a number inside (0, 1)."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def poisson_steps(mean: Column) -> Column:
    """P(X <= k) for k from 0 to beyond the last value that a 52-bit uniform number can reach."""
    ln = F.ln(F.greatest(mean, F.lit(1e-300)))
    top = F.ceil(mean + F.lit(12.0) * F.sqrt(mean) + F.lit(40.0)).cast("int")
    start = F.struct((-mean).alias("p"), F.array(F.exp(-mean)).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] + ln - F.ln(k.cast("double"))
        return F.struct(p.alias("p"), F.concat(acc["steps"], F.array(F.element_at(acc["steps"], -1) + F.exp(p))).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["steps"])


def fresh(docs: DataFrame, name: str) -> str:
    """A name that no column has."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: float = 1.0) -> tuple[DataFrame, int]:
    """(source_key, rate) and the number of sources. weights: target shares by source, else rows ** alpha."""
    sizes = docs.groupBy(F.col("source").alias("source_key")).agg(F.count("*").alias("source_rows"))
    if weights is None:
        share = F.pow(F.col("source_rows").cast("double"), F.lit(alpha))
    else:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.coalesce("source_key", F.lit(""))), F.lit(0.0))
    sizes = sizes.withColumn("share", share)
    whole = sizes.agg(F.sum("share").alias("share"), F.sum("source_rows").alias("rows"), F.count("*").alias("n")).first()
    scale = total * (whole["rows"] or 0) / (whole["share"] or 1.0)
    return sizes.select("source_key", (F.lit(scale) * F.col("share") / F.col("source_rows")).alias("rate")), whole["n"]


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, total: float = 1.0, seed: str = SEED) -> DataFrame:
    """The documents' rows, each as often as its count says, globally shuffled; with the columns in ADDED."""
    docs = docs.drop(*ADDED)
    rates, n = source_rates(docs, weights, alpha, total)
    key, steps, u = (fresh(docs, x) for x in ("source_key", "steps", "u"))
    rates = rates.withColumn(steps, poisson_steps(F.col("rate"))).withColumnRenamed("source_key", key)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    at = docs.join(broadcast_if_small(rates, n), F.col("source").eqNullSafe(F.col(key)), "left").withColumn(u, uniform(hashed_key(F.lit(seed), name)))
    counted = at.withColumn("n_copies", F.when(F.col("rate") > 0, F.size(F.filter(steps, lambda c: c < F.col(u)))).otherwise(0).cast("long")).drop(steps, key, u)
    copies = counted.filter("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    return copies.withColumn("shuffle_key", hashed_key(F.lit(seed), name, F.col("copy").cast("string"))).repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id")


#: The same rows in DuckDB's SQL, for production parameters.
ORACLE_SQL = """
WITH sizes AS (SELECT source, count(*) AS n FROM {docs} GROUP BY source),
rates AS (SELECT source, (SELECT sum(n) FROM sizes) / (SELECT sum(pow(n, 0.5)) FROM sizes) * pow(n, 0.5) / n AS rate FROM sizes),
ks AS (SELECT source, rate, k FROM (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT))) AS k FROM rates)),
logs AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - sum(CASE WHEN k = 0 THEN 0 ELSE ln(greatest(k, 1)) END) OVER (PARTITION BY source ORDER BY k)) AS p FROM ks),
steps AS (SELECT source, rate, list(c ORDER BY k) AS cs FROM (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM logs) GROUP BY source, rate),
drawn AS (SELECT d.*, s.rate, s.cs, (CAST(CAST('0x' || substr(md5('mix-1:' || CAST(d.doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM {docs} d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source),
counted AS (SELECT * EXCLUDE (cs, u), len(list_filter(cs, lambda c: c < u)) AS n_copies FROM drawn)
SELECT {columns} FROM (SELECT *, unnest(generate_series(1, n_copies)) AS copy FROM counted)
"""
