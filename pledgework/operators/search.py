"""trigram search over an inverted index instead of a scan.

The index keeps for each trigram the keys of the texts that have it, with the number of their trigrams. Two texts with a and b trigrams
whose similarity is at least t share at least t * (a + b) / (1 + t) of them, b is between t * a and a / t, and of any
a - ceil(t * a) + 1 trigrams of the first the second has one. So a search reads the postings of its rarest trigrams only, drops keys of
another length, and compares the few that are left. Nothing that is similar enough is missed; the result is the scan's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgework.functions.normalize import trigrams
from pledgework.operators.scratch import written


@dataclass(frozen=True)
class Index:
    """texts: (key, grams, n); postings: (gram, key, n), sorted by gram in their files, so that a search for few grams skips most of them; counts: (gram, texts)."""

    texts: DataFrame
    postings: DataFrame
    counts: DataFrame


def build(rows: DataFrame, key: str, column: str) -> Index:
    """The index of a column; rows without any word are in none."""
    texts = written(rows.select(F.col(key).alias("key"), trigrams(F.col(column)).alias("grams")).withColumn("n", F.size("grams")).filter("n > 0"), "texts")
    postings = texts.select(F.explode("grams").alias("gram"), "key", "n").repartition("gram").sortWithinPartitions("gram", "n")
    postings = written(postings, "postings")
    return Index(texts, postings, written(postings.groupBy("gram").agg(F.count("*").alias("texts")), "gram-counts"))


def candidates(index: Index, asked: DataFrame, least: float) -> DataFrame:
    """(q, key, grams of the question): pairs that may be similar enough. asked: (q, text)."""
    if not 0 < least <= 1:
        raise ValueError("a similarity is above 0 and at most 1")
    ours = asked.select("q", trigrams(F.col("text")).alias("own")).withColumn("a", F.size("own")).filter("a > 0")
    # a threshold of 0.3 must not ask for more than 0.3: bounds are loosened by what doubles lose
    needed = F.ceil(F.col("a") * F.lit(least) - 1e-9)
    rare = ours.select("q", "a", F.explode("own").alias("gram")).join(index.counts, "gram", "left")
    rare = rare.groupBy("q", "a").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram"))).alias("g"))
    probes = rare.select("q", "a", F.explode(F.slice("g", F.lit(1), F.col("a") - needed + 1)).alias("p")).select("q", "a", "p.gram")
    met = index.postings.join(probes, "gram").filter((F.col("n") >= F.col("a") * least - 1e-9) & (F.col("n") * least <= F.col("a") + 1e-9))
    return met.select("q", "key").distinct().join(ours.select("q", "own"), "q")


def search(index: Index, asked: DataFrame, least: float = 0.3) -> DataFrame:
    """(q, key, similarity) of all texts whose trigram similarity to the question is at least `least`; keys that repeat come as often as their texts."""
    both = candidates(index, asked, least).join(index.texts.select("key", "grams").distinct(), "key")
    share = F.size(F.array_intersect("own", "grams")) / F.size(F.array_union("own", "grams"))
    return both.withColumn("share", share).filter(F.col("share") >= least).select("q", "key", F.round("share", 6).alias("similarity"))
