"""What the near-duplicate join leaves on disk, and how it knows common shingles."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from pledgework.llm import jaccard
from pledgework.llm.common import materialize, scratch_dir


def shuffle_blocks(spark) -> int:
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return sum(blocks.apply(i).isShuffle() for i in range(blocks.size()))


def documents(spark, n: int = 400):
    rows = [(i, f"w{i} x{i} y{i} z{i} a{i} " + ("one passage that many of the documents share" if i % 2 else "")) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_blocks(spark)
    materialize(spark.range(5000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "counts")
    ends = time.time() + 20
    while shuffle_blocks(spark) > before and time.time() < ends:
        time.sleep(0.2)
    assert shuffle_blocks(spark) <= before


def test_the_join_drops_signatures_and_classes(spark):
    where = scratch_dir(spark).removeprefix("file:")
    held = lambda: {x for x in os.listdir(where) if x.startswith(("signed-", "classes-", "anchored-"))} if os.path.isdir(where) else set()
    before = held()
    assert jaccard.join(documents(spark)).count() == 400
    assert held() == before


def test_common_shingles_are_bits_of_a_fixed_number(spark):
    docs = documents(spark)
    bits = jaccard.common_shingles(docs)
    assert len(bits) == 1 << (jaccard.PLACES - 6)
    assert jaccard.is_in(jaccard.shingles("one passage that many of the documents share"), bits).all()
    alone = np.concatenate([jaccard.shingles(f"w{i} x{i} y{i} z{i} a{i}") for i in range(400)])
    assert jaccard.is_in(alone, bits).sum() <= 1
