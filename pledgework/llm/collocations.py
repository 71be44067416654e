"""Phrase collocation mining by sorted suffixes (suffix-sigma).

Every word occurrence gives one suffix, cut after MAX_N words or at the end of its piece. Tasks count equal suffixes of a few
megabytes of text before they are shuffled by language and first word; the rows of a partition are sorted
in reverse order and one stack of open prefixes counts all of them, whatever their length, in one pass. A prefix leaves the stack
when the next suffix no longer starts with it, and goes on only if it occurs often enough.

A word that starts a large share of a sample's suffixes is dealt by its first two words, and a pair of words that does so by three:
then the shorter prefixes are counted in parts, which are summed afterwards (as the counts of whole languages always are). The
sample decides about costs only, never about results.

Defined cases: a null text is empty; a null language is "und"; repeated rows count as often as they occur; ids and other
columns are not read; no rows give no phrases; words may hold any character but the separators, control characters included.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pledgework.llm.common import Columns, materialize

#: What is lower-cased, what ends a piece, what parts words.
UPPER, PIECE_ENDS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\x0a\x0b\x0c\x0d"
MAX_N, LEAST, TOP, INSIDE = 3, 10, 2000, 50
#: Bytes of text whose suffixes are counted together before the shuffle, and documents of the sample that finds hot words.
CHUNK, SAMPLE_DOCS = 8 << 20, 2000
SEP, ESCAPE = "\x00", b"\x01"
FOLD = bytes.maketrans(UPPER + PIECE_ENDS + b"\t", UPPER.lower() + b"\n" * len(PIECE_ENDS) + b" ")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
TOPS = 64


def folded(text: str | None) -> bytes:
    """Lower-cased, with one byte for piece ends and one between words; the separator byte is written in two other bytes."""
    data = (text or "").encode().translate(FOLD)
    if ESCAPE in data or b"\x00" in data:
        data = data.replace(ESCAPE, ESCAPE + b"\x02").replace(b"\x00", ESCAPE + ESCAPE)
    return data


def chunks(data: bytes, most: int = CHUNK) -> Iterator[tuple[list[bytes], int]]:
    """Words and piece ends (as the separator byte), with the number that begins in the chunk; MAX_N - 1 further ones look ahead."""
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > most:
            end = max(data.rfind(b" ", at, at + most), data.rfind(b"\n", at, at + most))
            if end <= at:  # a word longer than the chunk
                end = min((x for x in (data.find(b" ", at + most), data.find(b"\n", at + most)) if x >= 0), default=len(data))
        own = data[at:end].replace(b"\n", b" \x00 ").split()
        ahead, look = [], end
        while len(ahead) < MAX_N - 1 and look < len(data):
            if data[look : look + 1] == b"\n":
                ahead.append(b"\x00")
                break
            stop = min((x for x in (data.find(b" ", look), data.find(b"\n", look)) if x >= 0), default=len(data))
            ahead += [data[look:stop]] if stop > look else []
            look = stop + (data[stop : stop + 1] == b" ")
        yield own + ahead, len(own)
        at = end


def mixed(h: np.ndarray, more: np.ndarray) -> np.ndarray:
    h = (h ^ more) * GOLDEN
    return (h ^ (h >> np.uint64(29))) * GOLDEN


def counted(tokens: list[bytes], own: int, lang: str, hot: dict[str, tuple[set, set]]) -> Columns:
    """The distinct suffixes of a chunk with their counts and the key that they are dealt by; its last two bits tell by how many words."""
    encoded = pa.array(tokens, pa.binary()).dictionary_encode()
    words, codes = encoded.dictionary, encoded.indices.to_numpy().astype(np.int64) + 1
    end = pc.index(words, pa.scalar(b"\x00", pa.binary())).as_py()
    if end >= 0:
        codes[codes == end + 1] = 0
    size = len(words) + 1
    c = [codes] + [np.append(codes[k:], np.zeros(min(k, len(codes)), np.int64)) for k in range(1, MAX_N)]
    for k in range(1, MAX_N):
        c[k] = np.where(c[k - 1] == 0, 0, c[k])
    starts = np.flatnonzero(codes[:own])
    key, columns = c[0][starts], [c[0][starts]]
    for k in range(1, MAX_N):
        nxt = c[k][starts]
        if int(key.max(initial=0)) >= (1 << 62) // size:  # numbers that would not fit are replaced by their ranks
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + nxt
        columns.append(nxt)
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    columns = [x[first] for x in columns]
    hot_words, hot_pairs = hot.get(lang, ((), ()))
    names = words.to_pylist()
    hashes = np.array([0, *map(zlib.crc32, names)], np.uint64)
    is_hot = np.array([False, *(w in hot_words for w in names)])
    at = {w: k + 1 for k, w in enumerate(names)} if hot_pairs else {}
    pairs = [at[a] * size + at[b] for a, b in hot_pairs if a in at and b in at]
    depth = 1 + is_hot[columns[0]]
    depth = depth + (is_hot[columns[0]] & np.isin(columns[0] * size + columns[1], pairs))
    h = mixed(np.full(len(first), zlib.crc32(lang.encode()), np.uint64), hashes[columns[0]])
    for k in range(1, MAX_N):
        h = np.where(depth > k, mixed(h, hashes[columns[k]]), h)
    lang_column = pa.array([lang], pa.string()).take(pa.array(np.zeros(len(first), np.int64)))
    shown = [words.take(pa.array(x - 1, mask=x == 0)).cast(pa.string()) for x in columns]
    return Columns(key=(h << np.uint64(2) | depth.astype(np.uint64)).view(np.int64), suffix=pc.binary_join_element_wise(lang_column, *shown, SEP, null_handling="skip"), n=counts)


def suffixes(docs: DataFrame, hot: dict[str, tuple[set, set]]) -> DataFrame:
    """Rows key, suffix (language and words, with separators), n."""

    def make():
        waiting: dict[str, list[bytes]] = {}
        held = [0]

        def out() -> Iterator[Columns]:
            for lang, texts in waiting.items():
                for tokens, own in chunks(b"\n".join(texts)):
                    if own:
                        rows = counted(tokens, own, lang, hot)
                        for at in range(0, len(rows), 1 << 16):
                            yield Columns({k: v[at : at + (1 << 16)] for k, v in rows.items()})
            waiting.clear()
            held[0] = 0

        def mapped(batches):
            for batch in batches:
                for lang, text in zip(batch["lang"], batch["text"]):
                    data = folded(text.as_py())
                    lang = folded_lang(lang.as_py())
                    waiting.setdefault(lang, []).append(data)
                    held[0] += len(data)
                    if held[0] >= CHUNK:
                        yield from out()
            yield from out()

        return mapped

    schema = pa.schema([("key", pa.int64()), ("suffix", pa.string()), ("n", pa.int64())])

    def run(batches):
        for rows in make()(batches):
            yield pa.RecordBatch.from_arrays([rows["key"] if isinstance(rows["key"], pa.Array) else pa.array(rows["key"]), rows["suffix"], pa.array(rows["n"], pa.int64())], schema=schema)

    return docs.select("lang", "text").mapInArrow(run, "key long, suffix string, n long")


def folded_lang(lang: str | None) -> str:
    return "und" if lang is None else lang.replace("\x01", "\x01\x02").replace("\x00", "\x01\x01")


def hot_prefixes(docs: DataFrame, sample: int = SAMPLE_DOCS) -> dict[str, tuple[set, set]]:
    """By language, the words and pairs that start so many of a sample's suffixes that one task's share would stand out. A share bounds their number."""
    spark = docs.sparkSession
    share = 1 / (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.count()
    if rows > sample:
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(sample / rows * (1 << 20))))
    words = F.split("suffix", SEP)
    starts = suffixes(docs, {}).select(words[0].alias("lang"), words[1].alias("a"), F.get(words, F.lit(2)).alias("b"), "n")
    pairs = materialize(starts.groupBy("lang", "a", "b").agg(F.sum("n").alias("n")), "sampled-pairs")
    both = pairs.unionByName(pairs.groupBy("lang", "a").agg(F.sum("n").alias("n")).withColumn("b", F.lit("\x01\x03")))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    found = both.crossJoin(F.broadcast(total)).where(F.col("n") >= F.col("total") * share).collect()  # total is a single row; the share bounds these rows
    hot: dict[str, tuple[set, set]] = {}
    for r in found:
        words_, pairs_ = hot.setdefault(r["lang"], (set(), set()))
        if r["b"] == "\x01\x03":
            words_.add(r["a"].encode())
        elif r["b"] is not None:
            pairs_.add((r["a"].encode(), r["b"].encode()))
    return hot


def stack_counts(batches: Iterator[pa.RecordBatch], least: int = LEAST) -> Iterator[pa.RecordBatch]:
    """Counts the prefixes of sorted suffixes. The stack holds the open prefix of each length; what a batch closes is summed in runs."""
    stack: list[tuple[str, int, bool] | None] = [None] * (MAX_N + 1)

    def closed(level: int, entry) -> Iterator[tuple[str, int, int]]:
        if entry and (entry[2] or entry[1] >= least):
            yield entry[0], level, entry[1]

    def cut(suffix: str, level: int) -> str:
        return SEP.join(suffix.split(SEP, level + 1)[: level + 1])

    def batch_of(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], names=["prefix", "level", "f"])

    for batch in batches:
        if not batch.num_rows:
            continue
        suffix, n = batch["suffix"], batch["n"].to_numpy()
        dealt_by = batch["key"].to_numpy() & 3
        parts = pc.split_pattern(suffix, SEP)
        lens = pc.list_value_length(parts).to_numpy()
        rows = np.repeat(np.arange(len(lens)), lens)
        levels = np.arange(len(rows)) - np.repeat(np.cumsum(lens) - lens, lens)
        word = np.full((len(lens), MAX_N + 1), -1, np.int32)
        word[rows, levels] = parts.flatten().dictionary_encode().indices.to_numpy()
        changed = np.logical_or.accumulate(word[1:] != word[:-1], axis=1)
        out = []
        for level in range(MAX_N + 1):
            starts = np.flatnonzero(np.append(True, changed[:, level]))
            sums = np.add.reduceat(n, starts)
            there = word[starts, level] >= 0
            partial = level < dealt_by[starts]
            if there[0] and stack[level] and stack[level][0] == cut(suffix[0].as_py(), level):
                sums[0] += stack[level][1]
            else:
                out += closed(level, stack[level])
            stack[level] = None
            if there[-1]:  # the last one stays open
                stack[level] = (cut(suffix[int(starts[-1])].as_py(), level), int(sums[-1]), bool(partial[-1]))
                there[-1] = False
            for k in np.flatnonzero(there & (partial | (sums >= least))):
                out.append((cut(suffix[int(starts[k])].as_py(), level), level, int(sums[k])))
        if out:
            yield batch_of(out)
    out = [x for level, entry in enumerate(stack) for x in closed(level, entry)]
    if out:
        yield batch_of(out)


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Rows lang, words (array, empty for the language itself), f: all phrases of up to MAX_N words with f >= least, and each language's words."""
    dealt = suffixes(docs, hot_prefixes(docs)).repartition("key").sortWithinPartitions(F.col("suffix").desc())
    parts = dealt.mapInArrow(lambda batches: stack_counts(batches, least), "prefix string, level int, f long")
    whole = parts.groupBy("prefix", "level").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("level") == 0))
    words = F.split("prefix", SEP)
    return materialize(whole.select(words[0].alias("lang"), F.slice(words, 2, MAX_N).alias("words"), "f"), "phrases")


def plain(c):
    """Undoes the two-byte writing of control characters."""
    return F.replace(F.replace(c, F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score; see the module's text."""
    counts = phrase_counts(docs, least)
    phrases = counts.where(F.size("words") > 0)
    candidates = phrases.where(F.size("words") > 1).select("lang", "words", F.col("f").alias("a"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("slice(words, 1, k)"), "rest": F.expr("slice(words, k + 1, size(words) - k)")})
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(phrases.select("lang", F.col("words").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    squared = (wide["a"] * wide["a"]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    cuts = cuts.withColumns({"squared": squared, "product": wide["l"] * wide["r"]}).withColumn("score", F.expr("squared div product"))
    scored = cuts.groupBy("lang", "words").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("best")).select("lang", "words", "best.*")
    longer = candidates.where(F.size("words") > 2)
    inner = longer.select("lang", "a", F.explode(F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m))))")).alias("words"))
    inner = inner.groupBy("lang", "words").agg(F.max("a").alias("covering"))
    kept = scored.join(inner, ["lang", "words"], "left").where(F.coalesce(100 * F.col("covering") < INSIDE * F.col("a"), F.lit(True)))
    kept = kept.select(plain(F.col("lang")).alias("lang"), plain(F.array_join("words", " ")).alias("phrase"), "a", "l", "r", "score")
    best_first = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(TOPS)))  # the best of each part first, so that no task ranks a whole language
    kept = kept.withColumn("own", F.row_number().over(W.partitionBy("lang", "part").orderBy(*best_first))).where(F.col("own") <= top)
    kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best_first)).cast("long")).where(F.col("rank") <= top)
    n = counts.where(F.size("words") == 0).select(plain(F.col("lang")).alias("lang"), F.col("f").alias("n"))
    return kept.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same in DuckDB's SQL.
ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM {docs}
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), places AS (
  SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words)
), whole AS MATERIALIZED (
  SELECT lang, a, b, c, count(*) AS f FROM places GROUP BY ALL
), f AS MATERIALIZED (
  SELECT lang, a AS p, NULL AS b, NULL AS c, 1 AS m, sum(f)::BIGINT AS f FROM whole GROUP BY lang, a HAVING sum(f) >= 10
  UNION ALL SELECT lang, a, b, NULL, 2, sum(f)::BIGINT FROM whole WHERE b IS NOT NULL GROUP BY lang, a, b HAVING sum(f) >= 10
  UNION ALL SELECT lang, a, b, c, 3, f FROM whole WHERE c IS NOT NULL AND f >= 10
), g AS MATERIALIZED (
  SELECT lang, m, f, concat_ws(' ', p, b, c) AS p, p AS a, concat_ws(' ', p, b) AS ab, concat_ws(' ', b, c) AS bc, coalesce(c, b) AS z FROM f
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM whole GROUP BY lang),
halves AS (
  SELECT lang, p, m, f, 1 AS k, a AS head, bc AS tail FROM g WHERE m > 1 UNION ALL SELECT lang, p, m, f, 2, ab, z FROM g WHERE m = 3
), cuts AS (
  SELECT h.lang, h.p, k, h.f AS a, x.f AS l, y.f AS r, ((1000000::HUGEINT * h.f * h.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM halves h JOIN g x ON x.lang = h.lang AND x.p = h.head JOIN g y ON y.lang = h.lang AND y.p = h.tail
), scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, p, max(f) AS covering FROM (SELECT lang, ab AS p, f FROM g WHERE m = 3 UNION ALL SELECT lang, bc, f FROM g WHERE m = 3) GROUP BY ALL
), kept AS (
  SELECT s.lang, s.p AS phrase, a, l, r, score FROM scored s LEFT JOIN inner_ i ON i.lang = s.lang AND i.p = s.p WHERE covering IS NULL OR 100 * covering < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT k.*, n.n, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept k JOIN n ON n.lang = k.lang
) WHERE rank <= 2000
"""
