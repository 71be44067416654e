"""Exact Jaccard join of word-shingle sets, with R-trees over count vectors.

Shingles are hashed to 64 bits and dealt to groups; a document's point has the number of its shingles in
each group. The overlap of two sets is at most the sum of the coordinates' minima, so an R-tree over the
points prunes whole boxes whose summed minima with a query's point stay below the overlap that the
threshold needs; surviving pairs are verified on the sets themselves, in the task that holds the tree.

The corpus is dealt to R-trees so that no link is lost: two sets of similarity s share one of the
least-hashed (1 - s) parts of their shingles, so each such shingle is a bucket.
1. Documents with equal sets collapse into a class (a group-by on a 128-bit hash of the set).
   Shingles that a sample shows to be common come last in that order, which changes costs only.
2. A cheap first pass links most near copies: classes that share a min-hash (MINHASHES of them) are compared
   with the first class of their bucket. Groups of copies, however large, become one component here, and
   each comparison is a row of a join, not a pair of a group.
3. The exact pass looks at every prefix shingle's bucket that holds more than one component. Buckets with the
   same first class (their anchor) share one tree, so that a class meets an anchor's other classes once, however
   many shingles they have in common. Members of an anchor's largest component are in the tree only; all others
   are asked against it. Large groups are split into blocks of asked and of tree members; each pair of blocks is
   a task of bounded size. The trees are searched on points alone; only members of pairs within the bound bring
   their texts to a second search of the same tasks, which verifies on the sets, keeps which components it has
   joined, and gives out only the links that join two of them: fewer than its members, never all pairs.
Components are found by rounds of least-label propagation with pointer jumping on tables in the shared folder.

Defined cases: a null or empty text has no shingles and is linked with nothing; fewer words than the shingle
make one shingle; rows that repeat a doc_id come out as often as they came, and one id with several texts is one
document that has the links of each; a null doc_id is no member: such a row takes the component of an equal set
with an id, else null; an empty table gives no rows; further columns pass through `keep_one` and are ignored
elsewhere.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pledgework.llm.common import Columns, broadcast_if_small, map_slices, materialize, release

WORDS = 5
PERCENT = 80
#: (least size of a set, groups of its point); finer groups refine the coarser.
GROUPS = ((0, 64), (150, 256), (800, 1024))
MINHASHES = 4
#: Shingles that come in COMMON of the sampled documents, one in SAMPLE_SHARE whatever the size of the table, go to the end of the order in which prefixes are taken. Any order finds every link; this one keeps shared passages out of the prefixes.
SAMPLE_SHARE, COMMON = 8, 3
#: They are known by a bit each of 2 ** PLACES bits. Others that fall on the same bit go to the end too.
PLACES = 27
#: A group is cut into BLOCKS blocks, of at least and at most so many shingles.
BLOCKS, LEAST_BLOCK, MOST_BLOCK = 8, 256_000, 2_000_000
#: Lists of ids up to so many rows (16 bytes each) are broadcast, longer ones shuffled.
SMALL = 1_000_000
LEAF = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_SEEDS = [np.uint64(int.from_bytes(hashlib.sha256(b"minhash%d" % i).digest()[:8], "little") | 1) for i in range(64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words, A-Z in lower case."""
    tokens = (text or "").encode().lower().split()
    return np.array(list(map(xxhash.xxh3_64_intdigest, tokens)), np.uint64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the text's shingles of words."""
    ids = word_hashes(text)
    if not len(ids):
        return ids
    n = max(1, len(ids) - words + 1)
    found = np.full(n, np.uint64(min(len(ids), words)))
    for i in range(min(words, len(ids))):
        found = found * _ODD + ids[i : i + n]
    return np.unique(mix(found))


def needed(a: int | np.ndarray, b: int | np.ndarray, percent: int = PERCENT):
    """The least overlap with 100 * overlap >= percent * union."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Of the least hashes: a set of that similarity at least shares one of them."""
    return n - -(-percent * n // 100) + 1 if n else 0


def point(found: np.ndarray) -> np.ndarray:
    groups = max(g for least, g in GROUPS if len(found) >= least)
    return np.bincount((found >> np.uint64(20)).astype(np.int64) % groups, minlength=groups).astype(np.int32)


def together(points: list[np.ndarray]) -> np.ndarray:
    """Points as rows, with the groups of the coarsest."""
    least = min(map(len, points))
    return np.array([p if len(p) == least else p.reshape(-1, least).sum(axis=0) for p in points])


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    overlap = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * overlap >= percent * (len(a) + len(b) - overlap) and overlap > 0


class CountTree:
    """R-tree over count vectors, packed bottom up after sorting by size and the heaviest spread.

    query(p, n) gives positions of points whose summed minima with p reach the overlap that n and their own
    sizes need. A box bounds that sum by its upper corner, and the need by its least size.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int = PERCENT):
        self.points, self.sizes, self.percent = points, sizes, percent
        spread = points.std(axis=0) if len(points) else np.zeros(points.shape[1])
        axes = np.argsort(-spread)[:2]
        self.order = np.lexsort((points[:, axes[1]], points[:, axes[0]], sizes))
        self.levels = []
        tops, least, most = points[self.order], sizes[self.order], sizes[self.order]
        while len(tops) > LEAF:
            cuts = np.arange(0, len(tops), LEAF)
            tops, least, most = np.maximum.reduceat(tops, cuts), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
            self.levels.append((tops, least, most))

    def query(self, p: np.ndarray, n: int) -> np.ndarray:
        nodes = np.arange(len(self.levels[-1][0]) if self.levels else len(self.order))
        for depth in range(len(self.levels) - 1, -1, -1):
            tops, least, most = self.levels[depth]
            near = (self.percent * least[nodes] <= 100 * n) & (100 * most[nodes] >= self.percent * n)
            nodes = nodes[near]
            low = np.maximum(least[nodes], -(-self.percent * n // 100))
            nodes = nodes[np.minimum(tops[nodes], p).sum(axis=1) >= needed(low, n, self.percent)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.order)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < below]
        at = self.order[nodes]
        bound = np.minimum(self.points[at], p).sum(axis=1)
        return at[bound >= needed(self.sizes[at], n, self.percent)]


def common_shingles(docs: DataFrame, words: int = WORDS, share: int = SAMPLE_SHARE, least: int = COMMON) -> np.ndarray:
    """Bits, 64 a number, of the shingles that least documents of the sample, one in share, have."""
    part = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(share)) == 0)

    def make():
        return lambda batch: Columns(sig=np.concatenate([shingles(t, words).view(np.int64) for t in batch["text"].to_pylist()]))

    rows = map_slices(part.select("text").distinct(), make, "sig long").groupBy("sig").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    # the hash's high bits say the number, its low ones the bit: no more rows than numbers come to the driver
    bit = F.expr("shiftleft(1L, CAST(sig & 63 AS INT))")
    numbers = materialize(rows.groupBy(F.shiftrightunsigned("sig", 70 - PLACES).alias("at")).agg(F.bit_or(bit).alias("bits")), "common").toPandas()
    bits = np.zeros(1 << (PLACES - 6), np.uint64)
    bits[numbers["at"].to_numpy(np.int64)] = numbers["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def is_in(found: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return (bits[(found >> np.uint64(70 - PLACES)).astype(np.int64)] >> (found & np.uint64(63)) & np.uint64(1)).astype(bool)


def signatures(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, last: np.ndarray | None = None) -> DataFrame:
    """doc_id, n, set_hash, minhashes, prefix, point: what the join needs of each text. Prefixes are taken by hash, those with a bit in last after all others."""
    shared = docs.sparkSession.sparkContext.broadcast(np.zeros(1 << (PLACES - 6), np.uint64) if last is None else last)

    def make():
        last = shared.value

        def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
            ends = np.cumsum([0, *map(len, parts)])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), kind))

        def sign(batch: pa.RecordBatch):
            n, names, low, prefix, near = [], [], [], [], []
            for text in batch["text"].to_pylist():
                found = shingles(text, words)
                n.append(len(found))
                names.append(hashlib.blake2b(found.tobytes(), digest_size=16).hexdigest() if len(found) else None)
                low.append(np.array([(found * s).min() for s in _SEEDS[:MINHASHES]] if len(found) else [], np.uint64).view(np.int64))
                late = is_in(found, last)
                prefix.append(np.concatenate((found[~late], found[late]))[: prefix_length(len(found), percent)].view(np.int64))
                near.append(point(found))
            return Columns(doc_id=batch["doc_id"], n=n, set_hash=names, minhashes=lists(low, pa.int64()), prefix=lists(prefix, pa.int64()), point=lists(near, pa.int32()))

        return sign

    return map_slices(docs.select("doc_id", "text"), make, "doc_id long, n long, set_hash string, minhashes array<long>, prefix array<long>, point array<int>")


def components(edges: DataFrame, name: str = "labels") -> DataFrame:
    """(id, label): the least id that is reachable by edges (a, b), for the ids in edges. Ends when no label changes."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = materialize(both, f"{name}-edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), name)
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        new = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        # a label's own label is at least as low: jump
        jump = labels.select(F.col("id").alias("low"), F.col("label").alias("far"))
        new = materialize(new.join(jump, "low", "left").select("id", F.col("label").alias("old"), F.least("low", F.coalesce("far", "low")).alias("label")), name)
        changed = new.filter("old <> label").limit(1).count()
        labels = new.select("id", "label")
        if not changed:
            return labels


def id_list(ids: DataFrame, name: str) -> DataFrame:
    """A written list of ids for a join: broadcast below SMALL rows, else shuffled."""
    ids = materialize(ids, name)
    return broadcast_if_small(ids, ids.count(), SMALL)


def bounded(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose sizes and summed minima allow a link."""
    side = classes.select("rep", "n", "point")
    both = pairs.join(side.toDF("a", "n_a", "point_a"), "a").join(side.toDF("b", "n_b", "point_b"), "b")
    both = both.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    overlap = F.aggregate(F.zip_with("point_a", "point_b", lambda x, y: F.least(x, y)), F.lit(0), lambda acc, x: acc + x)
    return both.filter((F.size("point_a") != F.size("point_b")) | ((100 + percent) * overlap >= percent * (F.col("n_a") + F.col("n_b")))).select("a", "b").distinct()


def texts_of(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """(doc_id, text) of listed documents."""
    return docs.select("doc_id", "text").join(id_list(ids.toDF("doc_id").distinct(), name), "doc_id", "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, each: int = 500) -> DataFrame:
    """Of distinct pairs (a, b) of documents, those whose sets are linked.

    For pairs with few a for each b, as b's text is shuffled with every pair. The pairs of one a form a group that
    is read as a stream after a's own set; an a with many pairs is spread over salts.
    """
    pairs = materialize(pairs, "pairs")
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b"))), "pair-ids")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(each)).cast("int").alias("salts"))
    heads = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id"))
    rows = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", F.col("b").alias("doc_id"))
    whole = heads.unionByName(rows).hint("merge").join(texts, "doc_id").drop("doc_id")
    grouped = whole.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b"))

    def check():
        now: list = [None, []]

        def keep(batch: pa.RecordBatch):
            out = Columns(a=[], b=[])
            for a, salt, b, text in zip(*(batch[n].to_pylist() for n in ("a", "salt", "b", "text"))):
                found = shingles(text, words)
                if now[0] != (a, salt):
                    now[:] = [(a, salt), []]
                if b is None:
                    now[1].append(found)  # of an id with several texts, each counts
                elif any(linked(x, found, percent) for x in now[1]):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return keep

    return map_slices(grouped, check, "a long, b long").distinct()


def near_first(classes: DataFrame) -> DataFrame:
    """Distinct pairs (first class of a min-hash bucket, other class)."""
    buckets = classes.select(F.col("rep").alias("b"), F.posexplode("minhashes").alias("k", "h"))
    first = buckets.groupBy("k", "h").agg(F.min("b").alias("a"), F.max("b").alias("last")).filter("a < last").drop("last")
    return buckets.join(first.hint("merge"), ["k", "h"]).filter("a < b").select("a", "b").distinct()


def anchored(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct (anchor, rep, n, comp): the classes of the prefix buckets that hold several components, by the bucket's first class."""
    named = broadcast_if_small(labels.withColumnRenamed("id", "rep"), labels.count(), SMALL)
    rows = classes.select("rep", "n", "prefix").join(named, "rep", "left").select("rep", "n", F.coalesce("label", "rep").alias("comp"), F.explode("prefix").alias("sig"))
    rows = rows.repartition("sig")  # one exchange for both uses, which therefore read the same columns
    live = rows.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("rep").alias("anchor"), F.max("n").alias("most")).filter("lo < hi AND most > 0").select("sig", "anchor")
    return materialize(rows.join(live.hint("merge"), "sig").groupBy("anchor", "rep", "comp").agg(F.max("n").alias("n")), "anchored")


def blocks_of(met: DataFrame, least: int = LEAST_BLOCK, most: int = MOST_BLOCK, blocks: int = BLOCKS) -> DataFrame:
    """(anchor, i, j, kind, rep, comp): the tasks' rows. Kind 0 is asked, 1 is in the tree and of the anchor's largest component, 2 is in the tree and also asked."""
    size = F.greatest("n", F.lit(256)).cast("long")
    by_comp = met.groupBy("anchor", "comp").agg(F.count("*").alias("m"), F.sum(size).alias("size"))
    best = by_comp.groupBy("anchor").agg(F.max(F.struct("m", "comp", "size")).alias("x"), F.sum("size").alias("size"))
    block = F.least(F.lit(most), F.greatest(F.lit(least), F.ceil(F.col("size") / blocks)))
    best = best.withColumn("block", block).select("anchor", F.col("x.comp").alias("main"), F.ceil((F.col("size") - F.col("x.size")) / F.col("block")).cast("int").alias("asks"), F.ceil(F.col("size") / F.col("block")).cast("int").alias("trees"))
    best = materialize(best.filter("asks > 0"), "anchors")
    rows = met.join(best.hint("merge"), "anchor")
    i, j = F.pmod(F.xxhash64("rep"), F.col("asks")).cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("trees")).cast("int")
    asked = rows.filter("comp <> main").select("anchor", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("j"), F.lit(0).alias("kind"), "rep", "comp")
    kind = F.when(F.col("comp") == F.col("main"), 1).otherwise(2)
    return asked.unionByName(rows.select("anchor", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)).alias("i"), j.alias("j"), kind.alias("kind"), "rep", "comp"))


def overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of one sorted set with others, none of them empty."""
    flat = np.concatenate(others)
    same = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(same, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


class Group:
    """A task's rows: asked members and those in the tree, by position."""

    def __init__(self, kinds: list[int], reps: list[int], comps: list[int], sizes: list[int], points: list[np.ndarray], percent: int = PERCENT):
        self.reps, self.sizes, self.percent, kinds = np.array(reps), np.array(sizes), percent, np.array(kinds)
        _, self.comp = np.unique(comps, return_inverse=True)
        self.asked, self.members = np.flatnonzero(kinds == 0), np.flatnonzero(kinds > 0)
        self.both = kinds == 2
        if len(self.asked) and len(self.members):
            self.points = together(points)
            self.tree = CountTree(self.points[self.members], self.sizes[self.members], percent)

    def within(self, k: int, root: np.ndarray) -> np.ndarray:
        """Members of other components within the bound of an asked one; of two that are asked, the later asks."""
        at = self.members[self.tree.query(self.points[k], int(self.sizes[k]))]
        return at[(root[self.comp[at]] != root[self.comp[k]]) & (~self.both[at] | (self.reps[at] < self.reps[k]))]

    def kept(self) -> np.ndarray:
        """Positions of the rows in pairs within the bound."""
        keep = np.zeros(len(self.reps), bool)
        if len(self.members):
            for k in self.asked:
                at = self.within(k, np.arange(len(self.reps)))
                keep[at] = True
                keep[k] |= len(at) > 0
        return np.flatnonzero(keep)

    def forest(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links that join two components, each joining those of the links before it."""
        root, out = np.arange(len(self.reps)), []
        for k in self.asked if len(self.members) else ():
            n, at = self.sizes[k], self.within(k, root)
            if len(at):
                share = np.minimum(self.points[at], self.points[k]).sum(axis=1) / needed(self.sizes[at], n, self.percent)
                at = at[np.lexsort((self.reps[at], -share))]
            step = 8
            while len(at):
                now, at = at[:step], at[step:]
                found = overlaps(sets[k], [sets[x] for x in now])
                for x in now[100 * found >= self.percent * (n + self.sizes[now] - found)]:
                    if root[self.comp[x]] != root[self.comp[k]]:
                        out.append((int(self.reps[k]), int(self.reps[x])))
                        root[root == root[self.comp[x]]] = root[self.comp[k]]
                at = at[root[self.comp[at]] != root[self.comp[k]]]
                step = min(256, 2 * step)
        return out


TASK = ("anchor", "i", "j")


def by_task(rows: DataFrame, work, more: str, schema: str, slice_rows: int) -> DataFrame:
    """work(rows of a task as a list) gives columns; rows have TASK, kind, rep, comp and the column named more."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def make():
        held: list = []
        now: list = [None]

        def done(out: dict) -> None:
            if held:
                for n, values in zip(names, work(now[0], held)):
                    out[n] += values
                held.clear()

        def gather(batch: pa.RecordBatch):
            out = Columns((n, []) for n in names)
            ids = zip(*(batch[c].to_pylist() for c in (*TASK, "kind", "rep", "comp")))
            for (*task, kind, rep, comp), value in zip(ids, batch[more]):
                if now[0] != task:
                    done(out)
                    now[0] = task
                held.append((kind, rep, comp, value))
            return out

        def flush():
            out = Columns((n, []) for n in names)
            done(out)
            return [out]

        gather.flush = flush
        return gather

    dealt = rows.select(*TASK, "kind", "rep", "comp", more).repartition(*TASK).sortWithinPartitions(*TASK)
    return map_slices(dealt, make, schema, slice_rows)


def search(tasks: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of the tasks that are in pairs within the bound of their points."""

    def work(task: list, held: list):
        kinds, reps, comps, points = zip(*held)
        points = [p.values.to_numpy() for p in points]
        keep = Group(kinds, reps, comps, [int(p.sum()) for p in points], points, percent).kept().tolist()
        return *([x] * len(keep) for x in task), *([x[k] for k in keep] for x in (kinds, reps, comps))

    rows = tasks.hint("merge").join(classes.select("rep", "point"), "rep")
    return by_task(rows, work, "point", "anchor long, i int, j int, kind int, rep long, comp long", 4096)


def across(tasks: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that join components, of written tasks."""

    def work(task: list, held: list):
        members = [(*x[:3], found) for x in held if len(found := shingles(x[3].as_py(), words))]
        kinds, reps, comps, sets = zip(*members) if members else ((), (), (), ())
        links = Group(kinds, reps, comps, list(map(len, sets)), list(map(point, sets)), percent).forest(sets)
        return [a for a, _ in links], [b for _, b in links]

    texts = texts_of(docs, tasks.select("rep"), "task-ids")
    rows = tasks.hint("merge").join(texts, F.col("rep") == F.col("doc_id"))
    return by_task(rows, work, "text", "a long, b long", 64).distinct()


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    signed = materialize(signatures(docs, words, percent, common_shingles(docs, words)), "signed")
    named = materialize(signed.select("doc_id", "n", "set_hash"), "named")
    groups = materialize(signed.filter("n > 0").groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "groups")
    # rows that are no class of their own are few, as a rule: their names are sent, not the signatures
    chosen = groups.filter("rep IS NOT NULL").select(F.col("rep").alias("doc_id"), "set_hash")
    member = "n > 0 AND doc_id IS NOT NULL"
    others = materialize(named.filter(member).select("doc_id", "set_hash").join(chosen.hint("merge"), ["doc_id", "set_hash"], "left_anti").distinct(), "others")
    classes = signed.filter(member).join(broadcast_if_small(others, others.count(), SMALL // 4), ["doc_id", "set_hash"], "left_anti").withColumnRenamed("doc_id", "rep")
    # a class has one row, however often its text came
    several = named.filter("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("set_hash").alias("lo"), F.max("set_hash").alias("hi")).filter("rows > 1")
    several = materialize(several, "repeated-ids")
    first = docs.sparkSession.createDataFrame([], "a long, b long")
    if several.limit(1).count():
        classes = classes.dropDuplicates(["rep", "set_hash"])
        rows = named.join(several.filter("lo < hi").select("doc_id"), "doc_id", "left_semi").select("doc_id", "set_hash").join(groups, "set_hash")
        first = materialize(rows.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "same-id-links")
    classes = materialize(classes.select("rep", "n", "minhashes", "prefix", "point"), "classes")
    release(signed)
    first = materialize(verified(bounded(near_first(classes), classes, percent), docs, words, percent).unionByName(first), "first-links")
    labels = components(first)
    met = anchored(classes, labels)
    tasks = materialize(search(blocks_of(met), classes, percent), "tasks")
    release(classes)
    release(met)
    more = materialize(across(tasks, docs, words, percent), "more-links")
    if more.limit(1).count():
        labels = components(first.unionByName(more))
    found = groups.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_hash", F.coalesce("label", "rep").alias("component"))
    return named.join(found.hint("merge"), "set_hash", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component: that of the least doc_id, with all its columns; rows without a doc_id stay."""
    joined = materialize(join(docs, words, percent).filter("doc_id IS NOT NULL"), "joined")
    chosen = docs.join(id_list(joined.filter("doc_id <> component_id").select("doc_id").distinct(), "dropped"), "doc_id", "left_anti")
    repeated = joined.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("kept")).filter("rows > 1 AND kept").select("doc_id")
    repeated = materialize(repeated, "repeated")
    if repeated.limit(1).count():  # of rows that repeat an id one stays, that of the least text; only those rows are shuffled
        repeated = broadcast_if_small(repeated, repeated.count(), SMALL)
        order = W.partitionBy("doc_id").orderBy("text", F.xxhash64(*docs.columns))
        place = "_".join([*docs.columns, "place"])  # a name that no column has
        one = chosen.join(repeated, "doc_id", "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1)
        chosen = chosen.join(repeated, "doc_id", "left_anti").unionByName(one.drop(place))
    return chosen.select(*docs.columns)
