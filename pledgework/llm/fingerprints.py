"""Merkle-tree fingerprints of documents.

The leaves are runs of a few words with the separators after them, a paragraph is a node over its leaves, a
section a node over paragraphs, and the root a node over sections. Leaves end after words chosen by their own
hash, and sections after paragraphs chosen by theirs, so an insertion changes the leaves around it only. A leaf
is the hash of its text and every other node the hash of its children, with a mark of the level; as the leaves
together are the text, equal roots mean equal texts, and texts that differ differ in a leaf. Where roots differ,
equal nodes cover what both texts share, and the differing branches locate the edits.

The fingerprint is text: "root;section|paragraph=leaf*w.leaf*w|paragraph=...;section|...", w being the leaf's
length in code points; of nodes below the root it has the first half of the hash. `likeness` of two
fingerprints is twice the weight of shared leaves over the weight of all.

Defined cases: a null text is an empty one; two empty texts are alike by 1, an empty and another by 0; ties of
doc_id are ordered by text; a null doc_id comes last; a lone document is its own next; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgework.llm.common import Columns, map_slices

#: A leaf ends after a word of which a hash falls in one of so many.
LEAF_WORDS = 8
#: Words of more code points are cut where the code points of a run say so.
LONG_WORD, RUN = 64, 4
SECTION_PARAGRAPHS = 32
PARAGRAPH = re.compile(r"[^\n]*\n+|[^\n]+")
PIECE = re.compile(r"\S+\s*|\s+")


def node(level: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=level).digest()


class Cutter(dict):
    """The leaves of a paragraph; remembers which words end one."""

    def __init__(self, words_each: int = LEAF_WORDS):
        self.each = words_each

    def __missing__(self, piece: str) -> bool:
        if len(self) > 200_000:
            self.clear()
        end = self[piece] = zlib.crc32(piece.rstrip().encode()) % self.each == 0
        return end

    def __call__(self, paragraph: str) -> list[str]:
        pieces = PIECE.findall(paragraph)
        if max(map(len, pieces)) > LONG_WORD:
            pieces = [x for piece in pieces for x in (self.long(piece) if len(piece) > LONG_WORD else (piece,))]
        ends = [i for i, end in enumerate(map(self.__getitem__, pieces), 1) if end]
        if not ends or ends[-1] < len(pieces):
            ends.append(len(pieces))
        return ["".join(pieces[i:j]) for i, j in zip([0, *ends], ends)]

    @staticmethod
    def long(piece: str) -> list[str]:
        """A long word in parts of 16 to 64 code points, cut by the hash of the RUN before the cut."""
        out, at = [], 0
        while len(piece) - at > LONG_WORD:
            cut = next((i for i in range(at + 16, at + LONG_WORD) if zlib.crc32(piece[i - RUN : i].encode()) % 16 == 0), at + LONG_WORD)
            out.append(piece[at:cut])
            at = cut
        return [*out, piece[at:]]


class Tree:
    """sections: [(hash, paragraphs, weight)]; a paragraph is (hash, leaves, weight), a leaf "hash*weight"."""

    def __init__(self, text: str, cut: Cutter | None = None):
        cut, self.sections = cut or Cutter(), []
        nodes, paragraphs, inner = [], [], []
        for paragraph in PARAGRAPH.findall(text):
            parts = cut(paragraph)
            hashes = [node(b"leaf", x.encode()) for x in parts]
            own = node(b"paragraph", b"".join(hashes))
            nodes.append(own)
            paragraphs.append((own[:8].hex(), ["%s*%d" % (h[:8].hex(), len(x)) for h, x in zip(hashes, parts)], len(paragraph)))
            if len(nodes) >= SECTION_PARAGRAPHS or own[0] < 32:
                inner.append(self._close(nodes, paragraphs))
                nodes, paragraphs = [], []
        if nodes:
            inner.append(self._close(nodes, paragraphs))
        self.root = node(b"root", b"".join(inner)).hex()

    def _close(self, nodes: list[bytes], paragraphs: list) -> bytes:
        own = node(b"section", b"".join(nodes))
        self.sections.append((own[:8].hex(), paragraphs, sum(p[2] for p in paragraphs)))
        return own

    def __str__(self) -> str:
        return ";".join([self.root, *("|".join([h, *(f"{p}={'.'.join(leaves)}" for p, leaves, _ in paragraphs)]) for h, paragraphs, _ in self.sections)])


def parse(fingerprint: str) -> tuple[str, list]:
    root, *sections = fingerprint.split(";")
    out = []
    for section in sections:
        name, *paragraphs = section.split("|")
        cut = [(h, leaves.split(".")) for h, _, leaves in (p.partition("=") for p in paragraphs)]
        weighed = [(h, leaves, sum(int(x.rpartition("*")[2]) for x in leaves)) for h, leaves in cut]
        out.append((name, weighed, sum(p[2] for p in weighed)))
    return root, out


def apart(a: list, b: list) -> tuple[int, list, list]:
    """Of nodes (hash, children, weight): the weight of those that both have, and the children of the others on either side."""
    both = Counter(x[0] for x in a) & Counter(x[0] for x in b)
    taken, rest = 0, ([], [])
    for nodes, out in zip((a, b), rest):
        left, taken = both.copy(), 0
        for h, children, weight in nodes:
            if left and left[h] > 0:
                left[h] -= 1
                taken += weight
            else:
                out += children
    return taken, *rest


def likeness_of(root_a: str, a: list, root_b: str, b: list) -> float:
    """Of two trees; equal sections and paragraphs are taken whole, only leaves of differing branches are compared."""
    if root_a == root_b:
        return 1.0
    total = sum(x[2] for x in a) + sum(x[2] for x in b)
    shared, a, b = apart(a, b)
    more, a, b = apart(a, b)
    shared += more
    if not set(a).isdisjoint(b):
        shared += sum(n * int(x.rpartition("*")[2]) for x, n in (Counter(a) & Counter(b)).items())
    return 2 * shared / total if total else 0.0


def likeness(a: str, b: str) -> float:
    return likeness_of(*parse(a), *parse(b))


def near(a: Tree, b: Tree) -> float:
    return likeness_of(a.root, a.sections, b.root, b.sections)


def differing_branches(a: str, b: str) -> list[tuple[int, int, int, str]]:
    """(section, paragraph, leaf, hash) of b's leaves that a doesn't have, by position: where the edits are."""
    (_, x), (_, y) = parse(a), parse(b)
    left = Counter(leaf for _, paragraphs, _ in x for _, leaves, _ in paragraphs for leaf in leaves)
    out = []
    for i, (_, paragraphs, _) in enumerate(y):
        for j, (_, leaves, _) in enumerate(paragraphs):
            for k, leaf in enumerate(leaves):
                if left[leaf] > 0:
                    left[leaf] -= 1
                else:
                    out.append((i, j, k, leaf.partition("*")[0]))
    return out


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def next_in_order(docs: DataFrame, per_part: int = 2_000) -> DataFrame:
    """The documents dealt to ranges of falling doc_id, with the first row of each range also at the end of the range before.

    Adds part and guest. Bounds come from approximate quantiles of the ids, so that only ids are read twice
    and texts are shuffled once.
    """
    ids = docs.select("doc_id")
    n, least = ids.agg(F.count("*"), F.min("doc_id")).first()
    parts = max(1, min(10_000, n // per_part))
    probs = [i / parts for i in range(1, parts)]
    bounds = sorted({int(b) for b in ids.agg(F.percentile_approx("doc_id", probs, 10_000).alias("b")).first()["b"] or []}) if probs and least is not None else []
    falling = np.array(sorted(bounds, reverse=True), np.int64)
    # range of falling id: the number of bounds that are >= doc_id; a null id goes after all

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(-falling, -ids.to_numpy(np.int64), side="right").astype(np.int32))

    part = F.when(F.col("doc_id").isNull(), F.lit(len(falling))).otherwise(range_of(F.coalesce("doc_id", F.lit(0).cast("long")))).cast("int")
    heads = {r["part"]: r["top"] for r in ids.select("doc_id", part.alias("part")).groupBy("part").agg(F.max("doc_id").alias("top")).collect()}  # a row a range
    order = sorted(heads)
    before = {p: order[i - 1] for i, p in enumerate(order)}  # the first range's head goes to the end of the last
    null_head = [before[p] for p in order if heads[p] is None]  # where the last range has null ids only

    @F.pandas_udf("array<int>")
    def ranges_of(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(-falling, -ids.to_numpy(np.int64), side="right").tolist()
        return pd.Series([[p, before[p]] if heads.get(p) == i else [p] for p, i in zip(own, ids.tolist())])

    nulls = F.array(F.lit(len(falling)), *map(F.lit, null_head))
    both = F.when(F.col("doc_id").isNull(), nulls).otherwise(ranges_of(F.coalesce("doc_id", F.lit(0).cast("long"))))
    dealt = docs.select("doc_id", "text", F.posexplode(both).alias("guest", "part"))
    return dealt.select("doc_id", "text", "part", "guest"), len(order)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    dealt, parts = next_in_order(docs)
    rows = dealt.repartition(max(1, parts), "part").sortWithinPartitions("part", "guest", F.desc_nulls_last("doc_id"), "text")

    def make():
        waiting: list = []
        cut = Cutter()

        def result(doc_id, text: str, tree: Tree, following: str, following_tree: Tree):
            made = edited(text, following)
            new = Tree(made, cut)
            return doc_id, len(text), hashlib.sha256(made.encode()).hexdigest(), str(tree), str(new), near(tree, new), near(tree, following_tree)

        def link(batch: pa.RecordBatch):
            out = []
            for doc_id, text, part, guest in zip(*(batch[n].to_pylist() for n in ("doc_id", "text", "part", "guest"))):
                text = text or ""
                if waiting and waiting[0][0] != part:
                    waiting.clear()
                if guest and not waiting:  # further copies of a head that repeats
                    continue
                tree = Tree(text, cut)
                if waiting:
                    _, old_id, old_text, old_tree = waiting.pop()
                    out.append(result(old_id, old_text, old_tree, text, tree))
                if not guest:
                    waiting.append((part, doc_id, text, tree))
            return Columns(zip(NAMES, map(list, zip(*out)))) if out else None

        return link

    return map_slices(rows, make, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double", 128)


NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
