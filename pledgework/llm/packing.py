"""Best-fit decreasing packing of token sequences into fixed windows.

A document longer than a window is first cut into full windows; the rest of it is packed. Sizes are whole
numbers up to the window, so the packing itself runs on the histogram of sizes: windows with equal contents
form cohorts, a segment tree indexed by remaining capacity finds the tightest open cohort, and one step
fills many windows with as many pieces of one size as best-fit decreasing would put there one by one. The
histogram and the plan are bounded by the window, whatever the number of documents, and the plan equals the
global best-fit decreasing packing. Ranks of pieces within their size are found by a salted count and join.

Defined cases: a null text is an empty one and has the end id alone; repeated rows are packed as often as
they come; an empty table gives an empty result; other columns are ignored. Equal sizes are ranked by
(salt, doc_id, start).
"""

from __future__ import annotations

import base64
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pledgework.llm.common import Columns, map_slices, materialize

WINDOW = 2048
END_ID = 1
#: White space after white space and before other text: the vocabulary's pattern starts a piece there.
TURN = re.compile(r"(?<=\s)\s(?=\S)")
DOUBLE = re.compile(r"\s\s")
#: Spaces on which Python and the pattern's engine disagree; such texts go to the whole tokenizer.
ODD = re.compile("[\x1c-\x1f\x85]")
LOOKAHEAD = r"|\s+(?!\S)"


def text_encoder(tokenizer: str, ranks: str):
    """text -> little-endian unsigned 32-bit ids of the byte-level BPE; both files hold one vocabulary.

    The pattern's lookahead keeps its engine from using an automaton. It matters only where white space
    follows white space, so the text is cut there and the pattern without it gives the same pieces.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    if LOOKAHEAD not in public_tokenizers.PATTERN:
        raise ValueError("the vocabulary's pattern isn't the one that this splitting is for")
    core = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN.replace(LOOKAHEAD, ""), mergeable_ranks=table, special_tokens={})._core_bpe
    whole = Tokenizer.from_file(tokenizer)
    whole.encode_special_tokens = True

    def encode(text: str) -> bytes:
        if ODD.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not DOUBLE.search(text):
            return np.array(core.encode_ordinary(text), "<u4").tobytes()
        cuts = [0, *(m.start() for m in TURN.finditer(text)), len(text)]
        return b"".join([np.array(core.encode_ordinary(text[a:b]), "<u4").tobytes() for a, b in zip(cuts, cuts[1:])])

    return encode


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_pieces(docs: DataFrame, files: tuple[str, str] | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): full windows of a document, then the rest."""
    files = files or tokenizer_files()
    end = struct.pack("<I", end_id)

    def make():
        encode = text_encoder(*files)

        def cut(batch: pa.RecordBatch):
            out = Columns(doc_id=[], start=[], length=[], ids_crc32=[], doc_tokens=[])
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["doc_tokens"].append(n)
            return out

        return cut

    return map_slices(docs.select("doc_id", "text"), make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class CapacityTree:
    """Segment tree over remaining capacities: the least capacity >= size that has an open window."""

    def __init__(self, most: int):
        self.base = 1 << most.bit_length()
        self.any = [False] * (2 * self.base)

    def put(self, capacity: int, full: bool) -> None:
        i = capacity + self.base
        self.any[i] = full
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, size: int) -> int | None:
        i = size + self.base
        if not self.any[i]:
            while True:
                if i == 1:
                    return None
                if i % 2 == 0 and self.any[i + 1]:
                    i += 1
                    break
                i //= 2
            while i < self.base:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.base


def best_fit_plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (size, first rank, end rank, first window, pieces a window, offset), by size falling and rank rising."""
    tree, open_at = CapacityTree(window), {}
    plan, opened = [], 0

    def add(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_at.setdefault(capacity, []).append((first, n))
            tree.put(capacity, True)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room is None:
                room, first = window, opened
                n = -(-left // (room // size))
                opened += n
            else:
                first, n = open_at[room].pop()
                if not open_at[room]:
                    tree.put(room, False)
            each = room // size
            full = min(n, left // each)
            if full:
                plan.append((size, rank, rank + full * each, first, each, window - room))
                add(room - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            rest = n - full
            if rest and left and left < each:
                plan.append((size, rank, rank + left, first + full, left, window - room))
                add(room - left * size, first + full, 1)
                rank, left, full, rest = rank + left, 0, full + 1, rest - 1
            if rest and room < window:
                add(room, first + full, rest)
    return plan


def ranked(pieces: DataFrame, by: str, total: int, each: int = 100_000) -> DataFrame:
    """Adds rank, from 0 within equal values of by; a value with many rows is spread over salts."""
    salts = max(1, total // each)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    ahead = F.coalesce(F.sum("n").over(W.partitionBy(by).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = salted.groupBy(by, "salt").agg(F.count("*").alias("n")).select(by, "salt", ahead.alias("ahead"))
    own = F.row_number().over(W.partitionBy(by, "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    return salted.withColumn("own", own).join(offsets, [by, "salt"]).withColumn("rank", F.col("ahead") + F.col("own")).drop("own", "ahead", "salt")


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to written pieces."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row a size
    plan = np.array(best_fit_plan(counts, window), dtype=np.int64).reshape(-1, 6)
    span = max(counts.values(), default=0) + 1
    keys = -plan[:, 0] * span + plan[:, 1]  # rising

    def make():
        def put(batch: pa.RecordBatch):
            cols = {n: batch[n] for n in batch.schema.names}
            size, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            row = plan[np.searchsorted(keys, -size * span + rank, side="right") - 1]
            at = rank - row[:, 1]
            cols["sequence_id"] = row[:, 3] + at // row[:, 4]
            cols["offset"] = row[:, 5] + at % row[:, 4] * size
            return Columns(cols)

        return put

    out = ranked(pieces, "length", sum(counts.values()))
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"]
    return map_slices(out.select(order), make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rank long, sequence_id long, offset long", 8192).drop("rank")


def pack(docs: DataFrame, files: tuple[str, str] | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece with its sequence and offset; see the module's text."""
    return place(materialize(token_pieces(docs, files, window), "pieces"), window)
