"""Brown class-based bigrams: exchange clustering of words into classes, then scores of whole documents.

Exchange clustering runs in two steps. The first is on the UNIT_WORDS commonest training words, with the other words
bundled by their last two bytes (SUFFIXES commonest endings, and one unit for the rest) and the document's end as
a unit: its bigrams are a bounded matrix, on which words move until none gains. The second is on all of the HEAD commonest
words, in tasks: each word's counts of classes before and after it, from all training documents, say to which
class it moves. Words beyond the head, and words never seen, have the class of their ending. Class bigrams are then
counted anew over all training documents.

p(w | v) = LAMBDA * p(class w | class v) * p(w | class w) + (1 - LAMBDA) * p(w), all additively smoothed. As
each part has the factor count(w) + ADD, a document's score splits into sum log10(count + ADD), which for
rare words comes from a join with the vocabulary, and a sum over class pairs.

Defined cases: a null text is empty and has the end token alone; a null doc_id hashes as 'null'; rows that
repeat count and score as often as they come; without training documents every word is unknown; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgework.llm.common import Columns, crc_bucket, map_slices, materialize

FOLDS = 10
UNIT_WORDS = 768
SUFFIXES = 255
CLASSES = 48
#: Sweeps of the first step; it mostly ends sooner, when nothing moves.
SWEEPS = 40
HEAD = 131_072
ADD = 0.1
LAMBDA = 0.98
PULL = 10.0
FLUSH = 400_000
OTHER, END = UNIT_WORDS + SUFFIXES, UNIT_WORDS + SUFFIXES + 1
UNITS = END + 1


def words_of(text: str | None) -> list[bytes]:
    """Lower-case A-Z, words between white space of ASCII."""
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, words as bytes."""

    def make():
        held: Counter = Counter()

        def out() -> Columns:
            made = Columns(word=pa.array(list(held), pa.binary()), n=list(held.values()))
            held.clear()
            return made

        def count(batch: pa.RecordBatch):
            for text in batch["text"].to_pylist():
                held.update(words_of(text))
            return out() if len(held) > FLUSH else None

        count.flush = lambda: [out()] if held else []
        return count

    return map_slices(docs.select("text"), make, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Units(dict):
    """word -> unit; other words go by their ending: first, then one unit an ending, then one for the rest, then the end."""

    def __init__(self, words: list[bytes], endings: list[bytes], first: int = UNIT_WORDS, suffixes: int = SUFFIXES):
        super().__init__((w, i) for i, w in enumerate(words))
        self.endings = {e: first + i for i, e in enumerate(endings)}
        self.other = first + suffixes

    def __missing__(self, word: bytes) -> int:
        return self.endings.get(word[-2:], self.other)


def id_lists(docs: DataFrame, head: list[bytes], endings: list[bytes]) -> DataFrame:
    """(ids) of each text's words: the place in the head, or after it that of the ending. Written down, as several passes read them."""
    shared = docs.sparkSession.sparkContext.broadcast((head, endings))  # at most HEAD and SUFFIXES

    def make():
        head, endings = shared.value
        find = Units(head, endings, len(head)).__getitem__
        return lambda batch: Columns(ids=[np.fromiter(map(find, words_of(t)), np.int32) for t in batch["text"].to_pylist()])

    return materialize(map_slices(docs.select("text"), make, "ids array<int>"), "ids")


def with_ends(batch: pa.RecordBatch, last: int) -> np.ndarray:
    """The ids of a batch in a row, the end before the first text and after every one."""
    lists = batch["ids"]
    cuts = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy()[cuts[0] : cuts[-1]].astype(np.int64)
    return np.concatenate(([last], np.insert(flat, cuts[1:] - cuts[0], last)))


def bigram_matrix(ids: DataFrame, unit: np.ndarray) -> np.ndarray:
    """Counts of unit bigrams, a document's end standing before its first word too; unit: that of each id, the end's last."""

    def make():
        total = np.zeros(UNITS * UNITS, np.int64)

        def count(batch: pa.RecordBatch):
            a = unit[with_ends(batch, len(unit) - 1)]
            keys, n = np.unique(a[:-1] * UNITS + a[1:], return_counts=True)
            total[keys] += n
            return None

        def flush():
            keys = np.flatnonzero(total)
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000]
                yield Columns(key=part, n=total[part])

        count.flush = flush
        return count

    got = map_slices(ids, make, "key long, n long", 64).groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # at most UNITS ** 2 rows
    matrix = np.zeros(UNITS * UNITS)
    matrix[got["key"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    return matrix.reshape(UNITS, UNITS)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(matrix: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each unit; units move, commonest first, to where the class bigrams' likelihood is highest."""
    n = matrix.sum(axis=0) + matrix.sum(axis=1)
    order = np.argsort(-n[:-1], kind="stable")
    of = np.zeros(len(n), np.int64)
    of[order] = np.arange(len(order)) % (classes - 1)
    of[-1] = classes - 1  # the end stays alone
    rows = np.zeros((classes, len(n)))
    np.add.at(rows, of, matrix)
    m = np.zeros((classes, classes))
    np.add.at(m.T, of, rows.T)
    diagonal = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not n[w]:
                continue
            a, s = of[w], matrix[w, w]
            before, after = (np.bincount(of, weights=v, minlength=classes) for v in (matrix[:, w], matrix[w]))
            before[a] -= s
            after[a] -= s
            m[:, a] -= before
            m[a] -= after
            m[a, a] -= s
            right, left = m.sum(axis=0), m.sum(axis=1)
            f, base = xlogx(m), xlogx(m[diagonal, diagonal])
            down = xlogx(m + before[:, None]) - f
            across = xlogx(m + after[None, :]) - f
            gain = down.sum(axis=0) - down[diagonal, diagonal] + across.sum(axis=1) - across[diagonal, diagonal]
            gain += xlogx(m[diagonal, diagonal] + before + after + s) - base
            right, left = right + after, left + before  # what comes back wherever the word goes
            gain -= xlogx(right + before.sum() + s) - xlogx(right) + xlogx(left + after.sum() + s) - xlogx(left)
            gain[-1] = -np.inf
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else a
            m[:, b] += before
            m[b] += after
            m[b, b] += s
            of[w] = b
            moved += b != a
        if not moved:
            break
    return of


def gains(m: np.ndarray, before: np.ndarray, after: np.ndarray, own: int) -> np.ndarray:
    """The likelihood of the class bigrams m with a word in each class, less a constant. The word, which has class own now, comes after and before words of classes as counted."""
    m = m.copy()
    m[:, own] -= before
    m[own] -= after
    np.maximum(m, 0, out=m)
    diagonal = np.arange(len(m))
    right, left = m.sum(axis=0) + after, m.sum(axis=1) + before  # what comes back wherever the word goes
    f = xlogx(m)
    down, across = xlogx(m + before[:, None]) - f, xlogx(m + after[None, :]) - f
    gain = down.sum(axis=0) - down[diagonal, diagonal] + across.sum(axis=1) - across[diagonal, diagonal]
    gain += xlogx(m[diagonal, diagonal] + before + after) - f[diagonal, diagonal]
    return gain - (xlogx(right + before.sum()) - xlogx(right) + xlogx(left + after.sum()) - xlogx(left))


def neighbours(ids: DataFrame, words: int, of: np.ndarray, of_words: bool = True) -> tuple[DataFrame, np.ndarray]:
    """(id, slots) of the head's words, and the class bigrams. A slot is a class before the word, or CLASSES more than one after it, with its count."""

    def make():
        last = len(of) - 1
        total, pairs = np.zeros(words * 2 * CLASSES if of_words else 0, np.int32), np.zeros(CLASSES * CLASSES, np.int64)

        def count(batch: pa.RecordBatch):
            a = with_ends(batch, last)
            c = of[a]
            pairs[:] += np.bincount(c[:-1] * CLASSES + c[1:], minlength=len(pairs))
            if of_words:
                a = a[1:-1]
                known = a < words
                own = a[known] * (2 * CLASSES)
                keys, n = np.unique(np.concatenate((own + c[:-2][known], own + CLASSES + c[2:][known])), return_counts=True)
                total[keys] += n.astype(np.int32)
            return None

        def flush():
            yield Columns(key=-1 - np.flatnonzero(pairs), n=pairs[pairs > 0])
            keys = np.flatnonzero(total)
            for at in range(0, len(keys), 100_000):
                part = keys[at : at + 100_000]
                yield Columns(key=part, n=total[part].astype(np.int64))

        count.flush = flush
        return count

    found = materialize(map_slices(ids, make, "key long, n long", 256).groupBy("key").agg(F.sum("n").alias("n")), "neighbours")
    m = np.zeros(CLASSES * CLASSES)
    for r in found.filter("key < 0").collect():  # at most CLASSES ** 2
        m[-1 - r["key"]] = r["n"]
    width = F.lit(2 * CLASSES)
    slots = found.filter("key >= 0").groupBy(F.floor(F.col("key") / width).alias("id")).agg(F.collect_list(F.struct((F.col("key") % width).cast("int").alias("slot"), "n")).alias("slots"))  # at most 2 * CLASSES a word
    return slots, m.reshape(CLASSES, CLASSES)


def exchanged(slots: DataFrame, m: np.ndarray, of: np.ndarray) -> dict[int, int]:
    """The new class of each of the head's words that gains by a move; at most HEAD."""

    def make():
        def choose(batch: pa.RecordBatch):
            out = Columns(id=[], to=[])
            for i, slots in zip(batch["id"].to_pylist(), batch["slots"].to_pylist()):
                counts = np.zeros(2 * CLASSES)
                for s in slots:
                    counts[s["slot"]] = s["n"]
                own = int(of[i])
                gain = gains(m, counts[:CLASSES], counts[CLASSES:], own)
                gain[of[-1]] = -np.inf  # the end stays alone
                best = int(gain.argmax())
                if best != own and gain[best] > gain[own] + 1e-9:
                    out["id"].append(i)
                    out["to"].append(best)
            return out

        return choose

    return {r["id"]: r["to"] for r in map_slices(slots, make, "id long, to int", 1024).collect()}


class Model:
    """Plain arrays: what scoring needs, bounded by HEAD, SUFFIXES and CLASSES. of has the class of each of the head's words, then of endings, of the rest and of the end."""

    def __init__(self, head: list[bytes], head_counts: np.ndarray, endings: list[bytes], of: np.ndarray, step: np.ndarray, total: int, distinct: int, end_count: int):
        self.head, self.head_counts, self.endings, self.of, self.step = head, head_counts, endings, of, step
        self.total, self.distinct, self.end_count = total, distinct, end_count


def learn(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the words beyond its head as (word, n)."""
    vocabulary = materialize(word_counts(train), "vocabulary")
    ends = train.count()
    words_total, words_distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = vocabulary.orderBy(F.desc("n"), "word").limit(HEAD).collect()  # at most HEAD rows
    head = [bytes(r["word"]) for r in top]
    counts = np.array([r["n"] for r in top], np.int64)
    rest = vocabulary.filter("false") if len(top) < HEAD else vocabulary.filter((F.col("n") < int(counts[-1])) | (F.col("n") == int(counts[-1])) & (F.col("word") > F.lit(bytearray(head[-1]))))
    # endings: at most 256 ** 2 + 256 + 1 of them
    ending = F.expr("substring(word, greatest(length(word) - 1, 1), 2)")
    mass = {bytes(r["e"]): [r["n"], r["v"]] for r in vocabulary.groupBy(ending.alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    rare = {e: list(v) for e, v in mass.items()}
    for i, (w, c) in enumerate(zip(head, counts.tolist())):
        for table in (mass, rare) if i < UNIT_WORDS else (rare,):
            table[w[-2:]][0] -= c
            table[w[-2:]][1] -= 1
    endings = [e for e, _ in sorted(mass.items(), key=lambda x: (-x[1][0], x[0]))[:SUFFIXES]]
    ids = id_lists(train, head, endings)
    by_ending = Units([], endings)
    # the unit of each id: the commonest words, then endings, the rest and the end
    unit = np.array([*range(min(UNIT_WORDS, len(head))), *(by_ending[w] for w in head[UNIT_WORDS:]), *range(UNIT_WORDS, UNITS)], np.int64)
    of = exchange(bigram_matrix(ids, unit))[unit]
    slots, m = neighbours(ids, len(head), of)
    for i, to in exchanged(slots, m, of).items():
        of[i] = to
    _, pairs = neighbours(ids, len(head), of, of_words=False)
    units = len(head) + SUFFIXES + 2
    unit_n, unit_v = np.zeros(units), np.zeros(units)
    unit_n[: len(head)], unit_v[: len(head)] = counts, 1
    known = set(endings)
    for i, e in enumerate(endings):
        unit_n[len(head) + i], unit_v[len(head) + i] = rare[e]
    unit_n[-2], unit_v[-2] = (sum(v[k] for e, v in rare.items() if e not in known) for k in (0, 1))
    unit_n[-1], unit_v[-1] = ends, min(ends, 1)
    n, v = (np.bincount(of, weights=x, minlength=CLASSES) for x in (unit_n, unit_v))
    total, distinct = words_total + ends, words_distinct + min(ends, 1)
    room = n + ADD * (v + 1)
    transition = (pairs + PULL * (room / room.sum())[None, :]) / (pairs.sum(axis=1)[:, None] + PULL)
    step = np.log10(LAMBDA * transition / room[None, :] + (1 - LAMBDA) / (total + ADD * (distinct + 1)))
    return Model(head, counts, endings, of, step, int(total), int(distinct), int(ends)), rest


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    held = crc_bucket("doc_id", FOLDS) == 0
    model, rest = learn(docs.filter(~held))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        units = Units([], m.endings, len(m.head))
        place = {w: (c, i) for i, (w, c) in enumerate(zip(m.head, np.log10(m.head_counts + ADD).tolist()))}
        of, end, end_log = m.of, len(m.of) - 1, float(np.log10(m.end_count + ADD))
        end_class = int(of[end])
        find, lost = place.get, units.__missing__

        def sums(batch: pa.RecordBatch):
            out = Columns((n, []) for n in ("row", "doc_id", "held_out", "word", "n", "n_tokens", "known", "logs", "steps"))
            for row, doc_id, is_held, text in zip(*(batch[c].to_pylist() for c in ("row", "doc_id", "held_out", "text"))):
                words = words_of(text)
                ids, rare, logs = [end], Counter(), end_log
                add = ids.append
                for w in words:
                    got = find(w)
                    if got is None:
                        rare[w] += 1
                        add(lost(w))
                    else:
                        logs += got[0]
                        add(got[1])
                known = len(words) - rare.total() + (m.end_count > 0)
                c = of[np.array(ids)]
                steps = float(m.step[c, np.append(c[1:], end_class)].sum())
                if not rare:
                    rare[b"\0 no rare word %d" % row] = 0  # words have no spaces: joins with none
                n = len(rare)
                out["row"] += [row] * n
                out["doc_id"] += [doc_id] * n
                out["held_out"] += [is_held] * n
                out["word"] += rare.keys()
                out["n"] += rare.values()
                out["n_tokens"] += [len(words) + 1] + [0] * (n - 1)
                out["known"] += [known] + [0] * (n - 1)
                out["logs"] += [logs] + [0.0] * (n - 1)
                out["steps"] += [steps] + [0.0] * (n - 1)
            return out

        return sums

    parts = map_slices(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held.alias("held_out"), "text"), make, "row long, doc_id long, held_out boolean, word binary, n long, n_tokens long, known long, logs double, steps double", 128)
    joined = parts.join(rest.select("word", F.col("n").alias("c")), "word", "left")
    more = F.when(F.col("n") > 0, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).otherwise(0.0)
    whole = joined.groupBy("row", "doc_id", "held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("known") + F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("n_known"), F.sum(F.round(F.col("logs") + more, 9).cast("decimal(28,9)")).cast("double").alias("logs"), F.sum("steps").alias("steps")
    )
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(model.total + ADD * (model.distinct + 1))))
    own = F.col("logs") + F.col("steps")
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), own.alias("score"), F.pow(F.lit(10.0), -own / F.col("n_tokens")).alias("perplexity"))
