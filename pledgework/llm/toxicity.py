"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech, other). Letter-to-letter weighted
transducers then rewrite the symbols of a clause: one for negation, one for reported speech, one for aim
(a target before or after). Their composition is run over each clause with an insult or threat; its best
path says what the clause does: an insult or threat that is plain, aimed, negated or reported. A document's score is a
logistic function of the counts of what its clauses do. Its weights are also those of the arcs: an arc weighs what
the letter that it writes weighs.

Learned from labelled rows outside the held-out fold, on a bounded sample (SAMPLE_ROWS): insult words and stems beyond
the fixed list, from document frequencies under either label, and the weights, drawn to the prior PRIOR and
learned twice, as the first weights choose the paths that the second are learned from. Scoring covers every clause of
every text, whole: more than REACH other words in a row take the grammar back to its start, so a long clause falls
into stretches that are read one by one.

Defined cases: a null or empty text, or one without a match, scores the bias alone; rows that repeat get equal scores;
a null doc_id falls into the fold of the text 'null'; labels of null are ignored; without labels, the prior
scores; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgework.llm.common import Columns, broadcast_if_small, crc_bucket, map_slices, materialize

FOLDS = 5
SAMPLE_ROWS = 20_000
#: Least toxic texts of a learned word or stem, and how often they must outnumber the others: so many agree by chance in fewer than one word of a sample.
LEAST_WORD, LEAST_STEM, ODDS = 6, 8, 20
STEM_LETTERS = (4, 8)
#: Seed lexicons, lower case.
INSULTS = "idiot idiots moron morons stupid clown clowns scum trash loser losers pathetic worthless disgusting imbecile dumb dumbass fool filth vermin garbage creep coward cretin bastard asshole bitch jerk pig retard scumbag dirtbag lowlife freak dummkopf trottel arschloch abschaum versager connard imbécile salaud ordure crétin idiota imbécil estúpido estúpida basura escoria".split()
THREATS = "kill hurt destroy murder beat stab shoot smash burn punish crush strangle töten umbringen tuer matar".split()
TARGETS = "you your you're u ya he she they them him her these those everyone people this that du ihr dich euch tu vous toi tú usted ustedes".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't didn't nobody hardly nicht kein keine nie pas jamais nunca".split()
REPORTS = "said says say saying called calls quoted quotes quote wrote writes claimed claims reported reports alleged according sagte sagt dit disait dijo dice".split()
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE_END = re.compile(r"[.!?;\n]")
#: Other words in a row after which no transducer is in the scope of anything.
REACH = 8
GAP = re.compile("o{%d,}" % REACH)
#: What a path says of an insult (plain, aimed, negated, reported) or a threat (plain, aimed, negated, reported).
SAYS = "iAnrtTmq"
PRIOR = np.array([-4.0, 6.5, 8.0, 2.0, 3.0, 0.5, 6.0, 0.5, 1.0])


class Transducer:
    """Letter-to-letter, weights added along a path, the largest path wins."""

    def __init__(self, start, finals: dict, arcs: dict):
        self.start, self.finals, self.arcs = start, finals, arcs  # arcs: (state, letter) -> [(letter out, weight, state)]

    def compose(self, other: Transducer) -> Transducer:
        start = (self.start, other.start)
        arcs, finals, todo, seen = defaultdict(list), {}, [start], {start}
        letters = {letter for _, letter in self.arcs}
        while todo:
            a, b = at = todo.pop()
            if a in self.finals and b in other.finals:
                finals[at] = self.finals[a] + other.finals[b]
            for letter in letters:
                for mid, w, to_a in self.arcs.get((a, letter), ()):
                    for out, v, to_b in other.arcs.get((b, mid), ()):
                        to = (to_a, to_b)
                        arcs[at, letter].append((out, w + v, to))
                        if to not in seen:
                            seen.add(to)
                            todo.append(to)
        return Transducer(start, finals, dict(arcs))

    def best(self, letters: str) -> tuple[float, tuple[int, ...]]:
        """Weight of the best path, and how often it writes each letter of SAYS; ties go to the largest counts in that order."""
        front = {self.start: (0.0, (0,) * len(SAYS))}
        for letter in letters:
            new: dict = {}
            for state, (w, counts) in front.items():
                for o, v, to in self.arcs.get((state, letter), ()):
                    i = SAYS.find(o)
                    cand = (w + v, counts if i < 0 else (*counts[:i], counts[i] + 1, *counts[i + 1 :]))
                    if to not in new or cand > new[to]:
                        new[to] = cand
            front = new
        return max(((w + self.finals[s], counts) for s, (w, counts) in front.items() if s in self.finals), default=(float("-inf"), (0,) * len(SAYS)))


def scope(opener: str, reach: int, changes: dict[str, str], alphabet: str) -> Transducer:
    """After the opener, for some letters, changes apply."""
    arcs = {}
    for k in range(reach + 1):
        for letter in alphabet:
            out = changes.get(letter, letter) if k else letter
            arcs[k, letter] = [(out, 0.0, reach if letter == opener else max(0, k - 1))]
    return Transducer(0, {k: 0.0 for k in range(reach + 1)}, arcs)


def aim(weights: dict[str, float], before: int = 4, after: int = 3) -> Transducer:
    """An insult or threat near a target is aimed at it; a target to come is guessed, and the guess must hold."""
    arcs, alphabet, aimed = defaultdict(list), "oiYNRtnrmq", {"i": "A", "t": "T"}
    states = [("b", k) for k in range(before + 1)] + [("w", k) for k in range(1, after + 1)]

    def add(state: tuple, letter: str, out: str, to: tuple) -> None:
        arcs[state, letter].append((out, weights.get(out, 0.0), to))

    for kind, k in states:
        for letter in alphabet:
            if kind == "w":
                if letter == "Y":
                    add((kind, k), letter, letter, ("b", before))
                elif k > 1:
                    add((kind, k), letter, aimed.get(letter, letter), ("w", k - 1))
                continue
            left = before if letter == "Y" else max(0, k - 1)
            if letter in aimed and k:
                add((kind, k), letter, aimed[letter], ("b", left))
            else:
                add((kind, k), letter, letter, ("b", left))
                if letter in aimed:
                    add((kind, k), letter, aimed[letter], ("w", after))
    return Transducer(("b", 0), {s: 0.0 for s in states if s[0] == "b"}, dict(arcs))


def grammar(weights: np.ndarray = PRIOR) -> Transducer:
    """weights: bias, then one a letter of SAYS."""
    negation = scope("N", 3, {"i": "n", "t": "m"}, "oiYNRt")
    report = scope("R", 6, {"i": "r", "t": "q", "n": "r", "m": "q"}, "oiYNRtnm")
    return negation.compose(report).compose(aim(dict(zip(SAYS, weights[1:].tolist()))))


class Scanner:
    """Counts of what a text's clauses do; insults beyond the fixed list are given."""

    def __init__(self, learned: list[str], weights: np.ndarray = PRIOR):
        import ahocorasick

        self.kind = dict.fromkeys(REPORTS, "R") | dict.fromkeys(NEGATIONS, "N") | dict.fromkeys(TARGETS, "Y") | dict.fromkeys(THREATS, "t") | dict.fromkeys((w for w in learned if w[-1] != "*"), "i") | dict.fromkeys(INSULTS, "i")
        self.find, self.stems = ahocorasick.Automaton(), {w[:-1] for w in learned if w[-1] == "*"}
        for w in [w for w, k in self.kind.items() if k in "it"] + sorted(self.stems):
            self.find.add_word(w, (len(w), w in self.stems))
        self.find.make_automaton()
        self.machine, self.known = grammar(weights), {"": (0,) * len(SAYS)}

    def symbol(self, word: str) -> str:
        found = self.kind.get(word)
        if found is None and any(word[:n] in self.stems for n in range(STEM_LETTERS[0], STEM_LETTERS[1] + 1)):
            found = "i"
        return found or "o"

    def counts(self, text: str) -> list[int]:
        found, done = [0] * len(SAYS), -1
        low = text.lower()
        for end, (n, stem) in self.find.iter(low):
            if end < done or not stem and end + 1 < len(low) and low[end + 1].isalpha() or end >= n and low[end - n].isalpha():
                continue
            m = CLAUSE_END.search(low, end)
            done = m.start() if m else len(low)
            start = max(low.rfind(c, 0, end) for c in ".!?;\n") + 1
            letters = "".join([self.symbol(w) for w in WORD.findall(low[start:done].replace("’", "'"))])
            for stretch in GAP.split(letters):
                says = self.known.get(stretch)
                if says is None:
                    if len(self.known) > 50_000:
                        self.known = {"": (0,) * len(SAYS)}
                    says = self.known[stretch] = self.machine.best(stretch)[1]
                found = list(map(int.__add__, found, says))
        return found


def probability(counts: list[int] | np.ndarray, weights: np.ndarray) -> np.ndarray:
    x = np.log1p(np.atleast_2d(np.asarray(counts, dtype=float)))
    return 1.0 / (1.0 + np.exp(-(weights[0] + x @ weights[1:])))


def fit(counts: np.ndarray, toxic: np.ndarray, prior: np.ndarray = PRIOR, pull: float = 0.1, steps: int = 30) -> np.ndarray:
    """Logistic weights by Newton steps, drawn to the prior."""
    x = np.column_stack([np.ones(len(counts)), np.log1p(counts)])
    w = prior.astype(float).copy()
    for _ in range(steps if len(counts) else 0):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (toxic - p) - pull * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), gradient)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fold; a sample by hash of the id if there are more than sample_rows."""
    known = labels.filter(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("label_id"), "toxic").filter(crc_bucket("label_id", FOLDS) != 0)
    n = known.count()
    if n > sample_rows:
        known = known.filter(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    known = known.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "text").join(broadcast_if_small(known, min(n, sample_rows)), F.col("doc_id") == F.col("label_id")).select("text", "toxic")


def learned_insults(rows: DataFrame) -> list[str]:
    """Words, and stems with a star after them, that come in toxic texts and hardly in others. As many as the sample shows."""

    def make():
        def words(batch: pa.RecordBatch):
            seen: dict = defaultdict(lambda: [0, 0])
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
                for w in set(WORD.findall((text or "").lower())):
                    seen[w][1 if toxic else 0] += 1
            return Columns(word=list(seen), clean=[v[0] for v in seen.values()], toxic=[v[1] for v in seen.values()])

        return words

    counted = materialize(map_slices(rows, make, "word string, clean long, toxic long", 2048).groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-words")
    lengths = F.sequence(F.lit(STEM_LETTERS[0]), F.least(F.lit(STEM_LETTERS[1]), F.length("word")))
    stems = counted.filter(F.length("word") >= STEM_LETTERS[0]).select(F.explode(F.transform(lengths, lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("word"), "clean", "toxic").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    def clear(of: DataFrame, least: int) -> list[str]:
        chosen = of.filter((F.col("toxic") >= least + ODDS * F.col("clean")) & (F.length("word") >= 3))
        return sorted((r["word"] for r in chosen.select("word").collect()), key=lambda w: (len(w), w))  # bounded by the sample

    strong: set[str] = set()
    for stem in clear(stems, LEAST_STEM):  # shortest first
        if not any(stem[:n] in strong for n in range(STEM_LETTERS[0], len(stem))):
            strong.add(stem)
    words = [w for w in clear(counted, LEAST_WORD) if not any(w[:n] in strong for n in range(STEM_LETTERS[0], STEM_LETTERS[1] + 1))]
    return words + [k + "*" for k in sorted(strong)]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, rounds: int = 2) -> tuple[list[str], np.ndarray]:
    rows = materialize(training_rows(docs, labels, sample_rows), "toxicity-sample")
    learned, weights = learned_insults(rows), PRIOR
    for _ in range(rounds):

        def make(weights=weights):
            scanner = Scanner(learned, weights)

            def features(batch: pa.RecordBatch):
                return Columns(counts=[scanner.counts(t or "") for t in batch["text"].to_pylist()], toxic=batch["toxic"].cast(pa.int64()))

            return features

        got = map_slices(rows, make, "counts array<long>, toxic long").groupBy("counts", "toxic").agg(F.count("*").alias("n")).collect()  # bounded by the sample
        x = np.array([r["counts"] for r in got], dtype=float).reshape(-1, len(SAYS))
        n = np.array([r["n"] for r in got], dtype=int)
        y = np.array([1.0 if r["toxic"] else 0.0 for r in got])
        weights = fit(np.repeat(x, n, axis=0), np.repeat(y, n))
    return learned, weights


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, then the counts of what the clauses do."""
    learned, weights = train(docs, labels, sample_rows)
    schema = "doc_id long, held_out boolean, score double, predicted int, " + ", ".join(f"{n} long" for n in COUNTS)

    def make():
        scanner = Scanner(learned, weights)

        def judge(batch: pa.RecordBatch):
            counts = [scanner.counts(t or "") for t in batch["text"].to_pylist()]
            p = probability(counts, weights)
            columns = np.array(counts, dtype=np.int64).reshape(-1, len(SAYS)).T
            return Columns({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": p, "predicted": (p >= 0.5).astype(np.int32)} | dict(zip(COUNTS, columns)))

        return judge

    return map_slices(docs.select("doc_id", "text", (crc_bucket("doc_id", FOLDS) == 0).alias("held_out")), make, schema)


COUNTS = ("insults", "aimed_insults", "negated_insults", "reported_insults", "threats", "aimed_threats", "negated_threats", "reported_threats")


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that the grammar doesn't reject, with their own columns."""
    learned, weights = train(docs, labels, sample_rows)

    def make():
        scanner = Scanner(learned, weights)

        def keep(batch: pa.RecordBatch):
            p = probability([scanner.counts(t or "") for t in batch["text"].to_pylist()], weights)
            return batch.filter(pa.array(p < 0.5))

        return keep

    return map_slices(docs, make, docs.schema)
