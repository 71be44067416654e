"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

The fixed patterns (kinds assign, access, hex) find values behind credential names, access keys and long
hex runs. The token-efficiency test looks at every run of 16 or more key characters that mixes letters and
digits: a byte-pair vocabulary spells a word-like string with few tokens, but needs nearly a token for
every two characters of a random one. What has fewer than MOST_RATIO characters a token is a span of kind
"entropy". First known digests (hex of the usual digest lengths, labelled base64 digests) and UUIDs are cut out of
the run, with whatever label is before them; numbers, dates, paths and identifiers made of words are excluded. What
is left is tested whole, then in the parts between its separators and in overlapping windows, so that words beside a
key can't hide it, however long the run is; hits that meet become one span, and a window's hit takes the whole of
the parts that it begins and ends in.

Defined cases: a null text is empty and has no spans; offsets are code points, the end exclusive; spans of
one start are ordered assign, access, hex, entropy; rows that repeat give the same values; further columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from pledgework.llm.common import Columns, map_slices

#: The patterns of the base kinds.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGESTS = {32, 40, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
WORDS = re.compile(r"[A-Za-z]?[a-z]+|[A-Z]+|[0-9]+")
CREDENTIALS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
HAS_DIGIT, HAS_LETTER, MIXED = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]"), re.compile(r"[a-z][A-Z]+[a-z]+[A-Z]+[a-z]")
ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
MOST_RATIO = 2.0
LEAST, WINDOW, STEP = 16, 20, 4
PART = re.compile(r"[^/=_-]+")
#: base64 digests as they are labelled in web pages and lock files.
LABELLED = r"sha(?:256-[A-Za-z0-9+/]{43}=|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86}==)"
NO_SECRET = re.compile(rf"{LABELLED}|(?<![0-9a-fA-F]){UUID.pattern}(?![0-9a-fA-F])|(?<![A-Za-z0-9+])(?:[0-9a-f]+|[0-9A-F]+)(?![A-Za-z0-9+])")


def encoder(ranks: str):
    import public_tokenizers
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary


def known(run: str) -> bool:
    """Digests, UUIDs, numbers and identifiers made of words: strings that are long but no secret."""
    if not HAS_LETTER.search(run) or not HAS_DIGIT.search(run) and not MIXED.search(run):
        return True
    if UUID.fullmatch(run):
        return True
    if ALL_HEX.fullmatch(run) and len(run) in DIGESTS:
        return True
    parts = [p for p in re.split(r"[_/+=-]+", run) if p]
    longest = max((len(w) for w in WORDS.findall(run)), default=0)
    return len(parts) > 1 and all(p.isdigit() or p.isalpha() and (p.islower() or p.isupper() or p.istitle()) and len(p) < 20 for p in parts) or longest >= 0.5 * len(run)


def stretches(run: str) -> list[tuple[int, int]]:
    """What is left of a run without UUIDs and digests."""
    out, at = [], 0
    for m in NO_SECRET.finditer(run):
        if len(m.group()) in DIGESTS or not m.group().isalnum():
            out.append((at, m.start()))
            at = m.end()
    return [(a, b) for a, b in [*out, (at, len(run))] if b - a >= LEAST]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def random_spans(text: str, encode, most_ratio: float = MOST_RATIO) -> list[tuple[int, int]]:
    found = []

    def dense(part: str) -> bool:
        return len(part) >= LEAST and not known(part) and len(part) < most_ratio * len(encode(part))

    for m in RUN.finditer(text):
        at, run = m.start(), m.group()
        for a, b in stretches(run):
            part = run[a:b]
            if not HAS_LETTER.search(part) or not HAS_DIGIT.search(part) and not MIXED.search(part):
                continue
            if dense(part):
                found.append((at + a, at + b))
                continue
            parts = [(a + p.start(), a + p.end()) for p in PART.finditer(part)]
            hits = [(i, j) for i, j in parts if dense(run[i:j])]
            firsts, ends = [i for i, _ in parts], [j for _, j in parts]
            for i in sorted({*range(a, max(a, b - WINDOW) + 1, STEP), max(a, b - WINDOW)}):
                j = min(i + WINDOW, b)
                if dense(run[i:j]):
                    first, last = bisect_right(firsts, i) - 1, bisect_left(ends, j)
                    head = firsts[first] if first >= 0 and ends[first] > i else i
                    tail = ends[last] if last < len(ends) and firsts[last] < j else j
                    hits.append((head, tail))
            found += [(at + i, at + j) for i, j in merged(hits)]
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, ordered."""
    out, low = [], text.encode().lower()
    if any(name in low for name in CREDENTIALS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"akia" in low:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def scan(docs: DataFrame, ranks: str | None = None, most_ratio: float = MOST_RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans."""
    ranks = ranks or vocabulary()

    def make():
        encode = encoder(ranks)

        def find(batch: pa.RecordBatch):
            out = Columns(doc_id=batch["doc_id"], n_assign=[], n_access=[], n_hex=[], n_entropy=[], base_sha256=[], spans=[])
            for text in batch["text"].to_pylist():
                text = text or ""
                base = base_spans(text)
                more = [(a, 3, b) for a, b in random_spans(text, encode, most_ratio)]
                for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(s[1] == k for s in base))
                out["n_entropy"].append(len(more))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(sorted(base + more)))
            return out

        return find

    return map_slices(docs.select("doc_id", "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span's value replaced by <kind>; overlapping spans become one."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out.append(text[at:a] + f"<{KINDS[k]}>")
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, ranks: str | None = None, most_ratio: float = MOST_RATIO) -> DataFrame:
    """The same documents with every span cut from the text; n_chars follows where there is such a column."""
    ranks, schema = ranks or vocabulary(), docs.schema

    def make():
        encode = encoder(ranks)

        def clean(batch: pa.RecordBatch):
            cols = Columns({n: batch[n] for n in batch.schema.names})
            texts = []
            for text in batch["text"].to_pylist():
                if text:
                    spans = sorted(base_spans(text) + [(a, 3, b) for a, b in random_spans(text, encode, most_ratio)])
                    text = redact(text, spans) if spans else text
                texts.append(text)
            cols["text"] = texts
            if "n_chars" in cols:
                cols["n_chars"] = [n if t is None else len(t) for t, n in zip(texts, batch["n_chars"].to_pylist())]
            return cols

        return clean

    return map_slices(docs, make, schema)
