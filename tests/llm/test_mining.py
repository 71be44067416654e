"""Page text by minimum cut, product codes by kept sums, phrases by sorted suffixes: against brute force, with nulls, ties, repeats, empty tables and extra columns."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict
from math import floor

import numpy as np
import pytest

from pledgework.llm import codebooks, collocations, mincut

# ---- page text

PAGES = "page_id long, url string, html string, text string, n_chars string"
STORY = "This long paragraph of the article tells the story in full, with commas and a proper end."
PAGE = f"""<!DOCTYPE html><html><head><title>Title &amp; more</title><script>var t="</p>";</script><style>p{{}}</style></head><body class="has-sidebar">
<div id="cookie-banner"><p>We use cookies. Please accept them all today, thank you very much.</p><button>OK</button></div>
<header class="site-header"><div class="logo">Site</div><ul class="menu"><li><a href=a>Home</a></li><li><a href="b>c">News of the day</a></li></ul></header>
<div id="content"><h1>A heading</h1><p>{STORY}<p>Yes.<div class="ad-slot"><p>Buy our very good things now, they are so very cheap today.</p></div>
<p>Fish &amp; chips&nbsp;cost &lt;5&#8364; <b>to</b>day<br>only, they say in <a href=x>town</a>.</p><!-- <p>no</p> --><ul><li>First item</li><li>Second item</li></ul>
<form class="newsletter"><label>Your mail</label><select><option>one</option></select></form></div>
<aside class="sidebar"><h3>Related</h3><p>Some other story that is long enough to be a paragraph of text here.</p></aside>
<section id="comments"><article class="comment"><p>I liked the article very much, it was a long and good read.</p></article></section>
<footer><p>Copyright 2024 Site. All rights reserved.</p></footer></body></html>"""
TEXT = f"A heading {STORY} Yes. Fish & chips cost <5€ today only, they say in town. First item Second item"


def test_content_of_a_page_without_an_article_element(spark):
    rows = [(1, "u", PAGE, "a", "b"), (None, None, None, None, None), (3, "u", "", None, None), (4, "v", PAGE, None, None), (4, "v", PAGE, None, None), (5, "w", f"<main><p>{STORY}", None, None), (6, "x", "<p>cut <a hre", None, None)]
    got = mincut.extract(spark.createDataFrame(rows, PAGES))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    by_id = Counter((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got.collect())
    assert by_id[(1, "u", TEXT, len(TEXT))] == 1 and by_id[(4, "v", TEXT, len(TEXT))] == 2
    assert by_id[(None, None, "", 0)] == 1 and by_id[(3, "u", "", 0)] == 1 and by_id[(5, "w", STORY, len(STORY))] == 1
    assert mincut.extract(spark.createDataFrame([], PAGES)).collect() == []


def test_broken_and_deep_markup_ends(spark):
    for page in ("<" * 5000, "<a '" * 3000, "<div>" * 20000 + "x", '<p class="' * 2000 + ">", "<!--" * 3000, "<script>" * 100, "</p>" * 3000 + "a < b > c", "&#0;&#xD800;&bogus;"):
        for b in mincut.blocks(page):
            assert b.text
    assert [b.text for b in mincut.blocks("<p>1 < 2 &am</p><script>x</script >y<SCRIPT>z</Script>")] == ["1 < 2 &am", "y"]


def test_max_flow_gives_the_cheapest_labelling():
    """Against all labellings of small graphs, ties to the sink's side."""
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randint(1, 9)
        source, sink = ([rng.randint(0, 6) for _ in range(n)] for _ in range(2))
        edges = [(a, b, rng.randint(0, 5)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        cost = lambda on: sum(sink[i] if on[i] else source[i] for i in range(n)) + sum(c for a, b, c in edges if on[a] != on[b])  # noqa: E731, B023
        every = list(itertools.product([False, True], repeat=n))
        least = min(map(cost, every))
        best = [x for x in every if cost(x) == least]
        got = tuple(mincut.max_flow_side(n, source, sink, edges))
        assert got in best
        assert sum(got) == min(map(sum, best))


def test_a_short_line_follows_its_neighbours():
    weights = np.array(list(mincut.TEXT.values()))
    found = mincut.blocks(f"<div><div>{STORY}</div><div>Well</div><div>{STORY}</div></div>")
    alone = np.array([mincut.features(b) for b in found]) @ weights
    assert alone[1] < 0 and mincut.labelled(found, weights) == [True, True, True]


# ---- product codes


def plain_codes(vectors, entries, rounds):
    """vectors: rows of whole numbers in the order of their ids."""
    width = -(-len(vectors[0]) // 16)
    parts = [[(list(v) + [0] * (16 * width - len(v)))[p * width : (p + 1) * width] for p in range(16)] for v in vectors]
    books = [[list(v[p]) for v in parts[:entries]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min(range(len(books[p])), key=lambda e: (far(v[p], books[p][e]), e))
    for _ in range(rounds):
        codes = [[near(v, p) for p in range(16)] for v in parts]
        for p in range(16):
            for e in range(len(books[p])):
                own = [v[p] for v, c in zip(parts, codes) if c[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    codes = [[near(v, p) for p in range(16)] for v in parts]
    errors = [sum(far(v[p], books[p][c[p]]) for p in range(16)) for v, c in zip(parts, codes)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return ["".join(f"{x:02x}" for x in c) for c in codes], errors, digest


@pytest.mark.parametrize("size, scale", [(16, 1.0), (40, 3.0), (32, 1e19)])
def test_codes_equal_a_plain_loop(spark, size, scale):
    """Negative numbers, ties, lengths that 16 doesn't divide and numbers whose squares pass 64 bits."""
    rng = np.random.default_rng(3)
    rows = [(int(i) * 3, (rng.integers(-4, 5, size) * scale / 7).astype(np.float32).tolist(), int(i) % 3 if i % 4 else None) for i in rng.permutation(90)]
    bad = [(1, None, 1), (2, [None] + rows[0][1][1:], 1), (4, [float("nan")] * size, 1), (5, [float("inf")] * size, 1), (271, [0.5] * (size + 1), 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<float>, label int, code string").repartition(5)
    got = {r["vec_id"]: r for r in codebooks.compress(df, entries=8).collect()}
    rows.sort()
    codes, errors, digest = plain_codes([[floor(256 * float(x)) for x in r[1]] for r in rows], 8, 2)
    assert sorted(got) == [r[0] for r in rows]
    labels = defaultdict(int)
    for r, e in zip(rows, errors):
        labels[r[2]] += e
    fits = lambda e: e if e < 1 << 63 else None
    for r, c, e in zip(rows, codes, errors):
        assert (got[r[0]]["code"], got[r[0]]["error"], got[r[0]]["codebooks_sha256"]) == (c, fits(e), digest)
        if scale < 1e9:
            assert got[r[0]]["label_error"] == labels[r[2]]


def test_only_changed_parts_are_added_and_taken(spark):
    entries = np.zeros((16, 2, 1), np.int64)
    entries[:, 1] = 256
    rows = spark.createDataFrame([(1, None, [0.0] * 16, None), (2, None, [1.0] * 16, bytes([1] * 16)), (3, None, [1.0] * 15 + [0.0], bytes([1] * 16))], "vec_id long, label int, x array<double>, codes binary")
    written = codebooks.assigned(rows, entries)
    sums = {(r["part"], r["entry"]): (int(r["high"]) << 62) + int(r["low"]) for r in codebooks.differences(written, 1).collect()}
    counts = {(r["part"], r["entry"]): r["n"] for r in codebooks.differences(written, 1).collect()}
    assert counts == {**{(p, 0): 1 for p in range(15)}, (15, 0): 2, (15, 1): -1} and set(sums.values()) == {0}


def test_codes_of_no_few_and_repeated_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert codebooks.compress(spark.createDataFrame([], kind)).collect() == []
    got = codebooks.compress(spark.createDataFrame([(None, [1.0] * 16, None), (7, [2.0] * 16, 1), (7, [2.0] * 16, 1)], kind)).collect()
    assert sorted((r["vec_id"] or 0, r["code"], r["error"], r["label_error"]) for r in got) == [(0, "02" * 16, 0, 0), (7, "00" * 16, 0, 0), (7, "00" * 16, 0, 0)]


# ---- phrases

DOCS = "doc_id long, text string, lang string, n long, rank string"


def plain_phrases(rows, least=10, top=2000):
    f, total = defaultdict(Counter), Counter()
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(fold)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for i in range(len(words)):
                for m in (1, 2, 3):
                    if i + m <= len(words):
                        f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


def hard_texts():
    rng = random.Random(5)
    words = ["the", "The", "of", "a", "é", "\x00", "\x01", "\x01\x00x", "the\x01", "zz", "　", "\U0001f600"]
    texts = [" ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 60))) + rng.choice([".", "\n", "", "\t\t", " \r\n!"]) for _ in range(120)]
    return [None, "", "  \t ", ".,;", "the of a " * 800, "w " * 3000, *texts, *texts[:20]]


def test_phrases_equal_a_plain_count(spark):
    rows = [(i % 50, t, [None, "en", "de", "und", ""][i % 5], i, "x") for i, t in enumerate(hard_texts())]
    df = spark.createDataFrame(rows, DOCS).repartition(7)
    got = collocations.collocations(df)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows)
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []


def test_chunks_of_any_size_give_each_start_once():
    rng = random.Random(2)
    data = collocations.folded("".join(rng.choice("ab \n..\tcd") for _ in range(400)) + "x" * 90 + " tail of it")
    whole = Counter()
    for size in (7, 40, 10_000):
        found = Counter()
        for tokens, own in collocations.chunks(data, size):
            for i in range(own):
                if tokens[i] != b"\x00":
                    rest = list(itertools.takewhile(lambda w: w != b"\x00", tokens[i : i + 3]))
                    found[tuple(rest)] += 1
        whole = whole or found
        assert found == whole


def test_hot_words_and_pairs_are_counted_in_parts(spark):
    """A pair that starts most suffixes is dealt by three words; its own count and its first word's come out whole."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"so it w{rng.randint(0, 40)}" for _ in range(30)), "en", 0, "") for i in range(60)]
    df = spark.createDataFrame(rows, DOCS).repartition(6)
    hot = collocations.hot_prefixes(df)
    assert b"so" in hot["en"][0] and (b"so", b"it") in hot["en"][1]
    keys = collocations.suffixes(df, hot).where("suffix like 'en\x00so\x00it\x00%'").select("key").distinct().count()
    assert keys > 20
    assert sorted(map(tuple, collocations.collocations(df).collect())) == plain_phrases(rows)
    assert collocations.collocations(df, top=5).count() == 5
