"""Main text of web pages by a minimum cut between content and boilerplate.

A page is read into text blocks with the elements that hold them. A logistic classifier gives each block the cost of either label
from its text (length, links, sentence ends) and from what its elements are called; the costs are the capacities of
its edges to the two terminals. Smoothness edges tie a block to the next one of the page, the weaker the more elements end or begin
between them, and to the next one of the same element, whatever stands between. The minimum cut, found by max-flow, labels
the page's blocks together, so that a short line among paragraphs stays and a long one among menus goes.

The classifier starts from stated weights and is fitted to the pages themselves: blocks of pages that mark their article are
labelled by the mark, and features of text only are fitted to them, on a sample bounded by SAMPLE_PAGES and
SAMPLE_BLOCKS, with the stated weights as the centre of their prior and TRUST as the weight of all labels together.

Defined cases: a null or empty page has no text; character references are decoded once; a comment, script or style that
never ends reaches to the end of the page, a tag that never ends is left out; equal pages give equal texts; ties of the cut go to
boilerplate; a null id or url stays; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import html as html_
import math
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pledgework.llm.common import Columns, map_slices

#: Pages and blocks a page that the classifier is fitted on at most, and how many of the labels' votes all of them together have.
SAMPLE_PAGES, SAMPLE_BLOCKS, TRUST = 1000, 32, 20.0
#: Strength of a smoothness edge between neighbours in one element, and of one between blocks of one element with others between.
NEXT, SIBLING = 1.0, 0.8

#: Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noembed noframes xmp svg math object canvas audio video title textarea select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img nobr".split())
CLOSED_BY = {"p": frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt td th tr tbody body".split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]), "th": frozenset(["td", "th", "tr", "tbody", "tfoot"])}
CLOSED_BY["head"] = CLOSED_BY["p"] | {"p"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: What elements are called, by class, id, role or name, in the words of the web.
CALLED = {
    "main": "article main articlebody",
    "body": "content contents entry post story text body prose copy maincontent blogpost",
    "menu": "nav navigation navbar menu menubar topnav subnav breadcrumb breadcrumbs pager pagination toc tabs toolbar skip sitemap",
    "side": "sidebar aside complementary rail widget widgets related recommended recommendations popular trending teaser teasers tagcloud",
    "head": "header masthead banner topbar branding logo siteheader pageheader",
    "foot": "footer contentinfo copyright colophon legal credits disclaimer sitefooter pagefooter imprint",
    "reply": "comment comments commentlist disqus reply replies respond discussion reactions",
    "ad": "ad ads adv advert adverts advertisement advertisements advertising adsense adbox banner-ad sponsor sponsored sponsors promo promos promotion promotions dfp outbrain taboola affiliate",
    "notice": "cookie cookies consent gdpr notice notices notification notifications alert alerts warning popup modal overlay dialog newsletter subscribe subscription paywall signup toast interstitial announcement",
    "share": "share sharing social tags taglist author byline meta metadata postmeta rating print vcard",
    "form": "form search searchbox searchform login register contact survey poll",
    "hidden": "hidden invisible hide",
}
CALLS = {word: kind for kind, words in CALLED.items() for word in words.split()}
TAGS = {"article": "main", "main": "main", "nav": "menu", "menu": "menu", "aside": "side", "header": "head", "footer": "foot", "form": "form", "button": "form", "fieldset": "form", "legend": "form", "dialog": "notice"}
KINDS = tuple(CALLED)
#: Features of a block's text, then one for each kind of its elements; weights of content against boilerplate before any fitting.
TEXT = {"one": -1.2, "long": 0.55, "linked": -3.0, "sentence": 0.7, "paragraph": 0.8, "heading": 0.3, "listed": -0.3}
ELEMENTS = {"main": 4.0, "body": 1.5, "menu": -9.0, "side": -9.0, "head": -4.5, "foot": -9.0, "reply": -10.0, "ad": -10.0, "notice": -10.0, "share": -7.0, "form": -7.0, "hidden": -10.0}
#: A header within the article says little.
IN_ARTICLE = {"head": -0.5}

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-hidden|style|hidden)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?", re.I)
PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ENDS = re.compile(r"""[.!?…:]["'”’»)]*$""")
NO_DISPLAY = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    __slots__ = ("depth", "kinds", "linked", "parent", "tag", "text")

    def __init__(self, text: str, linked: int, parent: int, kinds: frozenset, depth: int, tag: str):
        self.text, self.linked, self.parent, self.kinds, self.depth, self.tag = text, linked, parent, kinds, depth, tag


def called(name: str, attributes: str) -> frozenset:
    """The kinds that an element's name and attributes say."""
    kinds = {TAGS[name]} if name in TAGS else set()
    if attributes and name not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "hidden" and not m[2] or key == "aria-hidden" and value.lower() == "true" or key == "style" and NO_DISPLAY.search(value):
                kinds.add("hidden")
            elif key in ("class", "id", "role", "itemprop"):
                for word in value.split():
                    whole = re.sub(r"[^a-z]", "", word.lower())
                    pieces = [p.lower() for p in PIECES.findall(word)]
                    if pieces[:1] in (["has"], ["no"], ["with"], ["js"], ["is"]) and whole not in CALLS:
                        continue
                    kinds.update(CALLS[p] for p in (whole, *pieces) if p in CALLS)
    return frozenset(kinds)


def blocks(page: str) -> list[Block]:
    """The text blocks in the page's order: runs of text that no element but an inline one interrupts."""
    out: list[Block] = []
    stack: list[tuple[str, int, frozenset]] = [("", 0, frozenset())]  # open elements but inline ones: name, number, kinds of all
    opened: dict[str, int] = {}
    text: list[str] = []
    numbers, links, linked, at, broken = 0, 0, 0, 0, False

    def end_block() -> None:
        nonlocal linked
        joined = " ".join(html_.unescape("".join(text)).split()) if text else ""
        if joined:
            name, _, kinds = stack[-1]
            out.append(Block(joined, min(linked, len(joined)), stack[max(0, len(stack) - 2)][1], kinds, len(stack), name))
        text.clear()
        linked = 0

    def pop(name: str) -> None:
        while True:
            gone = stack.pop()[0]
            opened[gone] -= 1
            if gone == name:
                return

    size, last = len(page), page.rfind(">")
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            if "head" not in opened or not opened["head"]:
                text.append(page[at:lt])
                linked += lt - at if links else 0
            at = lt
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        follows = page[at + 1 : at + 2]
        if follows in ("!", "?") or follows == "/" and not page[at + 2 : at + 3].isalpha():
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        m = None
        if at < last and (follows.isalpha() or follows == "/"):
            m = None if broken else TAG.match(page, at)
            if not m:
                broken, m = True, PLAIN_TAG.match(page, at)
        if not m:
            if at >= last and (follows == "/" or follows.isalpha() and follows.isascii()):
                break  # a tag that never ends
            text.append("<")
            at += 1
            continue
        at, closing, name, attributes = m.end(), m[1], m[2].lower(), m[3]
        if name == "br":
            text.append(" ")
        elif closing:
            if name == "a":
                links = max(0, links - 1)
            elif name not in INLINE and opened.get(name):
                end_block()
                pop(name)
            elif name == "p":
                end_block()
        elif name in RAW:
            if name not in ("svg", "math") or not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                at = page.find(">", end.start()) + 1 or size if end else size
            text.append(" " if name in ("select", "textarea", "datalist", "object", "iframe", "video", "audio") else "")
        elif name in VOID:
            if name == "hr":
                end_block()
        elif name in INLINE:
            links += name == "a"
        else:
            end_block()
            while len(stack) > 1 and name in CLOSED_BY.get(stack[-1][0], ()):
                pop(stack[-1][0])
            numbers += 1
            own, kinds = called(name, attributes), stack[-1][2]
            kinds = (kinds - {"form"} if "main" in own else kinds) | own  # a form around the article says nothing about it
            stack.append((name, numbers, kinds))
            opened[name] = opened.get(name, 0) + 1
    end_block()
    return out


def features(b: Block) -> list[float]:
    """Features of a block's text, in the order of TEXT."""
    linked = b.linked / len(b.text)
    return [1.0, min(math.log1p(len(b.text)), 7.0) / 2 * (1 - min(linked, 1.0)), linked, float(bool(ENDS.search(b.text))), float(b.tag == "p"), float(b.tag in HEADINGS), float(b.tag in ("li", "td", "th", "option", "dt"))]


def element_score(kinds: frozenset) -> float:
    inside = "main" in kinds
    return sum(IN_ARTICLE.get(k, ELEMENTS[k]) if inside else ELEMENTS[k] for k in kinds)


def max_flow_side(n: int, source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The nodes on the source's side of the minimum cut with fewest such nodes. source, sink: capacities of the nodes' terminal
    edges; edges: (a, b, capacity of either direction).

    What goes straight through a node is left out, and nodes whose terminal outweighs all their edges are settled first, which
    leaves small graphs; blocking flows over levels (shortest ways first) then find the flow.
    """
    net = [a - b for a, b in zip(source, sink)]
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
    free = [sum(c for _, c in x) for x in near]
    side: list[bool | None] = [None] * n
    ready = deque(i for i in range(n) if abs(net[i]) > free[i] or not free[i])
    while ready:
        i = ready.popleft()
        if side[i] is not None:
            continue
        side[i] = net[i] > 0
        for j, c in near[i]:
            if side[j] is None:
                net[j] += c if side[i] else -c
                free[j] -= c
                if abs(net[j]) > free[j] or not free[j]:
                    ready.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if rest:
        number = {i: k for k, i in enumerate(rest)}
        s, t = len(rest), len(rest) + 1
        to, room, out = [], [], [[] for _ in range(t + 1)]

        def edge(a: int, b: int, there: int, back: int) -> None:
            out[a].append(len(to))
            to.append(b)
            room.append(there)
            out[b].append(len(to))
            to.append(a)
            room.append(back)

        for i in rest:
            if net[i] > 0:
                edge(s, number[i], net[i], 0)
            elif net[i] < 0:
                edge(number[i], t, -net[i], 0)
            for j, c in near[i]:
                if j > i and j in number:
                    edge(number[i], number[j], c, c)
        while True:
            level = [-1] * (t + 1)
            level[s], ways = 0, deque([s])
            while ways:
                a = ways.popleft()
                for e in out[a]:
                    if room[e] and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        ways.append(to[e])
            if level[t] < 0:
                break
            tried, path, a = [0] * (t + 1), [], s
            while True:  # one blocking flow, depth first, without recursion
                if a == t:
                    least = min(room[e] for e in path)
                    for k, e in enumerate(path):
                        room[e] -= least
                        room[e ^ 1] += least
                    cut = next(k for k, e in enumerate(path) if not room[e])
                    a = to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while tried[a] < len(out[a]) and not (room[out[a][tried[a]]] and level[to[out[a][tried[a]]]] == level[a] + 1):
                    tried[a] += 1
                if tried[a] < len(out[a]):
                    path.append(out[a][tried[a]])
                    a = to[path[-1]]
                elif a == s:
                    break
                else:
                    a = to[path.pop() ^ 1]
                    tried[a] += 1
        for i in rest:
            side[i] = level[number[i]] >= 0
    return [bool(x) for x in side]


def labelled(found: list[Block], weights: np.ndarray) -> list[bool]:
    """True for the blocks on the content side of the page's minimum cut."""
    if not found:
        return []
    scores = np.array([features(b) for b in found]) @ weights + [element_score(b.kinds) for b in found]
    costs = np.logaddexp(0, np.stack([-scores, scores])) * 1000  # of the label content, of the label boilerplate
    content, boilerplate = np.rint(costs).astype(np.int64).tolist()
    edges, before = [], {}
    for i, b in enumerate(found):
        if i:
            other = found[i - 1]
            apart = (1 if b.parent == other.parent else 2 + abs(b.depth - other.depth)) + 4 * len(b.kinds ^ other.kinds)
            edges.append((i - 1, i, round(1000 * NEXT / (1 + apart))))
        if before.get(b.parent, i) < i - 1:
            edges.append((before[b.parent], i, round(1000 * SIBLING / 2)))
        before[b.parent] = i
    return max_flow_side(len(found), boilerplate, content, edges)


def sample_rows(pages: DataFrame) -> list[tuple[bool, list[float]]]:
    """Labels and features of blocks of pages that mark their article: SAMPLE_PAGES pages at most, SAMPLE_BLOCKS blocks of each."""

    def make():
        def read(batch: pa.RecordBatch):
            out = []
            for page in batch["html"].to_pylist():
                found = blocks(page or "")
                if any("main" in b.kinds for b in found):
                    step = max(1, len(found) // SAMPLE_BLOCKS)
                    out.append([float(x) for b in found[::step][:SAMPLE_BLOCKS] for x in (element_score(b.kinds) > 0, *features(b))])
            return Columns(values=out)

        return read

    rows = pages.count()
    taken = pages.where(F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 20)) < F.lit(int(SAMPLE_PAGES / rows * (1 << 20)))) if rows > SAMPLE_PAGES else pages
    found = map_slices(taken.select("html"), make, "values array<double>", 16).limit(2 * SAMPLE_PAGES).collect()
    size = len(TEXT) + 1
    return [(r["values"][k] > 0, r["values"][k + 1 : k + size]) for r in found for k in range(0, len(r["values"]), size)]


def fitted(rows: list[tuple[bool, list[float]]], rounds: int = 12) -> np.ndarray:
    """Weights of the text's features: the most likely ones under a prior of unit variance about the stated weights. Newton's method."""
    start = np.array(list(TEXT.values()))
    if not rows:
        return start
    rows = sorted(rows)  # so that the order of tasks doesn't show in the last digits
    y, x = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    each = min(1.0, TRUST / len(rows))
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = each * x.T @ (y - p) - (w - start)
        bend = each * (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return np.round(w, 6)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (content blocks in page order, joined by a space), n_chars; see the module's text."""
    weights = fitted(sample_rows(pages))

    def make():
        def read(batch: pa.RecordBatch):
            texts = []
            for page in batch["html"].to_pylist():
                found = blocks(page or "")
                texts.append(" ".join(b.text for b, kept in zip(found, labelled(found, weights)) if kept))
            return Columns(page_id=batch["page_id"], url=batch["url"], text=texts, n_chars=[len(t) for t in texts])

        return read

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return map_slices(pages.select("page_id", "url", "html"), make, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long", 64)
