"""HTML extraction by minimum-cut labelling of a page's text blocks.

A page becomes blocks of text in order. A linear classifier gives each block a log-odds of being main text from its
own words, punctuation and links and from the elements around it; the two costs that follow are its capacities to the
source (content) and the sink (boilerplate). Neighbouring blocks, and blocks under the same parent, are joined by
smoothness edges that are stronger the closer the two lie in the tree. The minimum cut labels the blocks. The name of an
element speaks against it only where prose stands outside of it: the part that holds the page's prose is kept.

Defined results: null or empty html, and a page without main text, give an empty text; html of any length is read
whole; broken markup is read as far as it can be; repeated rows get equal results; an empty table gives no rows; a
block whose two costs tie, with no edge that decides, is boilerplate. Other columns stay, but one with the name of the
result is replaced and the page itself is dropped.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Element names by what they do to the text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template title textarea iframe object svg math canvas select button head datalist audio video".split())
RAW = frozenset("script style textarea title noscript iframe".split())
OUTSIDE = frozenset("nav footer aside menu dialog".split())
INSIDE = frozenset("article main".split())
#: An element of the first kind ends when one of the others begins.
CLOSED_BY = {"p": BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"])}
#: Words of class names, ids and roles that name parts of a page beside its text.
CUES = frozenset(
    "ad ads advert advertisement adverts advertising banner bar breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright disclaimer "
    "disqus feedback footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup privacy promo promoted promotion "
    "recommended related reply replies respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar warning widget widgets".split()
)

#: The same for names of the main part.
MAIN_CUES = frozenset("article body content entry main maincontent post prose story text".split())

# The classifier's weights, in log-odds, and the strength of the smoothness edges.
BIAS, PER_LOG_WORD, LINKED, SENTENCES, PARAGRAPH, HEADING, ITEM, WITHIN, BESIDE, PLAIN_CUE = -0.9, 0.55, -4.0, 0.6, 0.9, 0.4, -0.4, 3.0, -9.0, -5.0
NAMED_MAIN = 1.5
ADJACENT, SIBLING = 0.8, 0.5

#: A name speaks against an element only while at least this share of the prose that it would take away stands elsewhere.
ELSEWHERE = 0.2

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)", re.S)
#: In a tag: its end, or the quote that begins a value, in which > is no end.
TAG_STOP = re.compile(r">|=\s*+([\"'])")
#: Where the raw text of such an element ends. Searched in the page itself, as lower case can have other offsets.
RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)")
NAME_PART = re.compile(r"[A-Za-z]+")
SENTENCE_END = re.compile(r"[.!?…:;,](?=\s|$)")


class Element:
    """An open element. What its ancestors say is carried down when it opens, so no text walks up a deep page."""

    __slots__ = ("tag", "up", "depth", "cue", "name", "hidden", "linked", "block", "within", "main", "keeps", "against", "prose")

    def __init__(self, tag: str, up: Element | None, attributes: str = ""):
        self.tag, self.up, self.depth = tag, up, up.depth + 1 if up else 0
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
        parts = {p.lower() for k in ("class", "id", "role") for p in NAME_PART.findall(named.get(k, ""))}
        page = tag in ("html", "body")
        self.cue = bool(parts & CUES) and not page
        #: Siblings of one name are one part of the page.
        self.name = (id(up), tag, " ".join(sorted(parts)))
        #: Words of prose below, but for what parts with a name of their own hold.
        self.prose = 0
        unseen = tag in UNSEEN or bool(HIDDEN.search(attributes)) or "display:none" in named.get("style", "").replace(" ", "").lower()
        self.hidden = unseen or bool(up and up.hidden)
        self.linked = tag == "a" or bool(up and up.linked)
        self.block = self if tag in BLOCK or up is None else up.block
        self.within = tag in INSIDE and not self.cue or bool(up and up.within)
        self.main = bool(parts & MAIN_CUES) and not self.cue and not page or bool(up and up.main)
        #: Holds a headline or a main part, so that its own name doesn't speak against it.
        self.keeps = False
        #: What it and its ancestors add to the log-odds, once the page is read.
        self.against: float | None = 0.0 if up is None else None

    def own_weight(self) -> float:
        if self.tag in OUTSIDE or self.tag == "form" and not self.keeps or self.tag == "header" and not self.within:
            return BESIDE
        if self.cue and not self.keeps and self.tag != "h1":
            return BESIDE if self.tag in BLOCK else PLAIN_CUE
        return 0.0

    def weight(self) -> float:
        path, e = [], self
        while e.against is None:
            path.append(e)
            e = e.up
        for x in reversed(path):
            x.against = x.up.against + x.own_weight()
        return self.against


def end_of_tag(page: str, at: int, last: int) -> int:
    """Where the tag that began before `at` ends; -1 if it does not, or a quoted value in it never ends."""
    while m := TAG_STOP.search(page, at, last):
        if m[1] is None:
            return m.end()
        at = page.find(m[1], m.end(), last) + 1
        if not at:
            return -1
    return -1


class Block:
    __slots__ = ("text", "linked", "at", "tag")

    def __init__(self, text: str, linked: int, at: Element, tag: str):
        self.text, self.linked, self.at, self.tag = text, linked, at, tag


def blocks_of(page: str) -> list[Block]:
    """The page's visible text blocks in order. Inline elements don't end a block, and <br> is white space in it."""
    elements: list[Element] = []
    root = now = Element("", None)
    opened: Counter = Counter()
    out: list[Block] = []
    pieces: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, min(linked, len(text)), now.block, now.block.tag))
            pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not now.hidden:
            pieces.append(text)
            if now.linked:
                linked += len(text.strip())

    def close_one() -> None:
        nonlocal now
        opened[now.tag] -= 1
        now = now.up

    at, last, quotes = 0, page.rfind(">") + 1, True
    tail = page.find("<!--", last)
    tail = len(page) if tail < 0 else tail  # an unclosed comment runs to the end
    while m := MARKUP.search(page, at, last):
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        # A tag whose quotes leave it open to the page's end is broken, and so are quotes from here on: a tag then ends at
        # its first >. So no part of a page is scanned more than twice.
        end = end_of_tag(page, at, last) if quotes else -1
        if end < 0:
            quotes, end = False, page.find(">", at) + 1
        attributes, at = page[at : end - 1], end
        tag = m[2].lower()
        if tag in BLOCK:
            end_block()
        elif tag == "br":
            say(" ")
        if m[1]:
            if opened[tag] > 0:
                while now.tag != tag:
                    close_one()
                close_one()
            continue
        while now.up and tag in CLOSED_BY.get(now.tag, ()):
            close_one()
        if tag in BLOCK and now.block.tag == "p" and tag not in ("li", "dd", "dt", "td", "th", "tr"):
            inner = now.block
            while now is not inner.up:
                close_one()
        if tag in VOID or attributes.endswith("/"):
            continue
        now = Element(tag, now, attributes)
        elements.append(now)
        opened[tag] += 1
        if tag == "h1" or tag in INSIDE and not now.cue:
            e = now.up
            while e and not e.keeps:
                e.keeps = True
                e = e.up
        if tag in RAW:
            close = RAW_END[tag].search(page, at)
            at = close.start() if close else len(page)
    say(page[at:tail] if at <= tail else "")
    end_block()
    believe_names(elements, out)
    return out


def believe_names(elements: list[Element], blocks: list[Block]) -> None:
    """Takes back what a name says against an element that holds the page's prose, such as `layout-with-sidebar`.

    Where hardly any prose stands outside the named parts, the part with most of it is kept, whatever it is called."""
    named = [e for e in elements if e.cue and not e.keeps and e.own_weight() in (BESIDE, PLAIN_CUE) and e.tag not in OUTSIDE]
    if not named:
        return
    words: Counter = Counter()  # below an element, outside named parts, with or without sentences
    for b in blocks:
        if b.linked * 2 < len(b.text):
            words[id(b.at)] += (n := b.text.count(" ") + 1)
            b.at.prose += n if SENTENCE_END.search(b.text) else 0
    most, against = Counter(), set(map(id, named))
    inner: dict[int, int] = {}  # the most prose that one named part below an element holds
    parts: dict[tuple, list[Element]] = {}
    for e in reversed(elements):
        if id(e) in against:
            parts.setdefault(e.name, []).append(e)
            gain = max(e.prose, inner.get(id(e), 0))
            most[e.name] += gain
            inner[id(e.up)] = max(inner.get(id(e.up), 0), gain)
            continue
        inner[id(e.up)] = max(inner.get(id(e.up), 0), inner.get(id(e), 0))
        if e.own_weight() == 0:
            e.up.prose += e.prose
            words[id(e.up)] += words[id(e)]
    elsewhere = words[id(elements[0].up)]
    for e in named:
        if id(e) in against and elsewhere < ELSEWHERE * most[e.name]:
            for x in parts[e.name]:
                against.discard(id(x))
                x.keeps = True
                elsewhere += x.prose


def log_odds(b: Block) -> float:
    """Classifier: the log-odds that a block is main text."""
    words = b.text.count(" ") + 1
    score = BIAS + PER_LOG_WORD * math.log1p(words) + LINKED * b.linked / len(b.text) + SENTENCES * bool(SENTENCE_END.search(b.text))
    score += {"p": PARAGRAPH, "blockquote": PARAGRAPH, "pre": PARAGRAPH, "li": ITEM}.get(b.tag, HEADING if re.fullmatch("h[1-6]", b.tag) else 0)
    return score + (WITHIN if b.at.within else NAMED_MAIN * b.at.main) + b.at.weight()


def tree_distance(a: Element, b: Element, most: int = 12) -> int:
    """Steps through the tree from one element to the other, counted up to `most`."""
    steps = 0
    while a is not b and steps < most:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Undirected edges: each block with the next one, and with the next one under the same parent."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT / (1 + tree_distance(blocks[i - 1].at, b.at) / 2)))
        parent = id(b.at.up)
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, SIBLING))
        last[parent] = i
    return edges


def min_cut(content: list[float], boilerplate: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay on the source's side. content and boilerplate: the capacities from the source and to the sink.

    What flows straight through a node is taken off first; level graphs then carry the rest along the edges."""
    n = len(content)
    excess = [c - b for c, b in zip(content, boilerplate, strict=True)]
    near: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []
    for a, b, w in edges:
        near[a].append(len(head))
        near[b].append(len(head) + 1)
        head += [b, a]
        room += [w, w]
    tiny = 1e-12
    while True:
        level = [0 if e > tiny else -1 for e in excess]
        queue, reached = deque(i for i in range(n) if not level[i]), False
        while queue:
            i = queue.popleft()
            for k in near[i]:
                j = head[k]
                if room[k] > tiny and level[j] < 0:
                    level[j] = level[i] + 1
                    reached |= excess[j] < -tiny
                    queue.append(j)
        if not reached:
            return [v >= 0 for v in level]
        nxt = [0] * n
        for s in range(n):
            while excess[s] > tiny and level[s] == 0:
                path, i = [], s
                while True:
                    if excess[i] < -tiny:
                        flow = min(excess[s], -excess[i], *(room[k] for k in path))
                        for k in path:
                            room[k] -= flow
                            room[k ^ 1] += flow
                        excess[s] -= flow
                        excess[i] += flow
                        break
                    while nxt[i] < len(near[i]):
                        k = near[i][nxt[i]]
                        if room[k] > tiny and level[head[k]] == level[i] + 1:
                            break
                        nxt[i] += 1
                    if nxt[i] < len(near[i]):
                        path.append(near[i][nxt[i]])
                        i = head[path[-1]]
                    elif path:
                        k = path.pop()
                        i = head[k ^ 1]
                        nxt[i] += 1
                    else:
                        level[s] = -2
                        break


def main_text(page: str | None) -> str:
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    odds = [log_odds(b) for b in blocks]
    softplus = lambda x: max(x, 0.0) + math.log1p(math.exp(-abs(x)))
    keep = min_cut([softplus(x) for x in odds], [softplus(-x) for x in odds], smoothness(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract_text(df: DataFrame, page: str = "html", to: str = "text") -> DataFrame:
    """Adds the column `to` with each page's main text; the page itself is dropped."""
    return df.withColumn(to, F.arrow_udf(extract, "string")(F.col(page))).drop(page)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
