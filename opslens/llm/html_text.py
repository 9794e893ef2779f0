"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks (runs of text between block-level tags). A fixed
logistic classifier over a block's place and shape gives it a cost for being
called content and one for being called boilerplate: the capacities of its
edges to the two terminals. Blocks that follow each other, and blocks that are
next to each other among the children of one element, are tied by smoothness
edges, the stronger the closer they are in the tree. The minimum cut of that
graph (by maximum flow) is the labelling of least total cost. Blocks whose
terminal edge outweighs all their smoothness edges keep that label in some
minimum cut, so they are settled first and only the doubtful rest is run
through the flow.

A page that marks its main part (article, main) has its text there. On any
other page a block is taken for content unless its place or its links speak
against it, and if the cut still leaves nothing, all blocks are content that
are neither in a marked part beside the text nor links as a whole.

An element is beside the text when a whole name of its class or id says so:
``post-comments`` and ``sidebar-left`` do, ``tags-explained`` does not.

Work is per page, in the tasks that read the pages; nothing is shuffled. The
time for a page is linear in its tags, however deep they are nested.

Nulls and odd rows: null or empty html gives the empty text; broken markup is
read as far as it goes (unclosed and stray tags, truncated pages); repeated
rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.common import bound_batches, fresh, table

# Element names, class words and weights of the block classifier.
BLOCK_TAGS = frozenset("""address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup p pre section summary table
    tbody td tfoot th thead title tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("button canvas head iframe noscript object script select style svg template textarea title".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CONTENT_TAGS = frozenset({"article", "main"})
CHROME_TAGS = frozenset({"nav", "footer", "aside", "form", "menu", "dialog"})
CHROME_WORDS = frozenset("""ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie
    cookies copyright disqus feedback footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice
    notices pager pagination popup promo related reply replies respond search share sharing sidebar signup skip social sponsor
    sponsored subscribe subscription tags toolbar topbar widget widgets""".split())
#: Of an article, only words that make it a part beside the text, alone in a
#: name or with words for an item: class="category-legal" says what it is about.
BESIDE_WORDS = frozenset("""ad ads advert advertisement adverts comment comments disqus promo related replies reply respond sidebar
    sponsor sponsored teaser teasers widget widgets""".split())
ITEM_WORDS = frozenset("article block body box card content div entry inner item li list main node post row story text user wrapper".split())
#: Words that, beside those above, a name of a part beside the text is made of.
PLACE_WORDS = frozenset("""area bar bottom col column desktop fixed global group header home inline js large left link links main mobile
    module new overlay page panel placeholder primary recent right secondary section site slot small sticky sub top unit view
    wrap zone""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CHROME_ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
W_BASE, W_IN_CONTENT, W_OUTSIDE, W_UNMARKED, W_CHROME, W_PAGE_HEADER, W_LINKS, W_LENGTH, W_STOP = -0.6, 4.0, -4.0, 1.5, -9.0, -5.0, -3.0, 2.0, 0.4
TIE_FOLLOWS, TIE_SIBLING, TIE_NEAR = 0.3, 0.4, 0.6
SCALE = 1000

_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


#: What the elements around a block make it: in the main part; in a part beside
#: the text there; in one around the main part; in a page header; not shown.
IN_CONTENT, BESIDE, AROUND, HEADER, HIDDEN = 1, 2, 4, 8, 16


class Block(NamedTuple):
    """A run of text. ``shared`` of its ``depth`` open elements were open all
    the time since the block before it; ``parent`` numbers the last but one."""

    text: str
    link_chars: int
    marks: int
    depth: int
    shared: int
    parent: int


def _says(value: str, words: frozenset[str], others: frozenset[str]) -> bool:
    """Whether a name in ``value`` has one of ``words`` and none but ``others`` beside."""
    names = ({w.lower() for w in _WORDS.findall(part)} for part in value.split())
    return any(not words.isdisjoint(name) and name <= words | others for name in names)


class _Blocks(HTMLParser):
    """Collects the blocks of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, marks, number
        self.places: dict[str, list[int]] = {}  # of the open elements in the stack, by tag
        self.main_places: list[int] = []  # of those that a stray end tag does not close
        self.in_link = self.link_chars = self.numbers = 0
        self.shared = 1
        self.parts: list[str] = []
        self.found: list[Block] = []

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                depth = len(self.stack)
                self.found.append(Block(text, self.link_chars, self.stack[-1][1], depth, self.shared, self.stack[-2][2] if depth > 1 else 0))
                self.shared = depth
            self.parts, self.link_chars = [], 0

    @staticmethod
    def mark(tag: str, attrs) -> int:
        if tag in HIDDEN_TAGS:
            return HIDDEN
        if tag in CHROME_TAGS:
            return BESIDE
        for name, value in attrs:
            if value and (name == "class" or name == "id" and tag not in HEADINGS):  # a heading's id is made from its text
                if tag == "article":
                    if _says(value, BESIDE_WORDS, ITEM_WORDS):
                        return BESIDE
                elif tag not in ("html", "body", "main") and _says(value, CHROME_WORDS, ITEM_WORDS | PLACE_WORDS):
                    return BESIDE
            if value and name == "role":
                if value == "main":
                    return IN_CONTENT
                if value in CHROME_ROLES:
                    return BESIDE
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return BESIDE
        if tag in CONTENT_TAGS:
            return IN_CONTENT
        return HEADER if tag == "header" else 0

    def push(self, tag: str, mark: int):
        marks = self.stack[-1][1]
        if mark == IN_CONTENT and not marks & IN_CONTENT and marks & BESIDE:
            marks ^= BESIDE | AROUND
        self.numbers += 1
        self.places.setdefault(tag, []).append(len(self.stack))
        if mark == IN_CONTENT or tag in CONTENT_TAGS or tag in CHROME_TAGS:
            self.main_places.append(len(self.stack))
        self.stack.append((tag, marks | mark, self.numbers))

    def pop(self, i: int):
        """Close the elements from place ``i`` on."""
        while len(self.stack) > i:
            tag, *_ = self.stack.pop()
            at = self.places[tag].pop()
            if self.main_places and self.main_places[-1] == at:
                self.main_places.pop()
        self.shared = min(self.shared, i)

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.in_link = 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCK_TAGS:
            self.flush()
        elif tag not in HIDDEN_TAGS and not attrs:
            return
        if tag in VOID_TAGS or (tag == "body" and self.places.get("body")):
            return
        top = self.stack[-1][0]
        if top in CLOSES_ITSELF.get(tag, ()) or tag in BLOCK_TAGS and top == "p":
            self.pop(len(self.stack) - 1)
        if tag in BLOCK_TAGS and tag != "head" and self.stack[-1][0] == "head":  # a head that was not closed
            self.pop(len(self.stack) - 1)
        mark = self.mark(tag, attrs)
        if tag in BLOCK_TAGS or mark:
            self.push(tag, mark)

    def handle_endtag(self, tag):
        if tag == "a":
            self.in_link = 0
        if tag in BLOCK_TAGS:
            self.flush()
        at = self.places.get(tag)
        # a stray end tag does not close the page's main parts
        free = tag in ("body", "html") or tag in CONTENT_TAGS or tag in CHROME_TAGS
        if at and (free or not self.main_places or self.main_places[-1] <= at[-1]):
            self.pop(at[-1])

    def handle_data(self, data):
        if not self.stack[-1][1] & HIDDEN:
            self.parts.append(data)
            if self.in_link:
                self.link_chars += len(data)


def blocks(html: str) -> list[Block]:
    """The text blocks of a page, in page order."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.found


def score(block: Block, page_is_marked: bool) -> float:
    """Log-odds that a block is content."""
    text, links, marks = block.text, block.link_chars, block.marks
    inside = marks & IN_CONTENT
    s = W_BASE + W_LENGTH * (1 - math.exp(-len(text) / 80)) + W_LINKS * min(1.0, links / len(text)) + W_STOP * (text[-1] in ".!?…。")
    s += W_IN_CONTENT if inside else W_OUTSIDE if page_is_marked else W_UNMARKED
    if marks & BESIDE:
        s += W_CHROME
    elif marks & AROUND:
        s += W_CHROME / 2
    if marks & HEADER and not inside:
        s += W_PAGE_HEADER
    return s


def ties(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges (i, j, capacity) between blocks."""
    out = []
    last_child: dict[int, int] = {}
    for j, block in enumerate(found):
        if j:
            steps = found[j - 1].depth + block.depth - 2 * block.shared
            out.append((j - 1, j, int(SCALE * (TIE_FOLLOWS + TIE_NEAR / (1 + steps)))))
        if last_child.get(block.parent, j - 1) != j - 1:
            out.append((last_child[block.parent], j, int(SCALE * TIE_SIBLING)))
        last_child[block.parent] = j
    return out


def min_cut(unary: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels (True: content side) of a minimum cut. ``unary[i]`` > 0 is the
    capacity from the source to i, < 0 that from i to the sink."""
    n = len(unary)
    around: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        around[i][j] = around[i].get(j, 0) + c
        around[j][i] = around[j].get(i, 0) + c
    unary = list(unary)
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # settle what its neighbours cannot turn; a settled block pulls on the rest
        i = todo.popleft()
        if label[i] is None and abs(unary[i]) >= sum(around[i].values()):
            label[i] = unary[i] >= 0
            for j, c in around[i].items():
                unary[j] += c if label[i] else -c
                del around[j][i]
                todo.append(j)
            around[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _max_flow({i: unary[i] for i in rest}, {i: around[i] for i in rest})
        for i in rest:
            label[i] = i in side
    return [bool(x) for x in label]


def _max_flow(unary: dict[int, int], around: dict[int, dict[int, int]]) -> set[int]:
    """Nodes on the source side of a minimum cut (Dinic's algorithm)."""
    s, t = -1, -2
    cap: dict[int, dict[int, int]] = {i: dict(a) for i, a in around.items()}
    cap[s], cap[t] = {}, {}
    for i, u in unary.items():
        cap[s][i], cap[i][s] = max(u, 0), 0
        cap[i][t], cap[t][i] = max(-u, 0), 0
    while True:
        level = {s: 0}
        queue = deque([s])
        while queue:
            i = queue.popleft()
            for j, c in cap[i].items():
                if c > 0 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if t not in level:
            return set(level)
        nexts = {i: iter(list(cap[i])) for i in level}
        path = [s]
        while path:
            i = path[-1]
            if i == t:
                steps = list(zip(path, path[1:]))
                flow = min(cap[a][b] for a, b in steps)
                for a, b in steps:
                    cap[a][b] -= flow
                    cap[b][a] = cap[b].get(a, 0) + flow
                cutoff = next(k for k, (a, b) in enumerate(steps) if not cap[a][b])
                nexts[path[cutoff]] = iter(list(cap[path[cutoff]]))
                del path[cutoff + 1:]
                continue
            for j in nexts[i]:
                if cap[i][j] > 0 and level.get(j, -1) == level[i] + 1:
                    path.append(j)
                    break
            else:
                path.pop()


def label_blocks(found: list[Block]) -> list[bool]:
    marked = any(b.marks & IN_CONTENT and not b.marks & BESIDE for b in found)
    labels = min_cut([int(SCALE * score(b, marked)) for b in found], ties(found))
    if not any(labels):
        labels = [not b.marks & (BESIDE | HEADER) and b.link_chars < len(b.text) for b in found]
    return labels


def main_text(html: str | None) -> str:
    """Content blocks of a page, joined by newlines."""
    found = blocks(html or "")
    return "\n".join(b.text for b, keep in zip(found, label_blocks(found), strict=True) if keep)


def extract(pages: DataFrame, html: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with a column (its name is returned) of the main text."""
    bound_batches(pages.sparkSession)
    name, = fresh(pages, "main_text")
    at = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(v.as_py()) for v in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{fields}, {name} string"), name


def query(spark, sf_dir: str) -> DataFrame:
    out, text = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col(text).alias("text"), F.char_length(text).cast("long").alias("n_chars"))
