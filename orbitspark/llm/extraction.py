"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is read into blocks, each with its open elements. A linear classifier over a block's containers, link share,
length and punctuation gives a logit; its soft costs are the capacities to the two terminals, content and boilerplate.
Blocks next to each other, and blocks that follow one another in one container, are tied by edges that weaken with
their distance in the document tree. The minimum cut, found by maximum flow, is the labelling of least total cost: short
lines that the classifier alone would drop stay with the paragraphs around them, and the other way round. Containers
that name themselves (article, nav, a class of adverts) weigh more than edges can, so that the cut decides the rest.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that end a block, hold no text, never close, and stand for boilerplate.
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = set("script style noscript template svg iframe object select option textarea button input math canvas audio video title head".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILER = set("nav header footer aside form menu dialog fieldset".split())
#: Elements whose text the tokeniser skips up to their end tag.
RAW = "script|style|noscript|template|textarea|title|iframe|svg"
#: Attributes of a tag, and its end. A quote opens a value only after "="; one that never closes is a plain character. Nothing
#: is tried twice, so that reading is linear in the page whatever it holds; a tag that the page cuts off takes the rest.
INSIDE = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+"""
TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b{INSIDE}(?:>|\Z).*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>{INSIDE})(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Names (of classes, ids, roles) of containers: parts that speak against or for content.
AGAINST = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|side-?bar|side|widgets?|related|recommend\w*|share|sharing|social|menu|nav\w*|breadcrumbs?|foot(?:er)?|head(?:er|bar)?|masthead|topbar|comments?|comment-?list|replies|reply|respond|disqus|newsletter|subscribe|signup|login|search|toc|pagination|pager|tags?|copyright|legal|disclaimer|toolbar|skip\w*|form|contentinfo|complementary|navigation)(?:$|[^a-z])"
)
FOR = re.compile(r"(?:^|[^a-z])(?:article\w*|content|post|entry|body|main|story|text|prose)(?:$|[^a-z])")
#: Names that say what a page or part allows or has, not what it is.
STATE = re.compile(r"(?:^|(?<=\s))(?:(?:has|with|without|no|show|hide|is|are|can)[-_][\w-]+|[\w-]+[-_](?:open|closed|enabled|disabled|active|allowed|on|off))(?=\s|$)")
#: Names of parts that stay out however much text they hold, unless most of the page, its article too, is in them.
NEVER = re.compile(r"(?:^|[^a-z])(?:comments?|comment-?list|replies|reply|respond|disqus)(?:$|[^a-z])")
#: The classifier: weights of a container's evidence, and of a block's own.
SECTION, BOILERPLATE, NAMED_AGAINST, NAMED_FOR = 5.0, -9.0, -9.0, 1.5
BIAS, BY_LENGTH, MOST_LENGTH, LINKED, ENDED, HEADED, LEGAL, UNSEEN = -1.0, 1 / 80, 2.5, -4.0, 0.5, 0.5, -3.0, -60.0
#: Weight of an edge between neighbours, halved by each step between them in the tree, and of one between blocks that
#: follow one another in a container.
BESIDE, AKIN = 4.0, 1.0
#: What notices and forms say, with whatever names.
NOTICE = re.compile(
    r"\b(?:(?:we|site|website|page) uses? cookies|(?:accept|allow|reject) (?:all )?cookies|cookie (?:policy|settings|preferences)|your (?:e-?mail address|email) will not be (?:published|shared)|(?:leave|post|write|add) a (?:comment|reply)|"
    r"(?:sign up|subscribe) (?:for|to) (?:our|the) newsletter|verwende[nt] cookies|utilis(?:e|ons) des cookies|utiliza(?:mos)? cookies)\b", re.I
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A wrapper that holds more than this share of a page's unlinked text is the page's frame, and its name says nothing.
FRAME = 0.5


class Node:
    """An open element: its parent, depth, evidence and what voids it, unlinked characters within, whether an article is within, and what its ancestors and it say."""

    __slots__ = ("tag", "parent", "depth", "evidence", "damped", "mass", "holds", "logit")

    def __init__(self, tag: str, parent: Node | None, evidence: float = 0.0, damped: str = ""):
        self.tag, self.parent, self.evidence, self.damped = tag, parent, evidence, damped
        self.depth, self.mass, self.holds, self.logit = parent.depth + 1 if parent else 0, 0, False, 0.0


class Block:
    __slots__ = ("text", "linked", "node")

    def __init__(self, text: str, linked: int, node: Node):
        self.text, self.linked, self.node = text, linked, node


def evidence_of(tag: str, names: str, inside_content: bool) -> tuple[float, str]:
    """What an open element says of the blocks in it, and when that is void: if it is the page's "frame", or a "wrapper" of its article too."""
    if tag in SILENT:
        return UNSEEN, ""
    names = STATE.sub(" ", names) if names and tag not in ("body", "html") else ""
    if names and NEVER.search(names):
        return NAMED_AGAINST, "wrapper"
    if tag in ("article", "main"):
        return SECTION, ""
    if tag in BOILER:
        return -2.0 if tag == "header" and inside_content else BOILERPLATE, "frame" if tag == "form" else ""
    if names:
        if AGAINST.search(names):
            return NAMED_AGAINST, "frame"
        if FOR.search(names):
            return NAMED_FOR, ""
    return 0.0, ""


def blocks_of(page: str) -> tuple[list[Block], list[Node]]:
    """Blocks in page order, and the elements around them, parents first.

    Unclosed elements end with their container; a cut-off tag, comment or script is dropped. Every step is constant or
    pays for an element that it closes, so that time is linear in the page.
    """
    out: list[Block] = []
    root = Node("", None)
    nodes, stack = [root], [root]  # the stack holds inline elements too; only blocks are nodes of the tree
    boxes = [root]
    inside = [False]  # by box: whether within article or main
    parts: list[str] = []
    at: dict[str, list[int]] = {}  # places of open elements in the stack, by tag
    box_at = [0]
    linked = silent = 0  # silent: open inline elements of which no text is read

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, linked, boxes[-1]))
                boxes[-1].mass += max(0, len(text) - linked)
            parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal silent
        tag = stack.pop().tag
        at[tag].pop()
        silent -= tag in SILENT and tag not in BLOCK
        if tag in BLOCK:
            boxes.pop()
            inside.pop()
            box_at.pop()

    for m in TOKEN.finditer(page):
        if (text := m["text"]) is not None:
            if silent:
                continue
            parts.append(text)
            if at.get("a"):
                linked += len(text.strip())
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            close()
        if m["end"]:
            # an inline end tag doesn't reach beyond its block
            if at.get(tag) and (tag in BLOCK or at[tag][-1] > box_at[-1]):
                for _ in range(len(stack) - at[tag][-1]):
                    pop()
        elif tag not in VOID:
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th") or tag in BLOCK and stack[-1].tag not in BLOCK:
                ends = {"p", *HEADINGS} if tag == "p" else {tag, "p"}
                while len(stack) > 1 and (stack[-1].tag in ends or stack[-1].tag not in BLOCK and any(at.get(t) for t in ends)):
                    pop()
            rest = m["rest"]
            if tag in BLOCK:
                names = " ".join(a or b or c for a, b, c in NAMED.findall(rest)).lower() if rest and "=" in rest else ""
                node = Node(tag, boxes[-1], *evidence_of(tag, names, inside[-1]))
                nodes.append(node)
                box_at.append(len(stack))
                boxes.append(node)
                inside.append(inside[-1] or tag in ("article", "main"))
            else:
                node = Node(tag, boxes[-1])
                silent += tag in SILENT
            at.setdefault(tag, []).append(len(stack))
            stack.append(node)
    close()
    return out, nodes


def weighed(nodes: list[Node]) -> None:
    """Adds up texts from the leaves, and evidence from the root, of which that of frames and wrappers is void."""
    for n in reversed(nodes):
        if n.parent:
            n.parent.mass += n.mass
            n.parent.holds |= n.holds or n.evidence == SECTION
    whole = nodes[0].mass
    for n in nodes:
        void = n.damped and n.mass > FRAME * whole and (n.damped == "frame" or n.holds)
        n.logit = (n.parent.logit if n.parent else 0.0) + (0.0 if void else n.evidence)


def block_logit(b: Block) -> float:
    """The classifier: positive for content."""
    n = len(b.text)
    logit = b.node.logit + BIAS + min(MOST_LENGTH, n * BY_LENGTH) + LINKED * min(1.0, b.linked / n)
    if b.text[-1] in ".!?…\"'”»":
        logit += ENDED
    if b.node.tag in HEADINGS:
        logit += HEADED
    if b.node.logit < SECTION and (b.text[0] == "©" or "all rights reserved" in b.text.lower() or NOTICE.search(b.text)):
        logit += LEGAL
    return logit


def tree_distance(a: Node, b: Node) -> int:
    """Steps between two elements. Over neighbours in page order the sum of them is at most twice the elements."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def minimum_cut(to_source: list[float], to_sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node stays with the source in a minimum cut; edges hold both ways. Maximum flow by shortest paths in levels."""
    n = len(to_source)
    source, sink = n, n + 1
    ends: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a: int, b: int, there: float, back: float) -> None:
        at[a].append(len(ends))
        ends.append(b)
        room.append(there)
        at[b].append(len(ends))
        ends.append(a)
        room.append(back)

    for i, (s, t) in enumerate(zip(to_source, to_sink, strict=True)):
        # what passes straight through a node changes no cut
        if s > t:
            edge(source, i, s - t, 0.0)
        elif t > s:
            edge(i, sink, t - s, 0.0)
    for a, b, w in edges:
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if room[e] > 1e-12 and level[ends[e]] < 0:
                    level[ends[e]] = level[a] + 1
                    queue.append(ends[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        used = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-12)
                a = ends[path[cut] ^ 1]
                del path[cut:]
                continue
            while used[a] < len(at[a]):
                e = at[a][used[a]]
                if room[e] > 1e-12 and level[ends[e]] == level[a] + 1:
                    path.append(e)
                    a = ends[e]
                    break
                used[a] += 1
            else:
                if a == source:
                    break
                e = path.pop()
                a = ends[e ^ 1]
                used[a] += 1


def labelled(page: str | None) -> list[tuple[str, bool, bool]]:
    """(text, whether content by the cut, whether by the classifier alone) of each block of a page, in order."""
    blocks, nodes = blocks_of(page) if page else ([], [Node("", None)])
    weighed(nodes)
    logits = [block_logit(b) for b in blocks]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, BESIDE * 0.5 ** tree_distance(blocks[i - 1].node, b.node)))
        box = b.node.parent
        if (j := last.get(box, i - 1)) < i - 1:
            edges.append((j, i, AKIN))
        last[box] = i
    soft = lambda x: math.log1p(math.exp(-abs(x))) + max(x, 0)
    kept = minimum_cut([soft(x) for x in logits], [soft(-x) for x in logits], edges)
    return [(b.text, k, x > 0) for b, k, x in zip(blocks, kept, logits, strict=True)]


def main_text(page: str | None) -> str:
    return " ".join(text for text, content, _ in labelled(page) if content)


def extracted(page: Column) -> Column:
    """Column of a page's main text; empty for a null, empty or wholly boilerplate page. Pages are read whole.

    It is a column of its row alone: repeated rows give equal texts, and other columns play no part.
    """

    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in pages], dtype=object)

    return of(page)
