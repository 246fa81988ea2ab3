"""Main text of web pages by tag-path ratios.

A page is read into blocks of text, each with the path of tags from the root to it. Text
length and punctuation are summed by path and divided by the path's nodes; both ratios are
smoothed over neighbouring blocks and fused. What tags, classes and ids say is a factor of that
score (an article counts more, a menu far less), and a threshold tells the paths of content.
Headings and plain text blocks without a score of their own follow the blocks they stand among.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from larderline.llm import words as W

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:svg|math)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*/>"
    r"|<(script|style|noscript|template|svg|math|iframe|object|textarea|title|select|xmp)\b[^>]*>"
    r".*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[A-Za-z/!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(
    r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])"""
    r"""(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""",
    re.I,
)
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")

# What elements mean.
BLOCKS = set(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead "
    "tbody tfoot tr td th blockquote pre figure figcaption address header footer nav aside form "
    "fieldset legend details summary center hr dialog menu button label head option".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = {"br", "hr", "img", "input", "wbr"}
APART = set("nav footer aside dialog menu button label fieldset head".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TEXTUAL = HEADINGS | set("p li dt dd td th caption figcaption blockquote pre summary".split())
CONTENT = {"article", "main"}
CLOSES_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"},
                 "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
LIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog",
         "alert", "alertdialog", "menu", "menubar", "toolbar"}
# Words of classes and ids: reader comments, other parts around an article, and words that
# name such a part as often as a subject.
COMMENTS = re.compile(
    r"comments?|commentlist|disqus|repl(?:y|ies)|responses?|discussions?|feedback|guestbook", re.I
)
AROUND = re.compile(
    r"ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|cookies?\w*|consent|gdpr|popup|modal|"
    r"newsletter|subscri\w*|share|sharing|sidebars?|widgets?|related|recommend\w*|outbrain|taboola|"
    r"breadcrumbs?|nav|navbar|navigation|topbar|toolbar|footer|masthead|signin|signup|pagination|"
    r"pager",
    re.I,
)
SUBJECTS = re.compile(
    r"banner|notices?|alerts?|overlay|social|side|rail|menus?|respond|login|search|copyright|"
    r"disclaimer|skip",
    re.I,
)
# Parts of a name that say nothing about what it names.
NEUTRAL = re.compile(
    r"\d*|area|bar|block|body|box|buttons?|container|content|form|group|inner|items?|links?|list|"
    r"main|outer|panel|posts?|section|slot|text|thread|top|bottom|left|right|unit|wrap|wrapper|zone",
    re.I,
)
# Words that tell the state of a page or article, not what an element is.
STATE = re.compile(
    r"(?<!\S)(?:(?:has|with|no|is|hide|show)[_-]\S+"
    r"|\S+[_-](?:open|opened|closed|enabled|disabled|on|off|visible|hidden|active))(?!\S)",
    re.I,
)
HEADER = re.compile(r"(?:site|page|top|global)?[_-]?header", re.I)
NEVER = {"html", "body", "main"}

# Factors of a path's score.
ARTICLE = 3.0  # inside an article or main element
SET_APART = 0.01  # menus, footers, comments and the like
ASIDE = 0.03  # named like an advert, a sidebar or a notice
IN_FORM = 0.1  # some sites put the whole page into one form
DOUBTFUL = 0.45  # inside an article, a word that may be its subject
NAMED_AFTER = 0.6  # a name that only starts with such a word
# Paths below this share of the greatest score, or below this score, are no content.
SHARE, LEAST = 0.35, 0.5


class _Node:
    """An open element: ``factor`` of its score, ``firm`` if an article inside cannot lift it."""

    __slots__ = ("tag", "parent", "depth", "order", "gone", "path", "root", "factor", "firm",
                 "bare", "held")

    def __init__(self, tag: str, parent, order: int, path: int):
        self.tag, self.parent, self.order, self.path = tag, parent, order, path
        self.depth = parent.depth + 1 if parent else 0
        self.gone = bool(parent and parent.gone)
        # The outermost article or main element around.
        self.root = (parent.root if parent else None) or (self if tag in CONTENT else None)
        self.factor = parent.factor if parent else 1.0
        self.firm = bool(parent and parent.firm)
        self.bare, self.held = True, None


def _name_factor(name: str, in_article: bool) -> tuple[float, bool]:
    """Factor of one class or id, and whether it names comments."""
    parts = [p for p in re.split(r"[_-]", name) if p]
    while len(parts) > 1 and NEUTRAL.fullmatch(parts[-1]):
        parts.pop()
    if not parts:
        return 1.0, False
    if COMMENTS.fullmatch(parts[-1]):
        return SET_APART, True
    if AROUND.fullmatch(parts[-1]) or (not in_article and HEADER.fullmatch(name)):
        return ASIDE, False
    if SUBJECTS.fullmatch(parts[-1]):
        return (DOUBTFUL if in_article else ASIDE), False
    if any(w.fullmatch(p) for p in parts[:-1] for w in (COMMENTS, AROUND, SUBJECTS)):
        return NAMED_AFTER, False
    return 1.0, False


def _weigh(node: _Node, attributes: str) -> None:
    """What an element's tag, role, class and id say about the text in it."""
    in_article = node.parent.root is not None
    own, comments = 1.0, False
    if node.tag in APART or (node.tag == "header" and not in_article):
        own, node.firm = SET_APART, True
    elif node.tag == "form":
        own = IN_FORM
    if attributes and node.tag != "html" and node.tag != "body":
        for name, value in NAMED.findall(attributes):
            name, value = name.lower(), value.strip("\"'").strip()
            if name in ("class", "id"):
                node.bare = False
                if node.tag in NEVER:
                    continue
                for word in STATE.sub(" ", value).split():
                    factor, of_comments = _name_factor(word, in_article)
                    own, comments = min(own, factor), comments or of_comments
            elif name == "role" and value.lower() in ROLES:
                own, node.firm = SET_APART, True
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                node.gone = True
            elif name == "style" and re.search(
                r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I
            ):
                node.gone = True
    node.firm |= comments
    # An article that nothing speaks against counts, whatever the box around it is called.
    if node.tag in CONTENT and own == 1.0 and not node.firm:
        node.factor = 1.0
    node.factor *= own


def blocks_of(page: str) -> list[tuple[_Node, str]]:
    """Texts between block tags in page order, each with the block element it stands in.

    Paths are numbered by (number of the parent's path, tag and class), and open elements are
    found by their tag, so that time and memory grow with the page and not with its depth.
    """
    paths: dict[tuple[int, str], int] = {}
    root = _Node("#", None, 0, 0)
    stack, out, held = [root], [], []
    open_at: dict[str, list[int]] = defaultdict(list)
    order = 0

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text and not stack[-1].gone:
                out.append((stack[-1], text))
            held.clear()

    def close(i: int):
        for node in stack[i:]:
            open_at[node.tag].pop()
        del stack[i:]

    def last(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at[t]), default=0)

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            held.append(page[at : token.start()])
        at = token.end()
        tag = token[3]
        if tag is None:
            if token[1]:
                held.append(" ")
            continue
        tag = tag.lower()
        if tag in BREAKS:
            held.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        if tag in VOID:
            continue
        if token[2]:
            if open_at[tag]:
                close(open_at[tag][-1])
            continue
        # A block ends an open paragraph; items, rows and cells end their like.
        if stack[-1].tag == "p" or (stack[-1].tag in HEADINGS and tag in HEADINGS):
            close(len(stack) - 1)
        if tag in CLOSES_ITSELF:
            like = last(LIKE.get(tag, (tag,)))
            if like > last(CLOSES_ITSELF[tag]):
                close(like)
        attributes, key = token[4], tag
        if attributes:
            found = re.search(r"""\bclass\s*=\s*["']?([\w-]+)""", attributes)
            key = f"{tag}.{found[1]}" if found else tag
        parent, order = stack[-1], order + 1
        path = paths.setdefault((parent.path, key), len(paths) + 1)
        node = _Node(tag, parent, order, path)
        _weigh(node, attributes)
        open_at[tag].append(len(stack))
        stack.append(node)
    held.append(page[at:])
    flush()
    return out


def path_scores(blocks: list[tuple[_Node, str]]) -> tuple[dict[int, float], float]:
    """Fused text and punctuation ratio of each path times its factor, and the threshold."""
    length, marks, nodes = defaultdict(int), defaultdict(int), defaultdict(int)
    for node, text in blocks:
        length[node.path] += len(text)
        marks[node.path] += len(PUNCTUATION.findall(text))
        nodes[node.path] += 1
    paths = [node.path for node, _ in blocks]
    text_ratio = np.array([length[p] / nodes[p] for p in paths])
    mark_ratio = np.array([marks[p] / nodes[p] for p in paths])
    kernel = np.array([0.1, 0.8, 0.1])

    def smooth(x: np.ndarray) -> np.ndarray:
        return np.convolve(np.pad(x, 1, mode="edge"), kernel, mode="valid")

    fused = np.sqrt(smooth(text_ratio) * (1 + smooth(mark_ratio)))
    fused *= np.array([n.factor * (ARTICLE if n.root else 1.0) for n, _ in blocks])
    total = defaultdict(float)
    for p, value in zip(paths, fused):
        total[p] += float(value) / nodes[p]
    return total, max(SHARE * max(total.values()), LEAST)


def _common(nodes: list[_Node]) -> _Node:
    """The innermost element around all: that around the first and the last to be opened."""
    a, b = min(nodes, key=lambda n: n.order), max(nodes, key=lambda n: n.order)
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return a


def _hold(node: _Node) -> bool:
    """Whether the element or one around it is marked as a holder; the answer is kept."""
    climbed = []
    while node.held is None and node.parent:
        climbed.append(node)
        node = node.parent
    for below in climbed:
        below.held = bool(node.held)
    return bool(node.held)


def main_text(page: str | None) -> str:
    """The article's blocks, one a line."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    scores, least = path_scores(blocks)
    passing = [i for i, (n, _) in enumerate(blocks) if scores[n.path] >= least]
    if not passing:
        return ""
    # What passes vouches for the plain blocks in its container and, in an article, for those
    # in the common container, unless a name speaks against them.
    nodes = [blocks[i][0] for i in passing]
    for node in nodes:
        holder = node.parent if node.tag in TEXTUAL else node
        holder.held = True
    box = _common(nodes)
    if box.root:
        box.held = True
    trusted = 0.5 * max(n.factor for n in nodes)
    roots = {n.root for n in nodes} - {None}

    def plain(node: _Node) -> bool:
        return node.factor >= trusted

    first, end = passing[0], passing[-1]
    low = first
    while low and blocks[low - 1][0].tag in HEADINGS and plain(blocks[low - 1][0]):
        low -= 1
    passes = set(passing)

    def kept(i: int) -> bool:
        node = blocks[i][0]
        if i in passes:
            return True
        if not plain(node):
            return False
        if node.tag in HEADINGS and (low <= i <= end or (i < first and node.root in roots)):
            return True
        if not (low <= i <= end or node.root in roots):
            return False
        return (node.tag in TEXTUAL or node.bare) and _hold(node)

    return "\n".join(text for i, (_, text) in enumerate(blocks) if kept(i))


def extract_text(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """Adds the main text of every page.

    White space inside a block is one space; blocks are lines in page order. Missing and empty
    pages, and pages without any text outside menus, scripts and the like, have an empty text. Broken markup is read as far as it goes: open elements end with the page.
    Repeated pages are read one by one. A column named like ``out`` is replaced.
    """
    pages = pages.drop(out) if out != page else pages
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())])
    names = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, page):
            texts = [main_text(value) for value in batch.column(page).to_pylist()]
            columns = [*batch.columns, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return pages.mapInArrow(read, schema)
