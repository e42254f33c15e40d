"""Main-text extraction from HTML by tag-path ratios.

A page is cut into blocks: runs of text between block-level tags. Each block belongs to its
root-to-leaf path of block-level tags (with class names, so that a path names one kind of
node on the page). Over the page, every path's blocks are aggregated: mean text length per
block, and mean punctuation per block. Both series are laid out in page order, smoothed with a
Gaussian over neighbouring blocks weighed by how much of the path they share, and fused (the
geometric mean of a path's own ratio and its smoothed one); a path whose fused ratio reaches a share of the page's standard deviation is content, unless its
text is mostly links.

Two kinds of evidence beyond the ratios are taken from the markup. Subtrees that are never article text
by their tag (menus, headers, footers, sidebars, forms, scripts, styles, hidden parts)
or by their class, id or role (adverts, comments, notices, ...) are left out before any
counting. A class counts as a whole (``ad-slot``, ``site-header``): every part is a skip word or a known
companion of one. Layout states (``has-sidebar``, ``md:hidden``) say nothing; other classes with a skip word divide the
ratio by MARK. A part that holds the only marked article, ``main`` or most of the text is not left out for its class. Where a page marks its article (``article``, ``main`` or the role), the mark is evidence
beside the ratios: it multiplies the ratios of paths within it and divides those of the others by MARK
before the threshold. Headings, list items, cells and captions are short by nature; they also stay with the
text they belong to (the next block for headings, the one before for the others) where the ratios keep that: in a
marked article anywhere, on other pages within the container of that text. Other short blocks of a marked
article (a line of dialogue, a verse, a quotation) stay beside text of the same article that the ratios keep:
on one side for a block without a class, on both sides for one with a class.

A form is left out, but for the one that holds an otherwise unmarked page's article, ``main`` or paragraphs
(pages wrapped in one form).

Pages are parsed by a tolerant tokenizer: implied end tags, stray end tags, unclosed elements,
comments, raw text elements and broken markup at the end of a page all have a defined reading
(the text so far). Time is linear in the page: paths are nodes of one tree, open elements are found by tag. Tasks handle one page at a time; the rows are Spark's.

**Cases.** Null and empty pages give an empty text. Repeated rows and ids are separate pages. A
page without markup is one block and is returned whole. Other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of the standard deviation of the fused ratios that a content path reaches.
THRESHOLD = 0.3
#: Neighbours on either side, and the width, of the Gaussian over blocks.
REACH, WIDTH = 3, 1.5
#: Share of link characters from which a path is a link list.
LINKS = 0.6
#: Share of the page's text from which a part is not left out for its class, id or role.
MOST = 0.8
#: Weight of a marked article: its paths' ratios count so many times, other paths' so many times less.
MARK = 8.0

# The HTML elements by role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
SKIPPED_TAGS = frozenset(
    "head script style noscript template textarea xmp iframe noembed noframes object svg math canvas audio video "
    "nav header footer aside form button select option optgroup datalist dialog menu search title".split()
)
#: Words of a class, id or role that mark a part as not the article's text: the class is made of these and of
#: COMPANIONS. A class with a word of STATES tells how something else is laid out.
SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted banner "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar pagination pager "
    "header masthead footer sidebar aside complementary contentinfo "
    "comment comments commentlist disqus reply replies respond "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay dialog "
    "share sharing social related recommended newsletter subscribe subscription signup login search form widget "
    "copyright disclaimer hidden".split()
)
COMPANIONS = frozenset(
    "slot box list area wrap wrapper container section block unit zone placeholder left right top bottom inner outer main "
    "primary secondary site page global post posts article entry blog recent latest top links link buttons button btn bar "
    "icons group row col column body content desktop mobile sticky fixed floating inline wp fb js visually rail "
    "leaderboard skyscraper rectangle small large sm md lg xl user item items text title".split()
)
STATES = frozenset("has no not with without show hide overflow open opened closed free enabled disabled on off hover focus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is short by nature, besides headings.
SHORT_TAGS = frozenset("li dt dd td th caption figcaption pre".split())
_LIST_PARTS = frozenset("ul ol dl menu dir li dt dd table thead tbody tfoot tr td th caption figure figcaption hgroup".split())
_CLOSED_BY_BLOCK = "p"
_SAME_LEVEL = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"  # comment
    r"|<[!?][^>]*(?:>|\Z)"  # declaration
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)",
    re.S,
)
_MARK = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_PLAIN = re.compile(r"[^\W_][\w-]*")  # no variant such as md:hidden
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")


class Path:
    """A root-to-leaf path of steps, as a node of the page's tree of paths (equal paths are one node)."""

    __slots__ = ("above", "step", "depth", "below")

    def __init__(self, above: Path | None, step: str):
        self.above, self.step, self.below = above, step, {}
        self.depth = above.depth + 1 if above else 0

    def child(self, step: str) -> Path:
        found = self.below.get(step)
        if found is None:
            found = self.below[step] = Path(self, step)
        return found

    def steps(self) -> tuple[str, ...]:
        out, node = [], self
        while node.above:
            out.append(node.step)
            node = node.above
        return tuple(reversed(out))


@dataclass
class Block:
    path: Path
    text: str
    links: int
    in_article: int  # number of the marked article, 0 for none
    doubtful: bool = False


@dataclass
class Part:
    """A part whose class, id or role has it left out: its text and the marked articles in it."""

    start: int
    outermost: bool
    in_article: bool
    form: bool
    chars: int = 0
    articles: int = 0
    paragraphs: int = 0
    main: bool = False

    def held(self, total: int, marked: bool) -> bool:
        """Whether the part is not to be left out after all."""
        if self.in_article or not self.chars:
            return False
        most = self.chars >= MOST * total
        if self.form:
            return not marked and (self.main or self.articles == 1 or (most and self.paragraphs > 0))
        return most or (not marked and (self.main or self.articles == 1))


#: What a part's markup says of it, from nothing to left out in any case.
LIKELY, DOUBTFUL, NAMED, NEVER = range(4)


def _word_level(token: str) -> int:
    """What one class, id or role says."""
    words = [w for w in _WORDS.findall(token) if len(w) > 1]
    if SKIPPED_WORDS.isdisjoint(words) or not STATES.isdisjoint(words) or not _PLAIN.fullmatch(token):
        return LIKELY
    return NAMED if all(w in SKIPPED_WORDS or w in COMPANIONS for w in words) else DOUBTFUL


def _level(tag: str, attrs: str) -> int:
    """What a part's tag, class, id, role or hiding says of it."""
    if tag in SKIPPED_TAGS:
        return NAMED if tag == "form" else NEVER
    if not attrs or tag in ("html", "body", "article", "main"):
        return LIKELY
    level = LIKELY
    for name, a, b, c in _MARK.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return NEVER
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return NEVER
        else:
            level = max([level, *map(_word_level, value.split())])
    return level


def _classes(attrs: str) -> str:
    for name, a, b, c in _MARK.findall(attrs) if attrs else ():
        if name.lower() == "class":
            return "." + ".".join((a or b or c).split())
    return ""


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, without left-out parts."""
    found, parts = _parse(page, frozenset())
    if not parts:
        return found
    total = sum(len(b.text) for b in found) + sum(p.chars for p in parts if p.outermost)
    marked = any(b.in_article for b in found)
    held = frozenset(p.start for p in parts if p.held(total, marked))
    return _parse(page, held)[0] if held else found


def _parse(page: str, held: frozenset[int]) -> tuple[list[Block], list[Part]]:
    """The blocks outside of left-out parts, and the parts left out by name, but for those that start
    at ``held``."""
    found: list[Block] = []
    parts: list[Part] = []
    root = Path(None, "")
    # tag, whether a block, left out, article, doubtful, named part, path
    stack: list[tuple[str, bool, bool, int, bool, Part | None, Path]] = []
    opened: dict[str, list[int]] = {}  # depths of the open elements of each tag
    text: list[str] = []
    links = link_depth = articles = 0

    def deepest(tags: Iterable[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=-1)

    def close_block() -> None:
        nonlocal links
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        if joined:
            _, _, _, article, doubtful, _, path = stack[-1] if stack else ("", False, False, 0, False, None, root)
            found.append(Block(path, joined, links, article, doubtful))
        text.clear()
        links = 0

    def pop_to(depth: int) -> None:
        nonlocal link_depth
        if any(s[1] for s in stack[depth:]):
            close_block()
        link_depth -= sum(s[0] == "a" for s in stack[depth:])
        while len(stack) > depth:
            tag, *_, part, _ = stack.pop()
            opened[tag].pop()
            above = stack[-1][5] if stack else None
            if part and above and part is not above:
                above.chars += part.chars
                above.articles += part.articles
                above.paragraphs += part.paragraphs
                above.main |= part.main

    at = 0
    while True:
        token = _TOKEN.search(page, at)
        piece = page[at : token.start()] if token else page[at:]
        if piece and not (stack and stack[-1][2]):
            text.append(piece)
            if link_depth:
                links += len(piece.strip())
        elif piece and stack[-1][5]:
            stack[-1][5].chars += len(piece.strip())
        if not token:
            break
        at = token.end()
        tag = (token["tag"] or "").lower()
        if not tag:
            continue
        if token["end"]:
            if opened.get(tag):
                pop_to(opened[tag][-1])
            continue
        if tag == "br":
            text.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            if tag in _SAME_LEVEL:
                same, scope = _SAME_LEVEL[tag]
                sibling = deepest(same - scope)
                if sibling > deepest(scope):
                    pop_to(sibling)
            if opened.get(_CLOSED_BY_BLOCK):
                pop_to(opened[_CLOSED_BY_BLOCK][-1])
            close_block()
        if tag in VOID_TAGS:
            continue
        if tag in RAW_TAGS:  # their content is not markup
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        _, _, out, in_article, doubtful, part, path = stack[-1] if stack else ("", False, False, 0, False, None, root)
        if not out or part:  # within a part left out in any case nothing counts
            level = _level(tag, token["attrs"])
            if level == NEVER:
                out, part = True, None
            elif level == NAMED and token.start() not in held:
                part = Part(token.start(), part is None, bool(in_article), tag == "form")
                parts.append(part)
                out = True
            doubtful = doubtful or level == DOUBTFUL
        role = re.search(r"role\s*=\s*[\"']?(main|article)\b", token["attrs"], re.I)
        if tag in ("article", "main") or role:
            if not in_article:
                doubtful = False
                if part:
                    part.articles += 1
                    part.main |= tag == "main" or bool(role and role[1].lower() == "main")
                articles += 1
                in_article = articles
        if part and tag == "p":
            part.paragraphs += 1
        if block:
            path = path.child(f"{tag}{_classes(token['attrs'])}")
        opened.setdefault(tag, []).append(len(stack))
        stack.append((tag, block, out, in_article, doubtful, part, path))
        link_depth += tag == "a"
    close_block()
    pop_to(0)
    return found, parts


def _shared(a: Path, b: Path) -> float:
    """Share of the longer path that both start with."""
    longer = max(a.depth, b.depth)
    while a is not b:
        if a.depth >= b.depth:
            a = a.above
        else:
            b = b.above
    return (a.depth + 1) / (longer + 1)


def path_scores(found: list[Block]) -> dict[tuple[str, ...], tuple[float, float]]:
    """Each path's fused ratio and its share of link characters."""
    return {path.steps(): score for path, score in _scores(found).items()}


def _scores(found: list[Block]) -> dict[Path, tuple[float, float]]:
    totals: dict[Path, list[float]] = {}
    for b in found:
        t = totals.setdefault(b.path, [0, 0, 0, 0])
        t[0] += 1
        t[1] += len(b.text)
        t[2] += len(_PUNCTUATION.findall(b.text))
        t[3] += min(b.links, len(b.text))
    text = [totals[b.path][1] / totals[b.path][0] for b in found]
    marks = [totals[b.path][2] / totals[b.path][0] for b in found]
    kernel = [math.exp(-(d * d) / (2 * WIDTH * WIDTH)) for d in range(REACH + 1)]
    fused: dict[Path, list[float]] = {}
    for i, b in enumerate(found):
        weights, length, punctuation = 0.0, 0.0, 0.0
        for j in range(max(0, i - REACH), min(len(found), i + REACH + 1)):
            w = kernel[abs(i - j)] * _shared(b.path, found[j].path)
            weights += w
            length += w * text[j]
            punctuation += w * marks[j]
        f = fused.setdefault(b.path, [0.0, 0])
        near = length / weights * (1 + punctuation / weights)
        f[0] += math.sqrt(near * text[i] * (1 + marks[i]))
        f[1] += 1
    return {p: (f[0] / f[1], totals[p][3] / totals[p][1]) for p, f in fused.items()}


def _tag(path: Path) -> str:
    return path.step.split(".", 1)[0]


def _owner(path: Path) -> Path:
    """The path without the paragraphs at its end."""
    while path.above and _tag(path) == "p":
        path = path.above
    return path


def _short_kind(block: Block) -> str:
    """"heading" or "item" for a block that is short by nature, else empty."""
    last = _tag(_owner(block.path))
    return "heading" if last in HEADINGS else "item" if last in SHORT_TAGS else ""


def _container(path: Path) -> Path:
    """The element that holds a text block, its heading or the list or table that it is an item of."""
    path = _owner(path) if _tag(path) == "p" else path.above or path
    while path.above and _tag(path) in _LIST_PARTS:
        path = path.above
    return path


def _belongs(found: list[Block], kept: list[bool], kind: str, order: range, links: list[bool]) -> None:
    """Keep the blocks of a short kind that follow, in the given order, a kept block that they belong to."""
    anchor: Block | None = None
    for i in order:
        b = found[i]
        if _short_kind(b) == kind:
            same = anchor and (b.in_article if anchor.in_article else _container(b.path) is _container(anchor.path))
            kept[i] = kept[i] or bool(same and not links[i] and not b.doubtful)
        elif b.in_article or kind == "heading" or not _short_kind(b):
            anchor = b if kept[i] else None


def _beside(found: list[Block], kept: list[bool], links: list[bool]) -> list[bool]:
    """Blocks of a marked article next to text of the same article that is kept: on one side for a block whose
    own element has no class, on both for one with a class."""
    n, sides = len(found), []
    for order in (range(n), range(n - 1, -1, -1)):
        near, last = [False] * n, 0  # the article whose text was kept last
        for i in order:
            article = found[i].in_article
            near[i] = article > 0 and article == last
            if kept[i] or article != last:
                last = article if kept[i] else 0
        sides.append(near)
    return [
        not links[i] and not b.doubtful and ((x and y) if "." in b.path.step else (x or y))
        for i, (b, x, y) in enumerate(zip(found, *sides))
    ]


def main_text(page: str | None) -> str:
    """The article text of a page: its content blocks in page order, joined by one space."""
    found = blocks(page or "")
    scores = _scores(found)
    marked = any(b.in_article for b in found)
    weights = [(MARK if b.in_article else 1 / MARK) if marked else 1.0 for b in found]
    values = [scores[b.path][0] * w / (MARK if b.doubtful else 1.0) for b, w in zip(found, weights)]
    mean = sum(values) / len(values) if values else 0.0
    deviation = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)) if values else 0.0
    links = [scores[b.path][1] >= LINKS for b in found]
    kept = [v >= THRESHOLD * deviation and not x for v, x in zip(values, links)]
    if marked:
        kept = [k or x for k, x in zip(kept, _beside(found, kept, links))]
    _belongs(found, kept, "item", range(len(found)), links)
    _belongs(found, kept, "heading", range(len(found) - 1, -1, -1), links)
    return " ".join(b.text for b, k in zip(found, kept) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    columns = pages.selectExpr("CAST(page_id AS long) AS page_id", "CAST(url AS string) AS url", "CAST(html AS string) AS html")
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")
