"""Main text of a page by the ratios of its tag paths.

Text nodes are grouped by their path of tags from the root. A path's ratio is the text per
node, its punctuation ratio the punctuation per node. Both are smoothed over the paths that
come before and after it on the page, fused by their product, and paths above a threshold
are content. Paths through elements that never hold the article (menus, forms, scripts,
notes) have no ratio, nor have boxes whose names say that they stand beside it (adverts,
comments, notices), unless what they hold shows that they are the frame of the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

from pyspark.sql import DataFrame

from .text import map_rows, text_bytes

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video head title".split())
NEVER = frozenset("nav header footer aside form button select option textarea label menu dialog fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
#: An element that opens closes an open one of these, as browsers do.
CLOSES = {
    "p": frozenset(
        "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
        "main menu nav ol p pre section table ul".split()
    ),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option"]),
}
#: Words in class, id or role that name a box beside the article.
BOXES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo comment comments disqus reply replies "
    "discussion cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup share sharing social "
    "sidebar widget related recommended menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead "
    "topbar toolbar login search copyright complementary contentinfo feedback".split()
)
#: Inline elements share the path of the block they stand in.
INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strong sub sup time tt u var".split()
)
#: An element that opens does not close what lies beyond one of these.
HOLDS = frozenset("table ul ol dl select article section div body".split())
#: A box of one of these names is not judged by its class: pages mark their state there.
BODY = frozenset(["html", "body", "main", "article"])

_name_parts = re.compile(r"[A-Za-z]+").findall
_split_camel = re.compile(r"(?<=[a-z])(?=[A-Z])").sub
_space = re.compile(r"[ \t\n\x0b\x0c\r ]+").sub
_punctuation = re.compile(r"[.,;:!?…。，！？、]").findall


#: Comments, declarations and tags; quoted attribute values may hold a ">".
_markup = re.compile(
    r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|$)""", re.DOTALL
).finditer
_attribute = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""").findall
_ends = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW | {"textarea"}}
#: Tags whose parts a task remembers.
REMEMBERED = 20_000


@dataclass(slots=True)
class Node:
    """A run of text: its path, its block on the page, whether it stands in a link, and the named boxes around it."""

    path: str
    block: int
    text: str
    link: bool
    boxes: tuple[int, ...]


def labelled(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The label of an element in paths, whether it never holds the article, and whether its name says it stands beside it."""
    named: set[str] = set()
    closed = tag in RAW or tag in NEVER
    for key, value in _attribute(attributes) if attributes else ():
        key = key.lower()
        if key in ("class", "id", "role"):
            named |= {word.lower() for word in _name_parts(_split_camel(" ", unescape(value)))}
        elif key == "hidden" or key == "aria-hidden" and "true" in value.lower():
            closed = True
    return ".".join([tag, *sorted(named)]), closed, tag not in BODY and not BOXES.isdisjoint(named)


class Reader:
    """Text nodes of pages in order; lenient as browsers are. One reader serves a task."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, str], tuple[str, bool, bool]] = {}

    def label(self, tag: str, attributes: str) -> tuple[str, bool, bool]:
        key = tag, attributes
        if key not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[key] = labelled(tag, attributes)
        return self.known[key]

    def read(self, page: str) -> list[Node]:
        nodes: list[Node] = []
        # tag, path so far, whether it never holds the article, links, named boxes
        stack: list[tuple[str, str, bool, int, tuple[int, ...]]] = []
        block, at, n_boxes = 0, 0, 0
        marked: set[int] = set()  # named boxes with an article inside
        titled: set[int] = set()  # named boxes with a title inside
        for found in _markup(page):
            if found.start() < at:
                continue
            if found.start() > at:
                self._text(nodes, stack, block, page[at : found.start()])
            at = found.end()
            if (tag := found[2]) is None:
                continue
            tag = tag.lower()
            if found[1]:
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == tag:
                        block += any(open_[0] in BLOCK for open_ in stack[depth:])
                        del stack[depth:]
                        break
                else:
                    block += tag in BLOCK
                continue
            block += tag in BLOCK
            if tag in VOID:
                continue
            for depth in range(len(stack) - 1, max(-1, len(stack) - 9), -1):
                above = stack[depth][0]
                if tag in CLOSES.get(above, ()):
                    del stack[depth:]
                    break
                if above in HOLDS:
                    break
            label, closed, beside = self.label(tag, found[3])
            path, shut, links, boxes = (stack[-1][1] + "/", *stack[-1][2:]) if stack else ("", False, 0, ())
            if tag in ("article", "main") and not shut:
                marked.update(boxes)
            elif tag == "h1" and not shut:
                titled.update(boxes)
            if beside:
                n_boxes += 1
                boxes = (*boxes, n_boxes)
            if tag not in INLINE or closed or beside:
                path += label
            else:
                path = path[:-1]
            if not (found[3].endswith("/") and tag not in BLOCK and tag not in RAW):
                stack.append((tag, path, shut or closed, links + (tag == "a"), boxes))
            if tag in _ends:
                end = _ends[tag].search(page, at)
                at = end.start() if end else len(page)
        if at < len(page):
            self._text(nodes, stack, block, page[at:])
        return outside(nodes, marked, titled)

    @staticmethod
    def _text(nodes: list[Node], stack: list, block: int, text: str) -> None:
        if not stack or not stack[-1][2]:
            path, links, boxes = (stack[-1][1], stack[-1][3], stack[-1][4]) if stack else ("", 0, ())
            nodes.append(Node(path, block, unescape(text) if "&" in text else text, bool(links), boxes))


#: A box that leaves no more than this share of the page's text outside is the frame of the page.
LEFT_OUTSIDE = 0.1


_in_text = re.compile(r"(^|/)(article|main|p)(\.|/|$)").search


def outside(nodes: list[Node], marked: set[int], titled: set[int]) -> list[Node]:
    """The nodes that stand in no box beside the article.

    A box is the frame of the page, whatever its name, if it has an article element inside, or
    the title and half of the text, or if next to no text, and no paragraph or article, stands
    outside of the named boxes.
    """
    if not any(node.boxes for node in nodes):
        return nodes
    held: Counter[int] = Counter()
    total, free, told = 0, 0, False
    for node in nodes:
        n = len(node.text.strip())
        total += n
        free += n * (not node.boxes)
        told = told or n > 0 and not node.boxes and bool(_in_text(node.path))
        for box in node.boxes:
            held[box] += n
    frames = {box for box, n in held.items() if box in marked or box in titled and 2 * n >= total}
    if free <= LEFT_OUTSIDE * total and not told:
        frames |= {box for box, n in held.items() if n >= (1 - LEFT_OUTSIDE) * total}
    return [node for node in nodes if frames.issuperset(node.boxes)]


#: A path keeps at least this share of the page's mean fused ratio, a plain box in the article this one.
THRESHOLD, BOX_THRESHOLD = 0.1, 0.5


_in_article = re.compile(r"(^|/)article(\.|/|$)").search
_in_main = re.compile(r"(^|/)main(\.|/|$)").search
_in_box = re.compile(r"(^|/)(div|section|ul|ol)(\.[^/]*)?$").search


def content_paths(nodes: list[Node]) -> set[str]:
    """Paths that hold the article.

    Where the page's article element, or else its main element, has half of what the ratios
    choose, paths outside of it go, and inside of it the ratios judge plain boxes alone.
    """
    length, marks, count, linked = Counter(), Counter(), Counter(), Counter()
    order: list[str] = []
    for node in nodes:
        text = _space(" ", node.text).strip()
        if not text:
            continue
        path = node.path
        if path not in count:
            order.append(path)
        count[path] += 1
        length[path] += len(text)
        marks[path] += len(_punctuation(text))
        linked[path] += len(text) * node.link
    if not order:
        return set()
    ratio = [length[p] / count[p] for p in order]
    punctuation = [(marks[p] + 1) / count[p] for p in order]
    fused = [a * b for a, b in zip(smooth(ratio), smooth(punctuation), strict=True)]
    mean = sum(fused) / len(fused)
    bound = THRESHOLD * mean
    chosen = {p for p, value in zip(order, fused, strict=True) if value >= bound and 2 * linked[p] <= length[p]}
    # a plain box is judged by its own text, too, and not only with its neighbours
    ratios = {p: min(value, a * b) for p, value, a, b in zip(order, fused, ratio, punctuation, strict=True)}
    for element in (_in_article, _in_main):
        own = [p for p in order if element(p)]
        if own and 2 * sum(length[p] for p in own) >= sum(length[p] for p in chosen):
            # text that stands in a plain box, and not in a paragraph or title, must be rich enough
            rich = {p for p in own if 2 * linked[p] <= length[p] and (not _in_box(p) or ratios[p] >= BOX_THRESHOLD * mean)}
            return rich or chosen
    return chosen


def smooth(values: list[float]) -> list[float]:
    """Each value with its neighbours on the page at half weight."""
    out = []
    for i, value in enumerate(values):
        near = values[max(0, i - 1) : i] + values[i + 1 : i + 2]
        out.append((value + sum(near) / 2) / (1 + len(near) / 2))
    return out


def main_text(page: str, reader: Reader | None = None) -> str:
    """Article of a page: blocks in order, white space as one space; empty if there is none."""
    nodes = (reader or Reader()).read(page)
    chosen = content_paths(nodes)
    blocks: dict[int, list[str]] = {}
    for node in nodes:
        if node.path in chosen:
            blocks.setdefault(node.block, []).append(node.text)
    made = (_space(" ", "".join(parts)).strip() for parts in blocks.values())
    return " ".join(text for text in made if text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    A null page is an empty one and gives an empty text. Rows are read one by one, so
    repeated rows give repeated results. Broken markup is read as browsers do: what is open
    at the end is closed there.
    """

    def rows(source: Iterator[tuple]) -> Iterator[tuple]:
        reader = Reader()
        for page_id, url, raw in source:
            text = main_text((raw or b"").decode("utf-8", "replace"), reader)
            yield page_id, url, text, len(text)

    kind = pages.schema["page_id"].dataType.simpleString()
    renamed = pages.select("page_id", "url", pages["html"].alias("text"))
    return map_rows(text_bytes(renamed, "page_id", "url"), rows, f"page_id {kind}, url string, text string, n_chars long")
