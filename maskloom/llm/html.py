"""Main text of web pages by scoring the element tree.

Paragraphs pass points for length and commas to their ancestors, discounted by link
density; the best container and the siblings that look like text are kept, without the
parts that are never article text.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from maskloom.llm.common import as_fields, carried, given_back

_UNSEEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|math|object|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)",
    re.I | re.S,
)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Za-z]+")
#: what a class or id says of an element: nothing, one part of it is unlikely, it is; or the element itself goes
PLAIN, DOUBTFUL, NAMED, GONE = range(4)
#: a doubtful element goes where it is shorter and not most of the page, or mostly links
SHORT, LINKED, LOWERED = 200, 0.5, 0.2

INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr picture q "
    "s samp small source span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = set(
    "head nav footer aside form button menu dialog input fieldset option optgroup audio video canvas map applet".split()
)
UNLIKELY = set(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice "
    "notification overlay pager pagination popup promo promoted promotion related replies respond search share "
    "sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# an opening tag of the key ends an open element of the value
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
}
HOLDERS = {"article", "main", "section", "div", "body", "html", "ul", "ol", "dl", "table", "blockquote", "td", "th"}


class Tree:
    """Elements by number, 0 the root, with the text runs in page order."""

    def __init__(self, page: str):
        self.parent, self.tag, self.kind = [-1], [""], [PLAIN]
        self.runs: list[tuple[int, list[str], int]] = []
        self._stack, self._text, self._links, self._anchors = [0], [], 0, 0
        page = _UNSEEN.sub("", page)
        at = 0
        for found in _TAG.finditer(page):
            if found.start() > at:
                self._add(page[at : found.start()])
            at = found.end()
            name = found[2] or found[5]
            if name:
                closes, extra = (found[1], found[3]) if found[2] else (found[4], found[6])
                self._close(name.lower()) if closes else self._open(name.lower(), extra)
        self._add(page[at:])
        self._end_run()

    def _add(self, text: str) -> None:
        text = unescape(text)
        self._text.append(text)
        if self._anchors:
            self._links += len(text.strip())

    def _leave(self, at: int) -> None:
        """Close the open elements from place ``at`` of the stack on."""
        self._anchors -= sum(self.tag[i] == "a" for i in self._stack[at:])
        del self._stack[at:]

    def _end_run(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                holder = next(i for i in reversed(self._stack) if self.tag[i] not in INLINE)
                self.runs.append((holder, text, self._links))
            self._text, self._links = [], 0

    def _open(self, name: str, extra: str) -> None:
        if name not in INLINE:
            self._end_run()
            for i in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[i]]
                if (tag == "p" and name != "br") or tag in ENDS.get(name, ()):
                    self._leave(i)
                    break
                if tag in HOLDERS:
                    break
        if name in VOID:
            return
        self.parent.append(self._stack[-1])
        self.tag.append(name)
        self.kind.append(self._unwanted(name, extra))
        if not extra.endswith("/") or name not in INLINE:
            self._stack.append(len(self.tag) - 1)
            self._anchors += name == "a"

    def _close(self, name: str) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[i]]
            if tag == name:
                if name not in INLINE:
                    self._end_run()
                self._leave(i)
                return
            if name in INLINE and tag not in INLINE:
                return

    def _unwanted(self, name: str, extra: str) -> int:
        if name in OUTSIDE:
            return GONE
        if name in ("html", "body", "article", "main") and not extra:
            return PLAIN
        inside = any(self.tag[i] in ("article", "main") for i in self._stack)
        if name == "header":
            return PLAIN if inside else GONE
        if not extra or extra == "/":
            return PLAIN
        kind = PLAIN
        unlikely = UNLIKELY if name in INLINE | HEADINGS or inside or name == "article" else UNLIKELY | {"header"}
        for found in _ATTRIBUTE.finditer(extra):
            key, value = found[1].lower(), (found[2] or found[3] or found[4] or "").lower()
            if key in ("class", "id"):
                if name not in ("html", "body", "main"):
                    for token in value.split():
                        parts = set(_PART.findall(token))
                        if parts & unlikely:
                            kind = max(kind, NAMED if parts <= unlikely else DOUBTFUL)
            elif key == "role" and value in ROLES:
                return GONE
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                return GONE
            elif key == "style" and "display:none" in value.replace(" ", ""):
                return GONE
        return kind

    def settle(self, names: bool = True) -> list[bool]:
        """Whether each element goes. One that is unwanted stays if it holds the article. A
        name (``names``) never takes an article away; one that is named, as a comment may be,
        keeps nothing around it. A name of which one part is unlikely takes only what is
        short or mostly links."""
        size = len(self.tag)
        chars, linked = [0] * size, [0] * size
        for holder, text, links in self.runs:
            chars[holder] += len(text)
            linked[holder] += min(links, len(text))
        for i in range(size - 1, 0, -1):
            if self.kind[i] != GONE:
                chars[self.parent[i]] += chars[i]
                linked[self.parent[i]] += linked[i]

        def unwanted(i: int) -> bool:
            if self.kind[i] == DOUBTFUL and names and self.tag[i] != "article":
                return chars[i] < min(SHORT, chars[0] / 2) or linked[i] > LINKED * chars[i]
            return self.kind[i] == GONE or (names and self.kind[i] == NAMED and self.tag[i] != "article")

        drop = [False, *map(unwanted, range(1, size))]
        holds = [False] * size
        for i in range(size - 1, 0, -1):
            if self.tag[i] in ("article", "main") and not drop[i] and self.kind[i] != NAMED:
                holds[i] = True
            if holds[i]:
                holds[self.parent[i]] = True
        gone = [False] * size
        for i in range(1, size):
            gone[i] = gone[self.parent[i]] or (drop[i] and (not holds[i] or self.tag[i] in ("head", "nav", "footer")))
        return gone

    def lowered(self) -> list[float]:
        """The share of its points that a run in each element gives."""
        share = [1.0] * len(self.tag)
        for i in range(1, len(share)):
            share[i] = LOWERED if self.kind[i] in (DOUBTFUL, NAMED) and self.tag[i] != "article" else share[self.parent[i]]
            if self.tag[i] == "article" and self.kind[i] == NAMED:
                share[i] = LOWERED
        return share


def main_text(page: str | None) -> str:
    """The text of the article, blocks joined by one space; empty if there is none."""
    if not page:
        return ""
    tree = Tree(page)
    gone = tree.settle()
    runs = [(holder, text, links) for holder, text, links in tree.runs if not gone[holder]]
    if not runs:
        # all of the page has an unlikely name
        gone = tree.settle(names=False)
        runs = [(holder, text, links) for holder, text, links in tree.runs if not gone[holder]]
    if not runs:
        return ""
    lowered = tree.lowered()
    size = len(tree.tag)
    points, chars, linked = [0.0] * size, [0] * size, [0] * size
    for holder, text, links in runs:
        worth = (1 + text.count(",") + min(len(text) / 100, 3)) * lowered[holder]
        share = 1.0
        i, level = holder, 0
        while i >= 0:
            chars[i] += len(text)
            linked[i] += min(links, len(text))
            if level and i > 0:
                # a paragraph's parent gets all, the next half, then less
                points[i] += worth * share
                share = 1 / (2 * level) if level < 2 else 1 / (3 * level)
            elif tree.tag[holder] in HOLDERS:
                points[i] += worth
            i, level = tree.parent[i], level + 1
    score = [p * (1 - k / c) if c else 0.0 for p, c, k in zip(points, chars, linked)]
    best = max(range(size), key=lambda i: (score[i], -i))
    # an article or main element around the best container is the container
    i = best
    while i > 0:
        if tree.tag[i] in ("article", "main"):
            best = i
            break
        i = tree.parent[i]
    parent = tree.parent[best]

    def sibling(i: int) -> bool:
        if tree.parent[i] != parent or not chars[i]:
            return False
        density = linked[i] / chars[i]
        if tree.tag[i] == "p" or tree.tag[i] in HEADINGS:
            return density < 0.25
        return score[i] >= max(5.0, 0.2 * score[best]) and density < 0.5

    kept: dict[int, bool] = {}

    def inside(i: int) -> bool:
        chain = []
        while i not in kept:
            chain.append(i)
            if i == best or best == 0 or (i > 0 and parent >= 0 and sibling(i)):
                kept[i] = True
                break
            if i <= 0:
                kept[i] = False
                break
            i = tree.parent[i]
        for j in chain:
            kept[j] = kept[i]
        return kept[i]

    # lists and boxes of links around the paragraphs are menus; between two of them they belong to the text
    menu = [False] * size
    if tree.tag[best] not in ("article", "main"):
        for i in range(1, size):
            boxed = tree.tag[i] in ("ul", "ol", "dl", "div", "table", "section") and i != best
            menu[i] = menu[tree.parent[i]] or (boxed and chars[i] > 0 and linked[i] > 0.6 * chars[i])
    plain = [k for k, (holder, text, links) in enumerate(runs) if not menu[holder] and links < 0.25 * len(text) and inside(holder)]
    first, last = (plain[0], plain[-1]) if plain else (0, -1)
    beside = parent >= 0 and best != 0

    def kept_run(k: int, holder: int, text: str, links: int) -> bool:
        within = first < k < last
        if inside(holder):
            return within or not menu[holder]
        # text of the parent beside the container: between what is kept, long, or a sentence
        loose = beside and holder == parent and links == 0
        return loose and (within or len(text) >= 80 or text.rstrip("\"')»”’").endswith((".", "!", "?", "…")))

    return " ".join(run[1] for k, run in enumerate(runs) if kept_run(k, *run))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the main text of each page as ``text`` and its code points as ``n_chars``.

    A narrow stage: no shuffle, each page by itself and whole, whatever its length. Null
    and empty pages, and pages without text, give an empty text. Character references are
    decoded, white space inside a block becomes one space, blocks are joined by one space
    in page order. Every input row gives one row with the caller's columns but the page;
    repeated rows give repeated results; ``text`` and ``n_chars`` replace columns of
    these names. An empty table gives an empty table.
    """
    select, fields, names = carried(pages, [html, text, "n_chars"])
    shape = StructType([*fields, StructField("made", StringType()), StructField("size", LongType())])
    target = to_arrow_schema(shape)

    def read(batches):
        for batch in batches:
            own = [as_fields(batch.column(f.name), target.field(f.name).type) for f in fields]
            made = [main_text(x) for x in batch.column("page").to_pylist()]
            yield pa.record_batch([*own, pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], names=target.names)

    done = pages.select(*select, F.col(f"`{html}`").alias("page")).mapInArrow(read, shape)
    return given_back(done, pages, names, {text: "made", "n_chars": "size"})
