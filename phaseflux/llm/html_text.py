"""Main text of web pages, by scoring the tree.

Every paragraph passes points for its length and commas to its ancestors, fewer the farther they are; a
container's points are discounted by the share of its text that stands in links. The best container is kept
with those siblings that score well or read like running text. Elements whose names tell of a part beside the article
are left out, however long they are, unless they hold the page's heading: then the name is that of a layout around the article.
Only where no article is left without them does it count how much of the page's text they hold. Work grows with the page's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded

# Element names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol "
    "p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_DROP = frozenset("aside button canvas datalist dialog footer head iframe input menu nav noscript object option script search select style svg template textarea title video audio".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Start tags that close an open element of these names.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = frozenset("table ul ol dl div article section body main aside nav td th".split())
_MAIN = frozenset(("article", "main"))
#: Words in a class, id or role that name a part which is not the article.
_PARTS = frozenset(
    "ad ads advert advertisement advertising adsense banner sponsor sponsored promo promotion breadcrumb breadcrumbs menu menubar nav navbar navigation sidebar aside footer masthead topbar toolbar "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus discussion reply replies respond responses widget widgets pagination pager complementary contentinfo search hidden".split()
)
_TOP = frozenset(("header", "banner"))
#: Of these the parts that may well be longer than the article.
_TALK = frozenset("comment comments commentlist disqus discussion reply replies respond responses".split())
#: Characters out of links that a named element must have to be taken for a layout, and that an article without a heading must have.
LAYOUT, ALONE = 140, 25
#: Ancestors that a paragraph gives points to.
LEVELS = 64
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Tree(HTMLParser):
    """Elements in page order with their parents, and runs of text with their element and block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.gone, self.inside, self.link = ["#"], [-1], [False], [False], [False]
        self.names: list[set[str]] = [set()]  # what names an element as a part beside the article
        self.open = [0]
        self.at: dict[str, list[int]] = {}  # places of each name among the open elements
        self.fences = [0]
        self.runs: list[tuple[int, int, str]] = []
        self.block = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCK:
            self._close({"p"})
            self.block += 1
        if tag in _CLOSES:
            self._close(_CLOSES[tag])
        if tag == "br":
            self._text(" ")
        if tag in _VOID:
            return
        up = self.open[-1]
        self.tag.append(tag)
        self.parent.append(up)
        gone, names = self._left_out(tag, dict(attrs), self.inside[up])
        self.gone.append(self.gone[up] or gone)
        self.names.append(names)
        self.inside.append(self.inside[up] or tag in _MAIN)
        self.link.append(self.link[up] or tag == "a")
        self.at.setdefault(tag, []).append(len(self.open))
        if tag in _FENCE:
            self.fences.append(len(self.open))
        self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # "/>" closes nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if self.at.get(tag):
            self._cut(self.at[tag][-1])
        if tag in _BLOCK:
            self.block += 1

    def handle_data(self, data: str) -> None:
        self._text(data)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Passes over '<![': a closed CDATA section as a whole, anything else up to the next '>', as browsers do."""
        close = self.rawdata.find("]]>", i) if self.rawdata.startswith(("<![CDATA[", "<![cdata["), i) else -1
        at = close + 2 if close >= 0 else self.rawdata.find(">", i)
        return at + 1 if at >= 0 else len(self.rawdata)

    def _text(self, data: str) -> None:
        if not self.gone[self.open[-1]]:
            self.runs.append((self.open[-1], self.block, data))

    def _cut(self, to: int) -> None:
        """Closes the open elements from a place on."""
        while len(self.open) > to:
            self.at[self.tag[self.open.pop()]].pop()
        while self.fences[-1] >= to:
            self.fences.pop()

    def _close(self, names: set[str]) -> None:
        """Closes the last open element of these names, if it is no farther than the last fence."""
        at = max((self.at[x][-1] for x in names if self.at.get(x)), default=0)
        if at and at >= self.fences[-1]:
            self._cut(at)
            self.block += 1

    def _left_out(self, tag: str, attrs: dict[str, str | None], inside: bool) -> tuple[bool, set[str]]:
        """Whether the element is left out whatever it holds, and the names by which it may be."""
        if tag in _DROP or tag == "header" and not inside or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True, set()
        if tag in ("html", "body", "article", "main") and not inside and attrs.get("role") != "complementary":
            names = _names(attrs) if tag == "article" else set()
            return False, names & {"comment", "comments", "reply", "ad", "ads", "advert", "sponsored", "promo", "related"}
        names = _names(attrs)
        found = names & _PARTS | (set() if inside else names & _TOP) | ({"form"} if tag == "form" else set())
        return bool(_HIDDEN.search(attrs.get("style") or "")), found


def _headed(tree: _Tree) -> int:
    """The page's heading: the first h1 with text that is not left out, else h2, h3; else 0. One in a discussion is none."""
    talk = [False] * len(tree.tag)
    for node in range(1, len(talk)):
        talk[node] = talk[tree.parent[node]] or bool(tree.names[node] & _TALK) and tree.tag[node] not in _HEADING
    first: dict[str, int] = {}
    for spare in (False, True):  # a discussion's own heading does where the page has no other: a layout may be named after it
        for node, _, data in tree.runs:
            if data.strip() and (spare or not talk[node]):
                at = node
                for _ in range(4):  # inline elements within a heading
                    if tree.tag[at] in _HEADING or not at:
                        break
                    at = tree.parent[at]
                if tree.tag[at] in ("h1", "h2", "h3") and (not spare or tree.tag[at] == "h1"):
                    first.setdefault(tree.tag[at], at)
        if first:
            break
    return next((first[x] for x in ("h1", "h2", "h3") if x in first), 0)


def _beside(tree: _Tree, heading: int) -> list[bool]:
    """Whether each element is left out by its names: all that have any, but those around the heading. If one of these holds
    the heading alone, its names are those of the page's building blocks and tell nothing."""
    count, around = len(tree.tag), []
    plain = [0] * count
    for node, _, data in tree.runs:
        plain[node] += len("".join(data.split()))
    for node in range(count - 1, 0, -1):
        plain[tree.parent[node]] += plain[node]
    at = heading
    while at > 0:
        around.append(at)
        at = tree.parent[at]
    loose = set().union(*(tree.names[x] - _TALK for x in around if plain[x] == plain[heading]))
    out = [bool(x - loose) for x in tree.names]
    for node in around:
        out[node] = False
    return out


def _sides(tree: _Tree) -> list[bool]:
    """Whether each element is left out by its names.

    It stays if it holds most of the page's text out of links, or if the elements of that name together do, so that
    the name tells nothing. Discussions may be longer than the article: of these only what holds a main heading stays.
    """
    count, parent, names = len(tree.tag), tree.parent, tree.names
    if not any(names):
        return [False] * count
    plain, titled = [0] * count, [False] * count
    for node, _, data in tree.runs:
        plain[node] += 0 if tree.link[node] else len(" ".join(data.split()))
    for node in range(count - 1, 0, -1):
        plain[parent[node]] += plain[node]
        titled[node] = titled[node] or tree.tag[node] in ("h1", "main")
        titled[parent[node]] = titled[parent[node]] or titled[node]
    most = lambda n, whole: n >= LAYOUT and 2 * n > whole
    talk, base = [False] * count, plain[0]
    for node in range(1, count):
        own = bool(names[node] & _TALK) and not (titled[node] and most(plain[node], plain[0]))
        base -= plain[node] * (own and not talk[parent[node]])
        talk[node] = talk[parent[node]] or own
    left = [bool(names[x]) and not talk[x] and not most(plain[x], base) for x in range(count)]
    sums: dict[str, int] = {}
    above: list[set[str]] = [set()] * count
    for node in range(1, count):
        above[node] = above[parent[node]]
        if left[node]:
            for name in names[node] - above[node]:
                sums[name] = sums.get(name, 0) + plain[node]
            above[node] = above[node] | names[node]
    loose = {name for name, n in sums.items() if most(n, base)}
    return [talk[x] or left[x] and bool(names[x] - loose) for x in range(count)]


def _names(attrs: dict[str, str | None]) -> set[str]:
    text = " ".join(attrs.get(x) or "" for x in ("class", "id", "role"))
    return set(_NAME.findall(_CAMEL.sub(" ", text).lower()))


def main_text(html: str | None) -> str:
    """Text of the page's article: blocks in page order, white space within and between them one space."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    if not any(tree.names):
        return _article(tree, [False] * len(tree.tag))[0]
    heading = _headed(tree)
    text, running, headed = _article(tree, _beside(tree, heading), heading)
    if running >= (1 if headed else ALONE):
        return text
    sides = _sides(tree)
    return _article(tree, sides)[0] or (_article(tree, [False] * len(sides))[0] if any(sides) else "")


def _article(tree: _Tree, sides: list[bool], heading: int = 0) -> tuple[str, int, bool]:
    """The text of the best container, without the elements in `sides` and what they hold; how much of it is neither in
    links nor in headings; whether it has the heading."""
    count, tag, parent = len(tree.tag), tree.tag, tree.parent
    gone, block_of = list(tree.gone), [0] * count
    for node in range(1, count):
        gone[node] = gone[node] or sides[node] or gone[parent[node]]
        block_of[node] = node if tag[node] in _BLOCK else block_of[parent[node]]
    runs = [x for x in tree.runs if not gone[x[0]]]
    text, linked = [0] * count, [0] * count
    para: dict[int, list[int]] = {}
    for node, _, data in runs:
        n = len(" ".join(data.split()))
        if not n:
            continue
        text[node] += n
        linked[node] += n * tree.link[node]
        sums = para.setdefault(block_of[node], [0, 0])
        sums[0] += n
        sums[1] += data.count(",") + data.count("،") + data.count("、") + data.count("，")
    if not para:
        return "", 0, False
    for node in range(count - 1, 0, -1):  # children come after their parents
        text[parent[node]] += text[node]
        linked[parent[node]] += linked[node]
    score: dict[int, float] = {}
    for node, (n, commas) in para.items():
        if tag[node] in _HEADING:
            continue
        points = (1 + commas + min(n / 100, 3)) * (1 - linked[node] / max(text[node], 1))
        up = parent[node] if tag[node] in ("p", "pre", "li", "dd", "dt", "td", "th", "blockquote") and node else node
        share = 1
        while up >= 0 and share <= LEVELS:
            score[up] = score.get(up, 0.0) + points / share
            up, share = parent[up], share + 1
    for node in score:
        score[node] *= 1 - linked[node] / max(text[node], 1)
        score[node] += 25 * (tag[node] in _MAIN)
    best = max(score, key=lambda x: (score[x], -x)) if score else 0
    at = best
    while at > 0:  # an article is one, however it is divided
        if tag[at] in _MAIN:
            best = at
        at = parent[at]
    kept = {best}
    if tag[best] not in _MAIN and best:
        for node in range(1, count):
            if parent[node] != parent[best] or gone[node] or not text[node]:
                continue
            density = linked[node] / text[node]
            running = tag[node] == "p" and density < 0.25 or tag[node] in _HEADING and density < 0.25
            if running or score.get(node, 0.0) >= max(2.0, 0.2 * score[best]) and density < 0.5:
                kept.add(node)
    within = [False] * count
    within[0] = 0 in kept
    for node in range(1, count):
        within[node] = node in kept or within[parent[node]]
    blocks: dict[int, list[str]] = {}
    running = 0
    for node, block, data in runs:
        if within[node]:
            blocks.setdefault(block, []).append(data)
            if not tree.link[node] and tag[block_of[node]] not in _HEADING:
                running += len("".join(data.split()))
    return " ".join(x for x in (" ".join("".join(b).split()) for b in blocks.values()) if x), running, bool(heading) and within[heading] and not gone[heading]


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row; other columns are not read.

    text is the page's article; n_chars its code points. Null and empty pages, and pages without text outside
    menus and the like, have an empty text; names of classes, ids and roles alone never make it empty. Null ids and repeated rows are treated like others. No rows: no rows.
    """
    rows = bounded(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extracting, "page_id long, url string, text string, n_chars long")
