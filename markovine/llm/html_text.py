"""Main text of raw web pages by two-pass block rules.

Pass one looks at each block alone.  Its length, its density of stop words and its
density of linked characters make it *good*, *bad* or, when it is short or its
densities are between the limits, *undecided*.  Pass two gives each undecided block the
label of its nearest decided neighbour, good on a tie.

Where a block stands is evidence beside the densities.  Degrees of it are told
apart.  Menus, footers, asides, forms, hidden elements and their roles are boilerplate
whatever the text.  A class or id that names boilerplate outright (``promo``,
``cookie-notice``, ``comments``) decides too; one that names a part of the layout
(``sidebar``) does unless the only article of the page would go with it.  A word that may mean something else (``share`` in ``market-share``) only
raises the demands: long prose stays.  Names that say how the page is laid out
(``has-sidebar``) say nothing about the element.

Inside an ``article`` or ``main`` element neighbours are those of the same element, and
an element without any decided block is kept as a whole; on a page that has such an
element, blocks outside are bad.

A block is the text between two block-level tags (or two ``br`` in a row).  Scripts,
styles, templates, drawings, form fields, comments in the markup and inline adverts are
not text.  Character references are decoded, white space inside a block becomes one
space, blocks are joined by one newline; nothing else is dropped and nothing is cut.

Cases: null or empty html gives an empty text of length 0; a page without good
blocks too; broken markup is read as browsers do (unclosed elements end with their
parent, a tag that the page's end cuts off is dropped); null and repeated ids are kept,
and repeated rows give repeated results; an empty table gives an empty result; extra
columns are ignored.  Work is linear in a page's length, however deep or broken it is.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks

# Common words of the languages served (matched in lower case).
STOP_WORDS = frozenset(
    """the of and to in is it that for was on are with as be by at this from or an not but have he she they we you
    le la les de des du un une et est en que qui dans pour par sur pas au aux avec ce il elle ne se
    der die das und ist von zu den mit ein eine für auf im nicht dem des sich auch als an es er sie wie
    el los las del y por con una para su al lo como más pero sus se no es
    il di che è e per non si una da sono del della o um uma os as do não com""".split()
)

# Elements whose content is never text.
RAW = frozenset("script style noscript template svg math iframe object embed canvas select option textarea button audio video map title datalist".split())
# Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that begin and end a block.
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup p pre search section summary table tbody
    td tfoot th thead tr ul""".split()
)
# Open elements that another one's start ends.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "tbody", "thead"), "tfoot": ("td", "th", "tr", "tbody", "thead")}
#: How many of the nearest open elements are searched for one whose end tag was left out.
NEAR = 64
# Elements and roles that hold boilerplate.
BAD_ELEMENT = frozenset("nav footer aside form menu dialog head fieldset search".split())
BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Parts of class and id names that mark boilerplate.
BAD_NAME = frozenset(
    """advert adverts advertisement advertising adsense adslot sponsor sponsored promo promotion cookie cookies
    consent gdpr popup modal newsletter subscribe subscription comment comments commentlist disqus respond sharing related
    recommended recommendations login signin signup searchform copyright disclaimer offscreen tagcloud paywall outbrain taboola""".split()
)
# The same, also met in the names of elements around a whole page.
LAYOUT_NAME = frozenset("ad ads adv sidebar sidenav breadcrumb breadcrumbs navbar nav navigation pagination pager masthead".split())
# Parts that do so with none but the neutral parts beside them, and neutral parts.
UNSURE_NAME = frozenset("banner overlay menu replies share social widget skip hidden notice notices alert toolbar header footer side top bottom search reply tags meta links toc legal info".split())
NEUTRAL_NAME = frozenset("bar box block button buttons container content entry group icon icons inline inner item items left links list main menu module nav outer page panel post pull right row section site story text the to title top wrap wrapper zone".split())
# First parts of names that tell a layout or a state.
STATE_NAME = frozenset("has with without no not is js layout theme page col grid".split())
GOOD_NAME = frozenset("article content post entry story body main text page".split())

SHORT, LONG = 70, 200
STOP_LOW, STOP_HIGH, LINKS_HIGH = 0.15, 0.30, 0.33

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[^\W\d_]+")

GOOD, BAD, OPEN = 1, -1, 0
#: How strongly an element speaks against its text.
FREE, DOUBTFUL, LAYOUT, NAMED, BARRED = 0, 1, 2, 3, 4


def _named(value: str) -> int:
    """What a class or id attribute says about its element."""
    worst = FREE
    for name in value.split():
        parts = [x.lower() for x in _NAME.findall(name)]
        if not parts or len(parts) > 1 and parts[0] in STATE_NAME:
            continue
        if any(x in BAD_NAME for x in parts):
            return NAMED
        if any(x in LAYOUT_NAME for x in parts):
            worst = LAYOUT
        elif any(x in UNSURE_NAME for x in parts) and not any(x in GOOD_NAME for x in parts):
            sure = all(x in UNSURE_NAME or x in NEUTRAL_NAME or len(x) == 1 for x in parts)
            if sure:
                return NAMED
            worst = max(worst, DOUBTFUL)
    return worst


def marks(tag: str, attrs: str) -> int:
    """What an element's name and attributes say about its text."""
    if tag in BAD_ELEMENT:
        return BARRED
    if not attrs or attrs.isspace():
        return FREE
    worst = FREE
    for m in _ATTR.finditer(attrs):
        key = m.group(1).lower()
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if key in ("class", "id"):
            if tag not in ("html", "body", "main"):
                worst = max(worst, _named(value))
        elif key == "role":
            if value.strip().lower() in BAD_ROLE:
                return BARRED
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return BARRED
    return worst


class _Frame:
    """An open block-level element and the inline elements open in it."""

    __slots__ = ("tag", "mark", "main", "inline", "open", "mute")

    def __init__(self, tag: str, mark: int, main: int):
        self.tag, self.mark, self.main = tag, mark, main
        self.inline: list[tuple[str, bool]] = []  # element, whether its text is dropped
        self.open: dict[str, int] = {}  # how many of each inline element are open
        self.mute = 0  # how many of them drop their text


class _Blocks:
    """Reads a page's tags and gathers its blocks."""

    def __init__(self):
        self.blocks: list[tuple[str, int, int, int]] = []
        self.stack = [_Frame("", FREE, 0)]
        self.depth: dict[str, int] = {}  # how many of each block element are open
        self.parts: list[str] = []
        self.linked = self.breaks = self.mains = 0
        self.link: int | None = None  # how deep the open link stands

    def close(self) -> None:
        """End the block."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                top = self.stack[-1]
                self.blocks.append((text, self.linked, top.mark, top.main))
            self.parts.clear()
        self.linked = self.breaks = 0

    def add(self, raw: str) -> None:
        if not raw:
            return
        if self.stack[-1].mute:
            self.parts.append(" ")
            return
        text = _html.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if not text.isspace():
            self.breaks = 0
            if self.link is not None:
                self.linked += len(" ".join(text.split()))

    def push(self, tag: str, mark: int) -> None:
        top = self.stack[-1]
        mark = max(mark, top.mark, NAMED if top.mute else FREE)
        main = top.main
        if tag in ("article", "main") and not main and mark < BARRED:
            self.mains += 1
            main = self.mains
            if mark == DOUBTFUL:
                mark = FREE
        elif tag == "header" and not main:
            mark = max(mark, NAMED)
        self.stack.append(_Frame(tag, mark, main))
        self.depth[tag] = self.depth.get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.stack.pop().tag
        self.depth[tag] -= 1
        if self.link is not None and self.link > len(self.stack):
            self.link = None  # an unclosed link ends with its parent
        return tag

    def begin(self, tag: str, attrs: str) -> None:
        self.close()
        if self.stack[-1].tag == "p":
            self.pop()
        for ended in CLOSES.get(tag, ()):
            if not self.depth.get(ended):
                continue
            for k in range(len(self.stack) - 1, max(len(self.stack) - NEAR, 0), -1):
                name = self.stack[k].tag
                if name == ended:
                    while len(self.stack) > k:
                        self.pop()
                    break
                if name not in ("address", "div", "p"):
                    break
        if tag != "hr":
            self.push(tag, marks(tag, attrs))

    def end(self, tag: str) -> None:
        self.close()
        if self.depth.get(tag):
            while self.pop() != tag:
                pass

    def inline(self, tag: str, ending: bool, attrs: str) -> None:
        top = self.stack[-1]
        if not ending:
            if tag not in VOID and not attrs.endswith("/"):
                mute = bool(attrs) and marks(tag, attrs) >= LAYOUT
                top.inline.append((tag, mute))
                top.open[tag] = top.open.get(tag, 0) + 1
                top.mute += mute
        elif top.open.get(tag):
            while True:
                name, mute = top.inline.pop()
                top.open[name] -= 1
                top.mute -= mute
                if name == tag:
                    break

    def anchor(self, ending: bool, attrs: str) -> None:
        self.link = None if ending else len(self.stack)
        if not ending:
            names = {m.group(1).lower() for m in _ATTR.finditer(attrs)}
            if "href" not in names:
                self.link = None


def split_blocks(page: str) -> list[tuple[str, int, int, int]]:
    """Blocks in page order: (text, linked characters, what its place says against it,
    number of the article or main element around it, 0 for none)."""
    b, at, low = _Blocks(), 0, None
    final = page.rfind(">")
    gone: set[str] = set()  # elements without any more end tags
    while True:
        m = _TAG.search(page, at) if at <= final else None
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[/!?a-zA-Z]", rest)  # a tag without an end
            b.add(rest[: cut.start()] if cut else rest)
            break
        b.add(page[at : m.start()])
        at = m.end()
        tag = m.group(2) or m.group(5)
        if tag is None:
            continue
        tag = tag.lower()
        ending, attrs = (m.group(1), m.group(3)) if m.group(2) else (m.group(4), m.group(6))
        if tag in RAW:
            if not ending and tag not in VOID and not attrs.endswith("/") and tag not in gone:
                low = page.lower() if low is None else low
                if len(low) == len(page):
                    end = low.find(f"</{tag}", at)
                else:
                    found = re.compile(rf"</{tag}", re.I).search(page, at)
                    end = found.start() if found else -1
                if end < 0:
                    gone.add(tag)
                    end = len(page) if tag in ("script", "style") else at
                at = end
        elif tag == "br":
            b.parts.append(" ")
            b.breaks += 1
            if b.breaks > 1:
                b.close()
        elif tag == "a":
            b.anchor(bool(ending), attrs)
            b.inline(tag, bool(ending), attrs)
        elif tag not in BLOCK:
            b.inline(tag, bool(ending), attrs)
        elif ending:
            b.end(tag)
        else:
            b.begin(tag, attrs)
    b.close()
    return b.blocks


def first_pass(text: str, linked: int, mark: int, main: int) -> int:
    """The label of a block by itself."""
    if mark >= LAYOUT:
        return BAD
    n = len(text)
    density = linked / n
    if density > (0.5 if main else LINKS_HIGH):
        return BAD
    if n < SHORT:
        return BAD if mark else OPEN
    words = _WORD.findall(text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if stops >= STOP_HIGH and n >= LONG:
        return GOOD
    if mark:
        return GOOD if stops >= STOP_LOW and n >= LONG else BAD
    if stops >= STOP_LOW:
        return OPEN if n < LONG and not main else GOOD
    return OPEN if main else BAD


def second_pass(labels: list[int]) -> list[int]:
    """Undecided blocks take the label of the nearest decided one, good on a tie."""
    n = len(labels)
    before, after = [(n, OPEN)] * n, [(n, OPEN)] * n
    last = None
    for i in range(n):
        if labels[i] != OPEN:
            last = i
        if last is not None:
            before[i] = (i - last, labels[last])
    last = None
    for i in range(n - 1, -1, -1):
        if labels[i] != OPEN:
            last = i
        if last is not None:
            after[i] = (last - i, labels[last])
    out = []
    for i, x in enumerate(labels):
        if x == OPEN:
            (d, a), (e, b) = before[i], after[i]
            x = a if d < e or d == e and a == GOOD else b
        out.append(x)
    return out


def _keep(blocks: list[tuple[str, int, int, int]]) -> list[int]:
    """The blocks whose final label is good."""
    labels = [first_pass(*b) for b in blocks]
    groups: dict[int, list[int]] = {}
    for i, (_, _, mark, main) in enumerate(blocks):
        if main and mark < LAYOUT:
            groups.setdefault(main, []).append(i)
    if not groups:
        return [i for i, x in enumerate(second_pass(labels)) if x == GOOD]
    kept = []
    for group in groups.values():
        own = second_pass([labels[i] for i in group])
        if GOOD not in own and BAD not in own:
            own = [GOOD] * len(own)
        kept += [i for i, x in zip(group, own, strict=True) if x == GOOD]
    return sorted(kept)


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    blocks = split_blocks(page)
    kept = _keep(blocks)
    if not kept and any(mark == LAYOUT and main for _, _, mark, main in blocks):
        # the only article of the page stands in an element with a layout's name
        kept = _keep([(t, n, FREE if mark == LAYOUT and main else BARRED, main) for t, n, mark, main in blocks])
    return "\n".join(blocks[i][0] for i in kept)


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col`` and ``text`` for each page."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches):
        for whole in batches:
            for b in chunks(whole, "html"):
                text = pa.array([extract(x) for x in b.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), text], names=[id_col, url_col, "text"])

    cols = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return cols.mapInArrow(run, f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string")
