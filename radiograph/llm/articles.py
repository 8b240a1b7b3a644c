"""Main text of web pages by two-pass block rules.

A page is cut into blocks at its block elements (and at two line breaks in a row). The first pass classifies a block by
what it is in (a menu, a form, a comment ...), its length, its share of link text and its share of stop words in the
page's language; short and doubtful ones stay undecided. In the second pass they inherit the label of the nearest decided
block before or after them, among the blocks of the same article where there is one. Blocks labelled good are the text.

Tags needn't be closed or nested well: an element ends with its end tag, its parent or what can't stand in it. Character
references are decoded, white space within a block becomes one space. Null and empty pages have empty text. Rows are
read one by one, so repeated rows and null ids keep theirs; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Frequent words without a subject of their own, by language.
STOP_WORDS = {
    "en": "the of and to in is that it was for on are as with be at this by from or an not which but they have has were you his her",
    "de": "der die das und in zu den ist von nicht mit sich des auf für als auch es an er hat aus bei einer ein eine dem im wird",
    "fr": "le la les de des du et un une est que qui dans pour pas sur au avec ce il elle ne se en par plus son sont",
    "es": "de la que el en los las y del se un una por con no para su al lo como más pero sus le es está",
    "it": "di che il la e un una in per è non del della con si da le i gli al dei sono come più",
    "pt": "de que o a os as e do da em um uma para com não por mais dos das se na no ao é",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als bij door naar uit",
}
#: Characters from which a block is long enough to be judged, and from which it is long.
LENGTH_LOW, LENGTH_HIGH = 70, 200
#: Share of link text from which a block is bad; shares of stop words that decide.
LINKS, STOPS_LOW, STOPS_HIGH = 0.4, 0.15, 0.3
#: Share of stop words below which a page is in no known language.
LEAST_STOPS = 0.05

BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table thead tbody tfoot tr td th caption article section nav header footer aside main blockquote pre figure figcaption form fieldset hr body html address details summary center menu dialog head option legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose text is never the article's.
OUTSIDE = frozenset("head nav footer aside form menu dialog noscript template svg math object select button canvas audio video map fieldset".split())
ARTICLE = frozenset(("article", "main"))
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that tell what an element is; the first kind also within an article, the second unless it holds one or is named as content as well.
NEVER = frozenset("ad ads advert adverts advertisement adsense adslot sponsor sponsored promo comment comments commentlist respond disqus cookie cookies consent gdpr popup modal".split())
HARDLY = frozenset("nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead banner footer sidebar aside widget notice newsletter subscribe subscription signup login share sharing social related recommended pagination pager toolbar copyright search overlay alert".split())
CONTENT = frozenset("article content main post entry story body text page wrapper container".split())
#: What an element's start ends: elements of these names, but none beyond a list, table or other container.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}

_QUOTED = r"""(?:"(?:[^"<>]*+"|[^"]{0,4096}")|'(?:[^'<>]*+'|[^']{0,4096}')|[^"'<>])*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_QUOTED})>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """A stretch of text: its words, the characters of it that are links, and where it stands."""

    text: str
    linked: int
    heading: bool
    outside: bool
    article: int
    label: bool | None = None


@dataclass
class Element:
    name: str
    never: bool = False
    hardly: bool = False


def _element(name: str, attributes: str) -> Element:
    of = Element(name, never=name in OUTSIDE, hardly=name == "header")
    words: set[str] = set()
    if "=" in attributes and name not in ("body", "html"):
        for key, *values in _NAMED.findall(attributes):
            value = next((v for v in values if v), "")
            if key.lower() == "role":
                of.never |= value.lower() in OUTSIDE_ROLES
            else:
                words.update(p.lower() for p in _PARTS.findall(value))
    of.never |= bool(words & NEVER)
    of.hardly |= bool(words & HARDLY) and not words & CONTENT
    return of


class _Page:
    """The blocks of a page, as its tags go by."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open: list[Element] = []
        self.parts: list[str] = []
        self.linked = self.breaks = self.articles = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            names = [e.name for e in self.open]
            inside = max((i for i, n in enumerate(names) if n in ARTICLE), default=-1)
            outside = any(e.never or (e.hardly and i > inside and not (e.name == "header" and inside >= 0)) for i, e in enumerate(self.open))
            self.blocks.append(Block(text, min(self.linked, len(text)), any(n in HEADINGS for n in names), outside, self.articles if inside >= 0 else 0))
        self.parts, self.linked, self.breaks = [], 0, 0

    def text(self, raw: str) -> None:
        if raw:
            shown = html.unescape(raw) if "&" in raw else raw
            self.parts.append(shown)
            if not shown.isspace():
                self.breaks = 0
                if any(e.name == "a" for e in self.open):
                    self.linked += len(" ".join(shown.split()))

    def close(self, at: int) -> None:
        del self.open[at:]

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.breaks += 1
            self.parts.append(" ")
            if self.breaks == 2:
                self.flush()
            return
        if name in BLOCKS:
            self.flush()
            ends, bounds = ENDS.get(name, ()), BOUNDS.get(name, ())
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].name == "p":  # a paragraph holds no blocks
                    self.close(i)
                    break
                if self.open[i].name in BLOCKS:
                    break
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].name in bounds:
                    break
                if self.open[i].name in ends:
                    self.close(i)
                    break
        if name == "body":
            self.open = [e for e in self.open if e.name == "html"]
        if name in ARTICLE and not any(e.name in ARTICLE for e in self.open):
            self.articles += 1
        if name not in VOID and not attributes.endswith((" /", '"/', "'/")) and attributes != "/":
            self.open.append(_element(name, attributes))

    def end(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].name == name:
                self.close(i)
                break
            if name not in BLOCKS and self.open[i].name in BLOCKS or name == "p" and self.open[i].name in BLOCKS:
                break


def blocks(page: str) -> list[Block]:
    """The blocks of a page in their order."""
    held, at = _Page(), 0
    while found := _TOKEN.search(page, at):
        held.text(page[at : found.start()])
        at = found.end()
        closing, name, attributes = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if closing:
            held.end(name)
        elif name in RAW:
            over = re.compile(rf"</{name}[\s/>]", re.I).search(page, at)
            at = over.start() if over else len(page)
        else:
            held.start(name, attributes)
    held.text(page[at:])
    held.flush()
    return held.blocks


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text)]


_STOPS = {language: frozenset(words.split()) for language, words in STOP_WORDS.items()}


def first_pass(held: list[Block]) -> None:
    """Decide each block by itself, where that is possible."""
    words = [_words(b.text) for b in held]
    inside = [w for b, ws in zip(held, words, strict=True) if not b.outside for w in ws]
    hits = {language: sum(w in stops for w in inside) for language, stops in _STOPS.items()}
    language = max(hits, key=hits.get)
    known = hits[language] >= LEAST_STOPS * max(len(inside), 1)
    for b, ws in zip(held, words, strict=True):
        length = len(b.text)
        stops = sum(w in _STOPS[language] for w in ws) / len(ws) if ws else 0.0
        if b.outside or b.linked > LINKS * length:
            b.label = False
        elif not b.article and "©" in b.text and length < LENGTH_HIGH:
            b.label = False
        elif length < LENGTH_LOW or b.heading:
            b.label = None
        elif not known:
            b.label = True if b.article or length >= LENGTH_HIGH else None
        elif stops >= STOPS_HIGH or stops >= STOPS_LOW and (length >= LENGTH_HIGH or b.article):
            b.label = True
        else:
            b.label = None if b.article or stops >= STOPS_LOW or length < LENGTH_HIGH else False


def second_pass(held: list[Block]) -> None:
    """Undecided blocks take the label of the nearest decided one in their article, or outside of all.

    Blocks that their place alone has decided (menus, footers, ...) don't count. Between two as near, a heading takes the
    label of what follows; else an article's are good and others bad. Where nothing was decided to be good, a page has
    short texts only: its undecided blocks are good.
    """
    for article in {b.article for b in held}:
        group = [b for b in held if b.article == article and not b.outside]
        if not any(b.label for b in group):
            for b in group:
                b.label = b.label is None
            continue
        before: list[tuple[int, bool] | None] = []
        last = None
        for i, b in enumerate(group):
            last = (i, b.label) if b.label is not None else last
            before.append(last)
        after, nearest = None, []
        for i in range(len(group) - 1, -1, -1):
            b = group[i]
            after = (i, b.label) if b.label is not None else after
            sides = [(abs(i - s[0]), s[1]) for s in (before[i], after) if s]
            least = min((d for d, _ in sides), default=0)
            labels = {label for d, label in sides if d == least}
            nearest.append((b, labels.pop() if len(labels) == 1 else bool(article) or not labels or (b.heading and after[1])))
        for b, label in nearest:
            b.label = label


def main_text(page: str) -> str:
    held = blocks(page)
    first_pass(held)
    second_pass(held)
    return "\n".join(b.text for b in held if b.label)


def extract_articles(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""
    small_batches(pages.sparkSession)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "") for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
