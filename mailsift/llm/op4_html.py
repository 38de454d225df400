"""Operator 4: main text of web pages by the maximum-scoring contiguous region.

A page is cut into items in page order: tags and words. Words score by the kind of place they
stand in (block element, inside a link or not, inside an element that names itself a menu,
advert, comment ...: a frame), tags score below zero by name. One linear scan finds the contiguous run of
items with the greatest sum: the content region. Blocks inside the region that stand in a menu,
form, advert or reader comment are left out, and the rest is the text.

A class, id or role makes a frame of a container (``div``, ``section``, ``ul`` ...) only, and only where all its words
are names of frames or of places and boxes: ``sidebar-right`` or ``comment-list``, but not ``related-work``,
``cookie-recipe``, ``ad-free``, ``entry-header``, ``has-sidebar`` or ``no-comments``. Paragraphs, headings, quotations, figures and tables are
never frames by name, nor is a ``header`` inside an article. A name makes no frame of a block with most of the page's unlinked words if the words outside frames
are less than a quarter of those in it, nor of a block whose words it would leave hardly any others;
an article or main element with most of the words ends a frame around it.

Weights are log odds of a place, or a tag, being inside the main region, counted on labelled
pages: pages that mark their main region themselves, at most
``TRAIN_PAGES`` of them (20 MB at most). The mark is an ``article`` or ``main`` that is in no frame and
holds most of the unlinked words outside frames, so teaser cards and comments are none. Its words score
more, by a weight counted like the others; words outside it keep their score.
Without labelled pages, fixed weights are used.

A block is the text of a block element; inline tags and ``br`` do not end it. Character
references are decoded once, white space inside a block becomes one space, blocks are joined by
a line break. Null or empty html, or no content: an empty text. Null and repeated ids or urls and
repeated rows: a row each. An empty table gives no rows. Unclosed and stray tags, comments and
scripts are read as browsers do, roughly: a quote opens an attribute's value after ``=`` only, and
the value goes on to the closing quote, of whatever length. Formulas are text. Very long pages and any depth of
nesting are read whole, in linear time.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import parts, strings, table

TRAIN_PAGES = 1000
TRAIN_CHARS = 20_000

# Element names by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr "
                   "math mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder "
                   "munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select iframe object svg canvas audio video title annotation annotation-xml".split())
FRAME = frozenset("nav header footer aside menu dialog button fieldset head".split())
MAIN = frozenset("article main".split())
FRAME_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie "
                        "cookies disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices "
                        "overlay pagination popup promo promotion related replies reply respond share sharing sidebar signup social "
                        "sponsor sponsored subscribe toolbar widget".split())
BOXES = frozenset("area bar block bottom box col column container content footer global group header inner item items left link links list main "
                  "menu outer page panel primary right secondary section site slot social top unit wrap wrapper".split())
#: Elements whose class, id or role can make a frame of them.
CONTAINERS = frozenset("div section ul ol dl form table center details span a".split()) | FRAME
FRAME_ROLES = frozenset("navigation banner contentinfo complementary form search menu dialog alert".split())

#: Words outside frames are hardly any if the frames hold so many times as many.
HARDLY = 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-z][a-z0-9:-]*)|<[!?/]|[^<]+|<", re.I | re.S)
_STEP = re.compile(r"""=\s*+(["'])|>""")
_END = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
#: A slash that is no part of an unquoted value.
_SELF = re.compile(r"""(?:^|[\s"'])/\s*\Z""")


class Element:
    __slots__ = ("name", "parent", "tagged", "named", "frame", "inside", "main", "link", "block", "direct", "words", "free")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        self.name = name
        self.parent = parent
        self.inside = name in MAIN or bool(parent and parent.inside)
        self.frame, self.main = 0, False  # until the whole page is read
        self.direct = self.words = self.free = 0  # unlinked words right in it, in all of it, and those in no frame
        self.link = name == "a" or bool(parent and parent.link)
        self.block = parent.block if parent and name in INLINE else name
        # an article's own header holds its title; a form may be the whole page
        self.tagged = name in FRAME and not (name == "header" and self.inside)
        self.named = name == "form"
        if attributes and name in CONTAINERS:
            for key, a, b, c in _NAMES.findall(attributes):
                names = FRAME_ROLES if key.lower() == "role" else FRAME_NAMES
                self.named = self.named or any(names_frame(x, names) for x in (a or b or c).lower().split())


def names_frame(value: str, names: frozenset[str]) -> bool:
    """Whether a word of a class, id or role names a frame: all its parts are names of frames or of
    boxes, one at least of a frame."""
    words = [w for w in _PART.split(value) if w and not w.isdigit()]
    return any(w in names for w in words) and all(w in names or w in BOXES for w in words)


class TagEnds:
    """Where the tags of a page end. An attribute's value is read up to its closing quote however
    far that is; a quote that is never closed is a character like others. A tag that never ends
    marks its steps, and a later one that comes to such a step stops there: linear in the page."""

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "\"'>"}
        self.lost: set[int] = set()
        self.first: tuple[int, re.Match | None] = (0, None)

    def of(self, at: int) -> int:
        """Place of the ``>`` of the tag whose attributes begin at ``at``, -1 if there is none."""
        page, last, steps = self.page, self.last, []
        start, step = self.first
        if step is None or not start <= at <= step.start():
            step = _STEP.search(page, at) if at <= last[">"] else None
            self.first = at, step
        while step and step.start() not in self.lost:
            quote = step[1]
            if quote is None:
                return step.start()
            steps.append(step.start())
            at = step.end()
            if at <= last[quote]:
                at = page.find(quote, at) + 1
            step = _STEP.search(page, at) if at <= last[">"] else None
        self.lost.update(steps)
        return -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('', '', text), (name, '/', '') and (name, '', attributes), in page order; an element whose
    content is no text comes as one (name, '|', '')."""
    ends, at = TagEnds(page), 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at, name = m.end(), m[2]
        if name is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                yield "", "", text
            elif len(text) == 2:
                close = page.find(">", at) if at <= ends.last[">"] else -1
                if close < 0:
                    at -= 1
                    yield "", "", "<"
                else:
                    at = close + 1
            continue
        close = ends.of(at)
        if close < 0:
            at = m.start() + 1
            yield "", "", "<"
            continue
        attributes, at, name = page[at:close], close + 1, name.lower()
        if name in RAW and not m[1]:
            end = _END[name].search(page, at)
            close = page.find(">", end.end()) if end else -1
            at = close + 1 if close >= 0 else len(page)
            yield name, "|", ""
        else:
            yield name, m[1], attributes


def items(page: str, made: list[Element]) -> Iterator[tuple[str, str | None, Element]]:
    """(tag, None, element around it) and ('', text, element around it), in page order; a tag that
    does not end a block comes with its name, others with ``|`` before it. Elements are added to
    ``made``, parents first."""
    stack = [Element("", "", None)]
    places: dict[str, list[int]] = {}  # of the open elements, by name
    blocks = [0]  # places of the open elements that are not inline
    made.append(stack[0])

    def close(k: int) -> None:
        while len(stack) > k:
            places[stack.pop().name].pop()
        while blocks[-1] >= k:
            blocks.pop()

    for name, kind, text in tokens(page):
        if not name:
            yield "", text, stack[-1]
            continue
        mark = name if name in INLINE else "|" + name
        if kind == "|":
            yield "|" + name, None, stack[-1]
            continue
        if kind:
            k = places[name][-1] if places.get(name) else 0
            if k and (name not in INLINE or k > blocks[-1]):  # an inline end tag closes nothing outside its block
                close(k)
            yield "/" + mark, None, stack[-1]
            continue
        if name not in INLINE:
            # a block ends an open paragraph and the inline elements in it
            k = blocks[-1]
            if stack[k].name == "p" or stack[k].name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                close(k)
        yield mark, None, stack[-1]
        if name not in VOID and not _SELF.search(text):
            places.setdefault(name, []).append(len(stack))
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append(Element(name, text, stack[-1]))
            made.append(stack[-1])


def frames(made: list[Element], names: bool) -> int:
    """Set ``frame`` of the elements (2: by an element like ``nav``, 1: by a form or a name); the number
    of unlinked words outside frames. An article or main element with most of the page's unlinked words
    ends a frame around it; a block with most of them ends one by name if hardly any words stand
    outside frames."""
    for e in made:
        e.free = e.direct
    for e in reversed(made[1:]):
        if not (e.tagged or names and e.named):
            e.parent.free += e.free
    most, outside = made[0].words / 2, made[0].free
    for e in made[1:]:
        own = 2 if e.tagged else 1 if names and e.named else 0
        e.frame = max(own, e.parent.frame)
        if e.frame and e.words > most and (e.name in MAIN and not own or e.frame == 1 and HARDLY * outside <= e.words):
            e.frame = 0
            outside += e.free
    return outside


def read(page: str) -> list[tuple[str, str | None, Element, int]]:
    """The items with their numbers of words; ``frame`` and ``main`` of the elements are set."""
    made: list[Element] = []
    found = [(tag, text, e, len(text.split()) if text else 0) for tag, text, e in items(page, made)]
    for _, _, e, n in found:
        if not e.link:
            e.direct += n
    for e in made:
        e.words = e.direct
    for e in reversed(made[1:]):
        e.parent.words += e.words
    outside = frames(made, True)
    # names that leave hardly any words are no names of frames (a page made of widgets)
    if HARDLY * outside <= made[0].words - outside and HARDLY * outside > frames(made, False) - outside:
        frames(made, True)
    for e in made:
        e.free = 0 if e.frame else e.direct
    for e in reversed(made[1:]):
        e.parent.free += e.free
    # an article or main element that holds most of the unframed text; cards and comments hold less
    least = made[0].free / 2
    for e in made[1:]:
        e.main = e.parent.main or e.name in MAIN and not e.frame and e.free > least
    return found


def place(e: Element) -> str:
    return f"{'frame' if e.frame else e.block}{':link' if e.link else ''}"


def count_places(page: str) -> Counter:
    """(kind, inside the main region) -> number of words or tags; empty if the page marks none."""
    out: Counter = Counter()
    labelled = False
    for tag, text, e, n in read(page):
        inside = e.main and not e.frame
        labelled = labelled or e.main
        if text is None:
            out["t " + tag.lstrip("/|"), inside] += 1
        else:
            out["w " + place(e), inside] += n
            out["main", inside] += n if e.main else 0
    return out if labelled else Counter()


class Weights:
    """Score of a word by its place and of a tag by its name, from counts or fixed."""

    def __init__(self, counts: dict[tuple[str, bool], int]):
        self.score: dict[str, float] = {}
        total = {inside: 1 + sum(n for (_, i), n in counts.items() if i == inside) for inside in (False, True)}
        for kind in {k for k, _ in counts}:
            odds = math.log((counts.get((kind, True), 0) + 0.5) / total[True]) - math.log((counts.get((kind, False), 0) + 0.5) / total[False])
            self.score[kind] = max(-2.0, min(2.0, odds))

    def word(self, e: Element) -> float:
        """Words score above zero but for those in frames and in links outside paragraphs; the main
        element adds to the score."""
        kind = place(e)
        more = max(0.1, min(1.0, self.score.get("main", 0.5))) if e.main else 0.0
        if e.frame:
            return max(-0.5, min(-0.1, self.score.get("w " + kind, -0.5)))
        if e.link:
            return more + max(-0.3, min(0.3, self.score.get("w " + kind, 0.2 if e.block == "p" else -0.3)))
        return more + max(0.2, min(1.0, self.score.get("w " + kind, 1.0)))

    def tag(self, tag: str) -> float:
        """Tags score below zero: hardly, if content has them; more, if frames have them."""
        name = tag.lstrip("/|")
        return max(-0.3, min(-0.01, self.score.get("t " + name, -0.1)))


def region(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous run with the greatest sum; the first of equal runs."""
    best = total = 0.0
    begin = first = last = 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, first, last = total, begin, i + 1
    return first, last


def extract(page: str, weights: Weights) -> str:
    found = read(page)
    scores = [weights.tag(tag) if text is None else n * weights.word(e) for tag, text, e, n in found]
    first, last = region(scores)
    blocks, open_block = [], []
    for tag, text, e, _ in found[first:last]:
        if text is not None:
            if not e.frame:
                open_block.append(text)
        elif "|" in tag:
            blocks.append(open_block)
            open_block = []
        elif tag in ("br", "img"):
            open_block.append(" ")
    blocks.append(open_block)
    lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def fit(pages: DataFrame, html_col: str = "html", limit: int = TRAIN_PAGES) -> Weights:
    """Weights from the first ``limit`` pages (of at most ``TRAIN_CHARS`` characters) that mark
    their main region; they are taken from as few partitions as hold them."""
    page = F.col(html_col).cast("string")
    labelled = pages.select(page.alias("html")).where(page.rlike("(?i)<(article|main)[\\s>]") & (F.char_length(page) <= TRAIN_CHARS))
    counts: Counter = Counter()
    for row in labelled.take(limit):
        counts.update(count_places(row.html))
    return Weights(counts)


def extract_text(pages: DataFrame, weights: Weights, keep: list[str], html_col: str = "html") -> DataFrame:
    """The columns ``keep`` with text and n_chars."""
    sent = pages.sparkSession.sparkContext.broadcast(weights)
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("_html"))
    schema = rows.drop("_html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "_html"):
            texts = [extract(p, sent.value) for p in strings(batch, "_html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return rows.mapInArrow(run, schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit(pages), ["page_id", "url"])
