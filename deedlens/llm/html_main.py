"""HTML main-text extraction by a maximum-scoring subsequence.

A page becomes a sequence of words and tags.  Words score positive and tags
negative, with weights learned from labelled pages: the log-odds that a token
of its kind lies in the content.  One linear scan finds the contiguous region of
the largest sum.  It grows to the whole element that holds it (in the body itself,
to the text elements next to it).  What stands in the region but belongs to an
element that is never content (navigation, notices, adverts, forms, reader
comments, ...) costs the scan nothing and is left out; the rest is returned as blocks.

What is never content follows from tags and from class names.  The words of a name
add their weights: fixed words of menus, notices, comments and the like are negative, words
of layout weigh nothing, other words speak for content (``related`` and ``related-posts``
are left out, ``related-work`` and ``copyright-law`` are not) until labelled pages show them
outside the content only.  Such names only count beside other text: where they would leave only headings and links of a page, the scan takes the named element with the largest sum for content
(``class="post comment-enabled"`` around the article), and decides again.

Labels: pages whose markup names the article (``article``, ``main`` or
``itemprop=articleBody``).  Those names are the label and never a feature, so the
weights carry over to pages without them.  A label names the whole article with the adverts
in it, so it teaches which names stand outside, never that a fixed word is content.  The
model is fitted on at most ``FIT_PAGES`` page ids (those of the smallest hash); rows of a
repeated id are all counted.

Edge cases: null or empty html gives an empty text; a page whose best sum is
not positive has no main text; markup that is cut off or badly nested is read as
far as it goes; a head without an end ends where the body's text or tags begin; an
attribute without its closing quote ends with the tag; elements nested deeper than
``MOST_DEPTH`` stand beside each other there, as in browsers; repeated rows give repeated results; ties take the earlier,
shorter region; extra columns are ignored; an empty table gives no rows (its
model is the prior).
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_blocks

FIT_PAGES = 2_000
MOST_DEPTH = 512
BLOCK_BYTES = 4_000_000
#: Words of a run that may make a named element content.
LONG_RUN = 12

# Fixed names of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video textarea select title xmp noembed noframes".split())
#: Tags that leave the head open.
HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: Elements that are never content.
NEVER = frozenset("nav header footer aside form button menu dialog label".split())
#: Words in class, id, role or aria-label that speak against content.
NEVER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer masthead header topbar cookie cookies consent gdpr notice notices alert popup modal "
    "newsletter subscribe subscription signup login share sharing social comment comments reply replies respond disqus discussion "
    "related recommended pagination pager widget toolbar skip search contentinfo complementary disclaimer copyright paywall".split()
)
#: Words of layout in such names: they say nothing about content.
LAYOUT_NAMES = frozenset(
    "area article articles bar block bottom box btn button buttons center col column container content count entry form global grid group "
    "inner item items js layout left link links list main news outer page pages panel part post posts primary reader right row secondary "
    "section site slot small stories story text thread title tools top unit user users view wrap wrapper".split()
)
#: A name below this weight marks what is never content.
NEVER_WEIGHT = -2.0
#: Pages that a name's prior counts as.
PRIOR_PAGES = 4.0
LABELS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that running text is made with.
TEXT_TAGS = frozenset("p br b i u em strong span sup sub code pre q cite blockquote ul ol li dl dt dd h2 h3 h4 h5 h6 a table tr td th tbody figure img".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*)(?=>|$)|[^>]*)(?:>|$)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
NAME_WORD = re.compile(r"[a-z]+")
CAPITAL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")


class Element:
    """An element and what it stands in."""

    __slots__ = ("name", "parent", "depth", "named", "words")

    def __init__(self, name, parent, named=False, words=()):
        if parent and parent.depth >= MOST_DEPTH:
            parent = parent.parent
        self.name, self.parent, self.depth = name, parent, parent.depth + 1 if parent else 0
        #: The words of its class names.
        self.words = words
        #: The innermost element, from this one outwards, whose class names say it is never content.
        self.named = self if named else parent.named if parent else None

    def at_depth(self, depth: int) -> Element:
        """The element that holds this one (or is it) at ``depth``, or this one if it is not so deep."""
        x = self
        while x.depth > depth:
            x = x.parent
        return x


class Segment:
    """A run of text, or a tag, with what it stands in (a tag stands in its own element)."""

    __slots__ = ("text", "words", "tag", "kind", "block", "inside", "never", "linked", "element")

    def __init__(self, text, words, tag, kind, block, inside, never, linked, element):
        self.text, self.words, self.tag, self.kind = text, words, tag, kind
        self.block, self.inside, self.never, self.linked, self.element = block, inside, never, linked, element


def _never(name: str, attributes: str, weights: dict[str, float]) -> tuple[bool, bool, list[str]]:
    """Whether an element is never content by its tag or because it is hidden, and by its class names; their words."""
    if name in NEVER or name == "head":
        return True, False, []
    hidden, named, words = False, False, []
    if name not in ("body", "html", "article", "main") and attributes:
        for key, value in ATTRIBUTE.findall(attributes):
            key = key.lower()
            if key in ("class", "id", "role", "aria-label"):
                for token in value.strip("\"'").split():
                    found = NAME_WORD.findall(CAPITAL.sub(" ", token).lower())
                    words += found
                    named = named or sum(name_weight(w, weights) for w in found) < NEVER_WEIGHT
            elif key == "hidden" or (key == "aria-hidden" and "true" in value.lower()) or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                hidden = True
    return hidden, named, words


def name_weight(word: str, weights: dict[str, float]) -> float:
    """The weight of a word of a class name: negative speaks against content."""
    if word in LAYOUT_NAMES or len(word) < 2:
        return 0.0
    prior = math.log((PRIOR_PAGES + 0.5) / 0.5)
    return -prior if word in NEVER_NAMES else weights.get("n:" + word, prior)


def _is_label(name: str, attributes: str) -> bool:
    return name in LABELS or "articlebody" in attributes.lower()


def segments(page: str, weights: dict[str, float]) -> list[Segment]:
    """The page's text runs and tags, in order; ``weights`` are those of class names."""
    out: list[Segment] = []
    # open elements: name, never-content, labelled, linked, text kind, element
    stack: list[tuple[str, bool, bool, bool, str, Element]] = [("", False, False, False, "none", Element("", None))]
    open_names: Counter = Counter()
    block, raw_until, pos, end = 0, None, 0, len(page)

    def close(at: int) -> None:
        for x in stack[at:]:
            open_names[x[0]] -= 1
        del stack[at:]

    while pos < end:
        if raw_until:
            m = re.compile(rf"</{re.escape(raw_until)}(?=[\s/>])", re.I).search(page, pos)
            raw_until, pos = None, m.start() if m else end
            continue
        m = TOKEN.match(page, pos)
        pos = m.end()
        name = m[2]
        if name is None:
            raw = m[0]
            if raw.startswith(("<!", "<?")):
                continue
            text = html.unescape(raw) if "&" in raw else raw
            if stack[-1][0] == "head" and not text.isspace():
                close(len(stack) - 1)
            _, never, inside, linked, kind, element = stack[-1]
            out.append(Segment(text, len(text.split()), "", kind, block, inside, never, linked, element))
            continue
        name, closing = name.lower(), bool(m[1])
        attributes = m[3] or ""
        if name in BLOCKS:
            block += 1
        if closing:
            if open_names[name] > 0:
                at = len(stack) - 1
                while stack[at][0] != name:
                    at -= 1
                _, never, inside, linked, _, element = stack[at]
                close(at)
                out.append(Segment(" " if name in ("td", "th") else "", 0, "/" + name, "", block, inside, never, linked, element))
            continue
        if stack[-1][0] == "head" and name not in HEAD:
            close(len(stack) - 1)
        if name in CLOSES_P and open_names["p"] > 0:  # an open paragraph ends where a block begins
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in BLOCKS:
                    break
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            if stack[-1][0] == name or (name in ("dt", "dd") and stack[-1][0] in ("dt", "dd")):
                close(len(stack) - 1)
        _, never, inside, linked, kind, parent = stack[-1]
        hidden, named, words = _never(name, attributes, weights)
        never = never or hidden
        element = Element(name, parent, named, words)
        if name in RAW and not attributes.rstrip().endswith("/"):
            raw_until = name
            out.append(Segment("", 0, name, "", block, inside, True, linked, element))
            # nothing in it is page text
            stack.append((name, True, inside, linked, "raw", element))
            open_names[name] += 1
            continue
        inside = inside or _is_label(name, attributes)
        linked = linked or name == "a"
        kind = name if name in BLOCKS else kind
        out.append(Segment(" " if name == "br" else "", 0, name, "", block, inside, never, linked, element))
        if name not in VOID:
            stack.append((name, never, inside, linked, kind, element))
            open_names[name] += 1
    return out


def mark_named(found: list[Segment], lifted: set[Element]) -> list[bool]:
    """Marks what stands in named elements, but for ``lifted`` ones, as never content; gives what it was."""
    before = [s.never for s in found]
    for s in found:
        named = s.element.named
        while named is not None and named in lifted:
            named = named.parent.named if named.parent else None
        s.never = s.never or named is not None
    return before


def word_key(s: Segment) -> str:
    """Kind of the words of a run: the nearest block, links, run length."""
    size = "long" if s.words >= 12 else "mid" if s.words >= 4 else "short"
    kind = "other" if s.kind in LABELS else s.kind
    return f"w:{kind}:{'a' if s.linked else '-'}:{'never' if s.never else size}"


def tag_key(s: Segment) -> str:
    """Kind of a tag; the tags that labels are made of share one."""
    name = s.tag.lstrip("/")
    return "t:other" if name in LABELS else f"t:{name}:{'never' if s.never else '-'}"


def count_page(page: str) -> Counter | None:
    """Tokens inside (``1``) and outside (``0``) of the labelled content, and pages that have most of a name's text there; None: no label."""
    found = segments(page, {})
    if not any(s.inside for s in found):
        return None
    beneath: Counter = Counter()  # words of text in elements with a name, inside less outside
    for s in found:
        element = s.element if s.words else None
        while element is not None:
            for w in element.words:
                beneath[w] += s.words if s.inside else -s.words
            element = element.parent
    mark_named(found, set())
    counts: Counter = Counter()
    for s in found:
        positive = int(s.inside and not s.never)
        if s.tag:
            counts[tag_key(s), positive] += 1
        elif s.words:
            counts[word_key(s), positive] += s.words
    for w, more in beneath.items():
        if w not in NEVER_NAMES and w not in LAYOUT_NAMES and len(w) > 1:
            counts["n:" + w, int(more >= 0)] += 1
    return counts


#: A prior in counts: plain words are content, links and never-elements are not.
PRIOR_WORDS = 4.0


def weights_from(counts: dict[tuple[str, int], float]) -> dict[str, float]:
    """Weights in [-3, 1], of names in [-3, 3]: words tend to be positive, tags negative."""
    out = {}
    for key in {k for k, _ in counts}:
        inside, outside = counts.get((key, 1), 0), counts.get((key, 0), 0)
        if key.startswith("n:"):  # a name speaks for content until pages show otherwise
            out[key] = min(3.0, max(-3.0, math.log((inside + PRIOR_PAGES + 0.5) / (outside + 0.5))))
            continue
        prior = default_weight(key)
        p = (inside + PRIOR_WORDS * (prior > 0) + 0.5) / (inside + outside + PRIOR_WORDS + 1)
        score = math.log(p / (1 - p))
        if key.startswith("t:"):
            out[key] = min(-0.05, max(-3.0, score - 1.0))  # every tag costs a little at least
        else:
            out[key] = min(1.0, max(-3.0, score))
    return out


def default_weight(key: str) -> float:
    """Weight of a token kind that no labelled page holds."""
    if key.startswith("t:"):
        return -1.0 if key.endswith("never") else -0.1 if key.split(":")[1] in TEXT_TAGS else -0.5
    _, _, linked, size = key.split(":")
    return -3.0 if size == "never" else -0.5 if linked == "a" else {"long": 1.0, "mid": 0.5, "short": 0.2}[size]


def best_region(scores: list[float]) -> tuple[int, int]:
    """The contiguous region of the largest positive sum, as [start, end)."""
    best, best_at, running, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if running <= 0:
            running, start = 0.0, i
        running += x
        if running > best:
            best, best_at = running, (start, i + 1)
    return best_at


PAGE_LEVEL = ("", "html", "body")


def container(element: Element) -> Element:
    """The innermost element around ``element``, or it, that is not made for running text itself."""
    while element.parent and element.name in TEXT_TAGS and element.name not in ("td", "th"):
        element = element.parent
    return element


def common_element(a: Element, b: Element) -> Element:
    """The innermost element that holds both."""
    depth = min(a.depth, b.depth)
    a, b = a.at_depth(depth), b.at_depth(depth)
    while a is not b:
        a, b = a.parent, b.parent
    return a


def whole_container(found: list[Segment], lo: int, hi: int) -> tuple[int, int]:
    """The region [lo, hi) grown to the element that holds it, and to those that hold its ends.

    The body (or a page without one) holds more than an article: there a region
    grows over text and text elements, up to the next other element or list of links.
    """
    ends = [s.element for s in found[lo:hi] if s.words and not s.never]
    around = ends[0]
    for element in ends[1:]:
        if element is not around:
            around = common_element(around, element)
    around = container(around)
    for box in (container(ends[0]), container(ends[-1]), around):
        if box.name in PAGE_LEVEL:
            continue
        while lo and found[lo - 1].element.at_depth(box.depth) is box:
            lo -= 1
        while hi < len(found) and found[hi].element.at_depth(box.depth) is box:
            hi += 1
    if around.name not in PAGE_LEVEL:
        return lo, hi
    grown = []
    for at, end, step in ((lo - 1, -1, -1), (hi, len(found), 1)):
        edge = at
        while at != end and found[at].element.at_depth(around.depth) is around:
            s = found[at]
            if s.element is around:
                if s.tag:
                    break
                at += step
                edge = at if s.words else edge
                continue
            child, words, linked, never = s.element.at_depth(around.depth + 1), 0, 0, True
            while at != end and found[at].element.at_depth(around.depth + 1) is child:
                s = found[at]
                if not s.never:
                    never, words, linked = False, words + s.words, linked + s.words * s.linked
                at += step
            if never:
                continue
            if child.name not in TEXT_TAGS or linked * 2 > words:
                break
            edge = at
        grown.append(edge)
    return grown[0] + 1, grown[1]


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page: its blocks joined by an empty line."""
    if not page:
        return ""
    found, lifted = segments(page, weights), set()
    while True:
        hard = mark_named(found, lifted)
        text, running = region_text(found, weights)
        if running:
            return text
        # no running text beside named elements: the one with the largest sum is content
        sums: dict[Element, float] = {}
        for s, gone in zip(found, hard):
            named = s.element.named
            if s.words >= LONG_RUN and not gone and named is not None and named not in lifted:
                while named.parent and named.parent.named is not None and named.parent.named not in lifted:
                    named = named.parent.named
                s.never = False
                sums[named] = sums.get(named, 0.0) + weight_of(s, weights) * s.words
        best = max(sums, key=sums.get, default=None)  # the first of equals
        if best is None or sums[best] <= 0:
            return text
        lifted.add(best)
        for s, gone in zip(found, hard):
            s.never = gone


def weight_of(s: Segment, weights: dict[str, float]) -> float:
    """The weight of a tag, or of each word of a run."""
    key = tag_key(s) if s.tag else word_key(s)
    w = weights.get(key)
    return default_weight(key) if w is None else w


def region_text(found: list[Segment], weights: dict[str, float]) -> tuple[str, bool]:
    """The text of the best region, and whether any of it is more than headings and links."""
    # what is left out anyway scores nothing: a region goes on after it
    scores = [0.0 if s.never else weight_of(s, weights) * (1 if s.tag else s.words) for s in found]
    lo, hi = best_region(scores)
    if lo == hi:
        return "", False
    lo, hi = whole_container(found, lo, hi)
    # a region ends inside no block: the rest of its first and last block belongs to it
    first, last = found[lo].block, found[hi - 1].block
    while lo and found[lo - 1].block == first:
        lo -= 1
    while hi < len(found) and found[hi].block == last:
        hi += 1
    # a heading right before the region heads it
    at = lo
    while at and (found[at - 1].tag or found[at - 1].kind in ("h1", "h2") or not found[at - 1].words):
        at -= 1
        if found[at].kind in ("h1", "h2") and found[at].words and not found[at].never:
            lo = at
    blocks: list[list[str]] = []
    open_block = None
    for s in found[lo:hi]:
        if s.never or not s.text:
            continue
        if s.block != open_block:
            blocks.append([])
            open_block = s.block
        blocks[-1].append(s.text)
    joined = (SPACE.sub(" ", "".join(b)).strip() for b in blocks)
    running = any(s.words and not s.never and not s.linked and s.kind not in HEADINGS for s in found[lo:hi])
    return "\n\n".join(b for b in joined if b), running


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", limit: int = FIT_PAGES) -> dict[str, float]:
    """Weights from at most ``limit`` labelled pages; counts are summed by Spark."""
    rows = pages.select(pages[id_col].alias("k"), pages[html_col].alias("html")).where(F.col("html").isNotNull())
    sample = rows.select("k").orderBy(F.xxhash64("k"), "k").limit(limit).distinct()
    rows = rows.join(F.broadcast(sample), "k", "left_semi").select("html")  # at most ``limit`` ids

    def count(batches):
        total: Counter = Counter()
        for b in batches:
            for _, _, found in text_blocks(b, "html", BLOCK_BYTES):
                for page in found:
                    total.update(count_page(page) or {})
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in total], pa.string()), pa.array([p for _, p in total], pa.int32()), pa.array(list(total.values()), pa.int64())],
            ["k", "inside", "n"],
        )

    counted = rows.mapInArrow(count, "k string, inside int, n long").groupBy("k", "inside").agg(F.sum("n").alias("n"))
    return weights_from({(r["k"], r["inside"]): float(r["n"]) for r in counted.collect()})


def extract_main_text(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    weights = fit(pages, id_col, html_col) if weights is None else weights
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    kinds = dict(rows.dtypes)

    def run(batches):
        for b in batches:
            for lo, hi, found in text_blocks(b, "html", BLOCK_BYTES):
                texts = [main_text(x, weights) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id").slice(lo, hi - lo), b.column("url").slice(lo, hi - lo), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op1_html_extraction(spark, sf_dir):
    """Query op1: the main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))
