"""HTML extraction by a maximum-scoring subsequence of words and tags.

A page is read as a sequence of words and tags. A word scores by where it stands: its region (such as
article, nav or div), its block there (such as p or li, inside a link or not) and the class, id and
role names of the nearest element that has some; the score is the log odds of main text against the
rest, learned from labelled pages; a tag scores negative, the more so the more often it stands outside
main text in that region. One linear scan finds the contiguous stretch with the highest sum: the
content region. Words of it that stand in boilerplate (an advert between two paragraphs) are left out,
and what remains is joined block by block.

Labelled pages are those that mark their main text with an ``article`` element; weights are counted
on at most ``MOST_LABELLED`` of them, the first by a hash of page_id. Elements and names of boilerplate
count as outside main text wherever they stand, in labelled articles, too; so they have a negative
weight even where the sample lacks them. Names are taken whole (``sidebar``, ``site-header``, not
``has-sidebar``), and those of html, body, main and article say nothing. A header in an article belongs
to it.

Defined cases: a null or empty page, or one whose best sum is not above 0, gives an empty text;
unclosed tags, comments and scripts end with the page; scripts, styles, titles and the like are raw
text up to their own end tag; a head without an end tag ends where text or an element comes that
cannot stand in it; very long pages are read whole, in time linear in their length however many
elements are open; repeated rows give equal texts; other columns pass through ``with_main_text``, whose
own (text, n_chars) replace equal names.
"""

from __future__ import annotations

import html as html_module
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

MOST_LABELLED = 2000
TAG_COST = 0.2
MOST_WEIGHT = 3.0
MOST_NAMES = 4                  # names of an element that count

# fixed values: element names of HTML and common names of page parts
DROPPED = frozenset("script style noscript template head title svg math iframe object select option textarea button canvas audio video".split())
RAW = frozenset("script style noscript title textarea iframe".split())         # text up to their end tag, without markup
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
                   "footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot "
                   "th thead tr ul".split())
REGIONS = frozenset("article aside body div footer form header main menu nav section table ul ol".split())    # no inline end tag closes them
SECTIONS = REGIONS - {"table", "ul", "ol"}
UNNAMED = frozenset("html body main article".split())       # their names tell of the page, not of its parts
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("ad ads advert advertisement advertising aside banner breadcrumb breadcrumbs comment comments consent cookie "
                        "cookies disclaimer discussion footer form header masthead menu modal nav navbar navigation newsletter notice "
                        "pagination popup promo promoted recommended related replies reply respond share sharing sidebar social "
                        "sponsor sponsored subscribe teaser toolbar widget".split())
BOILERPLATE_ELEMENTS = frozenset("aside footer form header menu nav".split())
NEGATIONS = frozenset("category has is no not tag with without".split())
SPACE = "\x20\t\n\x0b\x0c\r"

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|([^<]+|<)", re.S)
RAW_END = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>])[^>]*(?:>|\Z)", re.I) for name in RAW}
SCRIPT_PART = re.compile(r"<!--(?:-*>)?|-->|<(/?)script(?=[ \t\n\f\r/>])(?:[^>]*(?:>|\Z))?", re.I)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
COMPOUND = re.compile(r"[-_]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def names_of(attributes: str) -> tuple[str, ...]:
    """The whole class, id and role names, lower-cased, at most ``MOST_NAMES``."""
    given = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower().split()
    return tuple(given[:MOST_NAMES])


def is_boilerplate_name(name: str) -> bool:
    """A name of boilerplate, or a compound that ends in one and has no negation (``site-header``)."""
    if name in BOILERPLATE:
        return True
    parts = COMPOUND.split(name)
    return len(parts) > 1 and parts[-1] in BOILERPLATE and not NEGATIONS.intersection(parts)


class Place(NamedTuple):
    """What the open elements say of a text; carried along, so that no text looks at them again."""
    region: str = "body"
    boilerplate: str = ""       # the outermost feature of boilerplate
    names: tuple[str, ...] = ()
    block: str = "body"
    link: bool = False
    article: bool = False

    def within(self, name: str, attributes: str) -> "Place":
        names = names_of(attributes) if attributes and name not in UNNAMED else ()
        if not (names or name in SECTIONS or name in BLOCKS or name == "a"):
            return self
        region = self.region
        if name in SECTIONS:
            region = f"article {name}" if self.article and name in ("header", "footer") else name
        own = self.boilerplate
        if name == "main" and own.startswith("name "):
            own = ""                                    # what a page names around its main element says nothing of it
        if not own:
            if region in BOILERPLATE_ELEMENTS and name in SECTIONS or region == "article footer" != self.region:
                own = f"region {region}"
            own = next((f"name {n}" for n in names if is_boilerplate_name(n)), own)
        return Place(region, own, names or self.names, name if name in BLOCKS else self.block, self.link or name == "a",
                     self.article or name == "article")


class Open:
    """The open elements: a frame per region, in it the elements that are no regions."""

    def __init__(self):
        self.frames: list[tuple[str, Place, list[tuple[str, Place]], Counter]] = [("", Place(), [], Counter())]
        self.regions: Counter = Counter()
        self.place = Place()

    def _pop_inner(self, name: str) -> None:
        _, _, inner, count = self.frames[-1]
        while inner:
            element, self.place = inner.pop()
            count[element] -= 1
            if element == name:
                break

    def open(self, name: str, attributes: str) -> None:
        _, _, inner, count = self.frames[-1]
        if name in BLOCKS and inner and inner[-1][0] == "p":
            self._pop_inner("p")
        if name == "li" and count["li"]:
            self._pop_inner("li")
        if name in REGIONS:
            self.frames.append((name, self.place, [], Counter()))
            self.regions[name] += 1
        else:
            inner.append((name, self.place))
            count[name] += 1
        self.place = self.place.within(name, attributes)

    def close(self, name: str) -> None:
        if name not in REGIONS:
            if self.frames[-1][3][name]:
                self._pop_inner(name)
            return
        while self.regions[name]:
            element, self.place, _, _ = self.frames.pop()
            self.regions[element] -= 1
            if element == name:
                break


def _raw_end(page: str, name: str, at: int) -> int:
    """Where the raw text of an element that starts at ``at`` ends, its end tag included. As in HTML, a
    script may hold scripts of its own within ``<!--`` and ``-->``."""
    if name != "script":
        m = RAW_END[name].search(page, at)
        return m.end() if m else len(page)
    escaped = inner = False
    while m := SCRIPT_PART.search(page, at):
        part, at = m.group().lower(), m.start() + 1
        if part.startswith("<!--"):
            escaped = not part.endswith(">")
            inner = inner and escaped
            at = m.end()
        elif part == "-->":
            escaped = inner = False
        elif not m.group(1):
            inner = escaped
        elif inner:
            inner = False
        else:
            return m.end()
    return len(page)


def tokens(page: str) -> Iterator[tuple]:
    """("tag", name, place) and ("text", text, place, block number)."""
    elements = Open()
    block, skip, head, at = 0, None, False, 0
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        closing, name, attributes, text = m.groups()
        if name is not None:
            name = name.lower()
            opens = not closing and not attributes.rstrip().endswith("/")
            if opens and name in RAW and skip not in ("svg", "math"):
                if head and not skip and name not in HEAD:
                    head = False
                at = _raw_end(page, name, at)
                continue
            if skip:
                if closing and name == skip:
                    skip = None
                continue
            if head:
                head = name not in ("head", "body", "html", "br") if closing else name in HEAD
                if closing and (head or name == "head"):
                    continue
            if name in DROPPED and not closing:
                if opens and name == "head":
                    head = True
                elif opens:
                    skip = name
                continue
            if head:
                continue
            if name in BLOCKS:
                block += 1
            if closing:
                elements.close(name)
            elif name not in VOID:
                elements.open(name, attributes)
            yield "tag", name, elements.place
        elif text and not skip and text.strip(SPACE):
            head = False                                # nor does text stand in a head
            yield "text", text, elements.place, block


def features(place: Place) -> tuple[str, ...]:
    """A text of boilerplate tells of that alone."""
    if place.boilerplate:
        return (place.boilerplate,)
    return (f"region {place.region}", f"block {place.region} {place.block}{' a' if place.link else ''}", *[f"name {n}" for n in place.names])


def count_page(page: str) -> Counter:
    """(feature, inside the article) with its words or tags; nothing for a page without one."""
    counts: Counter = Counter()
    found = False
    for token in tokens(page):
        place = token[2]
        inside = place.article and not place.boilerplate
        if token[0] == "text":
            found |= inside
            n = len(WORD.findall(token[1]))
            for f in features(place):
                counts[f, inside] += n
        else:
            counts[f"tag {place.region} {token[1]}", inside] += 1
    return counts if found else Counter()


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log odds per feature, bounded; those of tags at most ``-TAG_COST``."""
    totals = {inside: {k: max(1, sum(n for (f, i), n in counts.items() if i == inside and f.startswith(k)))
                       for k in ("region", "block", "name", "tag")} for inside in (True, False)}
    out = {}
    for f in {f for f, _ in counts}:
        kind = f.partition(" ")[0]
        odds = math.log((counts.get((f, True), 0) + 1) / (totals[True][kind] + 2)) - math.log(
            (counts.get((f, False), 0) + 1) / (totals[False][kind] + 2))
        odds = max(-MOST_WEIGHT, min(MOST_WEIGHT, odds))
        out[f] = min(-TAG_COST, odds - TAG_COST) / 3 if kind == "tag" else odds
    return out


def word_weight(weights: dict[str, float], place: Place) -> float:
    """A region or block that the labelled pages lack is slightly positive, boilerplate negative."""
    if place.boilerplate:
        return 0.5 * min(-1.0, weights.get(place.boilerplate, -MOST_WEIGHT))
    of_region, of_block, *of_names = features(place)
    a = weights.get(of_region, weights.get("region article", 0.3) if place.region.startswith("article ") else 0.3)
    b = weights.get(of_block, -1.0 if place.link else 0.3)
    named = [weights[f] for f in of_names if f in weights]
    return a + 0.5 * b + (0.5 * min(named) if named else 0.0)


def tag_weight(weights: dict[str, float], name: str, place: Place) -> float:
    return weights.get(f"tag {place.region} {name}", -TAG_COST)


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """The contiguous range with the highest positive sum, the first and shortest of equal ones;
    (0, 0) if none is positive."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def main_text(page: str, weights: dict[str, float]) -> str:
    sequence = list(tokens(page or ""))
    scores, kept = [], []
    for token in sequence:
        place = token[2]
        if token[0] == "tag":
            scores.append(tag_weight(weights, token[1], place))
            kept.append(False)
        else:
            scores.append(word_weight(weights, place) * len(WORD.findall(token[1])))
            kept.append(not place.boilerplate and weights.get(f"region {place.region}", 0.0) > -1.0)
    first, last = best_stretch(scores)
    blocks: dict[int, list[str]] = {}
    for token, keep in zip(sequence[first:last], kept[first:last], strict=True):
        if keep:
            blocks.setdefault(token[3], []).append(token[1])
        elif token[:2] == ("tag", "br") and blocks:
            blocks[next(reversed(blocks))].append(" ")
    lines = (" ".join(WORD.findall(html_module.unescape("".join(parts)))) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def train(pages: DataFrame, most: int = MOST_LABELLED) -> dict[str, float]:
    """Weights from the labelled sample: counted per page, summed in Spark and fetched; the pages of
    the sample bound their number."""
    def count(batches):
        for batch in batches:
            counts = Counter()
            for page in batch.column("html").to_pylist():
                counts.update(count_page(page or ""))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in counts], pa.string()), pa.array([i for _, i in counts], pa.bool_()),
                 pa.array(list(counts.values()), pa.int64())], names=["feature", "inside", "n"])

    labelled = pages.where(F.instr(F.lower("html"), "<article") > 0).select("page_id", F.xxhash64("page_id").alias("h"))
    sample = labelled.orderBy("h", "page_id").limit(most).select("page_id").distinct()
    rows = (pages.select("page_id", "html").join(sample, "page_id").select("html")
            .mapInArrow(count, "feature string, inside boolean, n bigint")
            .groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect())
    return weights_of({(r["feature"], r["inside"]): r["n"] for r in rows})


def with_main_text(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``pages`` without ``html``, plus ``text`` and ``n_chars`` (its code points)."""
    shared = pages.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]

    def run(batches):
        for batch in batches:
            texts = [main_text(page or "", shared.value) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*kept, "text", "n_chars"])

    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select(*kept, "html").mapInArrow(run, schema)


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_main_text(pages, train(pages))
