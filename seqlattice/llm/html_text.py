"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page becomes a sequence of words and tags. A word scores +1, or as much below 0 where an element around it is known for menus, adverts and the like; a
tag scores below 0, and lower the more it is found outside of articles. One linear scan finds the contiguous region of the highest score. If that lies in an
``article`` or ``main`` element for the most part, it is taken to that element's borders. The region's blocks, without those in such elements, are the text.

Weights come from labelled pages: those that mark one ``article`` themselves. Of them, those with the ``TRAIN_PAGES`` least hashes of their ids are read: the
bound of the sample (rows of one id are in it together). Pages without labels, or none at all, leave the weights at the fixed values below.

Odd pages: a null or empty html gives an empty text, as does one without words outside of markup; text without any tag is one block. Elements that
are never closed end with the one around them, tags in no order are taken as they come, and what never ends (a comment, a script) runs to the page's
end. Character references are decoded once, known ones also without their semicolon. Rows of one id are read each; null ids pass through.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlattice.llm.common import batches_of, text_rows

#: Labelled pages that weights are learned from, at most.
TRAIN_PAGES = 2_000
#: A word's score, and, where nothing is known of it, that of a tag of running text and of any other.
WORD, TEXT_TAG, TAG = 1.0, -0.25, -3.0
TEXT_TAGS = frozenset("abbr b blockquote br cite code em figcaption h1 h2 h3 h4 h5 h6 i mark p pre q s small span strong sub sup time u".split())
#: Times that a name must be met, and the share of its words outside of articles, to be learned as one of menus and the like.
LEAST_WORDS, OUTSIDE = 20, 0.9

# Elements of HTML by what they hold.
HIDDEN = frozenset("script style noscript template svg math iframe object embed canvas audio video select textarea datalist head title button".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
AROUND = frozenset("nav footer aside form dialog menu".split())
#: Elements that tell nothing by their name alone.
PLAIN = frozenset("html body div span section article main ul ol li p a b i em strong table tbody thead tr td th h1 h2 h3 h4 h5 h6 figure blockquote pre header br".split())
#: Words of class, id and role that name what is not the article.
NAMES = frozenset("ad ads adv advert advertisement alert alertdialog banner breadcrumb breadcrumbs byline-share complementary consent contentinfo cookie copyright dialog disclaimer footer form gdpr legal login menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud teaser toolbar topbar trending widget".split())
PARTS_OF_NAMES = re.compile("advert|breadcrumb|comment|cookie|disqus|navbar|newsletter|promo|sidebar|sponsor|subscri")
#: Names of what holds the article where no ``article`` or ``main`` does.
HOLDS = frozenset("article articlebody content entry main post story".split())
#: Names of headers: of a page, not of the article's title.
TOPS = frozenset("header masthead".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(frozen=True)
class Weights:
    """Scores of tags by name, and names (``tag``, or ``.word`` of class, id and role) whose words are not the article's."""

    tags: dict[str, float] = field(default_factory=dict)
    outside: frozenset[str] = frozenset()


@dataclass
class Element:
    tag: str
    names: frozenset[str]
    hidden: bool
    outside: bool
    holds: bool
    number: int


@dataclass
class Piece:
    """Text between two tags: its words, the block it is in, what is around it."""

    text: str
    words: int
    block: int
    outside: bool
    names: frozenset[str]
    article: int
    tags: list[str]


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip() else {}


def names_of(tag: str, found: dict[str, str]) -> frozenset[str]:
    words = {w.lower() for key in ("class", "id", "role") for w in NAME_WORD.findall(found.get(key, ""))}
    whole = {w.lower() for key in ("class", "id", "role") for w in found.get(key, "").split()}
    return frozenset({"." + w for w in words | whole} | {tag})


def is_outside(tag: str, names: frozenset[str], in_article: bool, weights: Weights) -> bool:
    """Whether an element's words are a menu's, an advert's and so on. What wraps the whole page is never, whatever its class says."""
    if tag in ("html", "body", "main"):
        return False
    words = {n[1:] for n in names if n[0] == "."}
    if tag in AROUND or words & NAMES or any(PARTS_OF_NAMES.search(w) for w in words):
        return True
    if not in_article and (tag == "header" or words & TOPS):
        return True
    return tag != "article" and bool(names & weights.outside)


def pieces(page: str, weights: Weights) -> list[Piece]:
    """The visible text of a page in order, with the tags before each piece; the last may be an empty one for the tags at the end."""
    out: list[Piece] = []
    stack: list[Element] = []
    state = {"block": 0, "number": 0}
    tags: list[str] = []

    def text(raw: str) -> None:
        if not raw or any(e.hidden for e in stack):
            return
        decoded = html.unescape(raw)
        inside = next((e.number for e in reversed(stack) if e.tag in ("article", "main") and not e.outside), 0) or next((e.number for e in stack if e.holds and not e.outside), 0)
        names = frozenset().union(*(e.names for e in stack)) if stack else frozenset()
        out.append(Piece(decoded, len(decoded.split()), state["block"], any(e.outside for e in stack), names, inside, tags[:]))
        tags.clear()

    def close(tag: str) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag == tag:
                del stack[i:]
                return

    at = 0
    while True:
        m = TOKEN.search(page, at)
        text(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS:
            state["block"] += 1
        if tag not in HIDDEN:
            tags.append(tag)
        if m[1] or m[4]:
            close(tag)
            continue
        found = attributes(m[3] or m[6] or "")
        if tag == "body":
            close("head")
        if tag in ("article", "main"):  # an element that was never closed does not hold it
            first = next((i for i, e in enumerate(stack) if e.outside and e.tag not in ("article",) or e.tag == "head"), None)
            if first is not None and not is_outside(tag, names_of(tag, found), False, weights):
                del stack[first:]
        if tag in VOID or (m[3] or m[6] or "").rstrip().endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in BLOCKS:  # a block ends the paragraph that is open
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                if i == len(stack) or stack[i].tag in BLOCKS:
                    break
        if tag in ("li", "tr", "td", "th", "option", "dd", "dt") and stack and stack[-1].tag == tag:
            stack.pop()
        names = names_of(tag, found)
        hidden = tag in HIDDEN or "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")))
        if tag in BLOCKS or hidden or len(names) > 1:
            state["number"] += 1
            in_article = any(e.tag in ("article", "main") and not e.outside for e in stack)
            holds = tag in ("div", "section", "td") and bool({"." + w for w in HOLDS} & names)
            stack.append(Element(tag, names, hidden, is_outside(tag, names, in_article, weights), holds, state["number"]))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous part of the highest sum; the first and shortest of several, (0, 0) if no sum is over 0."""
    best, start, end, total, first = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, first = 0.0, i
        total += x
        if total > best:
            best, start, end = total, first, i + 1
    return start, end


def scored(found: list[Piece], weights: Weights) -> list[float]:
    """Scores in turn of the tags before each piece and of its words."""
    out = []
    for p in found:
        out.append(sum(weights.tags.get(t, TEXT_TAG if t in TEXT_TAGS else TAG) for t in p.tags))
        out.append(p.words * (-WORD if p.outside else WORD))
    return out


def main_text(page: str | None, weights: Weights) -> str:
    found = [p for p in pieces(page or "", weights)]
    start, end = best_region(scored(found, weights))
    first, last = start // 2, (end + 1) // 2
    region = found[first:last]
    inside: Counter[int] = Counter()
    for p in region:
        if not p.outside:
            inside[p.article] += p.words
    if inside:
        number, words = max(inside.items(), key=lambda x: x[1])
        if number and 2 * words > sum(inside.values()):
            region = [p for p in found if p.article == number]
    blocks: list[list[str]] = []
    now = None
    for p in region:
        if p.outside:
            continue
        if p.block != now:
            blocks.append([])
            now = p.block
        blocks[-1].append(" " + p.text if "br" in p.tags else p.text)
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def counts(page: str | None) -> Counter[tuple[str, bool]]:
    """For a page that marks one article: (name, inside) -> tags, and words of the elements called so. Else nothing."""
    found = pieces(page or "", Weights())
    out: Counter[tuple[str, bool]] = Counter()
    if len({p.article for p in found if p.article}) != 1 or len(re.findall(r"<article[\s>]", page or "", re.I)) != 1:
        return out
    for p in found:
        inside = bool(p.article)
        for t in p.tags:
            out["<" + t, inside] += 1
        for n in p.names:
            out[n, inside] += p.words
        out["words", inside] += p.words
    return out


def train(pages: DataFrame, id_col: str = "page_id", page: str = "html", most: int = TRAIN_PAGES) -> Weights:
    """Weights from a sample of the labelled pages: those with the ``most`` least different hashes of their ids. Only hashes are gathered, no pages."""
    marked = pages.where(F.col(page).rlike("(?i)<article[\\s>]")).select(F.col(page).alias("page"), F.xxhash64(F.col(id_col)).alias("h"))
    last = marked.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).head()[0]
    sample = marked.where(F.col("h") <= F.lit(last).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: Counter[tuple[str, bool]] = Counter()
            for text in b.column("page").to_pylist():
                total.update(counts(text))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.bool_()), pa.array(list(total.values()), pa.int64())], names=["name", "inside", "n"])

    found = text_rows(sample, F.col("page")).mapInArrow(run, "name string, inside boolean, n long").groupBy("name", "inside").agg(F.sum("n").alias("n"))
    # names of the sample's pages only
    return weights_of({(r["name"], r["inside"]): r["n"] for r in found.collect()})


def weights_of(n: dict[tuple[str, bool], int]) -> Weights:
    """A tag costs as many words as lie between articles and the rest: the geometric mean of their words a tag, by the share of this tag that lies outside."""
    tags = {k[0] for k in n if k[0].startswith("<")}
    of = lambda side: sum(n.get((t, side), 0) for t in tags)
    density = [n.get(("words", side), 0) / of(side) if of(side) else 0.0 for side in (True, False)]
    if not all(density):
        return Weights()
    cost = math.sqrt(density[0] * density[1])
    share = lambda name: (n.get((name, False), 0) + 1) / (n.get((name, True), 0) + n.get((name, False), 0) + 2)
    names = {k[0] for k in n if not k[0].startswith("<") and k[0] != "words" and k[0] not in PLAIN}
    outside = {x for x in names if n.get((x, False), 0) >= LEAST_WORDS and n.get((x, False), 0) >= OUTSIDE * (n.get((x, False), 0) + n.get((x, True), 0))}
    return Weights({t[1:]: -cost * share(t) for t in tags}, frozenset(outside))


def extract(pages: DataFrame, weights: Weights, page: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars`` (code points). Columns of these names are replaced."""
    kept = [c for c in pages.columns if c not in ("text", "n_chars", page)]
    schema = T.StructType([*[pages.schema[c] for c in kept], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, "_page"):
            texts = [main_text(x, weights) for x in b.column("_page").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=schema.names)

    return text_rows(pages, *[F.col(f"`{c}`") for c in kept], F.col(page).alias("_page")).mapInArrow(run, schema)
