"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from few templates. Every token of a page (a tag or a
text, in articles too) is told apart by its path of open elements. Tokens with
the same occurrence vector over all pages of a host form an equivalence class.
Vectors are compared by fingerprint: the exclusive or of a hash of (page,
count) over the pages that hold a token, which every task adds up for itself,
so that a host of any size costs one row per token and task. The template of a
host is its classes in the order that their tokens come in, the most common
first. On a page, a class is valid if its tokens come in that order, round by
round where they repeat, in each slot that has some; it then cuts the slot into
the gaps between its tokens, in which rarer classes nest.

Where a page says what its article is (an element of that meaning; of several
those at the place of the one with most words), its text stays, shared with
other pages or not. Inside, elements that are no part of an article by their
meaning go, and so do those whose names alone say advert, sharing, comments and
the like. A name that an article's own part may have too (a restaurant's menu,
a storm alert, a legal notice) decides nothing by itself: such an element goes
if it is mostly links, or mostly what the host's template holds, or if it is one
of several comments alike. Where no element says what the article is, texts of
the template's classes are boilerplate, and of the slots those go that are
navigation by their elements, names and share of links.

Pages with the same content key (the longest paragraph of their articles) are
copies, near ones too, and count as one, so that a text that is copied is no
template. A class needs ``MIN_PAGES`` such pages: two pages agree in what their
authors repeat, three rarely do. A host with fewer is read by the element rules
alone; that changes the text of pages without an article, and of doubtful names
in articles, and nothing else.

Html is parsed where it lies, once for the tokens and once for the text. A
worker gets the templates once, as long as all hosts' are few enough to be
broadcast; beyond that each page meets the classes of its own tokens by a
shuffle, so that no row grows with its host.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Tables, keep, prepare

MIN_PAGES = 3
#: Templates' tokens (some 200 bytes each in a worker) that are still broadcast.
BROADCAST_TOKENS = 100_000

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp template".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"br", "body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "select", "legend", "title"}
AGAIN = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",)}
# Elements, roles and names of what is not main text.
NOT_MAIN = set("nav footer aside form script style iframe template head button svg dialog textarea".split())
NOT_OUTSIDE = set("header noscript select menu object canvas audio video".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|side-bar|menu\w*|nav|navbar|navigation|topbar|footer|foot|header|masthead|comments?|"
    r"commentlist|respond|replies|disqus|cookies?|consent|gdpr|notices?|alert|subscribe|subscription|newsletter|signup|login|share|sharing|social|related|recommended|"
    r"breadcrumbs?|widget|popup|modal|overlay|pagination|pager|toolbar|skip-link|copyright|legal)(?:$|[-_\s])",
    re.I,
)
CONTENT = re.compile(r"(?:^|[-_\s])(?:article|content|main|post|entry|story|body)(?:$|[-_\s])", re.I)
# Names that say enough inside an article as well, and those that say too little there.
PLAIN_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|sidebar|side-bar|nav|navbar|navigation|topbar|footer|masthead|comments|comment-list|commentlist|respond|replies|disqus|"
    r"cookies?|consent|gdpr|subscribe|subscription|newsletter|signup|login|share|sharing|social|related|recommended|breadcrumbs?|widget|popup|modal|pagination|pager|toolbar|skip-link)(?:$|[-_\s])",
    re.I,
)
DOUBTFUL_NAMES = re.compile(r"(?:^|[-_\s])(?:banner|menu\w*|foot|comment|notices?|alert|overlay|copyright|legal|teasers?)(?:$|[-_\s])", re.I)

PIECES = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTES = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")


class Place(NamedTuple):
    """What the open elements say: path of names, whether a rule excludes, the article's number and path (or none), in a link, the outermost doubtful element."""

    path: str = ""
    excluded: bool = False
    inside: tuple[int, str] | None = None
    link: bool = False
    doubtful: tuple[int, str] | None = None


class Text:
    """A run of text: where it stands, also among the tokens (-1 without a word), and which block it is of."""

    __slots__ = ("at", "breaks", "doubtful", "excluded", "inside", "link", "path", "text")

    def __init__(self, text: str, place: Place, breaks: int, at: int = -1) -> None:
        self.path, self.excluded, self.inside, self.link, self.doubtful = place
        self.text, self.breaks, self.at = text, breaks, at


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTES.finditer(source)} if source.strip(" /") else {}


def _excluded(tag: str, given: dict[str, str], inside: bool) -> tuple[bool, bool]:
    """Whether an element is no main text, and whether more than its name has to say so."""
    if tag in NOT_MAIN or (tag in NOT_OUTSIDE and not inside):
        return True, False
    if "hidden" in given or given.get("aria-hidden") == "true" or given.get("role", "").lower() in ROLES - ({"alert"} if inside else set()):
        return True, False
    names = f"{given.get('class', '')} {given.get('id', '')}"
    if tag in ("html", "body", "article", "main"):
        return False, False
    if inside:
        content = CONTENT.search(names)
        plain = bool(PLAIN_NAMES.search(names)) and not (content and not re.search(r"comments|sidebar|nav", names, re.I))
        return plain, not plain and (tag == "menu" or given.get("role") == "alert" or bool(DOUBTFUL_NAMES.search(names)))
    return bool(NAMES.search(names)) and not (CONTENT.search(names) and not re.search(r"comment|sidebar|foot|menu|nav", names, re.I)), False


def parse(page: str) -> tuple[list[Text], list[str]]:
    """The texts of a page in order, and its tokens: tags (path of open elements and names) and texts (path and text).

    Elements that HTML lets stay open are closed as browsers do; an end tag
    without its start is nothing; a cut page ends where it ends.
    """
    texts: list[Text] = []
    tokens: list[str] = []
    stack: list[tuple[str, Place]] = []
    breaks = 0  # counts block limits, so that texts know which block they are of
    at, size = 0, len(page)

    def state() -> Place:
        return stack[-1][1] if stack else Place()

    def add(source: str) -> None:
        if source:
            place = state()
            text = references.unescape(source)
            plain = SPACE.sub(" ", text).strip()
            texts.append(Text(text, place, breaks, len(tokens) if plain else -1))
            if plain:
                tokens.append(f"{place.path}\0{plain}")

    def close(k: int) -> None:
        nonlocal breaks
        if any(e[0] in BLOCK for e in stack[k:]):
            breaks += 1
        del stack[k:]

    while at < size:
        found = PIECES.search(page, at)
        if found is None:
            rest = page[at:]
            cut = re.search(r"<[a-zA-Z/!][^<>]*$", rest)  # a tag that the page's end cuts
            add(rest[: cut.start()] if cut else rest)
            break
        add(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    tokens.append(f"{stack[k][1].path}/")
                    close(k)
                    break
                if tag in ("b", "i", "em", "strong", "a", "span", "u", "font", "small", "code") and stack[k][0] in BLOCK:
                    break  # the end of an inline element does not end blocks
            if tag in BLOCK:
                breaks += 1
            continue
        if tag in BLOCK:
            breaks += 1
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in AGAIN:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag or (tag in ("dt", "dd") and stack[k][0] in ("dt", "dd")) or (tag in ("td", "th") and stack[k][0] in ("td", "th")):
                    close(k)
                    break
                if stack[k][0] in AGAIN[tag]:
                    break
        path, excluded, inside, link, doubtful = state()
        given = _attributes(found[3])
        name = tag + (f".{SPACE.sub('.', given['class'].strip())}" if given.get("class") else "")
        own = f"{path}>{name}"
        tokens.append(own)
        if tag in VOID:
            continue
        if inside is None and (tag in ("article", "main") or given.get("role", "").lower() in ("main", "article") or given.get("itemprop") == "articleBody"):
            inside = len(tokens), own
        none, perhaps = _excluded(tag, given, inside is not None)
        here = Place(own, excluded or none, inside, link or tag == "a", doubtful or ((len(tokens), own) if perhaps else None))
        if tag in RAW and not found[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*[^>]*>", re.I).search(page, at)
            if tag == "title" or tag == "textarea":
                texts.append(Text(references.unescape(page[at : end.start() if end else size]), here._replace(excluded=True), breaks))
            at = end.end() if end else size
            continue
        if not (found[3].endswith("/") and tag in ("svg", "path", "use")):
            stack.append((tag, here))
    return texts, tokens


def token_hashes(stream: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in stream]


def content_key(texts: list[Text]) -> int:
    """The hash of the longest text of a page's article, or without one of all that no rule excludes; of equally long ones the least."""
    own = [t.text.strip() for t in texts if t.inside and not t.excluded and not t.doubtful and t.at >= 0] or [t.text.strip() for t in texts if not t.excluded and t.at >= 0]
    longest = max(map(len, own), default=0)
    return min((xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in own if len(t) == longest), default=0)


class Template:
    """Classes of a host, by falling commonness: of their tokens (hashes) the class and the place in it; and how many tokens a class has."""

    def __init__(self, tokens: Iterable[tuple[int, int, int, int]]) -> None:
        self.place, self.size = {}, {}
        for t, k, r, size in tokens:
            self.place[t], self.size[k] = (k, r), size

    def cut(self, hashes: list[int]) -> tuple[set[int], list[int]]:
        """The places of a page's tokens that are of its valid classes, and the slot of each place (0: outside all)."""
        found: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(hashes):
            if at := self.place.get(t):
                found.setdefault(at[0], []).append((i, at[1]))
        slots, fixed, made = [0] * len(hashes), set(), 1
        for k in sorted(found):
            if len({r for _, r in found[k]}) < self.size[k]:
                continue  # a page of another template
            inside: dict[int, list[tuple[int, int]]] = {}
            for i, r in found[k]:
                inside.setdefault(slots[i], []).append((i, r))
            # The tokens of a class that stand in one slot come round by round in the class's order.
            rounds = {slot: sorted({r for _, r in at}) for slot, at in inside.items()}
            if any([r for _, r in at] != rounds[slot] * (len(at) // len(rounds[slot])) for slot, at in inside.items()):
                continue
            for slot, at in inside.items():
                fixed.update(i for i, _ in at)
                for (i, r), (j, _) in zip(at, at[1:]):
                    for x in range(i + 1, j):
                        if slots[x] == slot:
                            slots[x] = made + r
                made += self.size[k]
        return fixed, slots


def _words(texts: Iterable[Text]) -> int:
    return sum(len(t.text.split()) for t in texts)


def _doubtful(texts: list[Text], fixed: set[int]) -> set[int]:
    """The doubtful elements of an article that are none of it: mostly links, mostly of the template, or comments of which there are several alike."""
    own: dict[tuple[int, str], list[Text]] = {}
    for t in texts:
        if t.doubtful:
            own.setdefault(t.doubtful, []).append(t)
    alike = Counter(path for _, path in own)
    gone = set()
    for (number, path), parts in own.items():
        n = _words(parts)
        several = alike[path] > 1 and re.search(r"(?:^|[-_.])comment(?:$|[-_.])", path.rpartition(">")[2], re.I)
        if several or 2 * _words(t for t in parts if t.link) > n or 2 * _words(t for t in parts if t.at in fixed) > n:
            gone.add(number)
    return gone


def main_text(texts: list[Text], fixed: set[int] = frozenset(), slots: list[int] | None = None) -> str:
    """The article's texts in page order: blocks by one space, white space inside as one space.

    ``fixed`` and ``slots`` are what a template makes of the page's tokens.
    """
    given = [t for t in texts if not t.excluded]
    if any(t.inside and t.at >= 0 for t in given):
        roots: dict[tuple[int, str], int] = Counter()
        for t in given:
            if t.inside:
                roots[t.inside] += len(t.text.split())
        _, chosen = max(roots, key=lambda r: (roots[r], -r[0]))
        own = [t for t in given if t.inside and t.inside[1] == chosen]
        gone = _doubtful(own, fixed)
        main = [t for t in own if not (t.doubtful and t.doubtful[0] in gone)]
    else:
        # No element says where the article is: what the template holds is none of it, nor is a slot that is mostly links, nor a block that is.
        main, words, linked = [t for t in given if t.at not in fixed], Counter(), Counter()
        place = lambda t: slots[t.at] if slots and t.at >= 0 else 0
        for t in main:
            n = len(t.text.split())
            for key in (("block", t.breaks), ("slot", place(t))):
                words[key] += n
                linked[key] += n * t.link
        mostly = lambda key: 2 * linked[key] > words[key]
        # A paragraph that is a link stays beside blocks that are none.
        blocks = list(dict.fromkeys(t.breaks for t in main if t.text.strip()))
        alone = {b for i, b in enumerate(blocks) if not any(mostly(("block", c)) for c in blocks[max(i - 1, 0) : i] + blocks[i + 1 : i + 2])}
        paragraph = lambda t: t.breaks in alone and bool(re.search(r">p(?:\.[^>]*)?(?:>|$)", t.path))
        main = [t for t in main if (not mostly(("block", t.breaks)) or paragraph(t)) and not (place(t) and mostly(("slot", place(t))) and not paragraph(t))]
    parts, before = [], None
    for t in main:
        if before is not None and t.breaks != before:
            parts.append(" ")
        parts.append(t.text)
        before = t.breaks
    return SPACE.sub(" ", "".join(parts)).strip()


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))


def page_tokens(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, key, page, tokens): of each page the content key, a hash, and (t, c, p, text) of its distinct tokens: hash, count, first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, offsets, t, c, p, text = [], [0], [], [], [], []
            for source in batch.column(2):
                texts, stream = parse(source.as_py() or "")
                keys.append(content_key(texts))
                seen: dict[int, int] = {}
                for i, h in enumerate(token_hashes(stream)):
                    if (at := seen.get(h)) is None:
                        seen[h] = len(t)
                        t.append(h)
                        c.append(1)
                        p.append(i)
                        text.append("\0" in stream[i])
                    else:
                        c[at] += 1
                offsets.append(len(t))
            cells = pa.StructArray.from_arrays([pa.array(t, pa.int64()), pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array(text, pa.bool_())], names=["t", "c", "p", "text"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells)], names=["host", "key", "page", "tokens"])

    prepare(pages.sparkSession)
    given = pages.where(F.length(html) > 0).select(_host(url).alias("host"), F.xxhash64(html).alias("page"), F.col(html).alias("html"))
    return given.mapInArrow(run, "host string, key long, page long, tokens array<struct<t:long,c:int,p:int,text:boolean>>")


def template_classes(tokens: DataFrame) -> DataFrame:
    """(host, k, own): the numbered classes of each host that has any, as arrays of (t, text), those without repeats and the most common first; a written table.

    A class of texts alone takes half of the host's pages and no repeats; a tag
    by itself has no gap and is none. All tokens of a class stand on each of
    its pages, so a row is bounded by a page.
    """
    with Tables(tokens.sparkSession) as tables:
        # Of copies the one with the least hash.
        own = tables.keep(tokens.groupBy("host", "key").agg(F.min_by("tokens", "page").alias("tokens")))
        pages = own.groupBy("host").agg(F.count("*").alias("pages"))
        rows = own.select("host", "key", F.inline("tokens"))
        vectors = rows.groupBy("host", "t").agg(F.count("*").alias("n"), F.max("c").alias("c"), F.bit_xor(F.xxhash64("key", "c")).alias("print"), F.avg("p").alias("p"), F.max("text").alias("text")).where(F.col("n") >= MIN_PAGES)
        alike = vectors.groupBy("host", "n", "print").agg(F.max("c").alias("c"), F.count_if(~F.col("text")).alias("tags"), F.array_sort(F.collect_list(F.struct("p", "t", "text"))).alias("own")).join(pages, "host")
        sized = F.size("own")
        of_texts = (F.col("tags") == 0) & (F.col("c") == 1) & (2 * F.col("n") >= F.col("pages"))
        valid = alike.where(of_texts | ((F.col("tags") > 0) & (sized > 1)))
        order = Window.partitionBy("host").orderBy(F.col("c") > 1, F.desc("n"), "print")
        return keep(valid.select("host", (F.row_number().over(order) - 1).alias("k"), F.transform("own", lambda x: F.struct(x["t"].alias("t"), x["text"].alias("text"))).alias("own")))


def templates(tokens: DataFrame) -> DataFrame:
    """(host, classes): :func:`template_classes` of each host in one row."""
    classes = template_classes(tokens).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("k", "own"))).alias("c"))
    return classes.select("host", F.transform("c", lambda x: x["own"]).alias("classes"))


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``: the main text of the whole html.

    Null html is an empty page: empty text. Null urls are one host. Pages
    without markup are their text. Repeated rows give repeated results, and
    count as one page for the template, so copies make nothing boilerplate.
    Other columns are not returned.
    """
    spark = pages.sparkSession
    prepare(spark)
    classes = template_classes(page_tokens(pages, url, html))
    flat = classes.select("host", "k", F.size("own").alias("size"), F.posexplode("own").alias("r", "x")).select("host", F.col("x.t").alias("t"), "k", "r", "size")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), _host(url).alias("__host"), F.col(html).alias("html"))
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")
    if classes.agg(F.coalesce(F.sum(F.size("own")), F.lit(0))).first()[0] <= BROADCAST_TOKENS:
        by_host: dict[str, list[tuple]] = {}
        for r in flat.collect():  # BROADCAST_TOKENS at most
            by_host.setdefault(r.host, []).append(tuple(r)[1:])
        known = spark.sparkContext.broadcast(by_host)
        return rows.withColumn("own", F.lit(None).cast("array<struct<t:long,k:int,r:int,size:int>>")).mapInArrow(_extractor(known), schema)
    # Each page with the classes of its own tokens.
    met = page_tokens(pages, url, html).select("host", "page", F.explode("tokens").alias("x")).select("host", "page", F.col("x.t").alias("t")).distinct().join(flat, ["host", "t"])
    own = met.groupBy(F.col("host").alias("__h"), F.col("page").alias("__p")).agg(F.collect_list(F.struct("t", "k", "r", "size")).alias("own"))
    joined = rows.withColumn("__page", F.xxhash64("html")).join(own, (F.col("__host") == F.col("__h")) & (F.col("__page") == F.col("__p")), "left")
    return joined.select("page_id", "url", "__host", "html", "own").mapInArrow(_extractor(None), schema)


def _extractor(known):
    """Texts of pages by templates that are broadcast, by host, or that come with the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Template] = {}
        for batch in batches:
            out = []
            for host, source, own in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                texts, stream = parse(source.as_py() or "")
                if known is None:
                    template = Template(tuple(x.values()) for x in own.as_py()) if own.is_valid else None
                else:
                    if host not in held and host in known.value:
                        held[host] = Template(known.value[host])
                    template = held.get(host)
                out.append(main_text(texts, *(template.cut(token_hashes(stream)) if template and stream else ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


__all__ = ["Template", "content_key", "extract_pages", "main_text", "page_tokens", "parse", "template_classes", "templates", "token_hashes"]
