"""Main text of web pages with site template removal.

A page is read once by a tolerant tag scanner, in time linear in its length.  Every
block-level element and every part that its name marks (navigation, advert, ...)
gets two hashes: one of its content (tag, class, text and the hashes of its
children) and, where it may be furniture, one of its frame, which holds no text
(tags and classes of the path to it and the kinds of its descendants), for menus,
adverts and footers whose words differ from page to page.  A frame is hashed for
parts with a marking name and, outside articles and main, for all containers.  A named part is no child of what holds it, so that a changing advert
doesn't hide a template.

Template removal: Spark counts, per host, the different pages on which each hash
occurs, and the host's pages; copies of one page count once.  A subtree whose content is on
MIN_PAGES pages of its host is template, and so is a named or linked frame.  Recurrence
alone says little where articles quote each other, so nothing plain goes from the densest
zone, which is the smallest container with more than half of the page's text outside of
links (one whose content is on SHARE of the host's pages is none), or the articles and main
elements; their paragraphs, headings and lists stay whatever recurs.  Outside of that zone
the frame of a plain container tells furniture as well, if it is on SHARE of the host's
pages, holds little of the page's text and no heading; so a site without any telling tag
or name still loses its furniture.  On a page without such a zone only contents count.
Named parts that don't recur are left out too; ``Page.removed`` tells how many texts each
of the two takes.

The text comes from the articles and the main element of the page, or else from
all that remains.  In them, words of class or id that text uses as well (discussion,
related, notice, ...) drop only a container that is mostly links or template, and
ids of headings and paragraphs say nothing.

Template hashes on the most pages go to the workers as one sorted array of at most
BROADCAST_HASHES numbers; if there are more, the others (each on few pages then) meet
the pages that hold them in a join.

Defined results
    null or empty html   empty text
    null or odd url      the page belongs to the host ""
    null page_id         read like any other page
    unclosed tags        end where HTML ends them (p before a block, li before li, ...)
    tag without its >    swallows the rest of the page, as in HTML
    repeated rows        one output row each
    very long page       read as a whole
    empty table          an empty result
    extra columns        ignored
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Collection, Iterable
from dataclasses import dataclass, field
from itertools import accumulate
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import attach
from ..sources.storage import checkpointed
from .common import map_batches, table

#: Pages of its host that a template is on at least.
MIN_PAGES = 4
#: The share of its host's pages that plain frames need besides.
SHARE = 0.4
#: Characters outside of links that the densest zone has at least: a few words are no article.
ZONE_CHARS = 50
#: A plain container is furniture by its frame if it holds at most this share of the page's text.
LIGHT = 0.2
#: Links that a container needs at least for its frame to count.
MIN_LINKS = 3
#: Template hashes that go to every worker (8 bytes each); the rest is joined.
BROADCAST_HASHES = 500_000
#: Copies of one page are spread over so many groups in that join.
SALTS = 16

_RAW = "script|style|title|textarea|noscript|iframe|template|xmp|noembed|noframes"
#: Attributes up to the tag's end; what is unclosed reaches the end of the page, so no start is scanned twice.
_INNER = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)?+)*+"""
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>{_RAW})(?=[\s/>]){_INNER}(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>{_INNER})(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Class names that speak of a part's surroundings or state, such as has-sidebar or comments-open.
_ABOUT_HEAD = tuple(f"{w}-" for w in "has with without no is hide show".split())
_ABOUT_TAIL = tuple(f"-{w}" for w in "open closed free enabled disabled on off".split())

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset(
    "nav header footer aside form svg button select object canvas video audio menu dialog datalist map "
    "annotation annotation-xml".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTAINERS = frozenset("div section ul ol dl table tbody fieldset details figure center".split())
_BLOCKS = _CONTAINERS | frozenset(
    "html body article main p h1 h2 h3 h4 h5 h6 li dt dd tr thead tfoot caption blockquote pre address figcaption "
    "summary hr hgroup legend option".split()
)
_CLOSES_P = _BLOCKS | _DROPPED - {
    "svg", "button", "select", "object", "canvas", "video", "audio", "map", "annotation", "annotation-xml"
}
#: A start tag ends an open element of its family, up to the nearest element that holds the family.
_SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
_NAMES = frozenset(
    "ad ads adbanner adbox adsbygoogle adslot adunit advert adverts advertisement advertising sponsor sponsored promo "
    "promoted promotion banner outbrain taboola nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer "
    "colophon copyright cookie cookies consent gdpr notice notices alert announcement popup modal overlay share sharing "
    "social related recommended newsletter subscribe subscription signup login comment comments disqus respond replies "
    "responses discussion pagination pager toolbar masthead skip widget paywall".split()
)
#: Words that text uses as well: in an article or main they drop only a container that is mostly links; one that recurs
#: on the host is template anyway.
_DOUBTFUL = frozenset(
    "discussion related notice notices alert announcement responses social share sharing menu banner promotion skip copyright".split()
)
#: Their ids are often made from the words of a heading.
_SLUGGED = frozenset("h1 h2 h3 h4 h5 h6 p section".split())
#: What an id says for sure of a section.
_THREADS = frozenset("comment comments disqus respond".split())
_PAGE_NAMES = frozenset("header topbar search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: What a stray article inside doesn't bring back.
_FIRM = frozenset(
    "nav aside footer menu dialog comment comments disqus respond replies responses discussion related recommended sidebar".split()
)
_MAIN_NAMES = frozenset("article articlebody content main post entry story".split())


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html_lib.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


@dataclass(slots=True)
class _Open:
    tag: str
    name: str
    first: int
    zone: int
    #: digest of the tags and classes from the root to here
    path: bytes
    #: characters of text, of link text, and links before it
    before: tuple[int, int, int]
    parts: list[bytes] = field(default_factory=list)
    shapes: set[bytes] = field(default_factory=set)
    #: its name is doubtful
    doubt: bool = False
    #: it holds a heading
    headed: bool = False
    #: an article began in this named part, so its end says nothing
    broken: bool = False


@dataclass
class Page:
    #: (block, text, zone, whether a name leaves it out) in page order
    segments: list[tuple[int, str, int, bool]] = field(default_factory=list)
    #: (content hash, frame hash or None, first segment, end segment)
    elements: list[tuple[bytes, bytes | None, int, int]] = field(default_factory=list)
    #: per element that goes only from outside of the densest zone: its characters and the hash of its frame, if it has one
    plain: dict[int, tuple[int, bytes | None]] = field(default_factory=dict)
    #: (characters outside of links, first segment, end segment, hash) of containers that may be the densest zone
    zones: list[tuple[int, int, int, bytes]] = field(default_factory=list)
    #: characters outside of links
    size: int = 0
    #: (first segment, end segment) of containers with a doubtful name that are mostly links
    link_lists: list[tuple[int, int]] = field(default_factory=list)

    def hashes(self) -> set[bytes]:
        return {h for content, frame, _, _ in self.elements for h in (content, frame) if h} | self.shared()

    def shared(self) -> set[bytes]:
        """The hashes that need a share of the host's pages."""
        return {frame for _, frame in self.plain.values() if frame} | {h for *_, h in self.zones}

    def _dense(self, template: Collection[bytes]) -> tuple[int, int] | None:
        """The segments of the smallest container with more than half of the text outside of links."""
        found = [(end - first, first, end) for chars, first, end, h in self.zones if 2 * chars > self.size and h not in template]
        return min(found)[1:] if found else None

    def _covered(self, spans: Iterable[tuple[int, int]]) -> list[int]:
        """Per segment, in how many of the spans it lies."""
        steps = [0] * (len(self.segments) + 1)
        for first, end in spans:
            steps[first] += 1
            steps[end] -= 1
        return list(accumulate(steps))[:-1]

    def _cut(self, template: Collection[bytes]) -> list[int]:
        dense = self._dense(template)

        def goes(i: int) -> bool:
            content, frame, a, b = self.elements[i]
            if i not in self.plain:
                return content in template or frame in template
            if not dense:
                return content in template
            if a < dense[1] and b > dense[0]:  # in the densest zone, or around it
                return False
            chars, frame = self.plain[i]
            return content in template or frame in template and chars <= LIGHT * self.size

        return self._covered(self.elements[i][2:] for i in range(len(self.elements)) if goes(i))

    def removed(self, template: Collection[bytes]) -> tuple[int, int]:
        """How many texts the template removes, and how many only names do."""
        cut = self._cut(template)
        texts = [(c, dark) for c, (_, text, _, dark) in zip(cut, self.segments) if not text.isspace()]
        return sum(c > 0 for c, _ in texts), sum(dark and not c for c, dark in texts)

    def text(self, template: Collection[bytes] = frozenset()) -> str:
        """Blocks of the best zone, without the template's subtrees; articles and main are one zone."""
        cut = zip(self._cut(template), self._covered(self.link_lists), self.segments)
        kept = [(block, text, zone) for c, links, (block, text, zone, dark) in cut if not (c or links or dark)]
        best = max((z for _, t, z in kept if not t.isspace()), default=0)
        blocks: list[list[str]] = []
        last = None
        for block, text, zone in kept:
            if zone == best or min(zone, best) >= 2:
                if block == last:
                    blocks[-1].append(text)
                else:
                    blocks.append([text])
                last = block
        return "\n\n".join(filter(None, (" ".join("".join(b).split()) for b in blocks)))


def _words(text: str) -> set[str]:
    told = (x for x in text.split() if not (x.lower().startswith(_ABOUT_HEAD) or x.lower().endswith(_ABOUT_TAIL)))
    return {w.lower() for x in told for w in _WORD.findall(x)}


def _names(found: dict[str, str]) -> set[str]:
    """The words of an element's class and id."""
    return _words(f"{found.get('class', '')} {found.get('id', '')}")


def _hits(tag: str, found: dict[str, str], zone: int) -> tuple[set[str], set[str]]:
    """Names that drop an element, and in an article or main those that may."""
    if zone < 2:
        return _names(found) & (_NAMES if zone else _NAMES | _PAGE_NAMES), set()
    by_class, by_id = _words(found.get("class", "")) & _NAMES, _words(found.get("id", "")) & _NAMES
    firm = by_class - _DOUBTFUL | (by_id - _DOUBTFUL if tag not in _SLUGGED else by_id & _THREADS if tag == "section" else set())
    if tag in _CONTAINERS:
        firm |= by_class & {"share", "sharing"}
    return firm, (by_class | by_id) - firm


def _reason(tag: str, attrs: str, zone: int) -> str | None:
    """Why an element is no main text, or None."""
    if tag in _DROPPED:
        return None if tag == "header" and zone else tag
    if not attrs or tag in ("html", "body", "article", "main"):
        if not attrs or "comment" not in attrs.lower():
            return None
    found = _attributes(attrs)
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return "hidden"
    if found.get("role", "").lower() in _ROLES:
        return found["role"].lower()
    if tag in ("html", "body", "main"):
        return None
    hit = _hits(tag, found, zone)[0] if tag != "article" else _names(found) & {"comment", "comments"}
    return min(hit) if hit else None


def _doubtful(tag: str, attrs: str, zone: int) -> bool:
    return zone >= 2 and tag in _CONTAINERS and bool(attrs) and bool(_hits(tag, _attributes(attrs), zone)[1])


def _main_named(attrs: str) -> bool:
    return bool(attrs) and bool(_MAIN_NAMES & _names(_attributes(attrs)))


def _plain_class(name: str) -> str:
    """The class without words that hold digits, which often number the part."""
    return " ".join(x for x in name.split() if not any(map(str.isdigit, x)))


def _digest(*parts: bytes) -> bytes:
    return xxhash.xxh64_digest(b"\x00".join(parts))


_WHOLE = frozenset(("html", "body", "article", "main"))


def parse(html: str | None) -> Page:
    page = Page()
    if not html:
        return page
    stack: list[_Open] = [_Open("", "", 0, 0, b"", (0, 0, 0))]
    places: defaultdict[str, list[int]] = defaultdict(list)  # depths of the open elements of a tag
    solid: list[int] = []  # depths of the open blocks and parts that end a paragraph's reach
    segments = page.segments
    block, dark, why = 0, 0, ""  # dark: depth of the named part that is left out, if one is open
    at = 0
    in_sight = 0  # characters of links that no name leaves out
    read, linked, links, link = 0, 0, 0, False  # characters of text, those in links, links, and whether one is open

    def open_element(tag: str, attrs: str, zone: int) -> _Open:
        name = _attributes(attrs).get("class", "") if attrs else ""
        tag_bytes, name_bytes = tag.encode("utf-8", "surrogatepass"), name.encode("utf-8", "surrogatepass")
        plain = _plain_class(name).encode("utf-8", "surrogatepass")
        node = _Open(tag, name, len(segments), zone, _digest(stack[-1].path, tag_bytes, plain), (read, linked, links))
        node.parts += (tag_bytes, name_bytes)
        node.shapes.add(_digest(tag_bytes, plain))
        places[tag].append(len(stack))
        if tag in _BLOCKS or tag in _DROPPED:
            solid.append(len(stack))
        stack.append(node)
        return node

    def close_to(depth: int) -> None:
        nonlocal dark, block, link
        while len(stack) > depth:
            node = stack.pop()
            places[node.tag].pop()
            if solid and solid[-1] == len(stack):
                solid.pop()
            named = bool(dark) and len(stack) == dark
            inside = bool(dark) and len(stack) > dark
            if node.tag in _BLOCKS and not (named or inside):
                block += 1
                link = False
            chars, in_links, n_links = read - node.before[0], linked - node.before[1], links - node.before[2]
            if node.doubt and in_links * 2 > chars:
                page.link_lists.append((node.first, len(segments)))
            if node.broken:
                continue
            content, shape = _digest(*node.parts), _digest(*sorted(node.shapes))
            if len(segments) > node.first and node.tag not in _WHOLE:
                menu = node.zone < 2 and node.tag in _CONTAINERS and n_links >= MIN_LINKS and in_links * 2 > chars
                plain = node.tag in _BLOCKS and (node.zone < 2 or node.tag in _CONTAINERS)
                if named or inside or plain:
                    frame = _digest(b"frame", node.path, shape) if named or menu and not inside else None
                    if not (named or inside or menu) and node.zone < 2:
                        bare = node.tag in _CONTAINERS and not node.headed
                        page.plain[len(page.elements)] = chars, _digest(b"plain", node.path, shape) if bare else None
                    page.elements.append((content, frame, node.first, len(segments)))
                if not (named or inside) and node.tag in _CONTAINERS and node.zone < 2 and chars - in_links >= ZONE_CHARS:
                    page.zones.append((chars - in_links, node.first, len(segments), _digest(b"zone", content)))
            if node.headed or node.tag in _HEADINGS:
                stack[-1].headed = True
            if named:
                dark = 0
            elif inside or node.tag in _BLOCKS:
                stack[-1].parts.append(content)
                stack[-1].shapes.add(shape)

    def add(text: str) -> None:
        nonlocal read, linked, in_sight
        if text:
            text = html_lib.unescape(text) if "&" in text else text
            top = stack[-1]
            segments.append((block, text, top.zone, bool(dark)))
            if not text.isspace():
                n = len(text.strip())
                read += n
                linked += n * link
                in_sight += n * (link and not dark)
                top.parts.append(" ".join(text.split()).encode("utf-8", "surrogatepass"))

    for m in _TOKEN.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag == "a":
            link = not m["end"]
            links += link
        if m["end"]:
            depth = places[tag][-1] if places[tag] else 0
            inside = stack[-1].zone
            if depth and not (inside and stack[depth].zone < inside and tag not in _WHOLE):
                close_to(depth)
            elif tag in _BLOCKS and not dark:
                block += 1
            elif tag == "br" and not dark:
                segments.append((block, " ", stack[-1].zone, False))
            continue
        attrs = m["attrs"]
        if tag in _VOID:
            if not dark:
                if tag == "hr":
                    block += 1
                elif tag == "br":
                    segments.append((block, " ", stack[-1].zone, False))
            continue
        if tag in _CLOSES_P and solid and stack[solid[-1]].tag == "p":
            close_to(solid[-1])
        if tag in _SIBLINGS:
            family, holder = (max((places[t][-1] for t in tags if places[t]), default=0) for tags in _SIBLINGS[tag])
            if family > holder:
                close_to(family)
        if dark:
            core = tag in ("article", "main") or (why == "form" and _main_named(attrs))
            if core and why not in _FIRM and not _reason(tag, attrs, 0):
                for node in stack[dark:]:  # a form or an unclosed part around the article
                    node.broken = True
                dark = 0
            else:
                if tag in _BLOCKS or tag in _DROPPED or tag == stack[dark].tag:
                    open_element(tag, attrs, stack[-1].zone)
                continue
        zone = stack[-1].zone
        reason = _reason(tag, attrs, zone)
        if reason:
            if tag in _BLOCKS or tag in _DROPPED and not tag.startswith("annotation"):
                block += 1
            open_element(tag, attrs, zone)
            dark, why = len(stack) - 1, reason
            continue
        if tag in _BLOCKS or tag == "header":
            block += 1
            zone = 3 if tag == "article" else max(zone, 2) if tag == "main" else zone
            found = _attributes(attrs) if attrs and zone < 2 else {}
            if zone < 2 and (found.get("role") == "main" or found.get("itemprop", "").lower() == "articlebody"):
                zone = 2
            elif not zone and _main_named(attrs):
                zone = 1
            open_element(tag, attrs, zone).doubt = _doubtful(tag, attrs, zone)
        elif tag in ("td", "th"):
            segments.append((block, " ", zone, False))
    add(html[at:])
    close_to(1)
    page.size = sum(len(text.strip()) for _, text, _, dark in segments if not dark) - in_sight
    return page


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def _signed(values: Iterable[int]) -> np.ndarray:
    return np.fromiter(values, dtype=np.uint64).view(np.int64)


def _page_keys(page: Page, host: int) -> dict[bytes, int]:
    """The page's hashes and their keys, which also hold the host."""
    return {h: xxhash.xxh64_intdigest(h, host) for h in page.hashes()}


def _subtrees(pages: DataFrame) -> DataFrame:
    """(host, key, shared, page): every page's hashes, keyed with its host, and a hash of host and html.

    ``shared`` marks those that need a share of the host's pages; key 0 stands for the page itself.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, keys, shared, marks = [], [], [], []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            host = _hash(host_of(url))
            page = parse(html)
            mine = page.shared()
            keyed = _page_keys(page, host)
            found = [0, *keyed.values()]
            keys += found
            shared += [False, *(h in mine for h in keyed)]
            hosts += [host] * len(found)
            marks += [_hash(html or "", host)] * len(found)
        columns = [pa.array(_signed(hosts)), pa.array(_signed(keys)), pa.array(shared, pa.bool_()), pa.array(_signed(marks))]
        return pa.RecordBatch.from_arrays(columns, ["host", "key", "shared", "page"])

    return map_batches(pages.select("url", "html"), run, "host long, key long, shared boolean, page long")


def templates(pages: DataFrame) -> DataFrame:
    """(key, n): the subtrees that recur on n >= MIN_PAGES different pages of their host, and on SHARE of them where that is asked."""
    counts = _subtrees(pages).distinct().groupBy("host", "key", "shared").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts.filter(F.col("n") >= MIN_PAGES))
    plain = counts.filter("shared")
    hosts = counts.filter("key = 0").select("host", F.col("n").alias("pages"))
    hosts = checkpointed(hosts.join(plain.groupBy("host").agg(F.count(F.lit(1)).alias("keys")), "host"))
    wide = attach(plain, hosts, ["host"], "keys", F.col("key"), "inner").filter(F.col("n") >= SHARE * F.col("pages"))
    return counts.filter("not shared and key <> 0").select("key", "n").unionByName(wide.select("key", "n"))


def _common(found: DataFrame) -> tuple[np.ndarray, DataFrame | None]:
    """(sorted keys on the most pages, at most BROADCAST_HASHES of them; the others, if any)."""
    size = F.floor(F.log2("n")).cast("int")
    room, least = BROADCAST_HASHES, 64
    for r in sorted(found.groupBy(size.alias("size")).count().collect(), reverse=True):  # at most 64 rows
        if r["count"] > room:
            break
        room, least = room - r["count"], r["size"]
    keys = np.array([r.key for r in found.filter(size >= least).select("key").collect()], dtype=np.int64)
    rest = found.filter(size < least)
    return np.sort(keys), None if rest.isEmpty() else rest


def main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col("`page_id`").alias("page_id"),
        F.col("`url`").cast("string").alias("url"),
        F.col("`html`").cast("string").alias("html"),
    )
    keys, rest = _common(checkpointed(templates(rows)))
    common = spark.sparkContext.broadcast(keys)
    id_type = rows.schema["page_id"].dataType.simpleString()
    if rest is None:
        rows = rows.withColumn("held", F.lit(None).cast("array<bigint>"))
    else:

        def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
            pairs = zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())
            mark = _signed(_hash(x or "", _hash(host_of(u))) for u, x in pairs)
            salt = np.arange(len(mark), dtype=np.int32) % SALTS
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(mark), pa.array(salt)], [*batch.schema.names, "page", "salt"])

        held = _subtrees(rows).select("key", "page").join(rest, "key").groupBy("page").agg(F.collect_set("key").alias("held"))
        held = held.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        keyed = map_batches(rows, marked, f"page_id {id_type}, url string, html string, page long, salt int")
        rows = keyed.join(held, ["page", "salt"], "left").drop("page", "salt")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for url, html, held in zip(*(batch.column(c).to_pylist() for c in ("url", "html", "held"))):
            page = parse(html)
            keyed = _page_keys(page, _hash(host_of(url)))
            mine = _signed(keyed.values())
            known = set(held or ())
            if len(common.value):
                at = np.minimum(np.searchsorted(common.value, mine), len(common.value) - 1)
                known.update(mine[common.value[at] == mine].tolist())
            texts.append(page.text({h for h, key in zip(keyed, mine.tolist()) if key in known}))
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes)],
            ["page_id", "url", "text", "n_chars"],
        )

    return map_batches(rows, run, f"page_id {id_type}, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op5_html_text": op5_html_text}
ORACLES: dict[str, str] = {}
