"""Main text of web pages by equivalence-class template deduction.

Pages of one host mostly come from one template with the page's own texts in its slots.
Tokens are start tags, told apart by their path of elements (tag, class, id, without the
numbers of single pages), and whole text blocks, told apart by path and text.

1. *Occurrence vectors.* How often each token occurs in each page of its host, as two
   sums of hashes of (page, count): tasks add up first, so no host's pages ever meet.
   Tokens in ``share`` of a host's pages and ``least`` of them at least, with equal
   vectors, make an equivalence class.
2. *Validity and nesting.* A class is valid if all pages show its tokens in one order,
   cycle by cycle, with every cycle inside one and the same gap between two tokens of the
   class around it (or of none). Only smallest and largest hashes of what pages show are
   grouped.
3. *Slots.* Text blocks of valid classes that nearly all pages of a host show are the
   template's own; the rest are in slots. Slots under elements which by tag, role, class
   or id hold menus, headers, footers, sidebars, notices, adverts, forms or comments go.
   The others stay, in page order, if they are in an article; without an article, in the
   main element; without either, in the innermost element that holds ``most`` of the text
   outside links of such slots, by the host's sums where its template has the slot.

A host's template has no more tokens than its average page has divided by ``share``.
Templates are joined to pages by broadcast while all are below 32 MB; beyond, those of
hosts with very many pages are broadcast and the rest joined by host.

Defined results: a null or empty html gives an empty text; pages whose url is null or has
no host make one host; repeated rows are pages of their own; hosts with fewer than
``least`` pages have no template, so only the third step's rules apply. Character
references are decoded as browsers do; white space is what Unicode calls so (with no-break
spaces); <br> is white space. Unclosed elements and stray ends are mended by HTML's rules
for paragraphs, list items, table cells and links.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import columns_of, row_of, stage, unstage
from .packed import batch_of, slices

# What HTML says about its elements.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = _BLOCK - frozenset("body caption dd dt head html legend li optgroup option select tbody td tfoot th thead tr".split())
_CELLS = frozenset("table caption tbody thead tfoot tr td th".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_AROUND = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
_HOLDERS = frozenset("html body div section center table tbody tr td main fieldset details".split())
# Elements, roles and words of class and id that hold no main text.
_ASIDE_TAGS = frozenset("head nav aside footer form menu dialog button select object canvas audio video applet search datalist label".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist note".split())
_ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners "
    "sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification alert "
    "alerts announcement disclaimer popup popover modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond "
    "discussion share sharing social related recommended recommendations widget widgets pagination pager toolbar search form aside teaser teasers skip copyright".split()
)
_HEADER_WORDS = frozenset("header topbar".split())
_READER_WORDS = frozenset("comment comments commentlist reply replies ad ads advert advertisement promo sponsored teaser related".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[A-Za-z/!?][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=\"'/>]+)")
_NUMBERED = re.compile(r"(?<=[-_])\d+|\d{3,}")
_LONG_NUMBER = re.compile(r"\d{3,}")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NONE_OF = re.compile(r"(?:has|with|no|without)[-_]")
_ENDERS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in _RAW}

_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _names(attributes: dict[str, str]) -> set[str]:
    """Words of class and id, but for what an element says it has or lacks."""
    given = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    return {w.lower() for x in given if not _NONE_OF.match(x.lower()) for w in _PART.findall(x)}


def _aside(tag: str, attributes: dict[str, str], in_article: bool) -> bool:
    """Whether an element holds something other than main text."""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return True
    if tag in ("html", "body"):
        return False
    words = _names(attributes)
    if tag in ("article", "main") or attributes.get("role") in ("main", "article"):
        return bool(words & _READER_WORDS) and not words & {"main", "content"}
    if tag in _ASIDE_TAGS or attributes.get("role", "").lower() in _ASIDE_ROLES or words & _ASIDE_WORDS:
        return True
    return not in_article and (tag == "header" or bool(words & _HEADER_WORDS))


class Element:
    """An open element. ``path`` tells its path; equal paths are one slot."""

    __slots__ = ("tag", "path", "aside", "article", "main", "link", "over")

    def __init__(self, tag: str, path: int, aside: bool, article: bool, main: bool, link: bool, over: Element | None):
        self.tag, self.path, self.aside, self.article, self.main, self.link, self.over = tag, path, aside, article, main, link, over


class Reader:
    """Reads pages into tokens and text blocks; elements met before are kept."""

    def __init__(self) -> None:
        self.known: dict[tuple, Element] = {}
        self.root = Element("", 0, False, False, False, False, None)

    def _element(self, over: Element, tag: str, given: str) -> Element:
        at = (over.path, over.article, over.main, over.aside, over.link, tag, given)
        if (found := self.known.get(at)) is None:
            if len(self.known) > 1 << 16:
                self.known.clear()
            attributes: dict[str, str] = {}
            for name, x, y, z, bare in _ATTRIBUTE.findall(given):
                attributes.setdefault((name or bare).lower(), _html.unescape(x or y or z))
            key = f"{tag} {_LONG_NUMBER.sub('#', ' '.join(sorted(attributes.get('class', '').split())))} {_NUMBERED.sub('#', attributes.get('id', ''))}" if tag in _BLOCK else ""
            path = xxhash.xxh64_intdigest(pack("<Q", over.path) + key.encode("utf-8", "replace")) & ~1 if key else over.path
            aside = over.aside or _aside(tag, attributes, over.article or over.main)
            role, prop = attributes.get("role", ""), attributes.get("itemprop", "")
            found = Element(tag, path, aside, over.article or tag == "article" or role == "article" or prop == "articleBody", over.main or tag == "main" or role == "main", over.link or tag == "a", over)
            self.known[at] = found
        return found

    def read(self, text: str) -> tuple[list[int], list[tuple[Element, str, int]]]:
        """(tokens in page order, text blocks as (element, raw text, raw length of links)).
        A tag's token is even, a text block's odd. Character references are as written."""
        tokens: list[int] = []
        blocks: list[tuple[Element, str, int]] = []
        stack, held, linked, at = [self.root], [], 0, 0

        def flush() -> None:
            nonlocal linked
            if held:
                own = " ".join("".join(held).split())
                if own:
                    top = stack[-1]
                    blocks.append((top, own, min(linked, len(own))))
                    tokens.append(xxhash.xxh64_intdigest(pack("<Q", top.path) + own.encode("utf-8", "replace")) | 1)
                held.clear()
            linked = 0

        def close(tags: set[str] | frozenset[str], around: set[str] | frozenset[str]) -> None:
            """Pops up to the nearest open element of ``tags``, unless ``around`` is nearer."""
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    flush()
                    del stack[k:]
                    return
                if stack[k].tag in around:
                    return

        def put(piece: str) -> None:
            nonlocal linked
            top = stack[-1]
            if not top.aside and piece:
                held.append(piece)
                if top.link:
                    linked += len(piece)

        n = len(text)
        while at < n:
            m = _TOKEN.search(text, at)
            if m is None:
                put(text[at:])
                break
            put(text[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            given = m[3] if m[2] else m[6]
            if m[1] or m[4]:
                if tag in ("body", "html"):
                    continue
                if tag in _BLOCK:
                    flush()
                    close({tag}, frozenset() if tag in _CELLS else {"td", "th"})
                else:
                    close_inline(stack, tag, flush)
                continue
            if tag == "br":
                put(" ")
                continue
            if tag in _BLOCK:
                flush()
            if tag in _ENDS_P:
                close({"p"}, {"td", "th", "table", "button"})
            if tag in _ENDS:
                while stack[-1].tag and any(e.tag in _ENDS[tag] for e in stack[_since(stack, _AROUND[tag]) :]):
                    close(_ENDS[tag], _AROUND[tag])
            if tag == "a":
                close_inline(stack, "a", flush)
            if tag in _VOID:
                continue
            if tag in _RAW:
                end = _ENDERS[tag].search(text, at)
                at = end.end() if end else n
                if tag != "title":
                    tokens.append(self._element(stack[-1], "div", f' class="{tag}"').path)
                continue
            own = self._element(stack[-1], tag, given.rstrip("/"))
            stack.append(own)
            if tag in _BLOCK:
                tokens.append(own.path)
        flush()
        return tokens, blocks


def _since(stack: list[Element], around: set[str]) -> int:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in around:
            return k + 1
    return 1


def close_inline(stack: list[Element], tag: str, flush) -> None:
    """Pops an inline element that is open since the nearest block."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in _BLOCK:
            return


_COUNTS = pa.schema([("host", pa.string()), ("token", pa.int64()), ("pages", pa.int64()), ("total", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("chars", pa.int64()), ("links", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each token's pages, occurrences, vector and text, added up over a slice; token
    null counts pages."""
    reader = Reader()
    for batch in slices(batches, 2):
        sums: dict[tuple[str, int | None], list[int]] = {}
        for host, page, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            tokens, blocks = reader.read(text or "")
            own = sums.setdefault((host, None), [0] * 6)
            own[0] += 1
            hashes: dict[int, int] = {}
            for token, n in Counter(tokens).items():
                h = hashes.get(n)
                if h is None:
                    h = hashes[n] = xxhash.xxh64_intdigest(pack("<qq", page, n))
                x = sums.get((host, token))
                if x is None:
                    x = sums[host, token] = [0] * 6
                x[0] += 1
                x[1] += n
                x[2] += h & 0xFFFFFFFF
                x[3] += h >> 32
            for element, raw, linked in blocks:
                # a text outside all elements, or after its element's page, has no tag token
                if (x := sums.get((host, element.path))) is not None:
                    x[4] += len(raw)
                    x[5] += linked
        out = {"host": [h for h, _ in sums], "token": [None if t is None else _signed(t) for _, t in sums]}
        for k, name in enumerate(_COUNTS.names[2:]):
            out[name] = [x[k] for x in sums.values()]
        yield batch_of(_COUNTS, out)


class Template:
    """A host's classes: which class a token is in, and how many tokens each has."""

    def __init__(self, classes: list[list[int]]):
        self.of = {t: k for k, c in enumerate(classes) for t in c}
        self.size = [len(c) for c in classes]

    def shown(self, tokens: list[int]) -> dict[int, int]:
        """For each class on a page, a hash of what the page shows of it (its tokens'
        order, and the gap of the class around it), or -1 if it is not valid here."""
        seen: dict[int, list[tuple[int, int]]] = {}
        for at, t in enumerate(tokens):
            if (k := self.of.get(t)) is not None:
                seen.setdefault(k, []).append((at, t))
        spans: list[tuple[int, int, int, list[int]]] = []
        out: dict[int, int] = {}
        for k, own in seen.items():
            size, order = self.size[k], [t for _, t in own]
            if len(own) % size or len(set(order[:size])) < size or order != order[:size] * (len(own) // size):
                out[k] = -1
                continue
            out[k] = xxhash.xxh64_intdigest(np.array(order[:size], np.uint64).tobytes()) >> 1
            for i in range(0, len(own), size):
                places = [at for at, _ in own[i : i + size]]
                spans.append((places[0], places[-1], k, places))
        # one sweep: spans that are open, innermost last
        spans.sort(key=lambda s: (s[0], -s[1]))
        open_: list[tuple[int, int, int, list[int]]] = []
        inside: dict[int, int] = {}
        for span in spans:
            first, last, k, _ = span
            while open_ and open_[-1][1] < first:
                open_.pop()
            around = -1
            if open_:
                _, end, outer, places = open_[-1]
                gap = int(np.searchsorted(places, first))
                if last > end or gap < len(places) and places[gap] < last:
                    out[k] = -1
                around = outer << 16 | gap
            if inside.setdefault(k, around) != around:
                out[k] = -1
            open_.append(span)
        return {k: h if h < 0 else xxhash.xxh64_intdigest(pack("<qq", h, inside[k])) >> 1 for k, h in out.items()}


_SHOWN = pa.schema([("host", pa.string()), ("class", pa.int64()), ("least", pa.int64()), ("greatest", pa.int64())])


def _classes_of(cell: list[dict]) -> list[list[int]]:
    return [[t & _MASK for t in c["tokens"]] for c in cell]


def _show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, templates = Reader(), {}
    for batch in slices(batches, 1):
        found: dict[tuple[str, int], list[int]] = {}
        hosts, classes = batch.column(0).to_pylist(), batch.column(2)
        for i, (host, text) in enumerate(zip(hosts, batch.column(1).to_pylist())):
            if host not in templates:
                if len(templates) > 1000:
                    templates.clear()
                templates[host] = Template(_classes_of(classes[i].as_py()))
            for k, h in templates[host].shown(reader.read(text or "")[0]).items():
                x = found.setdefault((host, k), [h, h])
                x[0], x[1] = min(x[0], h), max(x[1], h)
        yield batch_of(_SHOWN, {"host": [h for h, _ in found], "class": [k for _, k in found], "least": [x[0] for x in found.values()], "greatest": [x[1] for x in found.values()]})


def _chosen(blocks: list[tuple[Element, str, int]], slots: dict[int, tuple[float, float]], most: float) -> list[bool]:
    """Which blocks are main text."""
    for kind in ("article", "main"):
        if any(getattr(e, kind) for e, _, _ in blocks):
            return [getattr(e, kind) for e, _, _ in blocks]
    # text outside links under each path, and each path's children
    own: dict[int, float] = {}
    above: dict[int, list[Element]] = {}
    for e, raw, linked in blocks:
        if e.path not in above:
            chain, x = [], e
            while x is not None:
                if not chain or chain[-1].path != x.path:
                    chain.append(x)
                else:
                    chain[-1] = x  # the block element itself, not what is inline in it
                x = x.over
            above[e.path] = chain[::-1]
        chars, links = slots.get(e.path, (0.0, 0.0))
        chars, links = chars + len(raw), links + linked
        if 2 * links <= chars:
            own[e.path] = own.get(e.path, 0.0) + (chars - links if e.path in slots else len(raw))
    under: dict[int, float] = {}
    for path, chars in own.items():
        for x in above[path]:
            under[x.path] = under.get(x.path, 0.0) + chars
    at, depth = 0, 0
    while True:
        below = {c[depth + 1].path: c[depth + 1] for c in above.values() if len(c) > depth + 1 and c[depth].path == at and c[depth + 1].tag in _HOLDERS}
        best = max(below, key=lambda p: (under.get(p, 0.0), -p), default=None)
        if best is None or under.get(best, 0.0) < most * under.get(at, 0.0) or not under.get(best, 0.0):
            break
        at, depth = best, depth + 1
    return [len(above[e.path]) > depth and above[e.path][depth].path == at for e, _, _ in blocks]


def main_text(reader: Reader, text: str, own: frozenset[int], slots: dict[int, tuple[float, float]], most: float) -> str:
    """A page's blocks of main text, one a line."""
    tokens, blocks = reader.read(text)
    texts = [t for t in tokens if t & 1]  # one for each block, in the same order
    blocks = [b for b, t in zip(blocks, texts) if t not in own]
    lines = (" ".join(_html.unescape(raw).split()) for (_, raw, _), take in zip(blocks, _chosen(blocks, slots, most)) if take)
    return "\n".join(x for x in lines if x)


def _extract(most: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, templates = Reader(), {}
        for batch in slices(batches, 1):
            hosts, texts, own = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (host, text) in enumerate(zip(hosts, texts)):
                if host not in templates:
                    if len(templates) > 1000:
                        templates.clear()
                    cell = batch.column(2)[i].as_py() or {"own": [], "slots": []}
                    templates[host] = (frozenset(t & _MASK for t in cell["own"]), {s["token"] & _MASK: (s["chars"], s["links"]) for s in cell["slots"]})
                own.append(main_text(reader, text or "", *templates[host], most))
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(own, pa.string())], ["_row", "text"])

    return run


#: Up to so many bytes of templates, or of page counts, are broadcast.
_BROADCAST = 32 << 20


def _with_host(rows: DataFrame, of: DataFrame, pages: int, how: str) -> DataFrame:
    """Join by host, whatever a host's share of the rows. ``of`` has one row for each
    host, a column ``n`` of its pages, and a column ``bytes`` of its size."""
    total = of.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    of, plain = of.drop("n", "bytes"), of
    if total <= _BROADCAST:
        return rows.join(F.broadcast(of), "host", how)
    # fewer than 200 hosts have so many pages; Spark splits what is left where it is uneven
    hot = plain.where((F.col("n") > pages // 200) & (F.col("bytes") <= _BROADCAST // 200)).drop("n", "bytes")
    names = F.broadcast(hot.select("host"))
    rest = rows.join(names, "host", "left_anti").join(of.join(names, "host", "left_anti"), "host", how)
    return rows.join(F.broadcast(hot), "host").unionByName(rest)


def deduce(pages: DataFrame, share: float, least: int) -> tuple[DataFrame, DataFrame, int]:
    """(tokens by host with their class and whether that class is valid, pages by host,
    pages) of staged tables."""
    counts = stage(pages.select("host", "page", "html").mapInArrow(_count, "host string, token long, pages long, total long, low long, high long, chars long, links long").groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in _COUNTS.names[2:]]))
    hosts = counts.where(F.col("token").isNull()).select("host", F.col("pages").alias("n"))
    hosts = stage(hosts.withColumn("all", F.col("n")).withColumn("bytes", F.octet_length("host") + F.lit(16)))
    n = int(hosts.agg(F.sum("n").alias("n")).first()["n"] or 0)
    frequent = _with_host(counts.where(F.col("token").isNotNull() & (F.col("pages") >= least)), hosts, n, "inner")
    frequent = frequent.where(F.col("pages") >= share * F.col("all"))
    # one list for each class and host; together no longer than a page's tokens / share
    vector = ["host", "pages", "total", "low", "high"]
    classes = frequent.groupBy(*vector).agg(F.sort_array(F.collect_list(F.struct("token", "chars", "links"))).alias("members"))
    of_host = classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("pages", "total", "low", "high", "members"))).alias("classes"))
    of_host = stage(of_host.join(hosts, "host"))
    unstage(counts)
    lists = of_host.select("host", "n", F.transform("classes", lambda c: F.struct(c["members"]["token"].alias("tokens"))).alias("classes"))
    lists = lists.withColumn("bytes", 16 + 8 * F.aggregate("classes", F.lit(0), lambda a, c: a + 1 + F.size(c["tokens"])))
    shown = _with_host(pages.select("host", "html"), lists, n, "inner").select("host", "html", "classes").mapInArrow(_show, "host string, class long, least long, greatest long")
    valid = shown.groupBy("host", "class").agg(F.min("least").alias("least"), F.max("greatest").alias("greatest"))
    valid = valid.where((F.col("least") == F.col("greatest")) & (F.col("least") >= 0)).select("host", F.col("class").alias("k"))
    each = of_host.select("host", "n", F.posexplode("classes").alias("k", "c"))
    each = each.join(valid.withColumn("valid", F.lit(True)), ["host", "k"], "left")
    each = each.select("host", "n", "k", F.coalesce("valid", F.lit(False)).alias("valid"), F.col("c.pages").alias("pages"), F.col("c.total").alias("total"), F.col("c.members").alias("members"))
    each = stage(each)
    unstage(of_host)
    return each, hosts, n


def extract(pages: DataFrame, share: float = 0.5, least: int = 3, own_share: float = 0.8, own_least: int = 8, most: float = 0.6) -> DataFrame:
    """One row for each of ``pages`` (columns url and html): its other columns, ``text``
    and ``n_chars``. A text block is the template's own if its class is valid, has two
    tokens at least and is on ``own_share`` of the host's pages and ``own_least`` pages."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)).alias("host")
    others = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in ("html", "text", "n_chars")])
    slim = pages.select(host, F.xxhash64("url", "html").alias("page"), "html", row_of(others))
    classes, hosts, n = deduce(slim.select("host", "page", "html"), share, least)
    text = (F.col("n") >= own_least) & (F.col("pages") >= own_share * F.col("n")) & F.col("valid") & (F.size("members") > 1)
    of = classes.groupBy("host").agg(
        F.first("n").alias("n"),
        F.flatten(F.collect_list(F.when(text, F.filter(F.col("members")["token"], lambda t: t % 2 != 0)).otherwise(F.array().cast("array<bigint>")))).alias("own"),
        F.flatten(F.collect_list(F.filter("members", lambda m: m["chars"] > 0))).alias("slots"),
    )
    of = of.select("host", "n", F.struct("own", "slots").alias("template"), (16 + 8 * F.size("own") + 24 * F.size("slots")).alias("bytes"))
    of = stage(of)
    joined = _with_host(slim.select("host", "html", "_row"), of, n, "left").select("host", "html", "template", "_row")
    schema = StructType([joined.schema["_row"]]).add("text", "string")
    found = joined.mapInArrow(_extract(most), schema)
    return found.select(*columns_of(others), "text", F.char_length("text").cast("long").alias("n_chars"))
