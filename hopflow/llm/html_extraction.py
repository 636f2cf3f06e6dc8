"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its tags, told apart by the containers they lie in, and its text blocks. Over the pages of a
host each token has an occurrence vector, how often it occurs in each page; tokens with equal vectors form an
equivalence class. Vectors are compared by an exclusive-or of one hash for each page and count, which Spark adds up on
the map side, so no host is ever gathered. Classes with enough pages and tokens form the host's template. A page
accepts a class if its tokens come in the template's order and lie inside one gap of the classes accepted before (or
the other way round). Text blocks of accepted classes are part of the template; all others fill its slots. Slots in
menus, headers, footers and the like are left out by the containers around them, and where a page marks an article or
main part that has slots, these slots are the text.

A host may have several layouts. A token is judged by the pages that have its place, the containers it lies in. Hosts
with few pages share the template of their domain.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopflow.llm.common import hot_keys, salted_join, written

#: A class belongs to the template from this many pages and this share of the pages with its place on.
LEAST_PAGES, LEAST_SHARE = 5, 0.6
#: A place counts as one of the host's layouts from this share of the host's pages on, which bounds the template.
LEAST_LAYOUT = 0.05
#: Templates of up to this many bytes in all go to every task, so that no page is shuffled; more are joined by host.
BROADCAST_BYTES = 4 << 20
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page's article.
OUTSIDE = frozenset("head header title script style noscript template iframe object svg math canvas nav footer aside form button select textarea dialog menu".split())
#: The content of these holds no tags.
RAW = ("script", "style", "textarea", "title", "iframe", "noscript", "template")
#: Containers that make up the place of a token.
CONTAINERS = frozenset("html head body div section article main nav header footer aside form ul ol dl table figure details dialog menu".split())
#: Words of class and id that mark such content, alone or together with words that say nothing of content.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup sidebar aside menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments "
    "reply replies respond disqus discussion share sharing social related recommended recommendations login search toolbar skip copyright "
    "pagination pager".split()
)
PLAIN = frozenset(
    "top bottom left right main site page global primary secondary fixed sticky mobile desktop small large inner outer box block wrapper wrap container "
    "content area section panel list item bar holder slot unit zone row column col group links link buttons button icon icons text form title body widget "
    "widgets posts articles stories policy message settings".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">]+)*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|<[a-zA-Z][^>]*>|([^<]+|<)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Text:
    """A text block: its words, whether its place rules it out, whether it is in an article or main part."""

    text: str
    outside: bool
    article: bool
    main: bool


@dataclass(slots=True)
class Page:
    """The tokens of a page in order: what each is, the place it lies in, and the text block it stands for (-1: a tag)."""

    ids: list[int]
    around: list[int]
    block: list[int]
    texts: list[Text]


def _marks(value: str) -> bool:
    """Whether a class or id marks what is outside the article: one of its names has a word of MARKS and else only PLAIN
    ones, so `ad-box` and `cookieNotice` do and `ad-free` or `share-price` do not. Single letters count for nothing."""
    for name in value.split():
        words = [w.lower() for w in SPLIT.split(name) if len(w) > 1]
        if any(w in MARKS for w in words) and all(w in MARKS or w in PLAIN for w in words):
            return True
    return False


def _attributes(name: str, source: str) -> tuple[str, bool]:
    """The class and id of a tag, for its place, and whether the element is outside the article."""
    outside = name in OUTSIDE
    if not source or source.isspace():
        return "", outside
    label = ""
    for k, v in ATTRIBUTE.findall(source):
        k, v = k.lower(), v.strip("\"'")
        if k in ("class", "id"):
            label += f".{v}"
            if name not in ("html", "body", "article", "main"):
                outside |= _marks(v)
            elif name == "article":
                outside |= not {"comment", "comments", "reply"}.isdisjoint(w.lower() for w in SPLIT.split(v))
        elif k == "role":
            outside |= v.lower() in ROLES
        elif k == "hidden" or k == "style" and HIDDEN.search(v):
            outside = True
    return label, outside


def _hash(token: str) -> int:
    x = xxhash.xxh64_intdigest(token)
    return x - (1 << 64) if x >> 63 else x


#: The place outside all containers.
ROOT = 0


def read_page(source: str) -> Page:
    """The tokens and text blocks of a page, in one pass; time and memory grow with the page, whatever its depth.

    A place is a hash of the place around it and the container's name, class and id. Tags may be unclosed, crossed or
    cut off. Character references are decoded; white space inside a block is one space."""
    page = Page([], [], [], [])
    open_: list[tuple[str, int, bool, bool, bool]] = []  # name, and what was around it: place, outside, article, main
    opened: Counter = Counter()
    place, outside, article, main = ROOT, False, False, False
    run: list[str] = []

    def token(what: str, block: int = -1) -> None:
        page.ids.append(_hash(f"{place}{what}"))
        page.around.append(place)
        page.block.append(block)

    def close() -> None:
        if run:
            text = "".join(run)
            run.clear()
            if "&" in text:
                text = html_lib.unescape(text)
            if text := " ".join(text.split()):
                token(f"={text}", len(page.texts))
                page.texts.append(Text(text, outside, article, main))

    def push(name: str) -> None:
        open_.append((name, place, outside, article, main))
        opened[name] += 1

    at, end = 0, len(source)
    while at < end:
        m = TOKEN.match(source, at)
        at = m.end()
        closing, name, rest, text = m.groups()
        if text is not None:
            run.append(text)
            continue
        if name is None:
            continue
        name = name.lower()
        if name in INLINE and (closing or not outside):
            # Inline elements neither end a block nor change its place, unless they are marked as outside.
            if not closing and rest and not rest.isspace() and _attributes(name, rest)[1]:
                close()
                push(name)
                outside = True
            elif closing and open_ and open_[-1][0] == name:
                close()
                _, place, outside, article, main = open_.pop()
                opened[name] -= 1
            continue
        if name in INLINE:
            push(name)
            continue
        close()
        if closing:
            if opened[name]:  # else nothing that it could close is open
                while True:
                    last, place, outside, article, main = open_.pop()
                    opened[last] -= 1
                    if last == name:
                        break
            token(f"</{name}")
            continue
        label, out = _attributes(name, rest)
        token(f"<{name}{label}")
        if name in VOID or rest.endswith("/"):
            continue
        if name in RAW:
            stop = re.compile(f"</{name}\\s*>", re.I).search(source, at)
            at = stop.end() if stop else end
            continue
        push(name)
        if name in CONTAINERS:
            place = _hash(f"{place}/{name}{label}")
        outside |= out
        article |= name == "article" and not outside
        main |= name == "main" and not outside
    close()
    return page


def accept(classes: list[list[int]], tokens: list[int]) -> set[int]:
    """The tokens of the classes that a page accepts, larger classes first: in order, and nested."""
    first: dict[int, int] = {}
    for k, t in enumerate(tokens):
        first.setdefault(t, k)
    accepted: list[list[int]] = []
    found: set[int] = set()

    def one_gap(outer: list[int], inner: list[int]) -> bool:
        """Whether no token of the outer class lies between the first and the last of the inner one."""
        return bisect_right(outer, inner[0]) == bisect_left(outer, inner[-1])

    for c in sorted(classes, key=len, reverse=True):
        at = [first[t] for t in c if t in first]
        if len(at) < len(c) or any(a >= b for a, b in zip(at, at[1:])):
            continue
        if all(one_gap(a, at) or one_gap(at, a) for a in accepted):
            accepted.append(at)
            found.update(c)
    return found


def main_text(source: str, classes: list[list[int]] | None) -> str:
    page = read_page(source)
    inside = [t for t in page.texts if not t.outside]
    slots = inside
    if classes:
        # What is the same on the pages of a layout is template, the rest fills its slots.
        fixed = accept(classes, page.ids)
        slots = [t for t, i in ((page.texts[b], i) for b, i in zip(page.block, page.ids, strict=True) if b >= 0) if i not in fixed and not t.outside]
    # Pages that are the same throughout have no slots; the part they mark is their text.
    for found in (slots, inside) if not slots else (slots,):
        for part in ([t for t in found if t.article], [t for t in found if t.main]):
            if part:
                return " ".join(t.text for t in part)
    return " ".join(t.text for t in slots)


def counted(page: Page) -> dict[int, list]:
    """Of each token of a page: how often it occurs, the first occurrence as a share of the page, the token of its place.

    Token 0 stands for the page; it and the tokens of places have no place of their own."""
    named = {p: _hash(f"\1{p}") for p in set(page.around)}
    out: dict[int, list] = {0: [1, 0.0, None]} | {t: [1, 0.0, None] for t in named.values()}
    for k, (t, p) in enumerate(zip(page.ids, page.around, strict=True)):
        out.setdefault(t, [0, k / len(page.ids), named[p]])[0] += 1
    return out


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, token, at, signature, pages, place) over columns host, html; at is the token of the token's place.

    A page is named by its task, its host, a hash of its html and which copy it is there, so a task that runs again gives
    the same signatures in whatever order it meets its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        copies: Counter = Counter()
        seen: dict[tuple[str, int], list] = {}

        def out() -> pa.RecordBatch:
            keys, values = list(seen), list(seen.values())
            batch = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), *[pa.array([v[i] for v in values], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))]],
                names=["host", "token", "at", "signature", "pages", "place"],
            )
            seen.clear()
            return batch

        for batch in batches:
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                source = source.as_py() or ""
                page = _hash(f"{host}\0{source}")
                copies[page] += 1
                name = f"{task}:{page}:{copies[page]}"
                for t, (c, place, at) in counted(read_page(source)).items():
                    mine = seen.setdefault((host, t), [at, 0, 0, 0.0])
                    mine[1] ^= _hash(f"{name}:{c}")
                    mine[2] += 1
                    mine[3] += place
                if len(seen) > 200_000:
                    yield out()
        if seen:
            yield out()

    rows = pages.select("host", "html").mapInArrow(run, "host string, token long, at long, signature long, pages long, place double")
    return _added(rows, "host")


def _added(rows: DataFrame, host: str) -> DataFrame:
    return rows.groupBy(F.col(host).alias("host"), "token").agg(F.min("at").alias("at"), F.bit_xor("signature").alias("signature"), F.sum("pages").alias("pages"), F.sum("place").alias("place"))


def domain(host: Column) -> Column:
    """What a host shares with similar ones: its last two labels, under a name that no host has."""
    return F.concat(F.lit("*."), F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), 2), "."))


def templates(pages: DataFrame) -> DataFrame:
    """(host, pages, classes): the token lists of each host's valid classes, in page order, as a written table.

    A class has two tokens or more, and the pages that LEAST_PAGES, LEAST_SHARE and LEAST_LAYOUT ask for; the lists of a
    host hold at most 1 / (LEAST_SHARE * LEAST_LAYOUT) times the tokens of a mean page. Hosts with fewer pages than
    LEAST_PAGES are counted together as one host for each domain, `*.domain`; vectors are sums, so nothing is read again.
    The counts are kept on the executors' disks until then, not written as tables: those would have a file, which takes
    processes to set its mode where the store is a local folder, for each partition."""
    tokens = found = occurrences(pages).persist(StorageLevel.DISK_ONLY)
    size = found.filter("token = 0").select("host", F.col("pages").alias("host_pages"))
    few = size.filter(F.col("host_pages") < LEAST_PAGES).select("host")
    together = _added(found.join(few, "host").withColumn("domain", domain(F.col("host"))), "domain")
    found = found.join(few, "host", "left_anti").unionByName(together).filter(F.col("pages") >= LEAST_PAGES).persist(StorageLevel.DISK_ONLY)
    size = found.filter("token = 0").select("host", F.col("pages").alias("host_pages"))
    layouts = found.filter("at is null and token <> 0").join(size, "host").filter(F.col("pages") >= F.col("host_pages") * LEAST_LAYOUT)
    layouts = layouts.select("host", F.col("token").alias("at"), F.col("pages").alias("layout_pages"))
    frequent = found.join(layouts, ["host", "at"]).filter(F.col("pages") >= F.col("layout_pages") * LEAST_SHARE)
    classes = frequent.groupBy("host", "signature").agg(F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token"))).alias("t")).filter(F.size("t") > 1)
    lists = classes.groupBy("host").agg(F.collect_list("t.token").alias("classes"))
    known = size.join(lists, "host", "left").select("host", F.col("host_pages").alias("pages"), F.coalesce("classes", F.array().cast("array<array<bigint>>")).alias("classes"))
    try:
        return written(known, "templates")
    finally:
        found.unpersist()
        tokens.unpersist()


def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, url, text, n_chars) of batches of id, url, html, classes; Python holds one page and its classes at a time."""
    for batch in batches:
        texts = [main_text(source.as_py() or "", classes.as_py()) for source, classes in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id and url of every row, text, and n_chars (its code points).

    Null or empty html gives an empty text. A null url, or one without a host, belongs to the host with an empty name.
    A host with few pages takes the template of all such hosts of its domain; where these are few as well there is no
    template, and the containers of the blocks alone decide. Repeated rows and null ids are pages like others; pages are
    read whole. An empty table gives no rows; other columns are ignored."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), HOST, 1))
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).alias("html"))
    known = templates(slim)
    kind = pages.schema[id_col].dataType.simpleString()
    shared = known.filter(F.col("host").startswith("*.")).select(F.col("host").alias("_domain"), F.col("classes").alias("_shared"))
    own, rows = known.select("host", "classes"), slim.withColumn("_domain", domain(F.col("host")))
    if (known.agg(F.sum(F.octet_length("host") + 8 * F.size(F.flatten("classes")))).first()[0] or 0) <= BROADCAST_BYTES:
        both = rows.join(F.broadcast(own), "host", "left").join(F.broadcast(shared), "_domain", "left")
    else:
        hot = hot_keys(known, ["host"], "pages")
        both = salted_join(rows, own, ["host"], hot, F.xxhash64("html"), "left")
        both = salted_join(both, shared, ["_domain"], hot.withColumnRenamed("host", "_domain"), F.xxhash64("html"), "left")
    done = both.select("id", "url", "html", F.coalesce("classes", "_shared").alias("classes")).mapInArrow(extracted, f"id {kind}, url {pages.schema[url_col].dataType.simpleString()}, text string, n_chars long")
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
