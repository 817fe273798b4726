"""Main text of web pages by site template removal.

Every element subtree of a page is hashed, over its tags, classes and text; Spark counts on how many pages of its host
each hash occurs; subtrees that recur on many different pages of a host are its template and go. In the article only
boxes between different texts are: headings and paragraphs recur and are quoted, and articles are copied. On pages without
an article paragraphs need different surroundings too, so that a page that was fetched again and again is no template of
itself; shares are of the different pages of a host. Outside of the article the shape
alone (tags and classes, without text) is hashed too, as menus, adverts and footers change their words from page to page.
Elements that say what they are (nav, footer, role=banner, class="cookie-notice" ...) are hashed and counted like all
others, but two pages are enough for them; by their name alone they go only where a host has one page, so nothing to compare.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html import unescape
from itertools import accumulate, chain

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm.common import join_dealt, materialise, table, without

#: What hashes stand for, in their top bits, and from how many pages and which share of the host's pages they are template.
#: OUTSIDE: of the article. BOX: a lesser part of the article that is no heading or paragraph. MOST: one that has most of its
#: text, as articles are copied under other titles. LOOSE: paragraphs and the
#: like, or most of the page, on pages without an article. LOOSE_BOX: other boxes there. ROTATING: the shape of such a box at
#: its path. NAMED: the shape of elements with telling names.
OUTSIDE, BOX, MOST, LOOSE, LOOSE_BOX, ROTATING, NAMED = range(7)
LEAST = {OUTSIDE: (3, 0.3), BOX: (3, 0.3), MOST: (10, 0.9), LOOSE: (3, 0.3), LOOSE_BOX: (3, 0.3), ROTATING: (3, 0.3), NAMED: (2, 0.01)}
#: Many pages whatever share of a large host they are; this share bounds the hashes of a host.
MANY = (50, 0.01)
#: Hosts of fewer different pages have nothing to compare, so names decide there.
FEW = 2
KIND_BIT, BITS = 60, 62
#: Among the hashes of a host: it has pages enough for counts to decide.
COUNTED = -1
MAX_BROADCAST_ROWS = 200_000

# Element kinds of HTML, and the words by which pages name what is not their text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
BLOCK = CLOSES_P | frozenset("body html head li dt dd tr td th thead tbody tfoot caption summary legend option center".split())
MAIN = frozenset({"article", "main"})
UNSEEN = frozenset("audio canvas datalist head input object svg video".split()) | RAW
CHROME = frozenset("aside button dialog footer form label menu nav select".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter"
    " notice notices pager pagination paywall popup promo promoted promotion related respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: In the article ids are made from headings and classes style its own notes: only these roles and whole class names tell.
INSIDE_ROLES = CHROME_ROLES - {"alert", "banner", "complementary", "status"}
_INSIDE_NAME = re.compile(r"ads?|adverts?|advertisements?|adsbygoogle|comments|(?:ad|advert|comments?)[-_]?(?:area|banner|block|box|container|form|list|section|slot|thread|unit|wrapper)")
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr thead tbody tfoot table caption figure figcaption".split())
#: Closed by a sibling of its kind, up to the element that holds such siblings.
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist")}

#: A tag without `<` in it whose quotes close, as most are; others are taken apart by _Tags.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>\"']*)((?:[^<>\"']|\"[^<>\"]*\"|'[^<>']*')*)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
_WORDS = re.compile(r"[^a-z0-9]+")
_NUMBER = re.compile(r"(?<=[-_])\d+")


class Node:
    __slots__ = ("tag", "name", "kids", "chrome", "named", "said", "main", "holds")

    def __init__(self, tag: str, attributes: str = ""):
        found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        self.tag, self.kids = tag, []
        self.name = f"{found.get('class', '')}#{found.get('id', '')}" if found else ""
        self.main = tag in MAIN or found.get("role") in MAIN
        words = {w for key in ("class", "id") for w in _WORDS.split(found.get(key, ""))} if found else ()
        hidden = found and ("hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""))
        self.chrome = not self.main and tag not in ("html", "body") and bool(tag in UNSEEN or hidden)
        # an element that holds the article is none, whatever it is called (class="with-sidebar")
        self.named = not self.main and tag not in ("html", "body") and (tag in CHROME or found.get("role") in CHROME_ROLES or not CHROME_WORDS.isdisjoint(words))
        self.said = self.named and (tag in CHROME or found.get("role") in INSIDE_ROLES or any(_INSIDE_NAME.fullmatch(c) for c in found.get("class", "").split()))
        self.holds = self.main


class _Tags:
    """The tags and comments of a page, left to right, in time proportional to its length."""

    def __init__(self, html: str):
        self.html, self.close, self.failed = html, -1, set()

    def _quoted_end(self, at: int) -> int:
        """The place after the `>` that ends a tag, not in quotes; 0 if quotes never close or no `>` stands outside of them."""
        seen = []
        while m := _STOP.search(self.html, at):
            if m[0] == ">":
                return m.end()
            end = -1 if m.start() in self.failed else self.html.find(m[0], m.end())
            seen.append(m.start())
            if end < 0:
                break
            at = end + 1
        self.failed.update(seen)  # who comes upon one of these quotes again fails again
        return 0

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """(start, end, slash, name, attributes) of the first tag from `at` on; comments and the like have no name."""
        html = self.html
        while (start := html.find("<", at)) >= 0:
            if m := _TAG.match(html, start):
                return start, m.end(), m[1], m[2].lower(), m[3]
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, len(html) if end < 0 else end + 3, "", "", ""
            if self.close < start:
                self.close = html.find(">", start)
            if self.close < 0:  # nothing ends any more but a comment, with the page
                start = html.find("<!--", start)
                return (start, len(html), "", "", "") if start >= 0 else None
            if m := _NAME.match(html, start):
                end = self._quoted_end(m.end()) or self.close + 1
                return start, end, m[1], m[2].lower(), html[m.end() : end - 1]
            if html[start + 1 : start + 2] in ("!", "?", "/"):
                return start, self.close + 1, "", "", ""
            at = start + 1
        return None


class _Open:
    """The open elements, with the places of each tag, so that none is looked for in vain."""

    def __init__(self, root: Node):
        self.stack, self.where, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max(own[-1] if (own := self.where.get(t)) else 0 for t in tags)

    def cut(self, at: int) -> None:
        """Close the element at a place and all in it; the root (0) stays."""
        while at and len(self.stack) > at:
            self.where[self.stack.pop().tag].pop()
        while self.blocks[-1] >= len(self.stack):
            self.blocks.pop()

    def end(self, tag: str) -> None:
        """An end tag; that of an inline element does not end blocks."""
        at = self.last(tag)
        self.cut(at if tag in BLOCK or at > self.blocks[-1] else 0)

    def begin(self, tag: str) -> None:
        """What a start tag closes: a paragraph right around it, or a sibling."""
        if tag in CLOSES_P and self.stack[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        if tag in SIBLINGS:
            own, within = (x.split() for x in SIBLINGS[tag])
            at = self.last(*own)
            self.cut(at if at > self.last(*within) else 0)


def parse(html: str | None) -> Node:
    """The element tree of a page, however badly it is nested; character references stay as they are."""
    html = html or ""
    root = Node("html")
    tags, opened, at = _Tags(html), _Open(root), 0
    stack = opened.stack
    while found := tags.next(at):
        start, end, slash, tag, attributes = found
        if start > at:
            stack[-1].kids.append(html[at:start])
        at = end
        if not tag or tag == "html":
            continue
        if slash:
            opened.end(tag)
            continue
        if tag in CLOSES_P or tag in SIBLINGS:
            opened.begin(tag)
        node = Node(tag, attributes)
        stack[-1].kids.append(node)
        if node.main:
            for above in reversed(stack):
                if above.holds:
                    break
                above.holds = True
        if tag in RAW:
            last = _RAW_END[tag].search(html, at)
            at = last.start() if last else len(html)
        elif tag not in VOID:
            opened.push(node)
    stack[-1].kids.append(html[at:])
    return root


def _walk(root: Node) -> list[tuple[Node, bool]]:
    """All elements but those that are not shown, parents first, with whether they stand in the article (or are it)."""
    out, todo = [], [(root, root.main)]
    while todo:
        node, inside = todo.pop()
        out.append((node, inside))
        todo += [(k, inside or k.main) for k in reversed(node.kids) if isinstance(k, Node) and not k.chrome]
    return out


def _is_named(node: Node, inside: bool) -> bool:
    """Page headers are named; an article's own header is not, nor what has but a telling word in its class or id there."""
    return not node.holds and (node.said if inside else node.named or node.tag == "header")


def subtree_hashes(root: Node) -> dict[int, list[tuple[int, int, int]]]:
    """id(node) -> (hash, context, content) by which the host's pages are compared; none for the article, what holds it, and bare text.

    Inside of the article: tags, classes and text. Outside: the same, and the shape with its path from the root. Elements
    with telling names: the shape wherever they stand. Numbers in classes and ids (comment-17) are no shape. The context
    of an element is the longest text before and after it, one bit of BITS; so is its content where only the shape is hashed.
    """
    order = _walk(root)
    content: dict[int, int] = {}
    shape: dict[int, int] = {}
    length: dict[int, int] = {}
    count: dict[int, int] = {}
    own = [0] * len(order)
    for at in range(len(order) - 1, -1, -1):  # children first
        node = order[at][0]
        parts, shapes, below, size = [node.tag, node.name], [], 0, 1
        for kid in node.kids:
            if isinstance(kid, str):
                if text := " ".join(kid.split()):
                    parts.append(text)
                    own[at] += len(text)
            elif id(kid) in content:
                parts.append(str(content[id(kid)]))
                shapes.append(shape[id(kid)])
                below += length[id(kid)]
                size += count[id(kid)]
        content[id(node)] = xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) >> 4
        shape[id(node)] = xxhash.xxh64_intdigest(f"{node.tag} {_NUMBER.sub('0', node.name)} {sorted(set(shapes))}") >> 4
        length[id(node)], count[id(node)] = own[at] + below, size
    # the longest text up to and from each element on, of the article or else of the page
    mine = [n if inside or not root.holds else 0 for n, (_, inside) in zip(own, order, strict=True)]
    total, longest = sum(mine), lambda a, b: b if mine[b] > mine[a] else a
    before = list(accumulate(range(len(order)), longest))
    after = list(accumulate(range(len(order) - 1, -1, -1), longest))[::-1]
    text_at = lambda at: content[id(order[at][0])] if mine[at] else 0
    out: dict[int, list[tuple[int, int, int]]] = {}
    path = {id(root): 0}
    for at, (node, inside) in enumerate(order):
        for kid in node.kids:
            if id(kid) in content:
                path[id(kid)] = xxhash.xxh64_intdigest(f"{path[id(node)]} {node.tag} {_NUMBER.sub('0', node.name)}") >> 4
        if _is_named(node, inside):
            out[id(node)] = [(shape[id(node)] | NAMED << KIND_BIT, 0, 0)]  # equal contents have equal shapes
            continue
        if node.tag not in BLOCK or node.tag in ("html", "body") or node.holds or not any(isinstance(k, Node) or k.strip() for k in node.kids):
            continue
        h, placed = content[id(node)], shape[id(node)] ^ path[id(node)]
        if root.holds and not inside:
            out[id(node)] = [(h | OUTSIDE << KIND_BIT, 0, 0)]
            if node.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                out[id(node)].append((placed | OUTSIDE << KIND_BIT, 0, 0))
            continue
        if inside and node.tag in TEXTS:
            continue  # the article's own, however often it recurs
        most = 2 * length[id(node)] > total
        text = most or node.tag in TEXTS
        end = at + count[id(node)]
        around = f"{text_at(before[at - 1]) if at else 0} {text_at(after[end]) if end < len(order) else 0}"
        context = 1 << xxhash.xxh64_intdigest(around) % BITS
        out[id(node)] = [(h | ((MOST if most else BOX) if inside else LOOSE if text else LOOSE_BOX) << KIND_BIT, context, 0)]
        if not inside and not text:
            out[id(node)].append((placed | ROTATING << KIND_BIT, context, 1 << h % BITS))
    return out


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of text in page order, without subtrees that have a template hash; without named ones, if counts tell nothing."""
    few = COUNTED not in template
    gone = {n for n, hashes in subtree_hashes(root).items() if any(h in template for h, *_ in hashes)} if template else set()
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join(unescape("".join(run)).split()):
            blocks.append(text)
        run.clear()

    todo: list = [(root, root.main)]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        else:
            node, inside = item
            if node.tag == "br":
                run.append(" ")
                continue
            block = node.tag in BLOCK
            if block:
                flush()
                todo.append(None)
            todo += [k if isinstance(k, str) else (k, inside or k.main) for k in reversed(node.kids) if isinstance(k, str) or not (k.chrome or id(k) in gone or (few and _is_named(k, inside)))]
    flush()
    return "\n".join(blocks)


def host(url: str = "url") -> Column:
    """The lower-cased host of a URL; empty for a null one."""
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, hashes): for each host that has a template or FEW different pages the hashes of its subtrees; pages: host, html."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict = {}
            for site, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page: dict = {}
                for h, context, held in chain.from_iterable(subtree_hashes(parse(html)).values()):
                    known = page.get(h, (0, 0))
                    page[h] = (known[0] | context, known[1] | held)
                for h, (context, held) in page.items():
                    known = own.get((site, h), (0, 0, 0))
                    own[site, h] = (known[0] + 1, known[1] | context, known[2] | held)
            values = [pa.array([v[k] for v in own.values()], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in own], pa.string()), pa.array([k[1] for k in own], pa.int64()), *values], ["host", "h", "n", "contexts", "held"])

    found = pages.select("host", "html").mapInArrow(hashes, "host string, h long, n long, contexts long, held long")
    found = found.groupBy("host", "h").agg(F.sum("n").alias("n"), F.bit_or("contexts").alias("contexts"), F.bit_or("held").alias("held"))
    totals = pages.groupBy("host").agg(F.count_distinct(F.xxhash64("html")).alias("pages"))  # a page that comes again is none of its own
    kind, n, total = F.shiftright("h", KIND_BIT), F.col("n"), F.col("pages")
    of = lambda k: reduce(lambda c, x: c.when(kind == x, LEAST[x][k]), LEAST, F.when(F.lit(False), 0))
    share = n >= F.greatest(of(0), F.ceil(total * of(1)))
    many = share | (n >= F.greatest(F.lit(MANY[0]), F.ceil(total * MANY[1])))
    # bits set: half of what as many different ones would set tells template boxes from copied articles, rotating from own texts
    half = (1 - F.pow(F.lit(1 - 1 / BITS), F.least(n, total))) * BITS / 2
    differ = F.bit_count("contexts") >= F.greatest(F.lit(3), half)
    is_template = (
        F.when(kind == OUTSIDE, many)
        .when(kind.isin(BOX, LOOSE_BOX), many & differ)
        .when(kind.isin(MOST, LOOSE), share & differ)
        .when(kind == ROTATING, many & differ & (F.bit_count("held") <= half))
        .otherwise(share)
    )
    # at most (subtrees of a page / share) hashes a host
    kept = found.where(n >= of(0)).join(totals, "host").where(is_template).select("host", "h")
    enough = totals.where(F.col("pages") >= FEW).select("host", F.lit(COUNTED).cast("long").alias("h"))
    return kept.union(enough).groupBy("host").agg(F.collect_set("h").alias("hashes"))


def extract_text(pages: DataFrame, text_column: str = "text") -> DataFrame:
    """Replace html by the main text of each page (url, html): blocks joined by a newline, empty if there is none.

    Null html gives an empty text; pages without a host are compared with one another. Character references are decoded,
    white space in a block (line breaks too) is one space. A page that comes more than once, as a repeated row or under
    another address, has its text each time, and counts as one page of its host. Very long pages are taken whole; an
    empty table gives an empty one. Other columns pass through; an own column of the text's name is replaced.
    """
    pages = without(pages, text_column).withColumn("__host", host())
    found = materialise(templates(pages.select(F.col("__host").alias("host"), "html")), "site-templates")
    found = found.withColumnsRenamed({"host": "__site", "hashes": "__hashes"})
    if (found.agg(F.sum(F.size("__hashes"))).first()[0] or 0) <= MAX_BROADCAST_ROWS:  # 8 bytes each
        joined = pages.join(F.broadcast(found), F.col("__host") == F.col("__site"), "left").drop("__host", "__site")
    else:  # shuffled; a host that has many pages is dealt over tasks
        rows = pages.groupBy(F.col("__host").alias("__site")).agg(F.count("*").alias("__rows"))
        found = found.join(rows, "__site").withColumnRenamed("__site", "__host")
        joined = join_dealt(pages, found, "__host", "__rows", pages.count(), "left").drop("__host")
    names = [c for c in joined.columns if c not in ("html", "__hashes")]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("html").to_pylist(), batch.column("__hashes").to_pylist(), strict=True)
            texts = [main_text(parse(html), set(hashes or ())) for html, hashes in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, text_column])

    return joined.mapInArrow(extract, T.StructType([*(joined.schema[n] for n in names), T.StructField(text_column, T.StringType())]))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
