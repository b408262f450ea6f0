"""Main text of web pages, with site template removal.

Each page is parsed into its elements, in order. An element's subtree hash
covers its tag, attributes, text and children. Spark counts all subtrees with
text per host, those of menus and footers and those within articles alike; a
subtree that recurs across many different pages of its host is template and is
deleted. Pages are different if they differ in their main block, the longest
one outside the subtree, so that copies and near copies of a page do not make
its text a template. Within articles a subtree must recur on most pages of the
host, as articles may share lines and passages. In a second step go the elements that are left and whose tag, role or
class says that they are no article text. The rest is joined block by block.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bitmap, mark, marked, only_marked, stage, table
from docloom.ship import ship

#: A subtree is template if it recurs on MIN_PAGES different pages of its host and on MIN_SHARE of the host's pages.
MIN_PAGES, MIN_SHARE = 5, 0.3
#: On so many different pages of its host it is template whatever their share, so that the sections of a large host have templates of their own.
MANY_PAGES = 100
#: Within articles it is template only if it recurs on this share of its host's pages.
ARTICLE_SHARE = 0.5
#: Template subtrees that are broadcast, at most (8 bytes each); more are joined.
HELD_TEMPLATES = 1 << 20
#: Share of a page's text above which an element is its frame, whatever its name.
SPARED = 0.8
#: Elements are nested so deep at most; deeper ones count as their parent's text.
MAX_DEPTH = 512

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
INVISIBLE = frozenset("script style noscript template iframe object embed noembed noframes svg math canvas audio video head title".split())
#: Elements that are a part of the page by their tag; others are if they have a class, id or role.
PARTS = frozenset("nav header footer aside menu form dialog section".split())
DROPPED = frozenset("script style noscript template iframe object embed noembed noframes svg math canvas audio video nav footer header aside form button select option textarea input datalist dialog menu head title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id that name what isn't article text.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|signup|login|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side|widgets?|related|recommended|share|sharing|social|footer|header|masthead|comments?|disqus|replies|respond|pagination|pager|toolbar|search)(?:$|[\s_-])",
    re.I,
)

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*[\"']")
_ATTR = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts", "prose", "hidden", "end", "hash", "size", "span")

    def __init__(self, tag: str, attrs: str, parent: int, prose: bool, hidden: bool):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []
        self.prose, self.hidden = prose, hidden  # within article or main; within an element that is never shown
        self.end, self.hash, self.size, self.span = 0, b"", 0, (0, 0)


def _attributes(attrs: str) -> dict[str, str]:
    return {name.lower(): a or b or c for name, a, b, c in _ATTR.findall(attrs)}


def _named_out(attrs: str) -> bool:
    for name, value in _attributes(attrs).items():
        if name in ("class", "id") and NAMES.search(value) or name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


class _Scanner:
    """Finds the ends of tags and comments, each character being read a fixed number of times at most."""

    def __init__(self, source: str):
        self.source, self.last, self.quotes = source, source.rfind(">"), True

    def tag_end(self, at: int) -> int:
        """The position of the > that ends a tag, beyond quoted values; -1 if there is none."""
        if at > self.last:
            return -1
        source, i = self.source, at
        while self.quotes:
            m = _STOP.search(source, i)
            if not m:
                self.quotes = False  # the rest of the page is within quotes: from here on they do not count
                break
            if m.group() == ">":
                return m.start()
            i = source.find(m.group()[-1], m.end()) + 1
            if not i:
                self.quotes = False
                break
        return source.find(">", at)

    def comment_end(self, at: int) -> int:
        """The position after a comment that starts at `at`, or after what else starts with <!, <? or </."""
        source = self.source
        if not source.startswith("<!--", at):
            return (source.find(">", at) + 1 if at < self.last else 0) or len(source)
        if source.startswith(">", at + 4) or source.startswith("->", at + 4):
            return source.index(">", at + 4) + 1
        m = _COMMENT_END.search(source, at + 4)
        return m.end() if m else len(source)


_COMMENT_END = re.compile(r"--!?>")


def parse(source: str) -> list[Node]:
    """Elements in page order; node 0 is the page. A node's parts are texts and the numbers of its children."""
    nodes = [Node("", "", -1, False, False)]
    stack, depths = [0], [0]  # open elements; for each, the depth of the nearest element that is not inline
    open_tags: dict[str, int] = {}
    scan, n = _Scanner(source), len(source)

    def close(depth: int):
        while len(stack) > depth:
            open_tags[nodes[stack.pop()].tag] -= 1
            depths.pop()

    def text(start: int, stop: int):
        if stop > start:
            nodes[stack[-1]].parts.append(entities.unescape(source[start:stop]))

    at = from_ = 0
    while True:
        at = source.find("<", at)
        if at < 0:
            text(from_, n)
            break
        m = _OPEN.match(source, at)
        if not m:
            if source[at + 1 : at + 2] in ("!", "?", "/") and at + 1 < n:
                text(from_, at)
                at = from_ = scan.comment_end(at)
            else:
                at += 1
            continue
        stop = scan.tag_end(m.end())
        if stop < 0:
            if source.find("<", at + 1) < 0:  # the page breaks off within a tag
                text(from_, at)
                break
            at += 1
            continue
        text(from_, at)
        tag, inner = m.group(2).lower(), source[m.end() : stop]
        at = from_ = stop + 1
        if m.group(1):
            if open_tags.get(tag):
                for depth in range(len(stack) - 1, 0, -1):
                    if nodes[stack[depth]].tag == tag:
                        close(depth)
                        break
            continue
        if tag in ENDS_P:
            if nodes[stack[depths[-1]]].tag == "p":
                close(depths[-1])
        elif tag in SIBLING and any(open_tags.get(x) for x in SIBLING[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag in SCOPES[tag] and nodes[stack[depth]].tag not in SIBLING[tag]:
                    break
                if nodes[stack[depth]].tag in SIBLING[tag]:
                    close(depth)
                    if tag not in ("tr", "thead", "tbody", "tfoot"):
                        break
        up = nodes[stack[-1]]
        nodes.append(Node(tag, inner.strip().rstrip("/").strip(), stack[-1], up.prose or tag in ("article", "main"), up.hidden or tag in INVISIBLE))
        up.parts.append(len(nodes) - 1)
        if tag in VOID or inner.endswith("/") and tag not in INLINE and tag not in ENDS_P:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            own = source[at : end.start() if end else n]
            nodes[-1].parts.append(entities.unescape(own) if tag in ("title", "textarea") else own)
            at = from_ = n if not end else (source.find(">", end.end()) + 1 or n)
            continue
        if len(stack) < MAX_DEPTH:
            depths.append(depths[-1] if tag in INLINE else len(stack))
            stack.append(len(nodes) - 1)
            open_tags[tag] = open_tags.get(tag, 0) + 1
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        h = hashlib.blake2b(f"{node.tag} {node.attrs}".encode("utf-8", "surrogatepass"), digest_size=8)
        node.end = i + 1
        for part in node.parts:
            if isinstance(part, int):
                h.update(b"\1" + nodes[part].hash)
                node.end = nodes[part].end
                node.size += nodes[part].size
            elif words := part.split():
                joined = " ".join(words)
                h.update(b"\2" + joined.encode("utf-8", "surrogatepass"))
                node.size += 0 if node.hidden else len(joined)
        node.hash = h.digest()
    return nodes


#: Why a block does not stay.
KEPT, TEMPLATE, NAMED = range(3)


def _inherited(nodes: list[Node], own: set[int]) -> list[bool]:
    out = [False] * len(nodes)
    for i in range(1, len(nodes)):
        out[i] = i in own or out[nodes[i].parent]
    return out


def named(nodes: list[Node]) -> set[int]:
    """Elements that go by their tag, role, class or id.

    Never html or body, nor the article or main element with the most text and
    what it lies in. On pages without one, no form goes, and no element goes by
    role, class or id, that holds more than SPARED of the text.
    """
    core = max((i for i, x in enumerate(nodes) if x.tag in ("article", "main") and x.size), key=lambda i: nodes[i].size, default=0)
    spared = {0}
    i = core
    while i > 0:
        spared.add(i)
        i = nodes[i].parent
    out = set()
    for i, x in enumerate(nodes):
        if i in spared or x.tag in ("html", "body"):
            continue
        if x.tag in DROPPED and (x.tag != "form" or core or x.size <= SPARED * nodes[0].size) or x.attrs and (core or x.size <= SPARED * nodes[0].size) and _named_out(x.attrs):
            out.add(i)
    return out


def _walk(nodes: list[Node], gone: list[bool], focus: bool, spans: bool = False) -> list[tuple[int, str]]:
    out: list[tuple[int, list[str]]] = []
    fresh = True
    todo: list = [(0, 0)]
    while todo:
        i, k = todo.pop()
        node = nodes[i]
        inline = node.tag in INLINE
        if k == 0:
            if gone[i] or node.hidden:
                fresh = fresh or not inline
                continue
            fresh = fresh or not inline
            if spans:
                node.span = (len(out) - (not fresh), len(out))
        for k in range(k, len(node.parts)):
            part = node.parts[k]
            if isinstance(part, int):
                todo.append((i, k + 1))
                todo.append((part, 0))
                break
            if node.prose or not focus:
                if fresh and not part.isspace():
                    out.append((i, []))
                    fresh = False
                if not fresh:
                    out[-1][1].append(part)
        else:
            if spans:
                node.span = (node.span[0], len(out))
            fresh = fresh or not inline
    return [(i, " ".join("".join(parts).split())) for i, parts in out]


def blocks(nodes: list[Node], gone: list[bool] | None = None) -> list[tuple[int, str]]:
    """(element, text) of each block of text, in page order, without elements that go by name and those in gone.

    Inline elements belong to the block around them; all others, and line
    breaks, start and end one. If the page has article or main elements with
    text that stay, only what lies in them counts.
    """
    out = _inherited(nodes, named(nodes))
    focus = any(x.prose and x.size and not x.hidden and not out[i] for i, x in enumerate(nodes))
    both = [a or b for a, b in zip(out, gone, strict=True)] if gone else out
    return [(i, t) for i, t in _walk(nodes, both, focus) if t]


def host(url: Column) -> Column:
    """The host of a URL, lower-cased, without user and port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def candidates(nodes: list[Node]) -> list[int]:
    """Elements that may be template: all with text to be seen but the page's own frame, and no word or phrase of an article's sentence, which the block around it decides on."""
    return [i for i, x in enumerate(nodes) if i and x.size and not x.hidden and x.tag not in ("html", "body", "article", "main") and not (x.prose and x.tag in INLINE)]


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little", signed=True)


def key(host_: str, node: Node) -> int:
    """The number of a subtree of a host, within articles another than outside."""
    return _number(host_.encode("utf-8", "surrogatepass"), node.hash, b"article" if node.prose else b"")


#: The slot of all that lies in articles.
ARTICLE = 1


def _slot(host_: str, node: Node) -> int:
    """The number of the part of the host's pages that an element is, by its tag, class, id and role; 0 if it is none."""
    if node.prose:
        return ARTICLE
    given = _attributes(node.attrs) if node.attrs else {}
    name = [given.get(x, "") for x in ("class", "id", "role")]
    if node.tag not in PARTS and not any(name):
        return 0
    return _number(host_.encode("utf-8", "surrogatepass"), " ".join([node.tag, *name]).encode("utf-8", "surrogatepass"))


def _contexts(nodes: list[Node]) -> list[tuple[int, int]]:
    """(element, number that stands for the page's longest block outside it) of each candidate."""
    found = _walk(nodes, [False] * len(nodes), False, spans=True)
    texts = [t.lower() for _, t in found]
    # The longest block of the first and of the last so many; of equally long ones the first of the page.
    before, after = [""], [""]
    for t in texts:
        before.append(t if len(t) > len(before[-1]) else before[-1])
    for t in reversed(texts):
        after.append(t if len(t) >= len(after[-1]) else after[-1])
    out, marks = [], {}
    for i in candidates(nodes):
        start, stop = nodes[i].span
        a, b = before[start], after[len(found) - stop]
        main = a if len(a) >= len(b) else b
        if main not in marks:
            marks[main] = _least_pair(main)
        out.append((i, marks[main]))
    return out


def _least_pair(text: str) -> int:
    """The least number of the pairs of neighbouring words of a text: mostly the same for near copies."""
    words = text.encode("utf-8", "surrogatepass").split()
    return min((_number(a, b) for a, b in zip(words, words[1:] or [b""])), default=0)


_SUBTREES = pa.schema([("host", pa.int64()), ("content", pa.int64()), ("key", pa.int64()), ("slot", pa.int64()), ("context", pa.int64())])


def _subtrees(batches):
    """host, content, key, slot and context of each candidate of host's name, host, content, html."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            names, hosts, contents, sources = (c.to_pylist() for c in batch.slice(at, 64).columns)
            rows = []
            for name, h, c, source in zip(names, hosts, contents, sources, strict=True):
                nodes = parse(source or "")
                rows += {(h, c, key(name, nodes[i]), _slot(name, nodes[i]), context) for i, context in _contexts(nodes)}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=_SUBTREES)


def main_text(source: str, host_: str, is_template, names: bool = True) -> tuple[str, int, int]:
    """(text, number of blocks deleted as template, number of blocks that go by name after that).

    is_template says of an array of keys which are template. Without names, the second step is left out.
    """
    nodes = parse(source)
    asked = candidates(nodes) if is_template is not None else []
    hit = is_template(np.array([key(host_, nodes[i]) for i in asked], np.int64)) if asked else []
    gone = _inherited(nodes, {i for i, h in zip(asked, hit, strict=True) if h})
    shown = [i for i, t in _walk(nodes, [False] * len(nodes), False) if t]
    rest = [(i, t) for i, t in _walk(nodes, gone, False) if t]
    kept = blocks(nodes, gone) if names else rest
    return " ".join(t for _, t in kept), sum(gone[i] for i in shown), max(len(rest) - len(kept), 0)


def _extract(templates, bits, names: bool):
    """page_id, url, text, n_template, n_named of page_id, url, html, host, mark and, for pages with template, gone. With bits, pages whose bit is set are left out."""

    def held(keys):
        if not len(templates.value):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(templates.value, keys), len(templates.value) - 1)
        return templates.value[at] == keys

    def run(batches):
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(~marked(bits.value, batch.column(4).to_numpy(zero_copy_only=False))))
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                gone = part.column(5).to_pylist() if batch.num_columns > 5 else [None] * part.num_rows
                rows = []
                for source, host_, own in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), gone, strict=True):
                    test = held if templates is not None else (lambda keys, own=own: np.isin(keys, np.array(own, np.int64))) if own else None
                    rows.append(main_text(source or "", host_, test, names))
                text, n_template, n_named = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(n_template, pa.int64()), pa.array(n_named, pa.int64())], names=["page_id", "url", "text", "n_template", "n_named"])

    return run


OUT = "page_id long, url string, text string, n_template long, n_named long"
PAGE = "page_id long, url string, html string, name string, mark long, host long, content long"


def template_subtrees(seen: DataFrame, sizes: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """The keys of seen (host, content, key, slot, context) that are template.

    A key's different pages are its contexts; sizes has the number of distinct
    pages of each host. A key recurs if it has min_pages different pages and
    those are at least half of all its pages, which copies are not. It is template
    if it recurs on min_share of its host's pages or on many_pages, or if the
    keys that recur in the same slot (a menu with a few versions, say) do so
    together. Within articles it must recur on ARTICLE_SHARE of the pages.
    """
    often = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages).select("key")
    often, _ = stage(often, "often")
    # Keys that are seen a few times only are passed over by a bitmap before anything else is shuffled.
    some = seen.withColumn("mark", mark("key")).mapInArrow(only_marked(bitmap(often, "key"), 5), "host long, content long, key long, slot long, context long, mark long")
    n = F.count(F.lit(1))
    pages = some.join(often, "key", "left_semi").groupBy("host", "key", "slot", "context", "content").agg(n.alias("n"))
    keys = pages.groupBy("host", "key", "slot", "context").agg(n.alias("pages")).groupBy("host", "key", "slot").agg(n.alias("contexts"), F.sum("pages").alias("pages"))
    recur, _ = stage(keys.where((F.col("contexts") >= min_pages) & (2 * F.col("contexts") >= F.col("pages"))), "recurring")
    slots = recur.where(~F.col("slot").isin(0, ARTICLE)).groupBy("host", "slot").agg(F.sum("contexts").alias("together"))
    judged = recur.join(slots, ["host", "slot"], "left").join(sizes, "host")
    enough = F.greatest("contexts", F.coalesce("together", F.lit(0)))
    outside = (enough >= many_pages) | (enough >= min_share * F.col("host_pages"))
    return judged.where(F.when(F.col("slot") == ARTICLE, F.col("contexts") >= ARTICLE_SHARE * F.col("host_pages")).otherwise(outside)).select("key").distinct()


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES, names: bool = True, held_templates: int = HELD_TEMPLATES) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars, n_template, n_named.

    Pages are parsed twice: for their subtrees' hashes, which alone are counted
    and written, and for their text. n_template counts the blocks that are
    deleted as template, n_named those that go by name after that. Up to
    held_templates template subtrees are broadcast; if there are more, each page
    is joined with its own.

    Copies of a page count once when subtrees are counted, so that a page does
    not become its own template. Null, empty or text-free html gives empty text.
    Pages that break off are read as far as they go, and pages of any length in
    time in proportion. A null url, or one without a host, belongs to the host
    "". Rows that repeat a page get the same text each; other columns are not
    read. An empty table gives an empty result.
    """
    spark = ship(pages.sparkSession)
    html = F.coalesce(pages["html"], F.lit(""))
    named_host = host(pages["url"])
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"), named_host.alias("name"), F.xxhash64(named_host).alias("host"), F.xxhash64(html).alias("content"))
    seen, _ = stage(own.select("name", "host", "content", "html").mapInArrow(_subtrees, "host long, content long, key long, slot long, context long"), "subtrees")
    sizes = seen.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    template, _ = stage(template_subtrees(seen, sizes, min_pages, min_share, many_pages), "template_subtrees")

    given = own.withColumn("mark", mark("host", "content")).select("page_id", "url", "html", "name", "mark", "host", "content")
    if template.count() <= held_templates:
        keys = spark.sparkContext.broadcast(np.sort(template.toPandas()["key"].to_numpy(np.int64)))
        found = given.select("page_id", "url", "html", "name", "mark").mapInArrow(_extract(keys, None, names), OUT)
    else:
        hit, _ = stage(seen.join(template, "key", "left_semi").groupBy("host", "content").agg(F.collect_set("key").alias("gone")), "template")
        bits = bitmap(hit, "host", "content")
        joined = given.mapInArrow(only_marked(bits, 4), PAGE).join(hit, ["host", "content"], "left").select("page_id", "url", "html", "name", "mark", "gone")
        found = given.select("page_id", "url", "html", "name", "mark").mapInArrow(_extract(None, bits, names), OUT).union(joined.mapInArrow(_extract(None, None, names), OUT))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    """extract() over all pages; edge cases are extract()'s."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
