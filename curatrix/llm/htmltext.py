"""Main text of web pages, with site templates removed by recurrence.

A first pass parses each page into a tree and hashes its subtrees. Hashes are counted per host: on how many pages of
different content each recurs, and inside articles in how many different articles; what recurs is template. A second
pass writes the text in pieces and drops those that stand in template. Only pages that hold template move to it; all
others are read where they are.

A subtree is hashed with its text. What stands outside of the main text, be it called furniture by tag, role or class
or made of links, is also hashed by its shape alone: tags and names, like neighbours folded. So menus, adverts and footers recur
whose words differ from page to page. What names call furniture goes even if it doesn't recur, as on hosts of few pages.

Blocks (and inside articles whole divs, sections, lists and tables) recur by a count that stops growing with the host.
Parts of lists, tables and lines outside of articles, which recur by chance on a large host, need a share of its pages;
passages of an article, which several pages may quote, need nearly all of its articles. Recurring subtrees stay rows of
host and hash and meet the subtrees of pages, so that a page comes with its own template only."""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curatrix.llm.common import cut, marked, release, slices

#: A subtree is template from this many pages of different content on, if they are this share of the host's; a block also from ENOUGH_PAGES on, however many pages the host has.
MIN_PAGES, MIN_SHARE, ENOUGH_PAGES = 4, 0.3, 20
#: A passage of an article is template only from this many different articles on, if they are this share of the host's.
MIN_ARTICLES, NEARLY_ALL = 8, 0.9
# Kinds of subtrees: outside of articles blocks, parts of tables, lists and lines, shapes, and shapes of what names call furniture; inside them layout and passages. Hashes that count pages and articles.
BLOCK, PART, SHAPE, NAMED, LAYOUT, PASSAGE = range(6)
PAGE, ARTICLE = 0, 1
#: A subtree's hash inside an article is another than outside.
_INSIDE = 0x2545F4914F6CDD1D
#: Elements deeper than this become siblings, as in browsers; their text stays.
MAX_DEPTH = 512
#: A host is split from this many pages on; in large tables from a MAX_SPLIT-th of all pages, so at most MAX_SPLIT hosts are.
SLICE_PAGES, MAX_SPLIT = 256, 20_000
# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
DROPPED = frozenset("head title script style noscript template iframe object embed svg math canvas audio video form button select option textarea input nav footer aside dialog menu noembed noframes".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
# Chosen here: words in class names and ids, and roles, that call an element furniture.
FURNITURE = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion related respond reply replies search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar toolbar form alert".split())
#: Of these, what stays furniture even with most of a page's text, unless it holds the h1.
FIRM = frozenset("ad ads advert adverts advertisement advertising comment comments consent cookie cookies disqus gdpr promo promotion related respond reply replies sponsor sponsored".split())
_WITH = re.compile(r"\b(?:no|has|with|without)[-_]\w+")
PARTS = frozenset("caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li summary tbody td tfoot th thead tr".split())
PASSAGES = frozenset("blockquote p pre".split())
_OPENS = re.compile(r"<(?=/?[A-Za-z]|[!?])")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_STOPS = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attributes", "children", "parent")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []

    def attribute(self, *names: str) -> str:
        if not self.attributes.strip(" /"):
            return ""
        return " ".join(a or b or c for name, a, b, c in _ATTRIBUTE.findall(self.attributes) if name.lower() in names)


def _tag_end(page: str, place: int) -> int:
    """The place of the > that ends a tag, outside of quotes; a quote that never closes is a letter. -1: none."""
    while found := _STOPS.search(page, place):
        place = found.end()
        if found[0] == ">":
            return found.start()
        close = page.find(found[0], place)
        place = close + 1 if close >= 0 else place
    return -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, content) in order: text, open (with attributes), close, raw (what stands in a script or the like).

    One walk over the page, whatever its markup: a construct that never ends makes what follows text."""
    place, end, last, quotes, lower = 0, len(page), page.rfind(">"), True, None
    while place < end:
        opens = _OPENS.search(page, place)
        at = opens.start() if opens else end
        if at > last:
            break
        if at > place:
            yield "text", "", page[place:at]
        found = _TAG.match(page, at)
        if page.startswith("<!--", at):
            close = page.find("-->", at + 4)
            place = close + 3 if close >= 0 else end
        elif page.startswith("<![CDATA[", at) and (close := page.find("]]>", at)) >= 0:
            yield "text", "", page[at + 9 : close]
            place = close + 3
        elif page.startswith(("<!", "<?"), at):
            place = page.find(">", at) + 1
        else:
            close = _tag_end(page, found.end()) if quotes else -1
            if close < 0:  # all that is left stands in quotes: they mean nothing from here on
                quotes, close = False, page.find(">", found.end())
                if close < 0:
                    place = at
                    break
            tag, attributes, place = found[2].lower(), page[found.end() : close], close + 1
            if found[1]:
                yield "close", tag, ""
                continue
            yield "open", tag, attributes
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, place)
                yield "raw", tag, page[place : close.start() if close else end]
                place = close.end() if close else end
    if place < end:
        yield "text", "", page[place:]


_SAME = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "li": ("li",), "option": ("option",)}
_LISTS = frozenset("ul ol dl table tbody thead tfoot select div section article".split())
_LEAVE_CELLS = frozenset("table tr tbody thead tfoot td th body html article main section div".split())


def parse(page: str) -> Node:
    """A tree of elements and texts; unclosed and stray tags are put right as browsers do in the common cases."""
    root = Node("#root")
    stack = [root]
    held: dict[str, int] = {}  # open elements by tag
    flat: dict[str, int] = {}  # open elements that were too deep for the tree

    def leave(depth: int) -> None:
        for node in stack[depth:]:
            held[node.tag] -= 1
        del stack[depth:]

    for kind, tag, content in tokens(page):
        if kind in ("text", "raw"):
            (stack[-1] if kind == "text" else stack[-1].children[-1]).children.append(content)
            continue
        if kind == "close":
            if flat.get(tag):
                flat[tag] -= 1
            elif held.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        leave(i)
                        break
                    if stack[i].tag in ("td", "th", "table") and tag not in _LEAVE_CELLS:
                        break
            continue
        if tag in CLOSES_P and held.get("p"):
            i = len(stack) - 1
            while i and stack[i].tag not in BLOCKS:
                i -= 1
            if stack[i].tag == "p":
                leave(i)
        elif tag in _SAME and any(held.get(x) for x in _SAME[tag]):
            i = to = len(stack) - 1
            to += 1
            while i and stack[i].tag not in _LISTS:
                if stack[i].tag in _SAME[tag]:
                    to = i
                i -= 1
            leave(to)
        node = Node(tag, content, stack[-1])
        stack[-1].children.append(node)
        if tag not in RAW and tag not in VOID and not content.endswith("/"):
            if len(stack) <= MAX_DEPTH:
                stack.append(node)
                held[tag] = held.get(tag, 0) + 1
            else:
                flat[tag] = flat.get(tag, 0) + 1
    return root


def _named(node: Node) -> int:
    """1 if its names, role or tag call a node furniture, 2 if they call it comments, adverts or the like, else 0."""
    if node.tag in ("html", "body", "main"):
        return 0
    if node.attributes:
        names = _WITH.sub(" ", re.sub(r"([a-z])([A-Z])", r"\1-\2", node.attribute("class", "id")).lower())
        found = FURNITURE.intersection(re.split(r"[^a-z0-9]+", names))
        if found and (node.tag != "article" or found & {"comment", "comments", "reply", "related", "promo", "ad", "sponsored"}):
            return 2 if found & FIRM else 1
        if node.attribute("role").lower() in ROLES:
            return 1
    return int(node.tag == "form")


def _dropped(node: Node, inside_article: bool) -> bool:
    """What goes whatever it holds: by tag, or hidden."""
    if (node.tag in DROPPED and node.tag != "form") or (node.tag == "header" and not inside_article):
        return True
    if not node.attributes or (node.tag in ("article", "main", "body", "html") and not node.attributes.strip(" /")):
        return False
    if node.attribute("aria-hidden").lower() == "true" or re.search(r"display\s*:\s*none", node.attribute("style")):
        return True
    return any(name.lower() == "hidden" for name, *_ in _ATTRIBUTE.findall(node.attributes))


def furniture(root: Node) -> set[Node]:
    """The outermost nodes that are furniture.

    Names, roles and forms make no furniture of what holds half of the text of the page's articles (or main elements),
    or else of the page; comments, adverts and the like must hold its h1 as well. If that still leaves out more than
    half of the articles' text, whatever holds an article stays."""
    out: set[Node] = set()
    order, named = [], {}
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, inside = stack.pop()
        order.append(node)
        for child in node.children:
            if isinstance(child, Node):
                within = inside or child.tag in ("article", "main")
                if _dropped(child, within):
                    out.add(child)
                    continue
                if kind := _named(child):
                    named[child] = kind
                stack.append((child, within))
    if not named:
        return out
    size: dict[Node, int] = {}
    head: set[Node] = set()
    for node in reversed(order):
        size[node] = sum(len(c.strip()) if isinstance(c, str) else size.get(c, 0) for c in node.children)
        if node.tag == "h1" or any(c in head for c in node.children if isinstance(c, Node)):
            head.add(node)
    firm = {n for n, kind in named.items() if kind == 2 and n not in head}
    told: dict[Node, int] = {}  # text of articles in a node
    for wanted in ("article", "main"):
        mains, stack = [], [root]
        while stack:
            node = stack.pop()
            if _wanted(node, wanted):
                mains.append(node)
            else:
                stack += [c for c in node.children if isinstance(c, Node) and c not in out and c not in firm]
        if any(size[m] for m in mains):
            break
    for node in mains:
        up = node
        while up is not None:
            told[up] = told.get(up, 0) + size[node]
            up = up.parent
    whole = told.get(root, 0)
    spared = {n for n in named if n not in firm and (2 * told.get(n, 0) >= whole if whole and n in told else 2 * size[n] >= size[root] > 0)}

    def free(node: Node | None) -> bool:
        while node is not None:
            if node in named and node not in spared:
                return False
            node = node.parent
        return True

    if 2 * sum(size[m] for m in mains if free(m)) < whole:
        spared |= {n for n in told if n in named}
    return out | (named.keys() - spared)


def digests(root: Node) -> dict[Node, tuple[bytes, int]]:
    """(hash, characters of text) of every subtree without scripts and styles."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and c.tag not in ("script", "style")]
    out: dict[Node, tuple[bytes, int]] = {}
    for node in reversed(order):
        parts, size = [node.tag.encode("utf-8", "replace")], 0
        for child in node.children:
            if isinstance(child, str):
                text = _SPACE.sub(" ", child).strip()
                if text:
                    parts.append(text.encode("utf-8", "replace"))
                    size += len(text)
            elif child in out:
                parts.append(out[child][0])
                size += out[child][1]
        out[node] = hashlib.blake2b(b"\x00".join(parts), digest_size=8).digest(), size
    return out


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "big", signed=True)


def candidates(root: Node, gone: set[Node], mains: list[Node], known: dict[Node, tuple[bytes, int]]) -> Iterator[tuple[Node, int, int, int]]:
    """(node, hash, kind, content) of the subtrees of the main text that may be template: with text, but not most of what they stand in.

    Content is the hash of that: the page, or from an article or main on the outermost of these. The page itself comes
    as hash PAGE, articles as ARTICLE. Inline elements amid text are no subtrees of their own."""
    yield root, PAGE, BLOCK, _number(known[root][0])
    stack: list[tuple[Node, Node]] = []
    for main in mains:
        if main is not root and known[main][1]:
            yield main, ARTICLE, LAYOUT, _number(known[main][0])
        stack.append((main, main))
    while stack:
        node, holder = stack.pop()
        amid = any(isinstance(c, str) and c.strip() for c in node.children)
        for child in node.children:
            if isinstance(child, str) or child in gone or child not in known:
                continue
            value, size = known[child]
            if size and child.tag not in ("html", "body") and (child.tag in BLOCKS or not amid) and 2 * size <= known[holder][1]:
                if holder is root:
                    kind = PART if child.tag in PARTS or child.tag not in BLOCKS else BLOCK
                    yield child, _number(value), kind, _number(known[root][0])
                else:
                    kind = PASSAGE if child.tag in PARTS or child.tag in PASSAGES or child.tag not in BLOCKS else LAYOUT
                    yield child, _number(value) ^ _INSIDE, kind, _number(known[holder][0])
            stack.append((child, holder))


def _wanted(node: Node, wanted: str) -> bool:
    return node.tag == wanted or (wanted == "main" and node.attribute("role").lower() == "main")


def main_root(root: Node, gone: set[Node]) -> list[Node]:
    """The outermost articles that are no furniture, else main elements, else the page."""
    for wanted in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if _wanted(node, wanted):
                found.append(node)
                continue
            stack += [c for c in reversed(node.children) if isinstance(c, Node) and c not in gone]
        if found:
            return found
    return [root]


def content_root(root: Node, known: dict[Node, tuple[bytes, int]], gone: set[Node]) -> Node:
    """The deepest element with more than half of the page's text."""
    node = root
    while True:
        inner = [c for c in node.children if isinstance(c, Node) and c not in gone and c in known and 2 * known[c][1] > known[root][1]]
        if not inner:
            return node
        node = inner[0]


def _shape(root: Node) -> int:
    """Hash of a subtree's tags, classes and ids; neighbours of equal shape count once, texts don't."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if isinstance(c, Node) and c.tag not in ("script", "style")]
    out: dict[Node, bytes] = {}
    for node in reversed(order):
        parts = [node.tag.encode("utf-8", "replace"), node.attribute("class", "id").lower().encode("utf-8", "replace")]
        for child in node.children:
            if isinstance(child, Node) and child in out and out[child] != parts[-1]:
                parts.append(out[child])
        out[node] = hashlib.blake2b(b"\x00".join(parts), digest_size=8).digest()
    return _number(out[root])


def _linked(root: Node) -> bool:
    """Whether at least half of a subtree's text stands in links."""
    whole = linked = 0
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        for child in node.children:
            if isinstance(child, str):
                whole += len(child.strip())
                linked += len(child.strip()) * inside
            elif child.tag not in ("script", "style"):
                stack.append((child, inside or child.tag == "a"))
    return whole > 0 and 2 * linked >= whole


def shapes(root: Node, gone: set[Node], mains: list[Node], known: dict[Node, tuple[bytes, int]]) -> Iterator[tuple[Node, int]]:
    """(node, shape) of the outermost subtrees outside of the main text that are furniture or made of links."""
    core = set(mains) if mains != [root] else {content_root(root, known, gone)}
    above = set()
    for node in core:
        while node is not None and node not in above:
            above.add(node)
            node = node.parent
    stack = [root]
    while stack:
        for child in stack.pop().children:
            if isinstance(child, str) or child in core or child.tag in ("head", "script", "style", "noscript", "template") or child not in known or not known[child][1]:
                continue
            if child in gone or (child not in above and (child.tag in BLOCKS or child.tag in CLOSES_P) and _linked(child)):
                yield child, _shape(child)
            else:
                stack.append(child)


def subtrees(page: str, named: bool = False) -> tuple[set[tuple[int, int, int]], list[int]]:
    """(hash, kind, content) of a page's subtrees, and the shapes of those that names call furniture."""
    root = parse(page)
    gone = furniture(root)
    mains, known = main_root(root, gone), digests(root)
    found = {c[1:] for c in candidates(root, gone, mains, known)}
    whole, called = _number(known[root][0]), []
    for node, value in shapes(root, gone, mains, known) if named or mains == [root] else ():
        found.add((value, NAMED if node in gone else SHAPE, whole))
        if node in gone:
            called.append(value)
    return found, called


def pieces(page: str, marked: bool) -> Iterator[tuple[str, bool, tuple[int, ...]]]:
    """(text, whether a block ends before it, hashes of the subtrees that hold it) in order; hashes only if they are wanted."""
    root = parse(page)
    gone = furniture(root)
    mains = main_root(root, gone)
    marks: dict[Node, tuple[int, ...]] = {}
    if marked:
        known = digests(root)
        marks = {node: (value,) for node, value, *_ in candidates(root, gone, mains, known) if value not in (PAGE, ARTICLE)}
        for node, value in shapes(root, gone, mains, known) if mains == [root] else ():
            if node not in gone:
                marks[node] = (*marks.get(node, ()), value)
    for main in mains:
        ended = True
        stack: list[tuple[Node | str | None, tuple[int, ...]]] = [(main, ())]
        while stack:
            node, under = stack.pop()
            if node is None:
                ended = True
            elif isinstance(node, str) or node.tag == "br":
                yield node if isinstance(node, str) else " ", ended, under
                ended = False
            elif node is not main and node in gone:
                ended = ended or node.tag in BLOCKS or node.tag in CLOSES_P or node.tag in DROPPED
            else:
                if node is not main and node in marks:
                    under = under + marks[node]
                if node.tag in BLOCKS:
                    ended = True
                    stack.append((None, under))
                stack += [(c, under) for c in reversed(node.children)]


def extract(page: str, template: frozenset[int] = frozenset()) -> str:
    """The text of the pieces outside of the template, a block a line."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", entities.unescape("".join(now))).strip()
        now.clear()
        if text:
            out.append(text)

    for text, ended, under in pieces(page, bool(template)):
        if ended:
            flush()
        if template.isdisjoint(under):
            now.append(text)
    flush()
    return "\n".join(out)


_ROW = {"host": pa.string(), "key": pa.int64(), "hash": pa.int64(), "kind": pa.int32(), "body": pa.int64()}


def _subtrees(named: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                out: list[tuple] = []
                for host, key, page in zip(*(part.column(c).to_pylist() for c in ("host", "key", "html")), strict=True):
                    out += [(host, key, *found) for found in subtrees(page or "", named)[0]]
                columns = list(zip(*out, strict=True)) or [()] * len(_ROW)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ROW.values(), strict=True)], names=list(_ROW))

    return run


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _split_hosts(source: DataFrame) -> DataFrame:
    """(host, slices): hosts with more pages than a slice holds."""
    held = max(SLICE_PAGES, -(-source.count() // MAX_SPLIT))
    return source.groupBy("host").count().where(F.col("count") > held).select("host", F.ceil(F.col("count") / held).cast("int").alias("slices"))


def recurring(rows: DataFrame, split: DataFrame) -> DataFrame:
    """(host, kind, hash) of the subtrees that recur on their host."""
    whole = F.col("hash").isin(PAGE, ARTICLE)
    inside = (F.col("kind") >= LAYOUT).alias("inside")
    counts = rows.groupBy("host", "kind", "hash", "body").agg(F.lit(1).alias("one")).groupBy("host", "kind", "hash").agg(F.count("*").alias("n"))
    counts = cut(counts.where(whole | (F.col("n") >= MIN_PAGES)))
    sizes = counts.where(whole).select("host", inside, F.col("n").alias("pages")).join(split, "host", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
    dealt = counts.where(~whole).select("*", inside).join(split, "host", "left").withColumn("slice", F.pmod("hash", F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    share = F.greatest(F.lit(MIN_PAGES), MIN_SHARE * F.col("pages"))
    least = F.when(F.col("kind") == PART, share).when(F.col("kind") == PASSAGE, F.greatest(F.lit(MIN_ARTICLES), NEARLY_ALL * F.col("pages"))).otherwise(F.least(share, F.lit(ENOUGH_PAGES)))
    found = cut(dealt.join(sizes, ["host", "inside", "slice"]).where(F.col("n") >= least).select("host", "kind", "hash"))
    release(counts)
    return found


def templates(source: DataFrame, named: bool = False) -> DataFrame:
    """(host, key, kind, template array<long>): for each page by its host and key, which of its subtrees recur on the host."""
    rows = cut(source.select("host", "key", "html").mapInArrow(_subtrees(named), "host string, key long, hash long, kind int, body long"))
    known = recurring(rows, F.broadcast(_split_hosts(source)))  # at most MAX_SPLIT rows
    met = rows.select("host", "key", "hash", "kind").join(known, ["host", "kind", "hash"])
    found = cut(met.groupBy("host", "key", (F.col("kind") == NAMED).alias("named")).agg(F.collect_set("hash").alias("template")))
    release(rows, known)
    return found


def _source(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", _host(F.col("url")).alias("host"), F.xxhash64("html").alias("key"))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row for every input row.

    Null or empty html gives an empty text; a null address belongs to the host ''. Ids may be null; rows that repeat
    are pages of equal content and count once towards a template. A page is read whole, in time that grows with its
    length, however broken its markup. Other columns are not read."""
    source = _source(pages)
    known = templates(source).select("host", "key", "template")
    doubtful = marked(source, known, "key")
    own = ["page_id", "url", "html", "template"]
    joined = doubtful.where("marked").join(known, ["host", "key"], "left").select(own)
    joined = doubtful.where("not marked").select("page_id", "url", "html", F.lit(None).cast("array<long>").alias("template")).unionByName(joined)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for page, template in zip(part.column("html").to_pylist(), part.column("template").to_pylist(), strict=True):
                    texts.append(extract(page or "", frozenset(template or ())))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def removals(pages: DataFrame) -> DataFrame:
    """(page_id, url, n_template, n_named), a row for every input row: how many kinds of subtrees recurrence left out, and how many more only their names."""
    source = _source(pages)
    known = templates(source, named=True).groupBy("host", "key").agg(F.flatten(F.collect_list("template")).alias("template"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                recurs, only = [], []
                for page, template in zip(part.column("html").to_pylist(), part.column("template").to_pylist(), strict=True):
                    named = set(subtrees(page or "", True)[1])
                    recurs.append(len(set(template or ())))
                    only.append(len(named - set(template or ())))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(recurs, pa.int64()), pa.array(only, pa.int64())], names=["page_id", "url", "n_template", "n_named"])

    return source.join(known, ["host", "key"], "left").select("page_id", "url", "html", "template").mapInArrow(run, "page_id long, url string, n_template long, n_named long")
