"""Main text of web pages by wrapper induction over the pages of a host.

A page's tree is folded: siblings with one label become one node, so that its
paths form a small ordered tree of slots.  Pages with the most frequent trees
of a host are its exemplars; each page is aligned by simple tree matching with the one
that it is most like, and aligned slots share an identity.
Over all distinct pages of the host two things are template: slots whose text
hardly differs, and single nodes of a slot that almost all pages repeat.  The
rest varies and is content.  A page's text is its varying nodes, within the
article where there is one, without parts that markup or names show to be
menus, notices, forms and the like.  Articles are counted as the rest is; only
where all of an article is constant do the statistics not tell it from
template, and markup decides for it.

Pages are read in linear time and in one loop, however deep or broken they
are.  An unclosed tag, comment or script runs to the page's end, as browsers
have it.  Slots are told apart by their outermost LEVELS blocks.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from collections.abc import Container, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import pieces, written

#: Elements without content, elements whose content is no text, and elements that make blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = frozenset("script style noscript template textarea title svg iframe object select math canvas".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are never article text.
ASIDE = frozenset("nav footer aside form menu button dialog head label input search".split())
#: Names of headers: of what they hold, an article keeps headings.
HEADERS = frozenset("header masthead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Classes, ids and roles that name parts which are no article text, alone or in compounds with each other and COMPANIONS.
NAMES = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar tooltip widget".split()
)
COMPANIONS = frozenset(
    "area article articles aside bar block body bottom box btn button buttons container content entry form global group head icon icons inner item items left link links list main message module nav outer page panel post posts primary region right row secondary section site slot sticky top unit wrap wrapper".split()
)
#: Ids of sections within an article that name what readers added; other ids of sections and headings there are anchors.
ADDED = frozenset("comments comment-list respond disqus disqus_thread".split())
#: Starting one of these ends an open element of the others in the same list.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CLOSES |= {b: ("p",) for b in BLOCKS if b not in CLOSES and b not in ("html", "head", "body", "tbody", "thead", "tfoot", "caption")}
#: An element of the list above is not ended across these.
FENCES = frozenset("ul ol dl table article section div aside nav footer header main body form td th blockquote".split())
#: Comments, declarations and tags; what is not closed runs to the end, a quote without its twin is a character.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
#: Ends of elements whose content is no text.
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I) for tag in OPAQUE}
#: Blocks of a path beyond these share the slot of the last one.
LEVELS = 100
#: Nodes with more pairs of children than this align equal labels in order, without weighing them.
WIDE = 100_000
_NAME = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")


def _named(token: str, names: frozenset[str]) -> bool:
    """Whether a whole class, id or role is one of the names, or a compound of them and companions."""
    words = [w for w in _WORD.findall(token) if len(w) > 1]
    return any(w in names for w in words) and all(w in NAMES or w in HEADERS or w in COMPANIONS for w in words)


@lru_cache(50_000)
def _label(tag: str, attributes: str, inside: bool) -> tuple[str, int]:
    """(tag with its classes, 2 if tag or names show it to be no article text, 1 for a header); inside an article, ids of sections and headings are anchors."""
    drop, classes = 2 * (tag in ASIDE) or int(tag == "header"), ""
    if attributes:
        for kind, *values in _NAME.findall(attributes):
            kind, value = kind.lower(), next((v for v in values if v), "").lower()
            if kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and "display:none" in value.replace(" ", ""):
                drop = 2
            elif kind in ("class", "id", "role"):
                classes += "." + ".".join(value.split()) if kind == "class" and value else ""
                tokens = value.split() if tag not in ("html", "body", "article", "main") else []
                if kind == "id" and inside and (tag == "section" or tag in HEADINGS):
                    tokens = [t for t in tokens if tag == "section" and t in ADDED]
                drop = max(drop, 2 * any(_named(t, NAMES) or t in ADDED for t in tokens), any(_named(t, HEADERS) for t in tokens))
    return tag + classes, drop


class Block:
    """A block of text: its folded path, what it says, and where it stands."""

    __slots__ = ("path", "text", "dropped", "article")

    def __init__(self, path, text, dropped, article):
        self.path, self.text, self.dropped, self.article = path, text, dropped, article


class Open:
    """An open element, with what it takes from those around it."""

    __slots__ = ("tag", "path", "drop", "article", "heading")

    def __init__(self, tag, path, drop, article, heading):
        self.tag, self.path, self.drop, self.article, self.heading = tag, path, drop, article, heading


def blocks(page: str) -> list[Block]:
    """All blocks with text, in page order."""
    out: list[Block] = []
    top = Open("", (), 0, False, False)
    stack: list[Open] = [top]
    places: dict[str, list[int]] = {}  # of the open elements of each tag
    fences: list[int] = [0]
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(htmllib.unescape("".join(held)).split())
            held.clear()
            if text:
                # A heading in an article's header is the article's; the rest of the header is not.
                now = stack[-1]
                out.append(Block(now.path, text, now.drop > 1 or now.drop == 1 and not (now.article and now.heading), now.article))

    def cut(size: int) -> None:
        while len(stack) > size:
            tag = stack.pop().tag
            places[tag].pop()
            if tag in FENCES:
                fences.pop()

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if (own := places.get(tag)) and (tag in BLOCKS or own[-1] >= fences[-1]):
                cut(own[-1])
            continue
        if tag in OPAQUE:
            if not m[3].endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = len(page) if end is None else end.end()
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
            ended = max((places[t][-1] for t in CLOSES.get(tag, ()) if places.get(t)), default=-1)
            if ended >= fences[-1] and ended > 0:
                cut(ended)
        if tag in VOID:
            continue
        around = stack[-1]
        label, drop = _label(tag, m[3], around.article)
        path = (*around.path, label) if tag in BLOCKS and len(around.path) < LEVELS else around.path
        if tag in FENCES:
            fences.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append(Open(tag, path, max(around.drop, drop), around.article or tag in ("article", "main"), around.heading or tag in HEADINGS))
    if at < len(page):
        held.append(page[at:])
    flush()
    return out


# -- folded trees and their alignment -----------------------------------------

Tree = tuple  # (label, (child, ...))


def folded(paths: list[tuple[str, ...]]) -> Tree:
    """The ordered tree of distinct paths, at most LEVELS deep."""
    root: dict = {}
    for path in paths:
        node = root
        for label in path:
            node = node.setdefault(label, {})

    def frozen(label, children):
        return label, tuple(frozen(k, v) for k, v in children.items())

    return frozen("", root)


def _tag(label: str) -> str:
    return label.partition(".")[0]


@lru_cache(100_000)
def matched(a: Tree, b: Tree) -> tuple[int, tuple]:
    """Simple tree matching: (weight, pairs of matched children's places), in order.

    Nodes match if their tags do; equal labels weigh one more.
    """
    if _tag(a[0]) != _tag(b[0]):
        return 0, ()
    x, y = a[1], b[1]
    if len(x) * len(y) > WIDE:
        return _in_order(a, b)
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    weight = [[matched(p, q)[0] for q in y] for p in x]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight[i][j])
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return best[-1][-1] + 1 + (a[0] == b[0]), tuple(reversed(pairs))


def _in_order(a: Tree, b: Tree) -> tuple[int, tuple]:
    """As matched, for many children: equal labels are paired from the left, in linear time."""
    at = {child[0]: j for j, child in reversed(list(enumerate(b[1])))}
    pairs, last, weight = [], -1, 1 + (a[0] == b[0])
    for i, child in enumerate(a[1]):
        j = at.get(child[0], -1)
        if j > last:
            pairs.append((i, j))
            last, weight = j, weight + matched(child, b[1][j])[0]
    return weight, tuple(pairs)


@lru_cache(100_000)
def size(tree: Tree) -> int:
    return 1 + sum(map(size, tree[1]))


@lru_cache(20_000)
def slots(page: Tree, exemplars: tuple[Tree, ...]) -> dict[tuple[str, ...], str]:
    """Path in the page -> slot: number of the exemplar most like it, and the exemplar's path where aligned, else its own."""
    found: dict[tuple[str, ...], str] = {}

    def walk(p: Tree, path: tuple[str, ...], e: Tree | None, slot: str) -> None:
        found[path] = slot
        pairs = dict(matched(p, e)[1]) if e is not None else {}
        for i, child in enumerate(p[1]):
            twin = e[1][pairs[i]] if i in pairs and matched(child, e[1][pairs[i]])[0] else None
            walk(child, (*path, child[0]), twin, f"{slot}/{twin[0] if twin else '+' + child[0]}")

    # Matched nodes against the nodes of both; the first of equals.
    likeness = [matched(page, e)[0] / (size(page) + size(e)) for e in exemplars]
    best = max(range(len(exemplars)), key=likeness.__getitem__, default=-1)
    walk(page, (), exemplars[best] if exemplars else None, str(best) if exemplars else "")
    return found


def encoded(tree: Tree) -> str:
    return tree[0].replace("(", "").replace(")", "").replace(" ", "") + "(" + " ".join(map(encoded, tree[1])) + ")"


@lru_cache(20_000)
def decoded(text: str) -> Tree:
    """The inverse of encoded."""
    at = 0

    def node() -> Tree:
        nonlocal at
        end = text.index("(", at)
        label, at, children = text[at:end], end + 1, []
        while text[at] != ")":
            if text[at] == " ":
                at += 1
            children.append(node())
        at += 1
        return label, tuple(children)

    return node()


# -- DataFrames -----------------------------------------------------------------


def host_of(url: Column) -> Column:
    """Host in lower case, without user and port; the empty string if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


FOUND = "page_id long, url string, text string, n_chars long"


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end, _, _ in pieces(batch, 1):
            part = batch.slice(start, end - start)
            paths = [[b.path for b in blocks(p or "")] for p in part.column(1).to_pylist()]
            shapes = [encoded(folded([tuple(map(_tag, path)) for path in own])) for own in paths]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shapes, pa.string()), pa.array([encoded(folded(own)) for own in paths], pa.string())], names=["host", "shape", "tree"])


def _id(*parts: str) -> int:
    """A number for a slot of a host, a node of a slot, or a text."""
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(), digest_size=8).digest(), "little", signed=True)


@lru_cache(100_000)
def _slot_id(host: str, slot: str) -> int:
    return _id(host, slot)


def _observed(lookup):
    """Per page, each slot with its text, and each node of it with its slot."""
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, _, _ in pieces(batch, 1):
                out: list[list] = [[] for _ in kinds]
                for host, page, hashed, tree in zip(*(c.to_pylist() for c in batch.slice(start, end - start).columns), strict=True):
                    found = blocks(page or "")
                    where = slots(folded([b.path for b in found]), lookup(host, tree))
                    texts: dict[str, list[str]] = {}
                    for b in found:
                        if not b.dropped:
                            texts.setdefault(where[b.path], []).append(b.text)
                    for slot, said in texts.items():
                        own = _slot_id(host, slot)
                        rows = [(host, own, None, hashed, _id("\n".join(said))), *((host, _id(host, slot, t), own, hashed, None) for t in set(said))]
                        for o, v in zip(out, zip(*rows, strict=True), strict=True):
                            o += v
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["host", "id", "of", "page", "said"])

    return run


def main_text(found: list[Block], host: str, template: Container[int], exemplars: tuple[Tree, ...]) -> str:
    """Nodes that vary: those of the article where there is one."""
    where = slots(folded([b.path for b in found]), exemplars)
    varies = lambda b: _slot_id(host, where[b.path]) not in template and _id(host, where[b.path], b.text) not in template
    article = [b for b in found if b.article and not b.dropped]
    if article:
        kept = [b for b in article if varies(b)] or article
    else:
        kept = [b for b in found if not b.dropped and varies(b)]
    return "\n".join(b.text for b in kept)


def _extracted(lookup, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, _, _ in pieces(batch, 3):
                part = batch.slice(start, end - start)
                key, url, host, page, tree, constant = (c.to_pylist() for c in part.columns)
                texts = [main_text(blocks(p or ""), h, known(h, k), lookup(h, t)) for h, p, t, k in zip(host, page, tree, constant, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", exemplars: int = 4, least_pages: int = 10, most_distinct: float = 0.1, least_repeated: float = 0.9, most_broadcast: int = 32 << 20) -> DataFrame:
    """Per page row: page_id, url, text, n_chars.

    Statistics cover all pages of each host.  Its exemplars have the
    `exemplars` shapes (trees of tags) that most of its pages have; of a shape
    the least tree is taken.  Tables of hosts are broadcast up to `most_broadcast` bytes and
    joined beyond.  A slot, in articles too, is template if at least
    `least_pages` distinct pages have it and at most `most_distinct` of them
    differ in it; a node is, if as many pages have it and they are at least
    `least_repeated` of those with its slot.  Copies of a page count once.
    Null html is an empty page with an empty text; pages without a host share
    the empty one; repeated rows each give a row.  Other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), host_of(F.col(url).cast("string")).alias("host"), F.col(html).cast("string").alias("html"))
    small = lambda df, size: (df.agg(F.sum(size)).first()[0] or 0) <= most_broadcast
    shapes = rows.where("html IS NOT NULL").select("host", "html").mapInArrow(_skeletons, "host string, shape string, tree string").groupBy("host", "shape").agg(F.count("*").alias("n"), F.min("tree").alias("tree"))
    ranked = shapes.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "shape"))).where(F.col("rank") <= exemplars)
    trees = written(ranked.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rank", "tree"))).alias("x")).select("host", F.col("x.tree").alias("exemplars")), "exemplars")
    read = lambda texts: tuple(decoded(t) for t in texts or ())
    if small(trees, F.octet_length("host") + F.aggregate("exemplars", F.lit(0), lambda n, t: n + F.octet_length(t))):
        sent = spark.sparkContext.broadcast(dict(map(tuple, trees.collect())))
        with_tree = rows.withColumn("exemplars", F.lit(None).cast("array<string>"))
        lookup = lambda host, _: read(sent.value.get(host))
    else:
        with_tree = rows.join(trees, "host", "left")
        lookup = lambda _, texts: read(texts)
    seen = with_tree.select("host", "html", F.xxhash64("html").alias("page"), "exemplars").mapInArrow(_observed(lookup), "host string, id long, of long, page long, said long")
    # Copies of a page say the same in every slot and count once.
    counts = seen.distinct().groupBy("host", "id", "of").agg(F.count("*").alias("pages"), F.approx_count_distinct("said").alias("kinds")).where(F.col("pages") >= least_pages)
    counts = written(counts, "counts")
    of_slots = counts.where("of IS NULL")
    nodes = counts.where("of IS NOT NULL").join(of_slots.select("host", F.col("id").alias("of"), F.col("pages").alias("all")), ["host", "of"]).where(F.col("pages") >= least_repeated * F.col("all"))
    template = of_slots.where(F.col("kinds") <= F.greatest(F.lit(1), most_distinct * F.col("pages"))).select("host", "id").unionAll(nodes.select("host", "id"))
    template = written(template.groupBy("host").agg(F.collect_set("id").alias("constant")), "template")
    if small(template, F.octet_length("host") + 8 * F.size("constant")):
        constant = spark.sparkContext.broadcast({h: frozenset(s) for h, s in map(tuple, template.collect())})
        all_rows = with_tree.withColumn("constant", F.lit(None).cast("array<long>"))
        known = lambda host, _: constant.value.get(host, frozenset())
    else:
        all_rows = with_tree.join(template, "host", "left")
        known = lambda _, ids: frozenset(ids or ())
    return all_rows.select("page_id", "url", "host", "html", "exemplars", "constant").mapInArrow(_extracted(lookup, known), FOUND)
