"""Main text of pages by site style trees.

A page is read as a tree of blocks.  The site style tree of a host merges the pages of that host:
a style node is a path of tags with their class and id names.  Per node it keeps how many pages
show it, in which child layouts (presentation), and with which contents.  A node's importance is
the entropy of its layouts and contents over the pages that show it, scaled by the logarithm of
their number: branches that look and read alike everywhere are near 0, articles are near 1.

A page keeps the branches of its article.  What lies in elements that never hold main text
(scripts, forms, navigation, ...) goes first, and so do containers with a whole name of such parts,
because readers' comments and adverts differ from page to page as articles do; headings, paragraphs
and other content never go by a name, and inside an article only names of comments, adverts and
links to other pages count.  Then branches of low importance in the host's tree go.  Hosts with fewer than ``least_pages`` pages have no importance to judge by.

Only hashes per (host, node, page) are shuffled, distinct ones by task.  A host with any number of pages is one row of marked nodes, joined to pages by host with
the larger side split where a host is hot.

Defined results: null and empty html give an empty text; broken markup is closed where its parent
ends; a page whose every branch goes has an empty text; pages of a host with equal
text count once; pages without url belong to one nameless host; extra columns stay.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from gradeloom.llm.frames import free_name, map_pieces, pieces, written

LEAST_IMPORTANCE, LEAST_PAGES = 0.3, 4

#: Elements without main text.
DROPPED = frozenset("head script style noscript template nav header footer aside form button select option input textarea iframe object embed svg canvas "
                    "menu dialog audio video".split())
#: Class, id and role names that mark the same.
NAMES = frozenset("ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus "
                  "footer form header login menu modal nav navbar navigation newsletter notice notification pagination popup promo promotion related "
                  "replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets "
                  "alert complementary contentinfo search masthead teaser recommended".split())
#: Of these, the ones that also mark an article element as no main text.
ASIDE_NAMES = frozenset("ad ads advert advertisement comment comments promo promotion related replies reply sponsor sponsored teaser".split())
#: Words that may stand beside these in a name, as in ``site-footer``; a name with any other word is its own.
_PLACES = frozenset("site list area box bar wrapper wrap container links inner outer global posts articles button buttons".split())
#: Names that mark such a part inside an article too.
INSIDE_NAMES = ASIDE_NAMES | frozenset("share sharing social subscribe signup newsletter breadcrumb breadcrumbs cookie cookies consent pagination popup".split())
#: Elements that may be such a part; headings, paragraphs and other content never go by a name.
PARTS = frozenset("address center details div dl fieldset figure li ol section table tbody td tr ul span a ins".split())
#: Elements that hold the main text; a page with any keeps nothing outside them.
MAIN = frozenset("article main".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first ends an open element of the second.
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(script|style|textarea|title|noscript|template|iframe)\b([^>]*)>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S | re.I)
#: One attribute with its value; read one after the other, so values are never taken for names.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Compounds in one word that mark the same.
_MARKS = re.compile("(?:cookie|advert|sidebar|newsletter|breadcrumb|sponsor)(?:s|ed|ing|bar|box|banner|notice|consent|wrap|wrapper|list|left|right|[0-9])*")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\d+")


class Node:
    """``key`` names the path of block elements to the node; ``inside`` and ``article`` tell what it lies in."""

    __slots__ = ("article", "children", "dropped", "inside", "key", "name", "tag", "text")

    def __init__(self, tag: str, name: str, key: tuple[int, int], dropped: bool, inside: bool = False, article: bool = False):
        self.tag, self.name, self.key, self.dropped, self.inside, self.article = tag, name, key, dropped, inside, article
        self.children: list[Node] = []
        self.text: list[tuple[int, str]] = []  # (number of children before it, text)


def _below(key: tuple[int, int], name: str) -> tuple[int, int]:
    """The key of a child; keys are running hashes, so deep pages cost no more than flat ones."""
    b = f"/{name}".encode("utf-8", "surrogatepass")
    return zlib.crc32(b, key[0]), zlib.adler32(b, key[1])


def _marks(name: str, names: frozenset[str]) -> bool:
    """Whether a whole name says that its element is such a part."""
    words = [w for w in re.split(r"[-_:.]+", name) if w]
    marks = [w in names or _MARKS.fullmatch(w) is not None for w in words]
    return any(marks) and all(m or w in _PLACES for w, m in zip(words, marks))


def _style(tag: str, attributes: str, inside: bool = False, article: bool = False) -> tuple[str, bool]:
    """Name of the element in a style path, and whether it goes by its element or names.

    Inside an article only whole names of readers' comments, adverts, notices and links to other pages count, and no id:
    these differ from page to page, so the tree cannot tell them from text.  Any other name there is left to the tree.
    The header of an article is its headline and stays.
    """
    names, gone = [], tag in DROPPED and not (article and tag == "header")
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind in ("class", "id", "role"):
                parts = value.split()
                names += [_NUMBER.sub("0", p) for p in parts]
                if inside:
                    gone |= (tag in PARTS or tag in MAIN) and kind != "id" and any(_marks(p, ASIDE_NAMES if tag in MAIN else INSIDE_NAMES) for p in parts)
                elif tag in MAIN:
                    gone |= kind != "id" and any(_marks(p, ASIDE_NAMES) for p in parts)
                elif tag in PARTS:
                    gone |= any(_marks(p, NAMES) for p in parts)
            elif kind == "hidden" or kind == "aria-hidden" and value == "true" or kind == "style" and "display:none" in value.replace(" ", ""):
                gone = True
    return ".".join([tag, *sorted(names)]), gone


def parse(source: str) -> Node:
    """The tree of a page; elements left open end with their parent."""
    root = Node("#root", "#root", (0, 1), False)
    stack, at, open_tags = [root], 0, Counter()

    def close(depth: int) -> None:
        open_tags.subtract(n.tag for n in stack[depth:])
        del stack[depth:]
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            stack[-1].text.append((len(stack[-1].children), source[at:m.start()]))
        at = m.end()
        tag = m[4]
        if tag is None:
            continue
        tag = tag.lower()
        if m[3]:
            for depth in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[depth].tag == tag:
                    close(depth)
                    break
                if stack[depth].tag in ("article", "body", "html", "main", "section", "td", "div") and tag not in BLOCKS:
                    break
            continue
        if tag in BLOCKS:
            enders = CLOSES.get(tag, ()) if tag in CLOSES else {"p"}
            for depth in range(len(stack) - 1, 0, -1) if any(open_tags[t] for t in enders) else ():
                if stack[depth].tag in enders:
                    close(depth)
                    break
                if stack[depth].tag in ("ul", "ol", "table", "dl", "div", "article", "section", "body", "aside", "nav", "main", "blockquote"):
                    break
        parent = stack[-1]
        if tag == "br":
            parent.text.append((len(parent.children), " "))
            continue
        name, gone = _style(tag, m[5], parent.inside, parent.article)
        gone |= parent.dropped
        node = Node(tag, name, _below(parent.key, name) if tag in BLOCKS else parent.key, gone, parent.inside or tag in MAIN and not gone,
                    parent.article or tag == "article" and not gone)
        parent.children.append(node)
        if tag not in VOID and not m[5].endswith("/"):
            stack.append(node)
            open_tags[tag] += 1
    if at < len(source):
        stack[-1].text.append((len(stack[-1].children), source[at:]))
    return root


def walk(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        here = stack.pop()
        yield here
        stack.extend(reversed(here.children))


def _tops(root: Node) -> list[Node]:
    """The outermost articles in page order."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in MAIN and not node.dropped:
            found.append(node)
        else:
            stack.extend(reversed(node.children))
    return found


def blocks(root: Node, low: set[int]) -> list[str]:
    """Texts of the kept blocks in page order: those of the articles, or of the page where it has none.

    In an article only elements with a name of their own can be of low importance: plain headings and paragraphs are its content.
    """
    return [b for n in _tops(root) or [root] for b in _blocks(n, low)]


def _blocks(root: Node, low: set[int]) -> list[str]:
    out: list[str] = []
    now: list[str] = []

    def close():
        text = _SPACE.sub(" ", html.unescape("".join(now))).strip()
        now.clear()
        if text:
            out.append(text)

    stack: list[tuple[Node, int, int]] = [(root, 0, 0)]  # node, next text, next child
    while stack:
        node, t, c = stack.pop()
        if t == c == 0 and node.tag in BLOCKS:
            close()
        if node.dropped or (low and node.tag in BLOCKS and not (node.inside and (node.name == node.tag or node.tag in MAIN)) and node_id(node.key) in low):
            if node.tag in BLOCKS:
                close()
            continue
        if t < len(node.text) and node.text[t][0] <= c:
            now.append(node.text[t][1])
            stack.append((node, t + 1, c))
        elif c < len(node.children):
            stack.append((node, t, c + 1))
            stack.append((node.children[c], 0, 0))
        elif node.tag in BLOCKS:
            close()
    close()
    return out


def node_id(key: tuple[int, int]) -> int:
    return key[0] << 31 | key[1] >> 1


def key_hash(text: str) -> int:
    b = text.encode("utf-8", "surrogatepass")
    return node_id((zlib.crc32(b), zlib.adler32(b)))


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), F.lit(""))


def style_nodes(pages: DataFrame, url: str = "url", source: str = "html") -> DataFrame:
    """(host, node, layout, content, n): how often a host's pages show a style node with a layout and content hash."""
    plain = pages.select(host_of(F.col(url)).alias("host"), F.col(source).alias("html"))

    def read(batches):
        for piece in pieces(batches, "html"):
            seen: set[tuple] = set()
            for host, text in zip(piece.column("host").to_pylist(), piece.column("html").to_pylist()):
                if not text:
                    continue
                per: dict[tuple[int, int], list[Node]] = {}
                root = parse(text)
                for node in walk(root):
                    if node.tag in BLOCKS and not node.dropped:
                        per.setdefault(node.key, []).append(node)
                content = contents(root)
                page = content[id(root)][0]
                for key, nodes in per.items():
                    layout = key_hash(",".join(dict.fromkeys(c.name for n in nodes for c in n.children if c.tag in BLOCKS)))
                    seen.add((host, node_id(key), layout, joined(content[id(n)] for n in nodes)[0], page))
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), *[pa.array([k[j] for k in rows], pa.int64()) for j in (1, 2, 3, 4)]],
                                             ["host", "node", "layout", "content", "page"])
    return (plain.mapInArrow(read, "host string, node long, layout long, content long, page long").distinct()
            .groupBy("host", "node", "layout", "content").agg(F.count(F.lit(1)).alias("n")))


#: Hashes of sequences of texts are polynomials in ``_BASE``, so that a node's follows from its children's.
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def joined(parts: Iterable[tuple[int, int]]) -> tuple[int, int]:
    """(hash, power) of sequences one after the other."""
    total, power = 0, 1
    for h, p in parts:
        total, power = (total * p + h) % _PRIME, power * p % _PRIME
    return total, power


def contents(root: Node) -> dict[int, tuple[int, int]]:
    """By node, the hash of all texts below it but for dropped parts: its own first, then its children's."""
    out: dict[int, tuple[int, int]] = {}
    for node in reversed(list(walk(root))):  # children come before their parent
        own = () if node.dropped else ((key_hash(t) + 1, _BASE) for _, t in node.text)
        out[id(node)] = joined([*own, *(out[id(c)] for c in node.children)])
    return out


def importance(nodes: DataFrame) -> DataFrame:
    """(host, node, pages, importance): mean of the scaled entropies of layouts and of contents.

    The entropy of counts n_i of m pages is log m - sum(n_i log n_i) / m, so both are plain sums.
    """
    contents = nodes.groupBy("host", "node", "content").agg(F.sum("n").alias("n")).groupBy("host", "node").agg(
        F.sum("n").alias("pages"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("c"))
    layouts = nodes.groupBy("host", "node", "layout").agg(F.sum("n").alias("n")).groupBy("host", "node").agg(
        F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("l"))
    both = contents.join(layouts, ["host", "node"])
    m = F.col("pages").cast("double")
    scaled = [F.when(F.col("pages") > 1, (F.log(m) - F.col(x) / m) / F.log(m)).otherwise(1.0) for x in ("c", "l")]
    return both.select("host", "node", "pages", F.greatest(*scaled).alias("importance"))


def low_branches(pages: DataFrame, url: str = "url", source: str = "html", least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, low): the style nodes to remove, one row per host that has any."""
    found = importance(written(style_nodes(pages, url, source), "style"))
    return found.where((F.col("importance") < least) & (F.col("pages") >= least_pages)).groupBy("host").agg(F.collect_list("node").alias("low"))


def extract(pages: DataFrame, url: str = "url", source: str = "html", name: str = "text", **options) -> DataFrame:
    """``pages`` with ``name``: blocks of main text joined by blank lines."""
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() != name.lower()])
    host, low = free_name(pages.columns, "host"), free_name(pages.columns, "low")
    # Written first, so that Spark plans the join by the true size of the marks: small ones go to the pages, which then are not shuffled.
    marked = written(low_branches(pages, url, source, **options), "low").select(F.col("host").alias(host), F.col("low").alias(low))
    met = pages.withColumn(host, host_of(F.col(url))).join(marked, host, "left")
    kept = pages.columns

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        out = ["\n\n".join(blocks(parse(text), set(own or ()))) if text else ""
               for text, own in zip(piece.column(source).to_pylist(), piece.column(low).to_pylist())]
        return pa.RecordBatch.from_arrays([*[piece.column(c) for c in kept], pa.array(out, pa.string())], [*kept, name])
    return map_pieces(met, run, StructType([*pages.schema.fields]).add(name, StringType()), source)
