"""Main text of web pages, with site templates removed.

Every page becomes a tree of elements; the subtrees of block elements are hashed by tag, text and child hashes. Spark counts for each host on how
many pages a hash occurs and beside how many different articles (pre-aggregated, so a large host meets nowhere as a group). Subtrees that
recur on most of a host's pages, or on many pages beside many different articles, are deleted, inside an article element as well as outside of it.

A page is evidence for a subtree where the longest block of text outside of it is at least as long as the longest one inside: then
the subtree is not what the page is about. Different such blocks are counted as set bits of a mask of BITS, so never too many.

Prose inside an article element (paragraphs, headings, lists) is judged more strictly, as near copies of an article, and articles that quote one passage, share such
blocks: it goes if it is on most of the host's pages, beside many different articles, and, on the page at hand, most of the article's other text is not of that kind. So a
notice in all articles of a host goes, and an article that most pages of a host hold in near copies stays.

Names break ties, for what a site shows once only: tags of page furniture, and words that are a whole token of a class, id or role or its last part (``site-nav``, not
``search-engines``). No name takes an element that holds most of its article's text. What remains of the article is the text.

Parsing is linear in the page, whatever its markup. A task has its pages in the order of their hosts, behind one row of each host's templates.

Defined results: null or empty html gives an empty text; a null url belongs to a host of its own, "", and unclosed or misnested markup is read as
browsers do in simple cases (implied ends, unknown end tags ignored); an article with nothing but its heading left by names is read without them; of ties between
equal shares all are templates; repeated rows give a row each and count as a page each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import chunk_slices, cut_lineage, listed, map_chunks, table

#: A template occurs on that share of a host's pages at least, and on so many pages.
SHARE, LEAST_PAGES = 0.5, 4
#: So does what occurs beside so many different articles (SOME, unless it is prose), if it is on a small share of the pages (which bounds the templates of a host).
MANY, SOME, FEW, BITS = 10, 4, 0.001, 63
#: Share of an article's text that no name may take, and words from which on an element is text that can be an article's.
MOST, TEXT_WORDS = 0.5, 12
#: Parts of lists and tables recur by chance, so MANY counts them only where all their text is links (a menu's entries); else their whole list or table.
PARTS = frozenset("tr td th thead tbody tfoot caption li dt dd".split())
#: Pages of a host for each task; and hosts that are dealt over several tasks, at most: all with more than SPLIT pages and 1 / LARGE of all pages.
SPLIT, LARGE = 500, 100_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table tr td th thead tbody tfoot caption ol ul li dl dt dd article main hr address details summary".split())
FURNITURE = frozenset("head nav footer aside form menu dialog button select object audio video canvas".split())
#: Words that mark furniture where they are a whole token of a class, id or role, or its last part; and where they are its first part.
MARKED = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright disqus
    footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion
    recommended related respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget""".split()
)
BEGINS = frozenset("comments sidebar footer navbar breadcrumb breadcrumbs newsletter".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: An end is bounded in the attributes it may have, so that no tag is searched to the page's end again and again.
_token = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'){0,999}+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""")
_attribute = re.compile(r"""(?:^|\s)(class|id|role|aria-label|itemprop|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)|(?=[\s/]|$))""", re.I)
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_first, _last = re.compile(r"^(?:[A-Z]?[a-z]+|[A-Z]+)(?=[-_A-Z])"), re.compile(r"(?<=[-_a-z])(?:[A-Z]?[a-z]+|[A-Z]+)[-_0-9]*$")
_host = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


class Node:
    __slots__ = ("tag", "up", "parts", "marks", "inside", "hash", "deleted")

    def __init__(self, tag: str, up: Node | None, marks: frozenset):
        self.tag, self.up, self.marks, self.parts, self.hash, self.deleted = tag, up, marks, [], None, False
        #: whether an article is above
        self.inside = up is not None and (up.inside or up.tag in ("article", "main"))


NO_MARKS: frozenset = frozenset()


def marks_of(attributes: str) -> frozenset:
    if "=" not in attributes and "hidden" not in attributes.lower():
        return NO_MARKS
    out = set()
    for name, value in _attribute.findall(attributes):
        if name.lower() == "hidden":
            out.add("hidden")
        for token in value.strip("\"'").split():
            out.add(token.lower())
            if (m := _last.search(token)) is not None:
                out.add("-" + _part.match(m[0])[0].lower())
            if (m := _first.match(token)) is not None:
                out.add(m[0].lower() + "-")
    return frozenset(out)


def names_furniture(marks: frozenset) -> bool:
    """Whether a whole token, its last part, or its first part tells so."""
    return any(m in MARKED or m[0] == "-" and m[1:] in MARKED or m[-1] == "-" and m[:-1] in BEGINS for m in marks)


def parse(html: str) -> tuple[Node, list[Node]]:
    """The root and all nodes in page order."""
    root = Node("#root", None, frozenset())
    nodes = [root]
    # the open elements from the root down; for each tag the depths of those that are open; the depths of blocks but paragraphs
    path, depths, blocks = [root], defaultdict(list), [0]

    def deepest(tags) -> int:
        return max((depths[t][-1] for t in tags if depths[t]), default=0)

    def close(depth: int) -> None:
        """Close the element at that depth and all below it."""
        while len(path) > depth:
            depths[path.pop().tag].pop()
        while blocks[-1] >= depth:
            blocks.pop()

    at, length, last = 0, len(html), html.rfind(">") + 1
    search, paragraphs = _token.search, depths["p"]
    while at < length:
        m = search(html, at, last)  # up to the last one every tag has an end
        if m is None:
            path[-1].parts.append(html[at:].partition("<!--")[0])
            break
        start, end = m.span()
        if start > at:
            path[-1].parts.append(html[at:start])
        at = end
        closing, tag, attributes, closing2, tag2, attributes2 = m.groups()
        if tag is None:
            if tag2 is None:
                if m[0] == "<!--":
                    end = html.find("-->", at)
                    at = length if end < 0 else end + 3
                continue
            closing, tag, attributes = closing2, tag2, attributes2
        tag = tag.lower()
        if closing:
            if depths[tag]:
                close(depths[tag][-1])
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag not in ("svg", "math"):
                end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(html, at)
                at = end.end() if end else length
            continue
        inline = tag in INLINE
        if not inline and paragraphs and paragraphs[-1] > blocks[-1] and path[-1].tag not in ("#root", "body", "html"):
            close(paragraphs[-1])  # a block ends an open paragraph
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            while (depth := deepest(ends)) > deepest(stops):
                close(depth)
        here = path[-1]
        node = Node(tag, here, marks_of(attributes) if attributes else NO_MARKS)
        here.parts.append(node)
        nodes.append(node)
        if tag not in VOID and not (attributes.endswith("/") and tag in ("path", "circle")):
            depths[tag].append(len(path))
            if not inline and tag != "p":
                blocks.append(len(path))
            path.append(node)
    return root, nodes


def furniture(node: Node) -> bool:
    tag, marks = node.tag, node.marks
    if tag in FURNITURE or "hidden" in marks:
        return True
    if tag == "header":
        return not (node.inside and any(isinstance(x, Node) and re.fullmatch("h[1-6]", x.tag) for x in node.parts))
    if tag in ("html", "body", "#root", "main") or not marks:
        return False
    if tag == "article":
        return bool(marks & {"comment", "comments", "ad", "advert", "sponsored", "promo", "related"})
    return tag not in ("h1", "h2") and names_furniture(marks)


#: Furniture tags that a site may wrap its text in.
WRAPPERS = frozenset("form aside menu dialog select".split())


def text_lengths(nodes: list[Node]) -> tuple[dict[int, int], dict[int, int]]:
    """(code points but white space, words) of the text in each element that is not deleted, by its id."""
    points, words = {id(n): 0 for n in nodes}, {id(n): 0 for n in nodes}
    for node in reversed(nodes):
        found = [w for x in node.parts if not isinstance(x, Node) for w in x.split()]
        points[id(node)] += sum(map(len, found))
        words[id(node)] += len(found)
        if node.up is not None and not node.deleted:
            points[id(node.up)] += points[id(node)]
            words[id(node.up)] += words[id(node)]
    return points, words


def delete_by_name(root: Node, nodes: list[Node]) -> None:
    """Mark the elements that tags and names tell as furniture, but none that holds most of the text of its article (of the page, where there is none)."""
    sure = [n for n in nodes if furniture(n) and (n.tag in FURNITURE - WRAPPERS or n.tag == "header" or "hidden" in n.marks)]
    for node in sure:
        node.deleted = True
    spread(nodes)
    (lengths, words), inside = text_lengths(nodes), {}
    articles = any(n.tag in ("article", "main") and not n.deleted for n in nodes)
    for node in nodes:
        if node.deleted:
            continue
        around = inside.get(id(node.up), root)
        inside[id(node)] = node if node.tag in ("article", "main") else around
        if furniture(node) and not (lengths[id(node)] >= MOST * lengths[id(around)] and words[id(node)] >= TEXT_WORDS and (around is not root or not articles)):
            node.deleted = True
    spread(nodes)


def spread(nodes: list[Node]) -> None:
    """What is in a deleted element is deleted."""
    for node in nodes:
        node.deleted = node.deleted or node.up is not None and node.up.deleted


def hash_subtrees(nodes: list[Node]) -> None:
    """64-bit hash of each subtree, children first; None where there is no text."""
    for node in reversed(nodes):
        parts = [x.hash.to_bytes(8, "little") if isinstance(x, Node) else " ".join(x.split()).encode("utf-8", "replace") for x in node.parts if not isinstance(x, Node) or x.hash is not None]
        parts = [x for x in parts if x]
        node.hash = xxhash.xxh3_64_intdigest(node.tag.encode("utf-8", "replace") + b"\0" + b"\0".join(parts)) if parts else None


def can_be_template(node: Node) -> bool:
    return node.hash is not None and node.tag not in INLINE and node.tag not in ("#root", "html", "body", "article", "main")


def is_prose(node: Node) -> bool:
    """A block of an article's prose, which is judged more strictly."""
    return node.inside and node.tag in PROSE


#: What a hash stands for: a subtree outside of articles that is prose, or none, or prose inside of one. Kept in the mask's place of the sign.
KINDS = {"prose": 0, "block": 1, "inside": 2}


def kind_of(node: Node) -> int:
    return KINDS["inside" if is_prose(node) else "prose" if node.tag in PROSE else "block"]


def links_only(nodes: list[Node]) -> set[int]:
    """Ids of the nodes all of whose text is inside links."""
    out = set()
    for node in reversed(nodes):
        if node.tag == "a" or all(id(x) in out if isinstance(x, Node) else not x or x.isspace() for x in node.parts):
            out.add(id(node))
    return out


def template_evidence(html: str) -> dict[tuple[int, int], int]:
    """By hash (signed 64 bits) and kind of each of the page's subtrees that could be a template, the mask of the article beside it (0: none)."""
    _, nodes = parse(html)
    hash_subtrees(nodes)
    place = {id(node): i for i, node in enumerate(nodes)}
    owner, ends, own = [0] * len(nodes), [i + 1 for i in range(len(nodes))], [[] for _ in nodes]
    for i, node in enumerate(nodes):  # text of inline elements is their block's
        owner[i] = owner[place[id(node.up)]] if node.up is not None and node.tag in INLINE else i
        own[owner[i]] += [" ".join(x.split()) for x in node.parts if not isinstance(x, Node)]
    for i in range(len(nodes) - 1, 0, -1):
        up = place[id(nodes[i].up)]
        ends[up] = max(ends[up], ends[i])
    texts = ["".join(x) for x in own]
    sizes = [(len(t), -i) for i, t in enumerate(texts)]
    # the longest block up to each place and from it on; and, children first, within each subtree
    before, behind, inside = [(0, 0)], [(0, 0)], list(sizes)
    for x in sizes:
        before.append(max(before[-1], x))
    for x in reversed(sizes):
        behind.append(max(behind[-1], x))
    behind.reverse()
    for i in range(len(nodes) - 1, 0, -1):
        up = place[id(nodes[i].up)]
        inside[up] = max(inside[up], inside[i])
    out: dict[tuple[int, int], int] = {}
    links = links_only(nodes)
    for i, node in enumerate(nodes):
        if can_be_template(node):
            size, at = max(before[i], behind[ends[i]])
            shown = size > 0 and size >= inside[i][0] and (node.tag not in PARTS or id(node) in links)
            mask = 1 << xxhash.xxh3_64_intdigest(texts[-at].encode("utf-8", "replace")) % BITS if shown else 0
            key = node.hash - 2**63, kind_of(node)
            out[key] = out.get(key, 0) | mask
    return out


def delete_templates(nodes: list[Node], templates: frozenset, common: frozenset) -> None:
    """Mark subtrees that are templates of the host; ``common``: prose inside articles on most of its pages, which goes where most of the article's other text is not of that kind."""
    hash_subtrees(nodes)
    for node in nodes:
        node.deleted = (node.up is not None and node.up.deleted) or (can_be_template(node) and not is_prose(node) and node.hash - 2**63 in templates)
    often = [n for n in nodes if not n.deleted and is_prose(n) and can_be_template(n) and n.hash - 2**63 in common]
    if not often:
        return
    lengths, around, held = text_lengths(nodes)[0], {}, {id(n) for n in often}
    for node in nodes:
        up = around.get(id(node.up))
        around[id(node)] = node if node.tag in ("article", "main") else up
    below: set[int] = set()  # what is within one of them
    for node in nodes:
        if node.up is not None and (id(node.up) in held or id(node.up) in below):
            below.add(id(node))
    top = [n for n in often if id(n) not in below]
    mass: dict[int, int] = {}
    for node in top:
        mass[id(around[id(node)])] = mass.get(id(around[id(node)]), 0) + lengths[id(node)]
    for node in top:
        article = id(around[id(node)])
        if mass[article] < MOST * lengths[article]:
            node.deleted = True
    spread(nodes)


def main_text(html: str, templates=frozenset(), common=frozenset(), names: bool = True) -> str:
    """The page's main text, a line for each block. Without ``names`` only templates are taken out of the page."""
    root, nodes = parse(html)
    if templates or common:
        delete_templates(nodes, templates, common)
    by_template = [n.deleted for n in nodes]
    if names:
        delete_by_name(root, nodes)
    lines = lines_of(root, nodes, names)
    if names and sum(len(x.split()) for x in lines) < TEXT_WORDS and not any(len(x) > 0 for x in lines if not is_heading_text(x, nodes)):
        # nothing but a heading, or nothing at all: names have taken the text
        for node, gone in zip(nodes, by_template):
            node.deleted = gone or node.tag in FURNITURE - WRAPPERS or node.tag == "header" and not node.inside
        spread(nodes)
        lines = lines_of(root, nodes, True) or lines
    return "\n".join(lines)


def is_heading_text(line: str, nodes: list[Node]) -> bool:
    return any(re.fullmatch("h[1-6]", n.tag) and not n.deleted and line in blocks(n) for n in nodes)


def lines_of(root: Node, nodes: list[Node], names: bool) -> list[str]:
    articles = [n for n in nodes if n.tag == "article" and not n.deleted] or [n for n in nodes if (n.tag == "main" or "main" in n.marks and n.tag == "div" or "articlebody" in n.marks) and not n.deleted]
    chosen, below = {id(n) for n in articles}, set()
    for node in nodes:
        if node.up is not None and (id(node.up) in chosen or id(node.up) in below):
            below.add(id(node))
    tops = [n for n in articles if id(n) not in below] if names else []
    for starts in (tops, [root]):
        lines = [line for start in starts for line in blocks(start)]
        if lines:
            return lines
    return []


def blocks(start: Node) -> list[str]:
    """The blocks of text below ``start``, in page order; no recursion, so any depth of markup will do."""
    lines, held, todo = [], [], [iter([start])]
    ends: list[bool] = [False]

    def flush():
        line = " ".join(unescape("".join(held)).split())
        held.clear()
        if line:
            lines.append(line)

    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
            if ends.pop():
                flush()
        elif isinstance(part, str):
            held.append(part)
        elif not part.deleted:
            block = part.tag not in INLINE
            if block:
                flush()
            elif part.tag == "br":
                held.append(" ")
            todo.append(iter(part.parts))
            ends.append(block)
    flush()
    return lines


def host_of(url: str | None) -> str:
    m = _host.match(url or "")
    return m[1].lower() if m else ""


def page_counts(pages: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """(host, hash, kind, n, beside): pages by host (hash null), and by subtree where there are enough to make a template; different articles beside it."""

    def make():
        def work(rows):
            found = [(host_of(u), h, k, m) for u, t in zip(rows["url"], rows["html"]) for (h, k), m in (*template_evidence(t).items(), ((None, None), 0))]
            return {"host": [x[0] for x in found], "hash": [x[1] for x in found], "kind": [x[2] for x in found], "mask": [x[3] for x in found]}

        return work

    seen = map_chunks(pages, make, "host string, hash long, kind int, mask long", text="html")
    counts = seen.groupBy("host", "hash", "kind").agg(F.count(F.lit(1)).alias("n"), F.bit_count(F.bit_or("mask")).alias("beside"))
    return cut_lineage(counts.filter((F.col("n") >= least) | F.col("hash").isNull()))


def host_templates(counts: DataFrame, share: float = SHARE, many: int = MANY, few: float = FEW, some: int = SOME) -> DataFrame:
    """(host, templates, common): hashes of the subtrees that are deleted, and of the prose inside articles that may be.

    At most (subtrees of a page) / few of them, however many pages a host has.
    """
    of_host = counts.filter("hash is null").select("host", F.col("n").alias("pages"))
    often = counts.filter("hash is not null").join(of_host, "host")
    most, beside = F.col("n") >= share * F.col("pages"), F.when(F.col("kind") == KINDS["block"], some).otherwise(many)
    outside = (F.col("kind") != KINDS["inside"]) & (most | (F.col("beside") >= beside) & (F.col("n") >= few * F.col("pages")))
    inside = (F.col("kind") == KINDS["inside"]) & most & (F.col("beside") >= many)
    found = often.filter(outside | inside).groupBy("host").agg(F.collect_list(F.when(F.col("kind") != KINDS["inside"], F.col("hash"))).alias("templates"), F.collect_list(F.when(F.col("kind") == KINDS["inside"], F.col("hash"))).alias("common"))
    return found


def extract(pages: DataFrame, share: float = SHARE, least: int = LEAST_PAGES, many: int = MANY, few: float = FEW) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    counts = page_counts(pages, least)
    templates = host_templates(counts, share, many, few)
    # pages of large hosts are dealt over several tasks with a copy of the host's templates each; fewer than LARGE hosts can have 1 / LARGE of all pages
    of_host = counts.filter("hash is null").select("host", F.col("n").alias("pages"))
    whole = of_host.agg(F.sum("pages").alias("whole"))
    large = of_host.crossJoin(F.broadcast(whole)).filter((F.col("pages") > SPLIT) & (F.col("pages") * LARGE > F.col("whole")))
    large = large.select("host", F.ceil(F.col("pages") / SPLIT).cast("int").alias("salts"))
    salts, hashes = F.coalesce("salts", F.lit(1)), "array<long>"
    copies = templates.join(F.broadcast(large), "host", "left").select("host", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), "templates", "common")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    dealt = pages.withColumn("host", host).join(F.broadcast(large), "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), salts).cast("int"))
    # a host's templates come once for each of its tasks, before its pages
    first = copies.select("host", "salt", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "templates", "common")
    behind = dealt.select("host", "salt", F.lit(1).alias("kind"), "page_id", "url", "html", F.lit(None).cast(hashes).alias("templates"), F.lit(None).cast(hashes).alias("common"))
    ordered = first.unionByName(behind).repartition("host", "salt").sortWithinPartitions("host", "salt", "kind")

    def run(batches):
        here, known = None, (frozenset(), frozenset())
        for part in chunk_slices(batches, "html"):
            rows = listed(part, "html", part.schema.names)
            out = {"page_id": [], "url": [], "text": [], "n_chars": []}
            for at, place in enumerate(zip(rows["host"], rows["salt"])):
                if place != here:
                    here, known = place, (frozenset(), frozenset())
                if rows["kind"][at] == 0:
                    known = frozenset(rows["templates"][at] or ()), frozenset(rows["common"][at] or ())
                    continue
                text = main_text(rows["html"][at], *known)
                for name, x in (("page_id", rows["page_id"][at]), ("url", rows["url"][at]), ("text", text), ("n_chars", len(text))):
                    out[name].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out["page_id"], pa.int64()), pa.array(out["url"], pa.string()), pa.array(out["text"], pa.string()), pa.array(out["n_chars"], pa.int64())], names=list(out))

    return ordered.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
