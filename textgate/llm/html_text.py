"""HTML extraction with a site style tree.

Each page is parsed to blocks: runs of text between block-level tags, each with the chain of elements (tags and classes)
around it. The pages of a host are merged to its style tree, kept as counts:

* presentation nodes: an element at a path, with the distribution of its styles (the sequence of what it holds) over the
  host's pages;
* content nodes: an element that holds text itself, with the distribution of its texts, and each common text in it.

Importance is from 0 to 1. An element's own importance is the normalised entropy of its distribution: 1 where every page
differs, 0 where all agree, drawn towards 1 by PRIOR_PAGES imagined pages, so that few pages prove nothing: on a small host
what its pages hold alike stays, and the labels below decide alone. The role that tags and class words give a block labels
its content node and is its prior: boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments, and on pages with an article all that is outside of it) has importance 0, articles have 1 (near copies of one
article may be a host's only pages), for all others the entropy counts. A branch's importance is composed from its children:
INNER times the greatest importance in it plus the rest times its own presentation's; 0 if all in it is boilerplate. From
each page are removed the topmost branches of importance under LEAST_IMPORTANCE, and texts that are on at least COMMON_SHARE
of the host's pages (and PRIOR_PAGES more) in the same node, unless it is an article's. If the tree would remove all that
isn't boilerplate, that stays.

The tree's low nodes are a table with a row for each host, broadcast while it has at most MAX_HOSTS rows and MAX_NODES nodes
and joined by host beyond that. The texts of scripts, styles, templates and the like are no text of the page.

Nulls: null html is empty and gives an empty text; a null url belongs to the empty host. Broken markup is read leniently:
unclosed elements end with their parents. Very long pages are read whole, a page at a time. Ties don't arise; repeated rows
are each extracted (and counted). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textgate.llm.common import stored, table
from textgate.llm.url_filter import with_parts

PRIOR_PAGES = 4
INNER = 0.9
LEAST_IMPORTANCE = 0.2
COMMON_SHARE = 0.8
MAX_HOSTS = 20_000
MAX_NODES = 500_000
BRANCH = -1  # no null, which would make pandas round the other keys

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
LETTERS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea svg object canvas select title xmp noembed noframes annotation annotation-xml".split())
# Unclosed, these run to the end of the page; other raw elements end with their parent.
RAW_TO_END = set("script style textarea title".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split()
)
P_CLOSERS = set(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
BOILERPLATE_TAGS = set("nav footer aside form menu dialog button head fieldset".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# Words of classes and ids that mark a branch as boilerplate.
BOILERPLATE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs "
    "header masthead topbar footer sidebar aside rail widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay "
    "comment comments commentlist disqus replies share sharing social related recommended newsletter subscribe subscription signup login "
    "search searchform form pagination pager toolbar skip legal copyright".split()
)
STAYS_SHUT = set("comment comments commentlist disqus replies related recommended sidebar aside".split())

# SHUT ends at an article or main, SHUT_BY_WORD at a main, SHUT_FOR_GOOD with its element.
OPEN, ARTICLE, SHUT, SHUT_BY_WORD, SHUT_FOR_GOOD = range(5)


def _zone(tag: str, rest: str, zone: int, by_words: bool = True) -> tuple[int, str]:
    """Zone of an element inside a zone, and its classes. Without by_words no class but an article's own closes a branch to articles."""
    words: set[str] = set()
    leading: set[str] = set()
    named: set[str] = set()
    classes = role = ""
    hidden = False
    if rest and len(rest) > 2:
        for m in ATTRIBUTE.finditer(rest):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "class" or key == "id":
                classes += value
                words.update(LETTERS.findall(value))
                named.update(value.split())
                leading.update(w for x in value.split() for w in LETTERS.findall(x)[:1])
            elif key == "role":
                role = value
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                hidden = True
            elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hidden = True
    if zone == SHUT_FOR_GOOD or hidden:
        return SHUT_FOR_GOOD, classes
    if tag in ("html", "body"):
        return zone, classes
    if tag in ("aside", "head"):
        return SHUT_FOR_GOOD, classes
    if tag == "main" or role == "main":
        return ARTICLE, classes
    if zone == SHUT_BY_WORD:
        return SHUT_BY_WORD, classes
    if tag == "article" or role == "article":
        # <article class="comment"> is a comment, <article class="post has-comments"> is none.
        return (SHUT_BY_WORD if named & STAYS_SHUT else ARTICLE), classes
    if words & STAYS_SHUT:
        # A name that begins with the word (related-posts) may hold articles of its own kind; others (content-sidebar-wrap) hold the page's.
        return (SHUT_BY_WORD if by_words and leading & STAYS_SHUT else SHUT), classes
    if zone == SHUT or tag in BOILERPLATE_TAGS or role in BOILERPLATE_ROLES:
        return SHUT, classes
    if words & BOILERPLATE_WORDS or tag == "header":
        # A heading with such a class, or a header of the article itself, still belongs to the article.
        return (zone, classes) if zone == ARTICLE and (tag == "header" or tag[0] == "h" and tag[1:].isdigit()) else (SHUT, classes)
    return zone, classes


def _child(path: int, what: str) -> int:
    """Key of a node below that of path."""
    return ((path ^ crc32(what.encode("utf-8", "replace"))) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) >> 1 & (1 << 62) - 1


Block = tuple[tuple[int, ...], int, str]


def blocks(page: str, by_words: bool = True) -> list[Block]:
    """(paths of the elements around it from the outermost on, zone, text) of each block."""
    out: list[Block] = []
    pieces: list[str] = []
    stack: list[tuple[str, int, int]] = [("", OPEN, 0)]
    at, size = 0, len(page)

    def flush() -> None:
        if pieces:
            text = " ".join(references.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                out.append((tuple(path for tag, _, path in stack if tag not in INLINE), stack[-1][1], text))

    while at < size:
        m = TAG.search(page, at)
        if m is None:
            pieces.append(page[at:])
            break
        if m.start() > at:
            pieces.append(page[at : m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            if m["data"]:
                pieces.append(m["data"].replace("&", "&amp;"))
            continue
        name = name.lower()
        inline = name in INLINE
        if m["end"] or m["end2"]:
            if not inline:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    if any(zone != stack[k][1] for _, zone, _ in stack[k:]) or stack[k - 1][1] != stack[k][1]:
                        flush()
                    del stack[k:]
                    break
                if inline and stack[k][0] not in INLINE:
                    break
            continue
        rest = m["rest"] or m["rest2"] or ""
        unclosed = False
        if name in RAW:
            if rest.endswith("/") and name not in ("script", "style"):
                continue
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            unclosed = close is None and name not in RAW_TO_END
            if not unclosed:
                at = close.end() if close else size
                continue
        if name in VOID:
            if not inline:
                flush()
            continue
        if not inline:
            flush()
            if name in P_CLOSERS:
                _close(stack, {"p"}, {"button", "td", "th", "li", "article", "div"})
            if name in SIBLING:
                _close(stack, SIBLING[name], SCOPE.get(name, set()))
        if rest.endswith("/") and inline:
            continue
        before = stack[-1]
        zone, classes = (SHUT_FOR_GOOD, "") if unclosed else _zone(name, rest, before[1], by_words)
        if zone != before[1]:
            flush()
        # Numbers in classes and ids tell elements of one kind apart, so they don't count.
        stack.append((name, zone, before[2] if inline else _child(before[2], f"{name}.{DIGITS.sub('', classes)}")))
    flush()
    return out


def _close(stack: list[tuple[str, int, int]], names: set[str], scope: set[str]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k][0] in names:
            del stack[k:]
            return
        if stack[k][0] in scope:
            return


BOILERPLATE, UNDECIDED, MAIN = range(3)


def labelled(page: str | None) -> list[tuple[tuple[int, ...], int, str]]:
    """(chain, label, text) of each block; the chain ends with the content node."""
    found = blocks(page or "")
    if not any(zone < SHUT for _, zone, _ in found):
        # Without any text the page may have its article in a branch that a class word closed.
        found = blocks(page or "", by_words=False)
        found = [(chain, zone if zone == ARTICLE else SHUT, text) for chain, zone, text in found]
    has_article = any(zone == ARTICLE for _, zone, _ in found)
    out = []
    for chain, zone, text in found:
        label = MAIN if zone == ARTICLE else BOILERPLATE if zone >= SHUT or has_article else UNDECIDED
        out.append(((*chain, _child(chain[-1], f"text.{label}")), label, text))
    return out


def candidates(page: str | None) -> list[tuple[int, str, bool]]:
    """(content node, text, whether in an article) of the blocks that aren't labelled boilerplate."""
    return [(chain[-1], text, label == MAIN) for chain, label, text in labelled(page) if label != BOILERPLATE]


def _content(text: str) -> int:
    raw = text.encode("utf-8", "replace")
    return crc32(raw) << 31 | crc32(raw[::-1]) >> 1


def _nodes(page: str | None) -> set[tuple]:
    """(path, style or text, chain above, label) of the page's nodes; presentation nodes have no label."""
    out: set[tuple] = set()
    holds: dict[tuple[int, ...], list[int]] = {}
    for chain, label, text in labelled(page):
        out.add((chain[-1], _content(text), chain[:-1], label))
        for k in range(len(chain) - 1):
            inside = holds.setdefault(chain[: k + 1], [])
            if not inside or inside[-1] != chain[k + 1]:
                inside.append(chain[k + 1])
    out.update((chain[-1], crc32(repr(inside).encode()), chain[:-1], None) for chain, inside in holds.items())
    return out


def style_tree(pages: DataFrame) -> DataFrame:
    """pages (host, html) -> host, low: array<struct<path, content>> of what the tree removes; content BRANCH: all of it."""

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for host, page in zip(b["host"], b["html"], strict=True):
                out += [(host, path, style, list(above), label) for path, style, above, label in _nodes(page)]
            if out:
                frame = pd.DataFrame(out, columns=["host", "path", "style", "above", "label"])
                yield frame.astype({"label": "Int32"})

    hosts = pages.groupBy("host").agg(F.count("*").alias("pages"))
    counts = (
        pages.mapInPandas(nodes, "host string, path long, style long, above array<long>, label int")
        .groupBy("host", "path", "style")
        .agg(F.count("*").alias("n"), F.min("above").alias("above"), F.min("label").alias("label"))
    )
    counts = stored(counts, "style-tree")
    m, spread = F.sum("n"), F.sum(F.col("n") * F.log2("n"))
    entropy = F.when(m > 1, (F.log2(m) - spread / m) / F.log2(m)).otherwise(1.0)
    each = counts.groupBy("host", "path").agg(
        F.min("above").alias("above"), F.min("label").alias("label"), ((m * entropy + PRIOR_PAGES) / (m + PRIOR_PAGES)).alias("own")
    )
    each = stored(each, "style-tree-nodes")
    leaf = F.when(F.col("label") == BOILERPLATE, 0.0).when(F.col("label") == MAIN, 1.0).otherwise(F.col("own"))
    leaves = each.filter("label is not null").select("host", leaf.alias("importance"), F.explode(F.concat("above", F.array("path"))).alias("path"))
    best = leaves.groupBy("host", "path").agg(F.max("importance").alias("best"))
    composed = F.when(F.col("label").isNotNull() | (F.col("best") == 0), F.col("best")).otherwise(INNER * F.col("best") + (1 - INNER) * F.col("own"))
    low = each.join(best, ["host", "path"]).filter(composed < LEAST_IMPORTANCE).select("host", "path", F.element_at(F.concat(F.array(F.lit(0).cast("long")), "above"), -1).alias("parent"))
    low = stored(low, "style-tree-branches")
    topmost = low.join(low.select("host", F.col("path").alias("parent")), ["host", "parent"], "left_anti")
    # What is on few pages can't be common on a host of at least PRIOR_PAGES / COMMON_SHARE pages, so most rows stay where they are.
    frequent = counts.filter((F.col("label") == UNDECIDED) & (F.col("n") > PRIOR_PAGES))
    common = frequent.join(hosts, "host").filter(F.col("n") >= COMMON_SHARE * (F.col("pages") + PRIOR_PAGES))
    rows = topmost.select("host", "path", F.lit(BRANCH).cast("long").alias("content")).unionByName(common.select("host", "path", F.col("style").alias("content")))
    return rows.groupBy("host").agg(F.collect_set(F.struct("path", "content")).alias("low"))


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_blocks, n_removed."""
    pages = with_parts(pages.select("page_id", "url", "html")).select("page_id", "url", "host", "html")
    tree = stored(style_tree(pages), "style-tree-low")
    n_hosts, n_nodes = tree.agg(F.count("*"), F.coalesce(F.sum(F.size("low")), F.lit(0))).first()
    small = n_hosts <= MAX_HOSTS and n_nodes <= MAX_NODES
    joined = pages.join(F.broadcast(tree) if small else tree, "host", "left")
    id_type = pages.schema["page_id"].dataType.simpleString()

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for page_id, url, page, low in zip(b["page_id"], b["url"], b["html"], b["low"], strict=True):
                found = labelled(page)
                gone = {(x["path"], x["content"]) for x in low} if low is not None else set()
                left = [x for x in found if not any((path, BRANCH) in gone for path in x[0]) and (x[0][-1], _content(x[2])) not in gone]
                left = left or [x for x in found if x[1] != BOILERPLATE]
                out.append((page_id, url, " ".join(text for _, _, text in left), len(found), len(found) - len(left)))
            yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_blocks", "n_removed"])

    return joined.select("page_id", "url", "html", "low").mapInPandas(
        texts, f"page_id {id_type}, url string, text string, n_blocks int, n_removed int"
    )


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
