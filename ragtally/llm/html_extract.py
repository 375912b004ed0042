"""Main text of web pages by site style trees (operator 9).

All pages of a host are merged into one tree: a node is an element's path of
tags and classes from the root, without ids and digits (values of single pages).
Two things are counted per node in Spark, over
all pages: the presentation styles (sequences of child tags) and the contents
(hashes of its own text blocks).  From these come importances between 0 and 1:

* presentation: the entropy of the node's styles over its pages, to the base of
  the number of pages (1 if there is one page);
* content: one less the mean entropy of the pages' contents, a content on f of
  m pages having entropy log f / log m (on all pages: importance 0);
* composite, bottom-up in the host's tree: the content's for leaves; otherwise
  (1 - DAMP^l) * presentation + DAMP^l * mean of the children's composites,
  with l styles.

Branches below LEAST_IMPORTANCE are dropped from each page of the host, and so
are branches whose tag, role, class or id says what they are (menus, headers,
footers, forms, adverts, notices, comments ...), which entropy can't tell where
such parts differ from page to page.  A class or id says so as a whole or by its
last part (site-footer, comment-list; not ad-free, has-sidebar), never on html,
body, main, article or a headline, and a header inside an article holds its
headline.  Where such names lie around every article of a page, they count only
inside the articles.  Where a page has an article or main element, its text is
the page's text, less its branches of low importance.  Two guards there, since
pages may carry one article: headlines stay, and where the low branches hold
half or more of the characters, all stay.

Blocks: character references are decoded, white space in a block becomes one
space, blocks are trimmed and joined by one newline, in page order.

Skew: nodes are counted with partial aggregates (a hot host is no hot key), and
composites are aggregates by parent, a level of all trees at a time, so no task
holds a host's tree.  Nodes of a single page have importance 1, as all below
them, and need no level: a malformed page of thousands of levels costs none.  A host's list has its low branches only; pages meet their host's
list of low branches by a join that splits hot hosts.

Defined results: null html is empty and gives an empty text; a null or
malformed url is the host of its own text; repeated rows count as pages of
their own; a host with fewer than LEAST_PAGES pages drops nothing by
importance; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as html_module
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import null_safe_join, written

DAMP = 0.9
LEAST_IMPORTANCE = 0.2
LEAST_PAGES = 4
BILLION = 1_000_000_000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_DIGITS = re.compile(r"[0-9]+")
_RAW = frozenset("script style title textarea noscript iframe template svg xmp noembed noframes select object".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("""address article aside blockquote body br button caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup
    option p pre search section select summary table tbody td tfoot th thead tr ul""".split())
_MAIN = frozenset(("article", "main"))
_NOT_TEXT = frozenset("nav header footer aside form head menu button dialog search input label fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
#: Words of class and id names that say what a branch is.
_CUES = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar
    navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside widget widgets cookie cookies
    consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login form forms
    comment comments respond reply replies disqus discussion share sharing social related recommended pagination pager
    toolbar skip hidden""".split())
_WHOLE = frozenset(("html", "body", "main", "article", "h1", "h2", "h3", "h4", "h5", "h6"))
_HEADLINES = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_HEADERS = frozenset(("header", "masthead", "banner"))
#: Parts that say what a name's other parts belong to, not what they are.
_HOLDERS = frozenset("""list lists box block section area container wrapper wrap inner outer item items bar panel links
    content body group row widget widgets""".split())
_QUALIFIED = frozenset("has have no not non with without is long short free".split())
#: Elements that an opening tag closes, up to the nearest of the given containers.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
           "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
           "option": ({"option"}, {"select"})}


def host(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(found == "", url).otherwise(found)


class Element:
    __slots__ = ("tag", "path", "depth", "cue", "named", "main", "children", "inside", "dropped", "cued")

    def __init__(self, tag: str, path: int, cue: bool, named: bool, main: bool, parent: Element | None):
        self.tag, self.path, self.cue, self.named, self.main = tag, path, cue, named, main
        self.depth = parent.depth + 1 if parent else 0
        self.inside = main or parent is not None and parent.inside
        # by tags, roles and names; by tags and roles only
        self.dropped = cue or named or parent is not None and parent.dropped
        self.cued = cue or parent is not None and parent.cued
        self.children: list[str] = []


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _says(name: str, headers: bool) -> bool:
    """A class or id name says that its branch is no text; `headers`: header names count too."""
    parts = [p for p in _NAME.findall(name) if not p.isdigit()]
    if not _QUALIFIED.isdisjoint(parts):
        return False
    while len(parts) > 1 and parts[-1] in _HOLDERS:
        parts.pop()
    return bool(parts) and parts[-1] in _CUES and (headers or parts[-1] not in _HEADERS)


def parse(page: str) -> tuple[list[Element], list[tuple[Element, list[Element], str]]]:
    """All elements, and the text blocks in page order, each with its block element and that one's ancestors."""
    root = Element("", 0, False, False, False, None)
    elements, stack, blocks = [root], [root], []
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", "".join(buffer)).strip()
            buffer.clear()
            if text:
                line = [e for e in stack if e.tag in _BLOCK or e.tag == ""]
                blocks.append((line[-1], list(stack), text))

    def text(raw: str) -> None:
        if raw:
            buffer.append(html_module.unescape(raw) if "&" in raw else raw)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if tag in _BLOCK:
                flush()
            open_at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            # an inline end tag doesn't close the block around it
            if open_at and (tag in _BLOCK or not any(e.tag in _BLOCK for e in stack[open_at + 1:])):
                del stack[open_at:]
            continue
        if tag in _BLOCK:
            flush()
            if tag != "br" and stack[-1].tag != "":
                p = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in _BLOCK), 0)
                if p and stack[p].tag == "p":
                    del stack[p:]
            if tag in _CLOSES:
                ends, within = _CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in within:
                        break
                    if stack[i].tag in ends:
                        del stack[i:]
                        break
        parent = stack[-1]
        parent.children.append(tag)
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            continue
        names: list[str] = []
        classes: list[str] = []
        cue, main = tag in _NOT_TEXT, tag in _MAIN
        if attributes and "=" in attributes:
            for a in _ATTRIBUTE.finditer(attributes):
                value = (a[2] or a[3] or a[4] or "").lower()
                if a[1].lower() == "role":
                    cue, main = cue or value in _ROLES, main or value == "main"
                else:
                    names += [value]
                    classes += _DIGITS.sub("", value).split() if a[1].lower() == "class" else []
        # a header within an article holds its headline
        if tag == "header" and parent.inside:
            cue = False
        named = not main and tag not in _WHOLE and any(
            _says(name, not parent.inside) for value in names for name in value.split())
        path = _key(f"{parent.path}>{tag}.{' '.join(sorted(classes))}")
        e = Element(tag, path, cue, named, main, parent)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        elements.append(e)
        stack.append(e)
    flush()
    return elements, blocks


def extract(page: str, low: frozenset[int] = frozenset()) -> str:
    """Main text of a page; `low` holds the paths of its host's branches of low importance.  Only block elements have
    contents of their own, so an inline element left open makes no branch low."""
    if not page:
        return ""
    elements, blocks = parse(page)
    has_main = any(e.main and not e.cued for e in elements)
    # names around every article don't say that there is no text
    around = any(e.main and not e.dropped for e in elements)
    out, weak = [], []
    for _, line, text in blocks:
        if any(e.cue or e.named and (e.inside or around or not has_main) for e in line):
            continue
        if not has_main:
            if not any(e.path in low for e in line if e.tag in _BLOCK):
                out.append(text)
        elif line[-1].inside:
            out.append(text)
            weak.append(any(e.inside and e.path in low for e in line if e.tag in _BLOCK) and not any(e.tag in _HEADLINES for e in line))
    # more than half of an article is the article, however many pages carry it
    if any(weak) and 2 * sum(len(t) for t, w in zip(out, weak, strict=True) if w) < sum(map(len, out)):
        out = [t for t, w in zip(out, weak, strict=True) if not w]
    return "\n".join(out)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, parent, depth, node, kind, value): kind 0 a presentation style, 1 a content; one row per page and node."""
    for b in batches:
        rows = []
        for where, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            elements, blocks = parse(page)
            styles: dict[int, str] = {}
            parents: dict[int, int] = {}
            depths = {e.path: e.depth for e in elements}
            contents: dict[int, list[str]] = {}
            for e in elements:
                styles[e.path] = styles.get(e.path, "") + "|" + " ".join(e.children)
            for e, line, text in blocks:
                contents.setdefault(e.path, []).append(text)
                for a, c in zip(line, line[1:], strict=False):
                    parents[c.path] = a.path
            for path, style in styles.items():
                rows.append((where, parents.get(path), depths[path], path, 0, _key(style)))
            for path, texts in contents.items():
                rows.append((where, parents.get(path), depths[path], path, 1, _key("\n".join(texts))))
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                         names=["host", "parent", "depth", "node", "kind", "value"])


def composites(tree: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of nodes with host, parent, depth, node, pages, styles, presentation, content;
    importances in billionths, which sum to the same in any order.

    A node of one page has presentation and content 1, and so have the nodes below it, which are on that page only:
    its composite is 1 by the greatest of its children.  Levels go as deep as nodes that pages share."""
    tree = written(tree, "site-tree")
    single = tree.where(F.col("pages") == 1).select("host", "parent", "node", "pages", F.lit(BILLION).cast("long").alias("importance"))
    # those below nodes of several pages; deeper ones are nobody's children but each other's
    edge = written(null_safe_join(
        single, tree.where(F.col("pages") > 1).select("host", F.col("node").alias("parent"), "depth"), ["host", "parent"]), "site-edge")
    tree = tree.where(F.col("pages") > 1)
    deepest = tree.agg(F.max("depth")).first()[0]
    own = F.coalesce("content", "presentation")
    n = F.coalesce("children", F.lit(0)) + F.col("content").isNotNull().cast("int")
    keep = F.pow(F.lit(DAMP), F.greatest("styles", F.lit(1)).cast("double"))
    mean = (F.coalesce("total", F.lit(0)) / BILLION + F.coalesce("content", F.lit(0.0))) / n
    mixed = F.greatest((1 - keep) * F.col("presentation") + keep * mean, F.col("most") / BILLION, "content")
    value = F.round(F.when(F.col("children").isNull(), own).otherwise(mixed) * BILLION).cast("long")
    columns = ["host", "parent", "node", "pages", "importance"]
    out, below = single, None
    for depth in range(deepest if deepest is not None else 0, -1, -1):
        level = tree.where(F.col("depth") == depth)
        children = edge.where(F.col("depth") == depth).select(*columns)
        children = children if below is None else children.union(below)
        inner = children.where(F.col("parent").isNotNull()).groupBy("host", F.col("parent").alias("node")).agg(
            F.count("*").alias("children"), F.sum("importance").alias("total"), F.max("importance").alias("most"))
        level = null_safe_join(level, inner, ["host", "node"], "left")
        below = written(level.select("host", "parent", "node", "pages", value.alias("importance")), "site-level")
        out = out.union(below)
    return out.select("host", "node", "pages", "importance")


def site_tree(pages: DataFrame) -> DataFrame:
    """(host, node, parent, depth, pages, styles, presentation, content) of the hosts' nodes."""
    ship_package(pages.sparkSession)
    nodes = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(
        _nodes, "host string, parent long, depth int, node long, kind int, value long")
    counts = nodes.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("f"), F.min("parent").alias("parent"), F.min("depth").alias("depth"))
    m = F.sum("f")
    per = counts.groupBy("host", "node", "kind").agg(
        m.alias("m"), F.count("*").alias("l"), F.min("parent").alias("parent"), F.min("depth").alias("depth"),
        F.sum(F.col("f") * F.log(F.col("f").cast("double"))).alias("flogf"))
    # over pages: sum of f/m * log f is the mean entropy of the contents, log m less that the styles' entropy
    log_m = F.log(F.col("m").cast("double"))
    mean = F.when(F.col("m") > 1, F.col("flogf") / F.col("m") / log_m).otherwise(0.0)
    per = per.withColumn("importance", 1 - mean)
    return per.groupBy("host", "node").agg(
        F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.max("m").alias("pages"),
        F.coalesce(F.max(F.when(F.col("kind") == 0, F.col("l"))), F.lit(1)).alias("styles"),
        F.coalesce(F.max(F.when(F.col("kind") == 0, F.col("importance"))), F.lit(1.0)).alias("presentation"),
        F.max(F.when(F.col("kind") == 1, F.col("importance"))).alias("content"))


def low_branches(pages: DataFrame) -> DataFrame:
    """(host, low): the paths of each host's branches of low importance."""
    low = composites(site_tree(pages)).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE * BILLION)
                                 & (F.col("node") != 0))
    return low.groupBy("host").agg(F.collect_list("node").alias("low"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: dict[str | None, frozenset[int]] = {}
        out = []
        for where, low, page in zip(b.column("host").to_pylist(), b.column("low"), b.column("html").to_pylist(), strict=True):
            if where not in seen:
                seen[where] = frozenset(low.as_py() or ())
            out.append(extract(page, seen[where]))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())],
                                         names=["page_id", "url", "text"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    low = written(low_branches(pages), "low-branches")
    d = pages.select("page_id", "url", host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    d = null_safe_join(d, low, ["host"], "left").mapInArrow(_texts, "page_id long, url string, text string")
    return d.withColumn("n_chars", F.length("text").cast("long"))
