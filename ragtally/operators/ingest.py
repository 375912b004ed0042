"""Ingestion: HTML pages -> typed elements -> chunks, tables, images,
numbered asset links, corpus variants, per-model description overlays and
lexical vectors.

Per-document running sums and numbering use a two-level prefix: totals per
block of `block` positions, an exclusive prefix over the (few) blocks of a
document, and a window inside each block.  No task ever holds more than one
block of a document, so a single document holding a third of all rows is
spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._util import col
from ..session import scratch_path, ship_package
from .ordering import BLOCK, sequence_number
from .packing import pack_lines
from .tables import read_tables


# Tags that begin or end a block, the kinds of those that hold
# an element of their own (text in any other block is "text"), and the parts
# of a page that hold no text.  All other tags are inline.
KIND = {"title": "title", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading",
        "h6": "heading", "p": "text", "li": "list_item", "td": "table_cell", "th": "table_cell"}
BLOCK_TAGS = (*KIND, "html", "head", "body", "div", "section", "article", "main", "header", "footer", "nav", "aside",
              "ul", "ol", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "blockquote", "pre",
              "figure", "figcaption", "address", "form", "fieldset", "hr")
BLOCK_PATTERN = r"(?i)<(/?(?:" + "|".join(BLOCK_TAGS) + r"))(?:\s[^>]*)?/?>"
DROP_PATTERN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<!doctype[^>]*>"
# Named HTML entities decoded in element text (&amp; last).
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
NUMERIC_ENTITY = r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"


# --------------------------------------------------------------------------
# Elements

def _numeric(part: Column) -> Column:
    """'8364;rest' or 'x20AC;rest' -> the character and the rest; anything else gets its '&#' back."""
    digits = F.regexp_extract(part, NUMERIC_ENTITY, 1)
    code = F.when(F.lower(F.substring(digits, 1, 1)) == "x", F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(
        digits).cast("bigint")
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(digits == "", F.concat(F.lit("&#"), part)).otherwise(
        F.concat(char, F.regexp_replace(part, NUMERIC_ENTITY, "")))


def _decode(c: Column) -> Column:
    parts = F.split(c, "&#")
    c = F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), _numeric), ""))
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def extract_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """HTML -> (id, pos, tag, kind, text) in reading order: the text between
    two block tags is one element, of the block that the tag before it opens
    (after an end tag: tag 'text').  Scripts, styles and comments are removed
    first; a line break is a space, all other tags are inline and stripped; entities (named and
    numeric) are decoded, whitespace collapsed, empty elements dropped."""
    clean = F.regexp_replace(F.col(html_col), DROP_PATTERN, "")
    marked = F.split(F.regexp_replace(clean, BLOCK_PATTERN, "\u0001$1\u0002"), "\u0001")
    kind = F.create_map(*[x for k, v in KIND.items() for x in (F.lit(k), F.lit(v))])

    def element(part: Column, pos: Column) -> Column:
        has_tag = F.instr(part, "\u0002") > 0
        opened = F.lower(F.substring_index(part, "\u0002", 1))
        tag = F.when(has_tag & ~opened.startswith("/"), opened).otherwise("text")
        inner = F.substring_index(part, "\u0002", -1)  # the part itself without a mark
        text = F.regexp_replace(F.regexp_replace(inner, r"(?i)<br\b[^>]*>", " "), r"<[^>]*>", "")
        text = F.when(F.instr(part, "&") > 0, _decode(text)).otherwise(text)
        return F.struct(pos.alias("pos"), tag.alias("tag"), F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))

    # the texts are computed in the array, once; a filter on rows would be pushed below and compute them again
    found = F.filter(F.transform(marked, element), lambda e: e["text"] != "")
    ex = pages.select(id_col, F.explode(found).alias("e")).select(id_col, "e.pos", "e.tag", "e.text")
    return ex.select(id_col, "pos", "tag", F.coalesce(F.try_element_at(kind, F.col("tag")), F.lit("text")).alias("kind"), "text")


def chunk_text(elements: DataFrame, budget: int = 512, doc: str = "doc_id", pos: str = "pos",
               line: str = "line", page: str = "page_no", block: int = BLOCK) -> DataFrame:
    """Pack consecutive lines into chunks of at most `budget` tokens, tokens =
    whitespace-separated words.

    Rule: a chunk takes whole lines while they fit; the line that doesn't fit
    opens the next chunk.  Only a line above the budget is split, into pieces
    of `budget` words and a rest, packed like lines, their words joined by
    single spaces; other lines keep their text.  Chunk = its lines joined by
    newlines in order, first page, line refs.  See :mod:`.packing`.
    """
    if "type" not in elements.columns:  # untyped lines are text
        elements = elements.withColumn("type", F.lit("text"))
    n = F.size(F.filter(F.split(F.coalesce(F.col(line), F.lit("")), r"\s+"), lambda w: w != ""))
    g = pack_lines(elements, n, budget, doc, pos, line, page, "type", block)
    return g.select(doc, "chunk", "n_lines", "n_tokens", "first_page", "ref", "text",
                    ((F.col("n_lines") == 1) & (F.col("type") == "table")).alias("lone_table"))


def table_elements(elements: DataFrame, doc: str = "doc_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """Table elements: content = caption + ' ' + markdown, or the markdown alone
    without a caption.  Caption = the text line right before the table
    (an equi-join on (doc, pos - 1), no window over the document)."""
    tables = elements.where(F.col("type") == "table")
    prev = elements.where(F.col("type") == "text").select(
        F.col(doc), (F.col(pos) + 1).alias(pos), F.col(line).alias("caption"))
    t = tables.join(prev, [doc, pos], "left").withColumn("caption", F.coalesce("caption", F.lit("")))
    content = F.when(F.col("caption") != "", F.concat_ws(" ", "caption", line)).otherwise(F.col(line))
    return t.withColumn("page_content", content)


def image_elements(images: DataFrame, caption: str = "caption", descriptions: str = "descriptions") -> DataFrame:
    """Image elements: caption immediately followed by the descriptions joined
    by spaces (no separator after the caption)."""
    return images.withColumn("page_content", F.concat(F.coalesce(col(caption), F.lit("")),
                                                      F.array_join(col(descriptions), " ")))


def number_assets(elements: DataFrame, doc: str, stem: str, type_col: str = "type", pos: str = "pos",
                  root: str = "") -> DataFrame:
    """Running number per (document, type) in reading order and the asset link
    '{root}{stem}_{kind}_{n:03d}.png' (kind 'table' or 'img'); 3 digits are a
    minimum width, larger numbers keep all digits."""
    n = sequence_number(elements, [doc, type_col], pos, "asset_no")
    kind = F.when(F.col(type_col) == "image", "img").otherwise(F.col(type_col))
    link = F.concat(F.lit(root), F.col(stem), F.lit("_"), kind, F.lit("_"), F.format_string("%03d", F.col("asset_no")),
                    F.lit(".png"))
    return n.withColumn("img_link", link)


def page_image_links(pages: DataFrame, stem: str, page_no: str, root: str = "") -> DataFrame:
    """Page image link '{root}{stem}_{page:03d}.png'."""
    return pages.withColumn("img_link", F.concat(F.lit(root), F.col(stem), F.lit("_"),
                                                 F.format_string("%03d", F.col(page_no)), F.lit(".png")))


def corpus_variants(chunks: DataFrame, tables: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """'multimodal' = chunks without lone-table chunks + table elements (+ image
    elements); 'text_only' = all chunks.  Column `variant` tells them apart.
    Chunks are read once: each chunk row is exploded into its variants."""
    cols = ["doc_id", "element_id", "type", "page_content"]
    variants = F.when(F.col("lone_table"), F.array(F.lit("text_only"))).otherwise(
        F.array(F.lit("multimodal"), F.lit("text_only")))
    ch = chunks.select("doc_id", F.concat(F.lit("chunk-"), F.col("chunk").cast("string")).alias("element_id"),
                       F.lit("text").alias("type"), F.col("text").alias("page_content"),
                       F.explode(variants).alias("variant"))
    tb = tables.select("doc_id", F.concat(F.lit("table-"), F.col("pos").cast("string")).alias("element_id"),
                       F.lit("table").alias("type"), "page_content", F.lit("multimodal").alias("variant"))
    out = ch.unionByName(tb)
    if images is not None:
        out = out.unionByName(images.select(*cols).withColumn("variant", F.lit("multimodal")))
    return out


def element_counts(elements: DataFrame, doc: str = "doc_id", types: Sequence[str] = ("text", "table", "image"),
                   type_col: str = "type") -> DataFrame:
    """Elements per document and type (fixed type list) plus the total."""
    p = elements.groupBy(doc).pivot(type_col, list(types)).count()
    out = [F.coalesce(F.col(t), F.lit(0)).cast("bigint").alias(t) for t in types]
    return p.select(doc, *out).withColumn("total", sum((F.col(t) for t in types), F.lit(0)).cast("bigint"))


def needs_ocr(elements: DataFrame, doc: str = "doc_id", page: str = "page_no", type_col: str = "type") -> DataFrame:
    """Documents whose first page has no text element."""
    has_text = F.count_if((F.col(page) == 1) & (F.col(type_col) == "text"))
    return elements.groupBy(doc).agg((has_text == 0).alias("needs_ocr"))


def overlay_descriptions(corpus: DataFrame, descriptions: DataFrame, models: Sequence[str],
                         id_col: str = "point_id") -> DataFrame:
    """One corpus copy per model: image content replaced by that model's
    description (kept when the model gave none); other types unchanged.

    The model list is a parameter expanded with explode (no join); the
    descriptions join on (element, model)."""
    c = corpus.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    d = descriptions.select(id_col, "model", F.col("description"))
    j = c.join(d, [id_col, "model"], "left")
    return j.withColumn("page_content", F.when(F.col("type") == "image",
                                               F.coalesce("description", "page_content"))
                        .otherwise(F.col("page_content"))).drop("description")


#: Characters of text (and numbers of their vectors) that a task of :func:`vectorise_text` is dealt.
PART_CHARS = 8_000_000


def vectorise_text(docs: DataFrame, text_col: str = "text", dim: int = 768, out: str = "embedding",
                   id_col: str = "doc_id") -> DataFrame:
    """Lexical stand-in for the neural encoder: lower-cased word characters
    runs -> md5 buckets -> term counts x inverse document frequency
    ln((N + 1) / (df + 1)) -> unit length -> array<double> (zeros for a text
    without tokens).  Texts are dealt by document once; words are counted per
    document before they are hashed, and buckets summed, without another
    shuffle.  The sparse counts are written once and read for the frequencies
    and for the vectors, whose entries are laid out in bucket order with the
    zeros between them.  Documents are dealt to as many tasks as their length
    asks for, so a task's words and vectors do not grow with the table."""
    ids, chars = docs.agg(F.count_distinct(F.struct(id_col)), F.sum(F.length(text_col))).first()
    parts_n = max(1, -(-((chars or 0) + ids * dim) // PART_CHARS))
    tokens = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^0-9A-Za-z_]+"), lambda w: w != "")
    bucket = (F.conv(F.substring(F.md5("_w"), 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    counts = (docs.select(id_col, text_col).repartition(parts_n, id_col).select(id_col, F.explode(tokens).alias("_w"))
              .groupBy(id_col, "_w").agg(F.count(F.lit(1)).alias("_n"))
              .select(id_col, bucket.alias("_b"), "_n").groupBy(id_col, "_b").agg(F.sum("_n").alias("_tf")))
    path = scratch_path(docs.sparkSession, "term-counts")
    counts.write.parquet(path)
    counts = docs.sparkSession.read.parquet(path)
    idf = counts.groupBy("_b").agg(F.log((F.lit(ids) + 1.0) / (F.count(F.lit(1)) + 1.0)).alias("_idf"))
    parts = counts.join(idf, "_b").repartition(parts_n, id_col).groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("_b", (F.col("_tf") * F.col("_idf")).alias("w")))).alias("_p"))
    norm = F.sqrt(F.aggregate("_p", F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    gap = lambda x, i: x["_b"] - F.coalesce(F.get("_p", i - 1)["_b"], F.lit(-1)) - 1
    entry = lambda x: F.when(F.col("_norm") > 0, x["w"] / F.col("_norm")).otherwise(0.0)
    laid = F.flatten(F.transform("_p", lambda x, i: F.concat(zeros(gap(x, i)), F.array(entry(x)))))
    unit = parts.withColumn("_norm", norm).select(
        id_col, F.concat(laid, zeros(dim - 1 - F.element_at("_p", -1)["_b"])).alias(out))
    return docs.join(unit, id_col, "left").withColumn(out, F.coalesce(F.col(out), zeros(dim)))


# Fixed value: pattern of image markup.
IMG_PATTERN = r"(?is)<img\b[^>]*>"


def _cell_text(c: Column) -> Column:
    """Entities decoded, whitespace collapsed, trimmed."""
    return F.trim(F.regexp_replace(_decode(c), r"\s+", " "))


def extract_tables(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", header_rule: bool = False) -> DataFrame:
    """HTML tables -> (id, table_no, caption, markdown, page_content, n_rows, n_cols, n_header): rows as '| a | b |'
    lines; content = caption + ' ' + markdown, or the markdown alone without a caption (the table-element rule).

    Tables are read as cell grids (:mod:`.tables`): spans fill the places they cover, nested tables come on their own,
    numbered by where they begin.  n_header: rows at the top in a thead or of header cells only; `header_rule` puts
    the markdown rule below them.  Pages without a table (or null) give no rows and stay out of the Python pass."""
    ship_package(pages.sparkSession)
    clean = F.regexp_replace(F.col(html_col), DROP_PATTERN, "")
    some = pages.where(F.col(html_col).rlike("(?i)<table")).select(id_col, clean.alias(html_col))
    kind = some.schema[id_col].dataType.simpleString()
    t = some.mapInArrow(read_tables(id_col, html_col),
                        f"`{id_col}` {kind}, table_no int, caption string, grid array<array<string>>, n_header int")
    lines = F.transform("grid", lambda r: F.concat(
        F.lit("| "), F.array_join(F.transform(r, _cell_text), " | "), F.lit(" |")))
    n_cols = F.coalesce(F.size(F.get("grid", F.lit(0))), F.lit(0))
    if header_rule:
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n_cols), " | "), F.lit(" |"))
        lines = F.when(F.col("n_header") > 0, F.array_insert(lines, F.col("n_header") + 1, rule)).otherwise(lines)
    out = t.select(id_col, "table_no", _cell_text(F.col("caption")).alias("caption"), F.array_join(lines, "\n").alias("markdown"),
                   F.size("grid").alias("n_rows"), n_cols.alias("n_cols"), "n_header")
    content = F.when(F.col("caption") != "", F.concat_ws(" ", "caption", "markdown")).otherwise(F.col("markdown"))
    return out.select(id_col, "table_no", "caption", "markdown", content.alias("page_content"), "n_rows", "n_cols", "n_header")


def extract_images(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """HTML images -> (id, image_no, img_link, caption): link from src, caption
    from the alt text; feed to image_elements with model descriptions."""
    clean = F.regexp_replace(F.col(html_col), DROP_PATTERN, "")
    i = pages.select(id_col, F.posexplode(F.regexp_extract_all(clean, F.lit(IMG_PATTERN), 0)).alias("image_no", "tag"))
    return i.select(id_col, "image_no",
                    F.regexp_extract("tag", r"""(?i)src\s*=\s*["']([^"']*)["']""", 1).alias("img_link"),
                    _decode(F.regexp_extract("tag", r"""(?i)alt\s*=\s*["']([^"']*)["']""", 1)).alias("caption"))
