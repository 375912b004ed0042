"""Prompt and message builders over retrieval hits.

A message is array<struct<type, text, url>>: 'text' parts carry text,
'image_url' parts carry an image reference.  Image parts hold the image
link; :func:`attach_image_payloads` swaps links for base64 data URLs by a
join with a ``binaryFile`` scan, so image bytes are read by executors.
Per-question lists are bounded by k hits, so collecting them per group is
safe at any corpus size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions._util import col

def _empty_strings() -> Column:
    return F.array().cast("array<string>")


def text_part(text) -> Column:
    return F.struct(F.lit("text").alias("type"), col(text).alias("text"), F.lit(None).cast("string").alias("url"))


def image_part(url) -> Column:
    return F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"),
                    col(url).alias("url"))


def _empty_parts() -> Column:
    return F.array().cast("array<struct<type:string,text:string,url:string>>")


def single_message(prompt, links, text=None) -> Column:
    """One user message: text part = prompt (+ text), then one image part per link."""
    p = col(prompt)
    t = p if text is None else F.concat(p, F.coalesce(col(text), F.lit("")))
    return F.concat(F.array(text_part(t)), F.transform(col(links), lambda u: image_part(u)))


def image_context_message(prompt, links) -> Column:
    """Experiment-2 message: the prompt, the lead text part of the context, then one image part per link."""
    return F.concat(F.array(text_part(col(prompt)), text_part(F.lit(TX.IMAGE_CONTEXT_LEAD))),
                    F.transform(col(links), lambda u: image_part(u)))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _ordered_hits(hits: DataFrame, key: str, rank: str, fields: list[str]) -> DataFrame:
    return hits.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col(rank).alias("_rank"), *[F.col(f) for f in fields]))).alias("_h"))


def joined_context(hits: DataFrame, prompt_image: str, key: str = "query_id", rank: str = "rank") -> DataFrame:
    """One prompt per query: contents of text/table hits joined by newlines
    (rank order) after the prompt, and the image hits' links as image parts."""
    g = _ordered_hits(hits, key, rank, ["type", "page_content", "img_link"])
    links = F.transform(F.filter("_h", lambda x: x["type"] == "image"), lambda x: x["img_link"])
    texts = F.transform(F.filter("_h", lambda x: x["type"].isin("text", "table")), lambda x: x["page_content"])
    joined = F.array_join(texts, "\n")
    return g.select(key, links.alias("img_links"), joined.alias("text_joined"),
                    single_message(F.lit(prompt_image), links, joined).alias("message"))


def per_hit_prompts(hits: DataFrame, prompt_image: str, prompt_text: str) -> DataFrame:
    """One message per hit: images get the image prompt and their link,
    text/table hits the text prompt followed by their content, any other
    type (e.g. pdf_page) the text prompt alone."""
    t = F.col("type")
    msg = (F.when(t == "image", single_message(F.lit(prompt_image), F.array(F.col("img_link"))))
           .when(t.isin("text", "table"), single_message(F.lit(prompt_text), _empty_strings(), F.col("page_content")))
           .otherwise(single_message(F.lit(prompt_text), _empty_strings(), F.lit(""))))
    return hits.withColumn("message", msg)


def message_parts(questions: DataFrame, contexts: DataFrame, key: str = "Question_nr",
                  rank: str = "rank", instruction: str = "instruction") -> DataFrame:
    """Experiment-1 message: the instruction, then per context entry in rank
    order an image part (image entries with a link) and a '[ref] text' part
    (non-blank text).  References: every image's, then each text's if new."""
    g = _ordered_hits(contexts, key, rank, ["ctx_type", "ctx_text", "image_path", "reference"])

    def is_img(e):
        return (e["ctx_type"] == "image") & e["image_path"].isNotNull() & (e["image_path"] != "")

    def has_text(e):
        return e["ctx_text"].isNotNull() & (_strip(e["ctx_text"]) != "")

    def ref(e):
        return F.coalesce(e["reference"], F.lit("context"))

    per_entry = F.transform("_h", lambda e: F.concat(
        F.when(is_img(e), F.array(image_part(e["image_path"]))).otherwise(_empty_parts()),
        F.when(has_text(e), F.array(text_part(F.concat(F.lit("["), ref(e), F.lit("] "), _strip(e["ctx_text"])))))
         .otherwise(_empty_parts())))

    def step(acc, e):
        with_img = F.when(is_img(e), F.concat(acc, F.array(ref(e)))).otherwise(acc)
        return F.when(has_text(e) & ~F.array_contains(with_img, ref(e)),
                      F.concat(with_img, F.array(ref(e)))).otherwise(with_img)

    refs = F.aggregate("_h", _empty_strings(), step)
    ctx = g.select(key, F.flatten(per_entry).alias("_ctx_parts"), refs.alias("context_refs"))
    out = questions.join(ctx, key, "left")
    parts = F.concat(F.array(text_part(F.col(instruction))), F.coalesce(F.col("_ctx_parts"), _empty_parts()))
    return out.select("*", parts.alias("message"),
                      F.coalesce(F.col("context_refs"), _empty_strings()).alias("_refs")).drop(
        "_ctx_parts", "context_refs").withColumnRenamed("_refs", "context_refs")


def two_stage_prompt(questions: DataFrame, summaries: DataFrame, key: str = "Question_nr",
                     order: str = "rank", text: str = "summary", question: str = "question") -> DataFrame:
    """Final prompt: question + 'Here is context information:' + the
    per-hit summaries joined by newlines in order."""
    g = summaries.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
        .alias("_s"))
    joined = F.array_join(F.transform("_s", lambda x: x["t"]), "\n")
    out = questions.join(g.select(key, joined.alias("context_text")), key, "inner")
    return out.withColumn("message", single_message(F.concat(F.col(question), F.lit(TX.CONTEXT_LEAD)), _empty_strings(),
                                                    F.col("context_text")))


def no_context(questions: DataFrame, context: DataFrame, key: str = "Question_nr") -> DataFrame:
    """Questions with their context list; none (mode without retrieval or no
    hits) -> empty list '[]'."""
    out = questions.join(context.select(key, "labels", "Context_papers"), key, "left")
    return (out.withColumn("labels", F.coalesce(F.col("labels"), _empty_strings()))
            .withColumn("Context_papers", F.coalesce(F.col("Context_papers"), F.lit("[]"))))


def attach_image_payloads(messages: DataFrame, images: DataFrame, keys: list[str], msg_col: str = "message",
                          path_col: str = "path", content_col: str = "content",
                          mime: str = TX.EXP2_IMAGE_TYPE, keep_missing: bool = True) -> DataFrame:
    """Replace image links in messages by base64 data URLs of the files, of
    the MIME type `mime`.  Links without a file stay, or with
    keep_missing=False their image parts go (experiment 1 leaves out images
    that can't be read).

    `images` is a ``binaryFile`` scan (path, content); `keys` identify a
    message row.  The parts are exploded and joined to the image table on
    path (a shuffle join: image tables are not size-bounded), then
    re-assembled per message in part order."""
    ex = messages.select(*keys, F.posexplode(msg_col).alias("_pos", "_part"))
    img = images.select(F.col(path_col).alias("_url"), TX.image_data_url(content_col, mime).alias("_data"))
    ex = ex.join(img, ex["_part.url"] == img["_url"], "left")
    if not keep_missing:
        ex = ex.where((F.col("_part.type") != "image_url") | F.col("_data").isNotNull())
    part = F.struct(F.col("_part.type").alias("type"), F.col("_part.text").alias("text"),
                    F.coalesce(F.col("_data"), F.col("_part.url")).alias("url"))
    back = ex.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_pos", part.alias("p")))).alias("_ps"))
    back = back.select(*keys, F.transform("_ps", lambda x: x["p"]).alias("_msg"))
    return messages.drop(msg_col).join(back, keys, "left").withColumnRenamed("_msg", msg_col)
