"""Text Column expressions: reference labels, prompt templates, truncation,
image payloads and literal-newline cleanup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import col

LETTERS = ("A", "B", "C", "D")

# Prompt texts of the two experiments.
EXP1_INSTRUCTION_HEAD = ("You are an expert biomedical researcher. Carefully read the question and the "
                         "answer choices.\n")
EXP1_INSTRUCTION_TAIL = ("If contextual snippets are provided, use them judiciously. "
                         "Respond with a single capital letter (A, B, C, or D).")
EXP2_PROMPT_HEAD = ("You are an experienced senior researcher tasked with providing in-depth analysis.\n"
                    "Use all the information at your disposal, such as uploaded files and other sources. "
                    "Think about the following statement or question: ")
EXP2_PROMPT_MID = ("\nBelow are the possible answers, where letters mark each answer. "
                   "First, exclude the unlikely answer or answers, rethink, and select an output from the rest. "
                   "The output is only ONE letter from the list ['A', 'B', 'C', 'D']. "
                   "Check that you return only one letter; if two letters, choose one. No explanations. "
                   "The answers are:\n")
EXP2_RETRIEVAL_MID = " The answers are: "
CONTEXT_LEAD = "Here is context information:"
IMAGE_CONTEXT_LEAD = "Context information:"
# MIME types of image parts: experiment 1 sends PNG, experiment 2 and descriptions JPEG.
EXP1_IMAGE_TYPE, EXP2_IMAGE_TYPE = "image/png", "image/jpeg"


def reference_label(document_name="document_name", file_name=None, page_no="page_no", page_id=None) -> Column:
    """'{doc}_pg_{page}': doc = document name, else file name, else 'doc';
    page = page_no unless 0/missing, else page_id; no page -> doc alone."""
    names = [F.nullif(col(document_name), F.lit(""))]
    if file_name is not None:
        names.append(F.nullif(col(file_name), F.lit("")))
    doc = F.coalesce(*names, F.lit("doc"))
    pn = col(page_no)
    page = F.when(pn.isNotNull() & (pn != 0), pn.cast("string"))
    if page_id is not None:
        page = page.otherwise(col(page_id).cast("string"))
    return F.when(page.isNull(), doc).otherwise(F.concat(doc, F.lit("_pg_"), page))


def page_label(file_name, page_id) -> Column:
    """Experiment-2 page label: file name up to its first '.', '_pg_', page id."""
    return F.concat(F.substring_index(col(file_name), ".", 1), F.lit("_pg_"), col(page_id).cast("string"))


def choice_string(options: Sequence, sep: str = "\n") -> Column:
    """'A. x{sep}B. y{sep}...' over the four options."""
    return F.concat_ws(sep, *[F.concat(F.lit(f"{L}. "), col(o)) for L, o in zip(LETTERS, options)])


def instruction_block(question, options: Sequence) -> Column:
    """Experiment-1 instruction text with the (possibly permuted) options."""
    return F.concat(F.lit(EXP1_INSTRUCTION_HEAD), F.lit("Question: "), col(question), F.lit("\nChoices:\n"),
                    choice_string(options, "\n"), F.lit("\n"), F.lit(EXP1_INSTRUCTION_TAIL))


def exp2_prompts(question, options: Sequence) -> tuple[Column, Column]:
    """(retrieval prompt, model prompt) of experiment 2; options joined
    with no separator."""
    qs = choice_string(options, "")
    retrieval = F.concat(col(question), F.lit(EXP2_RETRIEVAL_MID), qs)
    model = F.concat(F.lit(EXP2_PROMPT_HEAD), col(question), F.lit(EXP2_PROMPT_MID), qs)
    return retrieval, model


def truncate(text, n: int) -> Column:
    """First n characters."""
    return F.substring(col(text), 1, n)


def image_data_url(content, mime: str = EXP2_IMAGE_TYPE) -> Column:
    """Binary file content -> base64 data URL of the MIME type (no resizing).  Spark may chunk
    base64 into 76-character lines; the URL carries it unbroken."""
    b64 = F.regexp_replace(F.base64(col(content)), "[\r\n]", "")
    return F.concat(F.lit(f"data:{mime};base64,"), b64)


def clean_newlines(df: DataFrame) -> DataFrame:
    """Replace the two characters backslash-n by a newline in every string column."""
    return df.select(*[F.replace(F.col(f"`{f.name}`"), F.lit("\\n"), F.lit("\n")).alias(f.name)
                       if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`")
                       for f in df.schema.fields])
