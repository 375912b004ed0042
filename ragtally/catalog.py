"""Registered queries: one callable (spark, sf_dir) -> DataFrame per key.

Each query reads the test tables through a fixture view (schema shaping
only) and runs the library's operator on the whole table.  Outputs are flat
scalar columns: arrays are rendered as text and doubles rounded to 6 digits,
so the DuckDB oracle in :mod:`ragtally.oracle` can compare them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import answers as A
from .functions import metrics as M
from .functions import stats as S
from .functions import text as TX
from .operators import collections as CO
from .operators import ingest as IN
from .operators import ordering as OR
from .operators import prompts as PR
from .operators import ranktests as RK
from .operators import retrieval as RT
from .operators import scoring as SC
from .operators import summaries as SUM
from .plans import run_plan as RP
from .session import scratch_path
from .sources import fixtures as FX
from .sources import readers as RD
from .sources import sinks as SK
from .sources.tables import read_table
from .streaming import incremental as ST

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

TOP_K = 5
CI_KEYS = ["Model", "Model_ret", "Difficulty"]


def register(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def r6(c, name: str | None = None) -> Column:
    """Round to 6 decimals the same way in Spark and in the DuckDB oracle:
    first to nano-units (absorbs the summation-order noise of the engines),
    then half-to-even on integers.  Plain rounding of a double flips at exact
    decimal ties (short decimal costs, means over power-of-two counts)."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    nano = F.floor(F.abs(x) * 1e9 + 0.5)
    r = nano % 1000
    q = (nano - r) / 1000
    up = ((r > 500) | ((r == 500) & (q % 2 == 1))).cast("long")
    sign = F.when(x < 0, F.lit(-1)).otherwise(F.lit(1))
    out = F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).otherwise(
        (sign * (q.cast("long") + up)) / 1e6)
    return out.alias(name) if name else out


def round_doubles(df: DataFrame) -> DataFrame:
    """r6 on every double column (for the oracle comparison)."""
    return df.select(*[r6(F.col(f"`{f.name}`"), f.name)
                       if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


# ---------------------------------------------------------------- 2.9 metrics

@register
def q_parse_context_list(spark, sf):
    ev = FX.fx_eval(spark, sf)
    items = M.parse_context_list("Context_papers")
    return ev.select("event_id", F.when(items.isNotNull(), F.size(items)).alias("n_items"),
                     F.array_join(items, "|").alias("items"))


@register
def q_hit_at_k(spark, sf):
    ev = FX.fx_eval(spark, sf)
    return ev.select("event_id", M.hit_at_k("Paper_id", "Context_papers").alias("hit"))


@register
def q_precision_at_k(spark, sf):
    ev = FX.fx_eval(spark, sf)
    return ev.select("event_id", r6(M.precision_at_k("Paper_id", "Context_papers", TOP_K), "precision"))


@register
def q_throughput(spark, sf):
    ev = FX.fx_eval(spark, sf)
    return ev.select("event_id", r6(M.throughput("Total_tokens", "Elapsed"), "throughput"))


@register
def q_cost(spark, sf):
    ev = FX.fx_eval(spark, sf)
    return ev.select("event_id", "Model", r6(M.cost("Model", "Total_tokens", FX.PRICES), "cost"))


# ---------------------------------------------------------------- 2.5 aggregates

@register
def q_per_iteration(spark, sf):
    out = SUM.per_iteration(FX.fx_eval(spark, sf), CI_KEYS, FX.PRICES, TOP_K, FX.MODELS, FX.RETRIEVERS)
    return round_doubles(out)


@register
def q_ci_summary(spark, sf):
    return SUM.ci_summary(FX.fx_eval(spark, sf), CI_KEYS, FX.PRICES, TOP_K, FX.MODELS, FX.RETRIEVERS)


@register
def q_ci_summary_no_difficulty(spark, sf):
    return SUM.ci_summary(FX.fx_eval(spark, sf), ["Model", "Model_ret"], FX.PRICES, TOP_K,
                          FX.MODELS, FX.RETRIEVERS)


@register
def q_ci_summary_wide(spark, sf):
    s = SUM.ci_summary(FX.fx_eval(spark, sf), CI_KEYS, FX.PRICES, TOP_K, FX.MODELS, FX.RETRIEVERS)
    return SUM.ci_summary_wide(s, ["Model", "Model_ret"], "Difficulty", FX.DIFFICULTIES,
                               ["cor_answer", "precision"])


@register
def q_agresti_coull(spark, sf):
    g = FX.fx_eval(spark, sf).groupBy("Model", "Model_ret").agg(
        F.sum("Cor_answer").alias("n_correct"), F.count("Cor_answer").alias("n"))
    low, upp = S.agresti_coull("n_correct", "n")
    return g.select("Model", "Model_ret", "n_correct", "n", r6(low, "ci_low"), r6(upp, "ci_upp"))


@register
def q_t_interval(spark, sf):
    g = FX.fx_eval(spark, sf).groupBy("Model", "Model_ret", "Iteration").agg(
        F.avg("Elapsed").alias("mean"), F.stddev_samp("Elapsed").alias("sd"), F.count("Elapsed").alias("n"))
    low, upp = S.t_interval("mean", "sd", "n")
    return g.select("Model", "Model_ret", "Iteration", "n", r6("mean", "mean"), r6(low, "ci_low"),
                    r6(upp, "ci_upp"))


@register
def q_format_ci_cell(spark, sf):
    g = (FX.fx_eval(spark, sf).where(F.col("Difficulty").isNotNull())
         .groupBy("Model", "Model_ret", "Difficulty")
         .agg(F.avg("Elapsed").alias("mean"), F.stddev_samp("Elapsed").alias("sd"),
              F.count("Elapsed").alias("n")))
    low, upp = S.t_interval_sql("mean", "sd", "n")
    return g.select("Model", "Model_ret", "Difficulty", M.format_ci_cell("mean", low, upp, 2).alias("cell"))


# ---------------------------------------------------------------- 2.9 answers, 2.4 key join


def _perm_text(c) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@register
def q_permute_options(spark, sf):
    mcq = FX.fx_mcq(spark, sf).withColumn("quest_order", A.permutation("Question_nr", 42))
    shown = A.shown_options(["A", "B", "C", "D"], "quest_order")
    return mcq.select("Question_nr", _perm_text(F.col("quest_order")).alias("quest_order"),
                      *[shown.getItem(i).alias(f"shown_{L}") for i, L in enumerate("ABCD")],
                      A.shown_correct("Correct", "quest_order").alias("shown_correct"))


@register
def q_parse_answer(spark, sf):
    r = FX.fx_responses(spark, sf)
    return r.select("conv_id", "turn", A.parse_answer("raw_response").alias("filt_resp"))


def _stored_requests(spark, sf):
    """Responses with the option order of their request: written with the requests, read back to score."""
    path = scratch_path(spark, "request-orders")
    keys = FX.fx_responses(spark, sf).select("conv_id", "turn", "Question_nr")
    SC.request_orders(keys, run_col="conv_id").write.parquet(path)
    orders = spark.read.parquet(path).select("conv_id", "turn", "quest_order")
    return FX.fx_responses(spark, sf).join(orders, ["conv_id", "turn"])


@register
def q_unpermute_answer(spark, sf):
    r = SC.score_responses(_stored_requests(spark, sf))
    return r.select("conv_id", "turn", _perm_text(F.col("quest_order")).alias("quest_order"),
                    "filt_resp", "answer")


@register
def q_join_answer_key(spark, sf):
    r = SC.score_responses(_stored_requests(spark, sf))
    out = SC.join_answer_key(r, FX.fx_mcq(spark, sf))
    return out.select("conv_id", "turn", "Question_nr", "answer", "Correct", "Difficulty", "Cor_answer")


@register
def q_parse_run_name(spark, sf):
    p = SC.parse_run_files(FX.fx_run_files(spark, sf))
    return p.select("file_id", "model_short", "vd_name", "perm_label", "timestamp",
                    F.col("perm_suffix").cast("int").alias("perm_suffix"), F.col("valid").cast("int").alias("valid"))


@register
def q_iteration_number(spark, sf):
    p = SC.parse_run_files(FX.fx_run_files(spark, sf)).where("valid")
    pair = ["model_short", "vd_name", "perm_label"]
    it = SC.iteration_number(p, pair, "file_name")
    # the pair is parsed from the file name, so the name alone is the join key
    return p.join(it.select("file_name", "Iteration"), "file_name").select("file_id", "Iteration")


@register
def q_filter_categories(spark, sf):
    ev = SUM.filter_categories(FX.fx_eval(spark, sf), "Model_ret", FX.RETRIEVERS, "ret_ordinal")
    return ev.select("event_id", "Model_ret", F.col("ret_ordinal").cast("int").alias("ret_ordinal"))


@register
def q_sort_full_report(spark, sf):
    ev = SC.sort_full_report(FX.fx_eval(spark, sf), "Model", "Model_ret", FX.RETRIEVERS, "Iteration")
    ev = ev.select("event_id", "Model", "Model_ret", F.col("category_ordinal").cast("int").alias("category_ordinal"),
                   "Iteration", "Question_nr").withColumn("_last", F.coalesce("category_ordinal", F.lit(1 << 30)))
    return OR.sequence_by_sort(ev, [], ["Model", "_last", "Iteration", "Question_nr", "event_id"], "row_number").drop("_last")


@register
def q_union_runs(spark, sf):
    ev = FX.fx_eval(spark, sf)
    a = ev.where("Iteration % 2 = 1").select("event_id", "Model", "Model_ret", "Question_nr", "Cor_answer",
                                             "Elapsed", "Total_tokens")
    b = ev.where("Iteration % 2 = 0").select("event_id", "Model", "Model_ret", "Question_nr", "Cor_answer",
                                             "Difficulty")
    return round_doubles(SC.union_runs([a, b]))


# ---------------------------------------------------------------- 2.5 report aggregates

def _eval_in_categories(spark, sf):
    ev = FX.fx_eval(spark, sf)
    ev = SUM.filter_categories(ev, "Model", FX.MODELS)
    return SUM.filter_categories(ev, "Model_ret", FX.RETRIEVERS)


@register
def q_run_accuracy(spark, sf):
    out = SUM.run_accuracy(FX.fx_eval(spark, sf), ["Model", "Model_ret", "Iteration"])
    return round_doubles(out)


@register
def q_accuracy_pivot(spark, sf):
    out = SUM.accuracy_pivot(_eval_in_categories(spark, sf), ["Model", "Model_ret"])
    return round_doubles(out)


@register
def q_majority_vote(spark, sf):
    out = SUM.majority_vote(_eval_in_categories(spark, sf), ["Model", "Model_ret"], ["Question_nr", "Difficulty"])
    return round_doubles(out)


def _eval_with_hit(spark, sf):
    return _eval_in_categories(spark, sf).withColumn("hit", M.hit_at_k("Paper_id", "Context_papers"))


@register
def q_sd_summary(spark, sf):
    ev = SUM.filter_categories(_eval_with_hit(spark, sf), "Difficulty", FX.DIFFICULTIES)
    return SUM.sd_summary(ev, ["Model", "Model_ret", "Difficulty"])


def _sd_wide(spark, sf):
    ev = SUM.filter_categories(_eval_with_hit(spark, sf), "Difficulty", FX.DIFFICULTIES)
    s = SUM.sd_summary(ev, ["Model", "Model_ret", "Difficulty"])
    return SUM.ci_summary_wide(s, ["Model", "Model_ret"], "Difficulty", FX.DIFFICULTIES, ["Cor_answer", "hit"])


@register
def q_sd_summary_wide(spark, sf):
    return _sd_wide(spark, sf)


def _sd_overall(spark, sf):
    s = SUM.sd_summary(_eval_with_hit(spark, sf), ["Model", "Model_ret"])
    return s.select("Model", "Model_ret", F.col("Cor_answer").alias("Cor_answer_summary"),
                    F.col("hit").alias("hit_summary"))


@register
def q_sd_overall(spark, sf):
    return _sd_overall(spark, sf)


@register
def q_join_summaries(spark, sf):
    return _sd_wide(spark, sf).join(_sd_overall(spark, sf), ["Model", "Model_ret"], "inner")


@register
def q_summary_grouping_sets(spark, sf):
    ev = _eval_with_hit(spark, sf)
    ev = ev.where(F.col("Difficulty").isNull() | F.col("Difficulty").isin(*FX.DIFFICULTIES))
    return SUM.summary_grouping_sets(ev, ["Model", "Model_ret"], "Difficulty")


TWO_STEP_VARS = {"Cor_answer": "proportion", "Elapsed": "mean", "Latency": "mean", "Price": "mean",
                 "is_paper_id_in_context": "mean"}


def _eval_two_step(spark, sf):
    ev = FX.fx_eval(spark, sf)
    return (ev.withColumn("Latency", M.throughput("Total_tokens", "Elapsed"))
              .withColumn("Price", M.cost("Model", "Total_tokens", FX.PRICES))
              .withColumn("is_paper_id_in_context", M.precision_at_k("Paper_id", "Context_papers", 10)))


@register
def q_two_step_summary(spark, sf):
    return SUM.two_step_summary(_eval_two_step(spark, sf), ["Model", "Model_ret"], TWO_STEP_VARS)


@register
def q_two_stage_analysis(spark, sf):
    return SUM.two_stage_analysis(_eval_two_step(spark, sf), ["Model", "Model_ret"], TWO_STEP_VARS)


# ---------------------------------------------------------------- 2.4 retrieval


K_HITS = 5
PROMPT_IMAGE = "Describe the figure."
PROMPT_TEXT = "Summarise the passage: "


def _emb_queries(spark, sf):
    """Encoded questions stand-in: each question (benchmark item) takes the
    embedding with its id as its vector, so the query set grows with the
    question table."""
    q = read_table(spark, sf, "benchmark", "item_id")
    e = read_table(spark, sf, "embeddings", "vec_id", "embedding")
    return q.join(e, q["item_id"] == e["vec_id"]).select(F.col("item_id").alias("query_id"), "embedding")


def _emb_points(spark, sf):
    return read_table(spark, sf, "embeddings", "vec_id", "embedding").withColumnRenamed("vec_id", "point_id")


def _hits_out(df):
    return df.select("query_id", "rank", "point_id", r6("score", "score"))


@register
def q_dense_topk(spark, sf):
    hits = RT.dense_topk(_emb_points(spark, sf), _emb_queries(spark, sf), K_HITS, metric="cosine")
    return _hits_out(hits)


@register
def q_dense_topk_arrow(spark, sf):
    hits = RT.dense_topk(_emb_points(spark, sf), _emb_queries(spark, sf), K_HITS, metric="cosine")
    return _hits_out(hits)


@register
def q_topk_per_query(spark, sf):
    hits = RT.dense_topk(_emb_points(spark, sf), _emb_queries(spark, sf), 10, metric="dot")
    return _hits_out(hits)


def _points_payload(spark, sf):
    """fx_points plus a text payload for text/table points."""
    return (FX.fx_points(spark, sf)
            .withColumn("page_content", F.when(F.col("type").isin("text", "table"),
                                               F.concat(F.lit("chunk "), F.col("vec_id").cast("string")))
                        .otherwise(F.lit("")))
            .withColumnRenamed("vec_id", "point_id"))


def _tenant_queries(spark, sf):
    """Questions with an owner: the point with the question's id gives vector and owner."""
    q = read_table(spark, sf, "benchmark", "item_id")
    p = FX.fx_points(spark, sf)
    return q.join(p, q["item_id"] == p["vec_id"]).select(F.col("item_id").alias("query_id"), "embedding", "username")


PAYLOAD = ["document_name", "page_no", "type", "img_link", "page_content"]


def _tenant_hits(spark, sf):
    return RT.dense_topk(_points_payload(spark, sf), _tenant_queries(spark, sf), K_HITS, metric="cosine",
                         on=["username"], carry=PAYLOAD)


@register
def q_dense_topk_tenant(spark, sf):
    h = _tenant_hits(spark, sf)
    return h.select("query_id", "rank", "point_id", r6("score", "score"), "username", "document_name")


def _patches_out(df):
    return df.select("query_id", "rank", "page_key", r6("score", "score"))


@register
def q_maxsim_topk(spark, sf):
    return _patches_out(RT.maxsim_topk(FX.fx_patches(spark, sf), FX.fx_qtokens(spark, sf), K_HITS))


@register
def q_maxsim_cosine_topk(spark, sf):
    # stand-in for unnormalised patch vectors: each patch scaled by (1 + patch_no)
    p = FX.fx_patches(spark, sf).withColumn(
        "embedding", F.transform("embedding", lambda x: x.cast("double") * (F.col("patch_no") + 1)))
    return _patches_out(RT.maxsim_topk(p, FX.fx_qtokens(spark, sf), K_HITS, normalize=True))


@register
def q_maxsim_topk_tenant(spark, sf):
    p = FX.fx_patches(spark, sf).withColumn("owner", F.concat(F.lit("user"), (F.col("page_key") % 5).cast("string")))
    t = FX.fx_qtokens(spark, sf).withColumn("owner", F.concat(F.lit("user"), (F.col("query_id") % 5).cast("string")))
    return _patches_out(RT.maxsim_topk(p, t, K_HITS, on=["owner"]))


@register
def q_rescore_topk(spark, sf):
    return _hits_out(RT.rescore_topk(_emb_points(spark, sf), _emb_queries(spark, sf), K_HITS))


def _page_hits(spark, sf):
    hits = RT.maxsim_topk(FX.fx_patches(spark, sf), FX.fx_qtokens(spark, sf), K_HITS)
    # page metadata stand-in: page_key -> file 'Paper{n}.pdf', page id = page_key
    return hits.withColumn("label", TX.page_label(
        F.concat(F.lit("Paper"), (F.col("page_key") % 25 + 1).cast("string"), F.lit(".pdf")), F.col("page_key")))


@register
def q_context_lists(spark, sf):
    c = RT.context_lists(_page_hits(spark, sf))
    return c.select("query_id", "Context_papers")


@register
def q_no_context(spark, sf):
    c = RT.context_lists(_page_hits(spark, sf)).withColumnRenamed("query_id", "Question_nr")
    out = PR.no_context(FX.fx_mcq(spark, sf), c)
    return out.select("Question_nr", F.size("labels").alias("n_context"), "Context_papers")


@register
def q_project_context(spark, sf):
    h = RT.project_context(_tenant_hits(spark, sf), TX.reference_label("document_name", None, "page_no"))
    return h.select("query_id", "rank", "ctx_type", "ctx_text", "image_path", "reference", r6("score", "score"))


def _render(message) -> Column:
    """Message parts as one text: 'type:text-or-url' joined by ' || '."""
    return F.array_join(F.transform(message, lambda p: F.concat(p["type"], F.lit(":"),
                                                                F.coalesce(p["text"], p["url"], F.lit("")))), " || ")


def _dense_payload_hits(spark, sf):
    return RT.dense_topk(_points_payload(spark, sf), _emb_queries(spark, sf), K_HITS, metric="cosine", carry=PAYLOAD)


@register
def q_joined_context(spark, sf):
    j = PR.joined_context(_dense_payload_hits(spark, sf), PROMPT_IMAGE)
    return j.select("query_id", F.array_join("img_links", "|").alias("img_links"), "text_joined",
                    _render(F.col("message")).alias("message"))


@register
def q_per_hit_prompts(spark, sf):
    h = PR.per_hit_prompts(_dense_payload_hits(spark, sf), PROMPT_IMAGE, PROMPT_TEXT)
    return h.select("query_id", "rank", "type", _render(F.col("message")).alias("message"))


@register
def q_single_message(spark, sf):
    g = _dense_payload_hits(spark, sf).groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "img_link", "type"))).alias("_h"))
    links = F.transform(F.filter("_h", lambda x: x["type"] == "image"), lambda x: x["img_link"])
    return g.select("query_id", _render(PR.single_message(F.lit(PROMPT_IMAGE), links)).alias("message"))


def _exp1_questions(spark, sf):
    mcq = FX.fx_mcq(spark, sf).withColumn("quest_order", A.permutation("Question_nr", 42))
    shown = A.shown_options(["A", "B", "C", "D"], "quest_order")
    mcq = mcq.select("*", *[shown.getItem(i).alias(f"s{L}") for i, L in enumerate("ABCD")])
    return mcq.withColumn("instruction", TX.instruction_block("question", ["sA", "sB", "sC", "sD"]))


@register
def q_message_parts(spark, sf):
    h = RT.project_context(_dense_payload_hits(spark, sf), TX.reference_label("document_name", None, "page_no"))
    ctx = h.withColumnRenamed("query_id", "Question_nr")
    m = PR.message_parts(_exp1_questions(spark, sf), ctx)
    return m.select("Question_nr", _render(F.col("message")).alias("message"),
                    F.array_join("context_refs", "|").alias("context_refs"))


def _page_messages(spark, sf):
    """Experiment-2 messages: each question with the images of its page hits."""
    g = _page_hits(spark, sf).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "page_key"))).alias("_h"))
    links = F.transform("_h", lambda x: F.concat(F.lit("/pages/"), x["page_key"].cast("string"), F.lit(".jpg")))
    m = FX.fx_mcq(spark, sf).join(g.select(F.col("query_id").alias("Question_nr"), links.alias("links")), "Question_nr")
    return m.select("Question_nr", PR.image_context_message("question", "links").alias("message"))


@register
def q_image_context_message(spark, sf):
    return _page_messages(spark, sf).select("Question_nr", _render(F.col("message")).alias("message"))


@register
def q_message_payloads(spark, sf):
    # stand-in for a binary scan of the page images: every second page has a file
    pages = FX.fx_patches(spark, sf).select("page_key").distinct().where("page_key % 2 = 0").select(
        F.concat(F.lit("/pages/"), F.col("page_key").cast("string"), F.lit(".jpg")).alias("path"),
        F.encode(F.concat(F.lit("image of page "), F.col("page_key").cast("string")), "UTF-8").alias("content"))
    m = PR.attach_image_payloads(_page_messages(spark, sf), pages, ["Question_nr"], mime=TX.EXP1_IMAGE_TYPE,
                                 keep_missing=False)
    return m.select("Question_nr", _render(F.col("message")).alias("message"))


@register
def q_two_stage_prompt(spark, sf):
    # stand-in for the model's summaries: one per (question, rank) of the real hits
    h = _dense_payload_hits(spark, sf).select(
        F.col("query_id").alias("Question_nr"), "rank",
        F.concat(F.lit("summary of "), F.col("document_name"), F.lit(" "), F.col("page_content")).alias("summary"))
    p = PR.two_stage_prompt(FX.fx_mcq(spark, sf), h, order="rank", text="summary")
    return p.select("Question_nr", _render(F.col("message")).alias("message"))


# ---------------------------------------------------------------- 2.9 text functions

@register
def q_choice_string(spark, sf):
    m = FX.fx_mcq(spark, sf)
    return m.select("Question_nr", TX.choice_string(["A", "B", "C", "D"], "\n").alias("choices_exp1"),
                    TX.choice_string(["A", "B", "C", "D"], "").alias("choices_exp2"))


@register
def q_instruction_block(spark, sf):
    return _exp1_questions(spark, sf).select("Question_nr", "instruction")


@register
def q_exp2_prompts(spark, sf):
    m = FX.fx_mcq(spark, sf)
    ret, model = TX.exp2_prompts("question", ["A", "B", "C", "D"])
    return m.select("Question_nr", ret.alias("retrieval_prompt"), model.alias("model_prompt"))


@register
def q_reference_label(spark, sf):
    p = FX.fx_points(spark, sf).select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, F.lit("")).otherwise(F.col("document_name")).alias("document_name"),
        F.when(F.col("vec_id") % 11 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("file"), F.col("vec_id").cast("string"), F.lit(".png"))).alias("file_name"),
        F.when(F.col("vec_id") % 5 == 0, F.lit(0)).otherwise(F.col("page_no")).alias("page_no"),
        F.when(F.col("vec_id") % 3 == 0, F.lit(None)).otherwise(F.col("vec_id")).alias("page_id"))
    return p.select("vec_id", TX.reference_label("document_name", "file_name", "page_no", "page_id").alias("label"),
                    TX.page_label(F.coalesce("file_name", F.lit("x.y")), F.col("vec_id")).alias("page_label"))


@register
def q_truncate_response(spark, sf):
    r = FX.fx_responses(spark, sf)
    return r.select("conv_id", "turn", TX.truncate("raw_response", 50).alias("resp_init"),
                    TX.truncate("raw_response", 1500).alias("resp_cut"))


@register
def q_image_payload(spark, sf):
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", TX.image_data_url(F.encode("text", "UTF-8")).alias("url"))


@register
def q_extract_content(spark, sf):
    r = FX.fx_responses(spark, sf)
    parts = F.array(F.struct(F.lit("text").alias("type"), F.col("raw_response").alias("text")),
                    F.struct(F.lit("text").alias("type"), F.lit("!").alias("text")))
    msg = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("raw_response").alias("content")))) \
           .otherwise(F.to_json(F.struct(parts.alias("content"))))
    return r.select("conv_id", "turn", A.extract_content(msg).alias("content"))


# ---------------------------------------------------------------- 2.1 collections


DELETE_DOCS = ["Paper1.pdf", "Paper2.pdf", "Paper3.pdf"]
DELETE_USER = "user3"


@register
def q_create_collection(spark, sf):
    c = CO.create_collection(FX.fx_points(spark, sf), "embedding", 64, "cosine")
    return c.select("vec_id", F.size("embedding").alias("dim"), "label")


def _versions(spark, sf):
    e = read_table(spark, sf, "embeddings", "vec_id", "label")
    v1 = e.withColumn("version", F.lit(1))
    v2 = e.where(F.col("vec_id") % 3 == 0).withColumn("label", F.col("label") + 100).withColumn("version", F.lit(2))
    return v1, v2


@register
def q_upsert_points(spark, sf):
    v1, v2 = _versions(spark, sf)
    return CO.upsert_points(v1, v2, "vec_id", "version").select("vec_id", "label", "version")


@register
def q_scroll_points(spark, sf):
    s = CO.scroll_points(FX.fx_points(spark, sf), must={"username": DELETE_USER, "type": ["text", "table"]},
                         must_not={"document_name": ""})
    return s.select("vec_id", "document_name", "type")


def _delete_selector(df):
    return F.col("document_name").isin(DELETE_DOCS) & (F.col("username") == DELETE_USER)


@register
def q_delete_points(spark, sf):
    return CO.delete_points(FX.fx_points(spark, sf), _delete_selector(None)).select("vec_id")


@register
def q_distinct_links(spark, sf):
    dense = FX.fx_points(spark, sf)
    pages = FX.fx_points(spark, sf).where(F.col("type") == "pdf_page")  # page-image collection stand-in
    return CO.deleted_links([dense, pages], _delete_selector)


@register
def q_distinct_documents(spark, sf):
    return CO.distinct_documents(FX.fx_points(spark, sf))


def _corpus_files(spark, sf):
    """Corpus file paths stand-in derived from the pages table."""
    p = read_table(spark, sf, "pages", "page_id")
    return p.select(F.concat(F.lit("/corpus/"), F.when(F.col("page_id") % 3 == 0, F.lit("old_")).otherwise(F.lit("")),
                             F.lit("Paper"), (F.col("page_id") % 30 + 1).cast("string"), F.lit(".pdf")).alias("path"))


@register
def q_collection_inventory(spark, sf):
    return CO.collection_inventory(FX.fx_points(spark, sf), _corpus_files(spark, sf))


@register
def q_tenant_copy(spark, sf):
    t = CO.tenant_copy(FX.fx_points(spark, sf), "alice", "./src/vectordb/")
    return t.select("vec_id", "username", "img_link")


@register
def q_batch_rows(spark, sf):
    b = CO.batch_rows(FX.fx_points(spark, sf), 4, ["label"], "vec_id")
    return b.select("vec_id", "label", "batch")


@register
def q_filter_types(spark, sf):
    r = CO.route_types(_points_payload(spark, sf))
    return r.select("point_id", "route", "route_content", "route_image")


@register
def q_filter_models(spark, sf):
    m = FX.fx_eval(spark, sf).select(F.col("Model_ret").alias("model_name")).distinct()
    m = m.withColumn("model_id", F.when(F.col("model_name") == "error", F.lit("Not_working"))
                     .otherwise(F.col("model_name")))
    out = CO.available_models(m, ["MM_A", "MM_B", "MM_C", "MM_D", "MM_E"], "model_name")
    return out.select("model_name", "model_id", "vd_mm")


# ---------------------------------------------------------------- 2.1 sources and sinks


@register
def q_align_links(spark, sf):
    pages = read_table(spark, sf, "pages", "page_id", "url")
    files = pages.select(F.format_string("page_%05d.pdf", F.col("page_id")).alias("name"))
    links_path = scratch_path(spark, "links")
    pages.orderBy("page_id").select("url").write.text(links_path)  # links in file-name order
    return RD.align_links(spark, files, links_path)


def _question_sheet(spark, sf):
    m = FX.fx_mcq(spark, sf)
    return m.select("Question_nr", F.concat(F.lit("Paper"), (F.col("Question_nr") % 25 + 1).cast("string"))
                    .alias("Paper_id"), F.lit(0).alias("Nr_data_suppl"), F.lit("").alias("doi"),
                    F.lit("").alias("title"), "question", "A", "B", "C", "D", "Correct", "Difficulty")


@register
def q_scan_questions(spark, sf):
    path = scratch_path(spark, "questions")
    _question_sheet(spark, sf).write.options(**RD.CSV_OPTIONS).csv(path)
    q = RD.scan_questions(spark, path)
    return q.select("Question_nr", "Paper_id", "question", "A", "B", "C", "D", "Correct", "Difficulty")


@register
def q_shuffle_questions(spark, sf):
    q = RD.shuffle_questions(FX.fx_mcq(spark, sf)).select("Question_nr", "shuffle_key")
    return OR.sequence_by_sort(q, [], ["shuffle_key", "Question_nr"], "row_number")


@register
def q_scan_config(spark, sf):
    models = FX.fx_eval(spark, sf).select(F.col("Model").alias("model_name")).distinct()
    cfg = models.select(F.to_json(F.collect_list(F.struct(
        "model_name", F.upper("model_name").alias("model_short"), F.lit("9999").alias("port"),
        F.lit("RAG_TEXT").alias("text_vd"), F.concat(F.lit("MM_"), F.col("model_name")).alias("mm_vd"),
        F.lit("late").alias("late_inter"), F.lit("LATE").alias("late_inter_short")))).alias("value"))
    path = scratch_path(spark, "config")
    cfg.write.text(path)  # one JSON array, one row per model: a handful of rows
    return RD.scan_config(spark, path).select("model_name", "model_short", "mm_vd")


RUN_CSV_SCHEMA = "event_id long, Model string, Model_ret string, Question_nr long, Cor_answer int, Elapsed double"
RUN_JSON_SCHEMA = ("event_id long, Model_ret string, Question_nr long, Cor_answer int, Difficulty string, "
                   "elapsed_time double, timestamp string, permuted_answers boolean")


@register
def q_scan_runs(spark, sf):
    ev = FX.fx_eval(spark, sf)
    root = scratch_path(spark, "runs")
    # two runs: a CSV one without a header record, a JSON one whose rows carry it
    ev.where("Iteration % 2 = 1").select("event_id", "Model", "Model_ret", "Question_nr", "Cor_answer", "Elapsed") \
      .write.options(**RD.CSV_OPTIONS).csv(f"{root}/csv/eval_gen-a_mm_RAG_perm_benchmark_20250101-101500_perm_q.csv")
    ev.where("Iteration % 2 = 0").select(
        "event_id", "Model_ret", "Question_nr", "Cor_answer", "Difficulty",
        F.lit(12.5).alias("elapsed_time"), F.lit("20250102-235959").alias("timestamp"),
        F.lit(True).alias("permuted_answers")).write.json(f"{root}/json/eval_gen-b_text_RAG_no_perm_benchmark_20250102-110000.json")
    from pyspark.sql.types import _parse_datatype_string
    r = RD.scan_runs(spark, f"{root}/csv/*", f"{root}/json/*", _parse_datatype_string(RUN_CSV_SCHEMA),
                     _parse_datatype_string(RUN_JSON_SCHEMA))
    return round_doubles(r.select(
        "event_id", "Model_ret", "Question_nr", "Cor_answer", "Elapsed", "Difficulty", "model_short", "vd_name", "perm_label",
        "file_timestamp", "run_timestamp", F.col("permuted_answers").cast("int").alias("permuted_answers"), "elapsed_time",
        F.col("valid").cast("int").alias("valid")))


@register
def q_write_run(spark, sf):
    path = scratch_path(spark, "run_tables")
    SK.write_run(FX.fx_eval(spark, sf).select("event_id", "Model", "Model_ret", "Iteration", "Question_nr",
                                                "Cor_answer"), path)
    back = SK.read_runs(spark, path)
    return back.select("event_id", "Model", "Model_ret", F.col("Iteration").cast("int").alias("Iteration"),
                       "Question_nr", "Cor_answer")


@register
def q_write_report(spark, sf):
    ev = FX.fx_eval(spark, sf)
    summary = SUM.ci_summary(ev, CI_KEYS, FX.PRICES, TOP_K, FX.MODELS, FX.RETRIEVERS)
    per_iter = SUM.per_iteration(ev, CI_KEYS, FX.PRICES, TOP_K, FX.MODELS, FX.RETRIEVERS)
    path = scratch_path(spark, "report")
    sheets = SK.write_report({"Summary": summary, "per_iteration": per_iter}, path)
    return spark.read.parquet(sheets["Summary"])


@register
def q_clean_newlines(spark, sf):
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    # stand-in for a spreadsheet export that stored newlines as the two characters '\n'
    escaped = c.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\\n")))
    return TX.clean_newlines(escaped)


@register
def q_embedding_cache(spark, sf):
    root = scratch_path(spark, "embedding_cache")
    from .functions import vectors as V

    def compute():
        e = read_table(spark, sf, "embeddings", "vec_id", "embedding")
        return e.select("vec_id", V.normalize("embedding").alias("embedding"))

    SK.embedding_cache(spark, root, "unit/normaliser", compute)  # computes and writes
    again = SK.embedding_cache(spark, root, "unit/normaliser", compute)  # served from the table
    return again.select("vec_id", F.size("embedding").alias("dim"),
                        r6(F.element_at("embedding", 1), "first_component"))


@register
def q_embedding_cache_fill(spark, sf):
    root = scratch_path(spark, "embedding_cache")
    from .functions import vectors as V

    e = read_table(spark, sf, "embeddings", "vec_id", "label", "embedding")
    unit = lambda missing: missing.select("key", V.normalize("embedding").alias("unit"))
    SK.fill_cache(spark, root, "unit/normaliser", e.where("label = 0"), "embedding", unit)  # an earlier state of the table
    SK.fill_cache(spark, root, "unit/normaliser", e, "embedding", unit)  # computes what came since
    again = SK.cached_vectors(spark, root, "unit/normaliser", e, "embedding")
    return again.select("vec_id", F.size("unit").alias("dim"), r6(F.element_at("unit", 1), "first_component"))


@register
def q_export_requests(spark, sf):
    q = _exp1_questions(spark, sf).withColumn("message", F.array(PR.text_part(F.col("instruction"))))
    path = scratch_path(spark, "requests")
    SK.export_requests(q, path, "Question_nr", "gen_a")
    r = SK.read_requests(spark, path)
    return r.select("custom_id", F.col("body.model").alias("model"),
                    F.col("body.messages")[0]["content"][0]["text"].alias("prompt"))


@register
def q_import_responses(spark, sf):
    conv = read_table(spark, sf, "conversations", "conv_id", "turn", "role")
    reqs = conv.where("role = 'user'").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("custom_id"))
    resp = FX.fx_responses(spark, sf).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("custom_id"),
        F.col("raw_response").alias("content"))
    path = scratch_path(spark, "responses")
    resp.write.json(path)
    return SK.import_responses(spark, reqs, path)


# ---------------------------------------------------------------- 2.2 ingestion


CHUNK_BUDGET = 512
LINES_PER_PAGE = 40


def _elements(spark, sf):
    """Document lines as elements; the page number stand-in is 40 lines a page."""
    return FX.fx_elements(spark, sf).withColumn(
        "page_no", (F.floor(F.col("pos") / LINES_PER_PAGE) + 1).cast("int"))


@register
def q_extract_elements(spark, sf):
    return IN.extract_elements(read_table(spark, sf, "pages", "page_id", "html"))


def _chunks(spark, sf):
    return IN.chunk_text(_elements(spark, sf), CHUNK_BUDGET)


@register
def q_chunk_text(spark, sf):
    c = _chunks(spark, sf)
    return c.select("doc_id", "chunk", "n_lines", "n_tokens", "first_page", "ref", "text",
                    F.col("lone_table").cast("int").alias("lone_table"))


@register
def q_table_elements(spark, sf):
    t = IN.table_elements(_elements(spark, sf))
    return t.select("doc_id", "pos", "caption", "page_content")


def _image_stand_in(spark, sf):
    p = FX.fx_points(spark, sf).where(F.col("type") == "image")
    return p.select(
        F.col("vec_id").alias("point_id"),
        F.when(F.col("vec_id") % 3 == 0, F.lit("")).otherwise(
            F.concat(F.lit("Figure "), F.col("vec_id").cast("string"), F.lit(":"))).alias("caption"),
        F.array(F.concat(F.lit("label "), F.col("label").cast("string")),
                F.concat(F.lit("page "), F.col("page_no").cast("string"))).alias("descriptions"))


@register
def q_image_elements(spark, sf):
    return IN.image_elements(_image_stand_in(spark, sf)).select("point_id", "page_content")


@register
def q_number_assets(spark, sf):
    e = _elements(spark, sf).withColumn("stem", F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    n = IN.number_assets(e, "doc_id", "stem", root="./vd/")
    return n.select("doc_id", "pos", "type", "asset_no", "img_link")


def _pages_with_tables(spark, sf):
    """Pages whose menu is laid out as a captioned table and whose heading follows an image (the test pages have neither)."""
    html = F.col("html")
    for old, new in (("<ul>", "<table class=m><caption>Menu &amp; more</caption><tr>"), ("</ul>", "</tr></table>"),
                     ("<li>", "<td>"), ("</li>", "</td>"), ("<h1>", "<img alt=\"Figure &lt;1&gt;\" src='/img/1.png'><h1>")):
        html = F.replace(html, F.lit(old), F.lit(new))
    return read_table(spark, sf, "pages", "page_id", "html").withColumn("html", html)


@register
def q_html_tables(spark, sf):
    t = IN.extract_tables(_pages_with_tables(spark, sf))
    return t.select("page_id", "table_no", "caption", "markdown", "page_content")


@register
def q_html_images(spark, sf):
    return IN.extract_images(_pages_with_tables(spark, sf)).select("page_id", "image_no", "img_link", "caption")


@register
def q_page_image_links(spark, sf):
    p = FX.fx_points(spark, sf).withColumn("stem", F.regexp_replace("document_name", r"\.pdf$", ""))
    return IN.page_image_links(p, "stem", "page_no", "pages/").select("vec_id", "img_link")


@register
def q_corpus_variants(spark, sf):
    e = _elements(spark, sf)
    v = IN.corpus_variants(IN.chunk_text(e, CHUNK_BUDGET), IN.table_elements(e))
    return v.select("variant", "doc_id", "element_id", "type", "page_content")


@register
def q_element_counts(spark, sf):
    return IN.element_counts(_elements(spark, sf))


@register
def q_needs_ocr(spark, sf):
    n = IN.needs_ocr(_elements(spark, sf))
    return n.select("doc_id", F.col("needs_ocr").cast("int").alias("needs_ocr"))


@register
def q_overlay_descriptions(spark, sf):
    corpus = _points_payload(spark, sf).select("point_id", "type", "page_content")
    imgs = corpus.where(F.col("type") == "image")
    desc = imgs.select("point_id", F.explode(F.array(*[F.lit(m) for m in FX.MODELS])).alias("model"))
    idx = F.when(F.col("model") == FX.MODELS[0], 0).when(F.col("model") == FX.MODELS[1], 1).otherwise(2)
    desc = (desc.where((F.col("point_id") + idx) % 2 == 0)
            .withColumn("description", F.concat(F.col("model"), F.lit(" describes "), F.col("point_id").cast("string"))))
    o = IN.overlay_descriptions(corpus, desc, FX.MODELS)
    return o.select("model", "point_id", "type", "page_content")


@register
def q_vectorise_text(spark, sf):
    d = read_table(spark, sf, "documents", "doc_id", "text")
    v = IN.vectorise_text(d, "text", 768)
    total = F.aggregate(F.transform("embedding", lambda x, i: x * (i + 1)), F.lit(0.0), lambda acc, x: acc + x)
    return v.select("doc_id", F.size("embedding").alias("dim"),
                    F.size(F.filter("embedding", lambda x: x != 0)).alias("nnz"), r6(total, "weighted_sum"))


# ---------------------------------------------------------------- 2.6 rank tests


def _pairs(spark, sf):
    wide = RK.item_accuracy(FX.fx_eval(spark, sf), "Model", "Model_ret", "Question_nr", "Cor_answer", FX.RETRIEVERS)
    return RK.item_pairs(wide, "Model", "Question_nr", FX.RETRIEVERS)


@register
def q_item_pairs(spark, sf):
    return round_doubles(_pairs(spark, sf))


@register
def q_wilcoxon_ranks(spark, sf):
    r = RK.wilcoxon_ranks(_pairs(spark, sf), "Model", "Question_nr")
    return round_doubles(r.select("Model", "cond_1", "cond_2", "Question_nr", "d", "rank", "tie_size"))


def _tests(spark, sf):
    return RK.wilcoxon_test(_pairs(spark, sf), "Model", "Question_nr")


@register
def q_wilcoxon_test(spark, sf):
    return round_doubles(_tests(spark, sf))


@register
def q_bonferroni(spark, sf):
    return round_doubles(RK.bonferroni(_tests(spark, sf), "Model"))


# ---------------------------------------------------------------- 2.4 plans, 2.9 descriptions

@register
def q_run_plan(spark, sf):
    models = FX.fx_eval(spark, sf).select(F.regexp_replace("Model", "_", "-").alias("model_short")).distinct()
    p = RP.exp1_plan(models, "model_short", 5, {"vd_text": "RAG_TEXT", "vd_mm": "MM_STORE", "vd_colpali": "COL_PALI"})
    return p.select("model_short", "perm_label", "repeat", "mode", "vector_db", "eval_type", "output_stub",
                    "perm_quest", RP.should_permute(F.col("perm_quest")).cast("int").alias("permuted"))


@register
def q_exp2_plan(spark, sf):
    gens = FX.fx_eval(spark, sf).select(F.col("Model").alias("generator")).distinct()
    return RP.exp2_plan(gens, "generator", FX.RETRIEVERS, 5)


@register
def q_reject_run_files(spark, sf):
    files = FX.fx_run_files(spark, sf)
    # stand-in for names that don't follow the layout: every seventh lost its time stamp
    files = files.withColumn("file_name", F.when(F.col("file_id") % 7 == 0, F.regexp_replace(
        "file_name", "_benchmark_[0-9]+-[0-9]+", "_benchmark_x")).otherwise(F.col("file_name")))
    return SC.reject_run_files(files).select("file_id", "file_name")


@register
def q_metric_descriptions(spark, sf):
    s = SUM.ci_summary(FX.fx_eval(spark, sf), CI_KEYS, FX.PRICES, TOP_K, FX.MODELS, FX.RETRIEVERS)
    display = {"cor_answer": "Cor_answer", "elapsed": "Elapsed", "tokens": "Total_tokens",
               "precision": f"P@{TOP_K}", "throughput": "Throughput", "cost": "Cost",
               "price_per_correct": "Price-per-cost"}
    cells = F.explode(F.array(*[F.struct(F.lit(v).alias("Metric"), F.col(k).alias("cell"))
                                for k, v in display.items()]))
    long = s.select(cells.alias("c")).select("c.Metric", "c.cell")
    g = long.groupBy("Metric").agg(F.count_if(F.col("cell") != "N/A").alias("n_groups"))
    return g.select("Metric", RP.description_column(F.col("Metric"), TOP_K).alias("Description"), "n_groups")


# ---------------------------------------------------------------- 2.10 streaming


@register
def q_stream_upsert(spark, sf):
    v1, v2 = _versions(spark, sf)
    root = scratch_path(spark, "stream_upsert")
    v1.write.parquet(f"{root}/in/drop1")
    v2.write.parquet(f"{root}/in/drop2")
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", T.IntegerType()),
                           T.StructField("version", T.IntegerType())])
    # file drops arrive in one folder
    src = f"{root}/src"
    spark.read.parquet(f"{root}/in/drop1").write.parquet(src)
    spark.read.parquet(f"{root}/in/drop2").write.mode("append").parquet(src)
    return ST.stream_upsert(spark, src, schema, f"{root}/out", "vec_id", "version")


@register
def q_stream_run_accuracy(spark, sf):
    root = scratch_path(spark, "stream_acc")
    ev = FX.fx_eval(spark, sf).select("event_id", "Model", "Model_ret", "Iteration", "Cor_answer")
    src = f"{root}/src"
    ev.repartition(5).write.parquet(src)  # several run files, taken in several micro-batches
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("Model", T.StringType()),
                           T.StructField("Model_ret", T.StringType()), T.StructField("Iteration", T.IntegerType()),
                           T.StructField("Cor_answer", T.IntegerType())])
    out = ST.stream_run_accuracy(spark, src, schema, f"{root}/out", max_files_per_trigger=2)
    return round_doubles(out.select("Model", "Model_ret", "accuracy", "n_rows"))


@register
def q_maxsim_topk_packed(spark, sf):
    pages = RT.pack_patches(FX.fx_patches(spark, sf))
    return _patches_out(RT.maxsim_topk_packed(pages, FX.fx_qtokens(spark, sf), K_HITS))


@register
def q_merge_runs(spark, sf):
    ev = FX.fx_eval(spark, sf).select("event_id", "Model", "Model_ret", "Iteration", "Question_nr", "Cor_answer")
    path = scratch_path(spark, "merge_runs")
    # one CSV per (model, retriever, iteration) run, in a folder named after the run
    run = F.concat_ws("-", "Model", "Model_ret", F.col("Iteration").cast("string"))
    (ev.withColumn("run", run).repartition("run").drop("Iteration")
       .write.partitionBy("run").options(**RD.CSV_OPTIONS).csv(path))
    schema = "event_id long, Model string, Model_ret string, Question_nr long, Cor_answer int"
    m = RD.merge_runs(spark, path, schema, "csv")
    return m.select("event_id", "Model", "Model_ret", "Iteration", "Question_nr", "Cor_answer")
