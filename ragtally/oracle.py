"""DuckDB SQL for each registered query (the correctness oracle).

The fixture views of FIXTURES.md are inlined as CTEs over the pre-registered
test tables.  Formulas are written independently of the Spark code, in
DuckDB's dialect, and constants (quantiles, prompt texts, run modes, patterns)
are written out or computed here on their own; only the fixtures' parameters
are shared.
"""

from __future__ import annotations

import math
from itertools import combinations

from .sources import fixtures as FX

ORACLE: dict[str, str] = {}

# Prompt texts, run modes and metric descriptions.
EXP1_HEAD = "You are an expert biomedical researcher. Carefully read the question and the answer choices.\n"
EXP1_TAIL = ("If contextual snippets are provided, use them judiciously. "
             "Respond with a single capital letter (A, B, C, or D).")
EXP2_HEAD = """You are an experienced senior researcher tasked with providing in-depth analysis.
Use all the information at your disposal, such as uploaded files and other sources. \
Think about the following statement or question: """
EXP2_MID = """
Below are the possible answers, where letters mark each answer. First, exclude the unlikely answer or answers, \
rethink, and select an output from the rest. The output is only ONE letter from the list ['A', 'B', 'C', 'D']. \
Check that you return only one letter; if two letters, choose one. No explanations. The answers are:
"""
EXP2_RETRIEVAL_MID = " The answers are: "
CONTEXT_LEAD = "Here is context information:"
EXP1_MODES = (("no_RAG", "", ""), ("text_RAG", "RAG_TEXT", "mm_RAG"), ("mm_RAG", "MM_STORE", "mm_RAG"),
              ("colpali", "COL_PALI", "colpali"))
DESCRIPTIONS = (("Cor_answer", "Average correctness rate per question"),
                ("Elapsed", "Average wall-clock time per question (seconds)"),
                ("Total_tokens", "Average total tokens consumed per question"),
                ("P@5", "Precision@5: share of retrieved documents containing the reference paper"),
                ("Throughput", "Average tokens processed per second"), ("Cost", "USD spent per iteration/run"),
                ("Price-per-cost", "Cents spent per correct answer"))

# ------------------------------------------------------------------ fixtures

FX_SQL = {
    "fx_eval": r"""
SELECT event_id,
  CASE event_id % 3 WHEN 0 THEN 'gen_a' WHEN 1 THEN 'gen_b' ELSE 'gen_c' END AS Model,
  CASE event_type WHEN 'click' THEN 'ret_a' WHEN 'view' THEN 'ret_b' WHEN 'purchase' THEN 'ret_c' ELSE event_type END AS Model_ret,
  user_id AS Question_nr,
  CASE WHEN user_id % 50 = 49 THEN NULL WHEN user_id % 3 = 0 THEN 'Easy' WHEN user_id % 3 = 1 THEN 'Medium' ELSE 'Hard' END AS Difficulty,
  CAST(event_id % 5 + 1 AS INT) AS Iteration,
  CASE WHEN user_id % 10 = 0 THEN 'General' ELSE concat('Paper', CAST(user_id % 25 + 1 AS VARCHAR)) END AS Paper_id,
  CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 101 = 0 THEN '[broken' ELSE concat('[''paper', CAST((user_id + k) % 25 + 1 AS VARCHAR), '_pg_', CAST(k AS VARCHAR),
     ''', ''Paper', CAST(user_id % 25 + 1 + k % 2 AS VARCHAR), '_pg_1'', ''Paper', CAST(k % 25 + 1 AS VARCHAR), '_pg_2'', ''other_pg_3'', ''Paper1_pg_4'']') END AS Context_papers,
  substr('ABCD', CAST(k % 4 + 1 AS INT), 1) AS Answer,
  substr('ABCD', CAST(user_id % 4 + 1 AS INT), 1) AS Correct,
  CASE WHEN k % 4 = user_id % 4 THEN 1 ELSE 0 END AS Cor_answer,
  value AS Elapsed, CAST(k * 100 + user_id AS BIGINT) AS Total_tokens
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e""",
    "fx_points": r"""
SELECT vec_id, embedding, label,
  concat('Paper', CAST(vec_id % 25 + 1 AS VARCHAR), '.pdf') AS document_name,
  concat('https://doi.example/', CAST(vec_id % 25 + 1 AS VARCHAR)) AS document_link,
  CAST(floor(vec_id / 25) + 1 AS INT) AS page_no,
  CASE vec_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'image' ELSE 'pdf_page' END AS type,
  concat('user', CAST(label AS VARCHAR)) AS username,
  CASE WHEN vec_id % 4 >= 2 THEN concat('/vd/images/p', CAST(vec_id AS VARCHAR), '.png') ELSE '' END AS img_link
FROM embeddings""",
    "fx_patches": r"""
SELECT CAST(floor(vec_id / 10) AS BIGINT) AS page_key, vec_id % 10 AS patch_no, embedding FROM embeddings""",
    "fx_qtokens": r"""
SELECT item_id AS query_id, t AS token_no, embedding
FROM (SELECT item_id, unnest(range(4)) AS t FROM benchmark) b
JOIN embeddings e ON e.vec_id = (item_id * 4 + t) % (SELECT count(*) FROM embeddings)""",
    "fx_mcq": r"""
SELECT item_id AS Question_nr, text AS question,
  concat('opt', CAST(item_id * 4 + 1 AS VARCHAR)) AS A, concat('opt', CAST(item_id * 4 + 2 AS VARCHAR)) AS B,
  concat('opt', CAST(item_id * 4 + 3 AS VARCHAR)) AS C, concat('opt', CAST(item_id * 4 + 4 AS VARCHAR)) AS D,
  substr('ABCD', CAST(item_id % 4 + 1 AS INT), 1) AS Correct,
  CASE item_id % 3 WHEN 0 THEN 'Easy' WHEN 1 THEN 'Medium' ELSE 'Hard' END AS Difficulty
FROM benchmark""",
    "fx_responses": r"""
SELECT conv_id, turn, conv_id % (SELECT count(*) FROM benchmark) AS Question_nr,
  CASE conv_id % 9 WHEN 0 THEN 'A' WHEN 1 THEN 'B.' WHEN 2 THEN 'Answer: C.' WHEN 3 THEN concat('{"answer":"', substr('ABCD', CAST(turn % 4 + 1 AS INT), 1), '"}')
    WHEN 4 THEN NULL WHEN 5 THEN 'b' WHEN 6 THEN 'The answer is D' WHEN 7 THEN substr('ABCD', CAST(turn % 4 + 1 AS INT), 1) ELSE text END AS raw_response
FROM conversations WHERE role = 'assistant'""",
    "fx_run_files": r"""
SELECT o_orderkey AS file_id,
  concat('eval_', CASE o_custkey % 3 WHEN 0 THEN 'gen-a' WHEN 1 THEN 'gen-b' ELSE 'gen-c' END, '_',
   CASE o_orderkey % 4 WHEN 0 THEN 'no_RAG' WHEN 1 THEN 'text_RAG' WHEN 2 THEN 'mm_RAG' ELSE 'colpali' END, '_',
   CASE o_orderstatus WHEN 'F' THEN 'perm' ELSE 'no_perm' END, '_benchmark_20250101-', substr(CAST(100000 + o_orderkey % 86400 AS VARCHAR), 1, 6),
   CASE o_orderstatus WHEN 'F' THEN '_perm_q' ELSE '' END, CASE WHEN o_orderkey % 50 = 0 THEN '.bak' ELSE '.json' END) AS file_name
FROM orders""",
    "fx_elements": r"""
SELECT doc_id, pos, line, CASE WHEN line LIKE '%|%' THEN 'table' ELSE 'text' END AS type
FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos,
             unnest(string_split(text, chr(10))) AS line FROM documents) t
WHERE trim(line) <> ''""",
}


def with_fx(body: str, *ctes: tuple[str, str] | str) -> str:
    """Prefix `body` with the named fixture CTEs and extra (name, sql) CTEs."""
    parts = []
    for c in ctes:
        if isinstance(c, str):
            parts.append(f"{c} AS ({FX_SQL[c]})")
        else:
            parts.append(f"{c[0]} AS ({c[1]})")
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 4)"


# ------------------------------------------------------------------ formulas

LIST_ITEMS = "regexp_extract_all({c}, '''([^'']*)''', 1)"


def ctx_list(c: str) -> str:
    """Python-repr list -> list of strings; null if not a list or malformed."""
    return (f"CASE WHEN starts_with({c}, '[') AND json_valid(replace({c}, '''', '\"')) "
            f"THEN {LIST_ITEMS.format(c=c)} END")


def precision_sql(pid: str, ctx: str, k: int) -> str:
    items = LIST_ITEMS.format(c=ctx)
    return (f"CASE WHEN {pid} IS NULL OR NOT starts_with({pid}, 'Paper') THEN NULL "
            f"WHEN {ctx} IS NULL OR NOT starts_with({ctx}, '[') THEN 0.0 "
            f"ELSE len(list_filter({items}, lambda x: lower(split_part(x, '_pg_', 1)) = lower({pid}))) / {float(k)} END")


def hit_sql(pid: str, ctx: str) -> str:
    items = LIST_ITEMS.format(c=ctx)
    return (f"CAST(CASE WHEN {pid} IS NULL OR NOT starts_with(lower({pid}), 'paper') THEN NULL "
            f"WHEN {ctx} IS NULL OR NOT starts_with({ctx}, '[') THEN 0.0 "
            f"WHEN len(list_filter({items}, lambda x: lower(split_part(x, '_pg_', 1)) = lower({pid}))) > 0 THEN 1.0 "
            f"ELSE 0.0 END AS DOUBLE)")


def throughput_sql(tok: str = "Total_tokens", el: str = "Elapsed") -> str:
    return f"CASE WHEN {el} = 0 THEN NULL ELSE CAST({tok} AS DOUBLE) / CAST({el} AS DOUBLE) END"


def cost_sql(model: str = "Model", tok: str = "Total_tokens") -> str:
    cases = " ".join(f"WHEN {q(m)} THEN CAST({p!r} AS DOUBLE)" for m, p in FX.PRICES.items())
    return f"(CAST({tok} AS DOUBLE) / 1e6) * (CASE {model} {cases} END)"


Z975 = 1.9599639845400545  # standard normal quantile at 0.975
T_TABLE_MAX_DF = 100


def _t975(df: int) -> float:
    """t(0.975, df) from the finite series of the t distribution's integral A(t, df) = 0.95, by bisection."""
    def inside(t: float) -> float:
        theta = math.atan(t / math.sqrt(df))
        c, s = math.cos(theta), math.sin(theta)
        if df == 1:
            return 2 * theta / math.pi
        term, total = (c, c) if df % 2 else (1.0, 1.0)
        k = 2 if df % 2 else 1
        while k + 2 <= df - 1:  # coefficients 2/3, 4/5 ... (odd df) or 1/2, 3/4 ... (even df)
            term *= k / (k + 1) * c * c
            total += term
            k += 2
        return 2 / math.pi * (theta + s * total) if df % 2 else s * total
    lo, hi = 0.0, 20.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if inside(mid) < 0.95 else (lo, mid)
    return (lo + hi) / 2


T_LIST = "[" + ", ".join(repr(_t975(df)) for df in range(1, T_TABLE_MAX_DF + 1)) + "]"


def t975_sql(df: str) -> str:
    z = Z975
    g1 = (z ** 3 + z) / 4.0
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96.0
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384.0
    g4 = (79 * z ** 9 + 776 * z ** 7 + 1482 * z ** 5 - 1920 * z ** 3 - 945 * z) / 92160.0
    d = f"CAST({df} AS DOUBLE)"
    return (f"CASE WHEN {df} < 1 THEN NULL WHEN {df} <= {T_TABLE_MAX_DF} THEN {T_LIST}[CAST({df} AS BIGINT)] "
            f"ELSE {z!r} + {g1!r} / {d} + {g2!r} / ({d} * {d}) + {g3!r} / ({d} * {d} * {d}) "
            f"+ {g4!r} / ({d} * {d} * {d} * {d}) END")


def t_bounds_sql(mean: str, sd: str, n: str, floor_zero: bool = False) -> tuple[str, str]:
    half = f"({t975_sql(f'({n} - 1)')} * {sd} / sqrt(CAST({n} AS DOUBLE)))"
    low = f"({mean} - {half})"
    if floor_zero:
        low = f"greatest(0.0, {low})"
    return (f"CASE WHEN {n} >= 2 THEN {low} END", f"CASE WHEN {n} >= 2 THEN ({mean} + {half}) END")


def ac_bounds_sql(count: str, nobs: str) -> tuple[str, str]:
    z = Z975
    z2 = z * z
    nc = f"(CAST({nobs} AS DOUBLE) + {z2!r})"
    qc = f"((CAST({count} AS DOUBLE) + {z2 / 2.0!r}) / {nc})"
    dist = f"({z!r} * sqrt({qc} * (1.0 - {qc}) / {nc}))"
    return (f"CASE WHEN {nobs} > 0 THEN least(1.0, greatest(0.0, {qc} - {dist})) END",
            f"CASE WHEN {nobs} > 0 THEN least(1.0, greatest(0.0, {qc} + {dist})) END")


def fmt_sql(x: str, d: int) -> str:
    return f"printf('%.{d}f', round_even(CAST({x} AS DOUBLE), {d}))"


def ci_cell_sql(mean: str, low: str, upp: str, d: int) -> str:
    return (f"CASE WHEN ({mean}) IS NULL OR ({low}) IS NULL OR ({upp}) IS NULL THEN 'N/A' ELSE "
            f"concat({fmt_sql(mean, d)}, chr(10) || '[', {fmt_sql(f'greatest(0.0, {low})', d)}, ', ', "
            f"{fmt_sql(upp, d)}, ']') END")


def float_text_sql(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'nan')"


def mean_sd_sql(mean: str, sd: str) -> str:
    return (f"concat({float_text_sql(f'round_even({mean}, 3)')}, ' (SD=', "
            f"{float_text_sql(f'round_even({sd}, 3)')}, ')')")


def interval_text_sql(mean: str, low: str, upp: str) -> str:
    return (f"concat({float_text_sql(f'round_even({mean}, 3)')}, ' [', {float_text_sql(f'round_even({low}, 3)')}, "
            f"'-', {float_text_sql(f'round_even({upp}, 3)')}, ']')")


def register(key: str, sql: str) -> None:
    ORACLE[key] = sql


# ------------------------------------------------------------------ 2.9 metrics

register("parse_context_list", with_fx(f"""
SELECT event_id, CAST(len({ctx_list("Context_papers")}) AS INTEGER) AS n_items,
       array_to_string({ctx_list('Context_papers')}, '|') AS items
FROM fx_eval""", "fx_eval"))

register("hit_at_k", with_fx(f"SELECT event_id, {hit_sql('Paper_id', 'Context_papers')} AS hit FROM fx_eval",
                             "fx_eval"))

register("precision_at_k", with_fx(
    f"SELECT event_id, {r6(precision_sql('Paper_id', 'Context_papers', 5))} AS precision FROM fx_eval",
    "fx_eval"))

register("throughput", with_fx(f"SELECT event_id, {r6(throughput_sql())} AS throughput FROM fx_eval", "fx_eval"))

register("cost", with_fx(f"SELECT event_id, Model, {r6(cost_sql())} AS cost FROM fx_eval", "fx_eval"))


# ------------------------------------------------------------------ 2.5 aggregates

def per_iteration_sql(keys: list[str], k: int = 5) -> str:
    """Unrounded per-iteration CTE body over fx_eval."""
    group = list(dict.fromkeys(keys + ["Iteration"]))
    g = ", ".join(group)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in group)
    return f"""
SELECT {g}, avg(Cor_answer) AS mean_cor_answer, avg(Elapsed) AS mean_elapsed,
       avg(Total_tokens) AS mean_tokens, avg(Precision) AS mean_precision,
       avg(Throughput) AS mean_throughput, coalesce(sum(Cost), 0.0) AS sum_cost,
       CAST(sum(Cor_answer) AS BIGINT) AS correct_answers,
       CASE WHEN sum(Cor_answer) > 0 THEN coalesce(sum(Cost), 0.0) * 100 / sum(Cor_answer) END AS price_per_cost
FROM (SELECT *, {throughput_sql()} AS Throughput, {cost_sql()} AS Cost,
             {precision_sql('Paper_id', 'Context_papers', k)} AS Precision
      FROM fx_eval WHERE Model IN {in_list(FX.MODELS)} AND Model_ret IN {in_list(FX.RETRIEVERS)}) m
WHERE {notnull}
GROUP BY {g}"""


CI_METRICS = (("cor_answer", "mean_cor_answer", "prop", 3), ("elapsed", "mean_elapsed", "t", 2),
              ("tokens", "mean_tokens", "t", 1), ("precision", "mean_precision", "t", 3),
              ("throughput", "mean_throughput", "t0", 1), ("cost", "sum_cost", "t0", 2),
              ("price_per_correct", "price_per_cost", "t0", 2))


def ci_summary_sql(keys: list[str]) -> str:
    g = ", ".join(keys)
    aggs = []
    for name, src, _kind, _d in CI_METRICS:
        aggs += [f"avg({src}) AS {name}_mean", f"stddev_samp({src}) AS {name}_sd",
                 f"count({src}) AS {name}_n", f"sum({src}) AS {name}_sum"]
    cells = []
    for name, _src, kind, d in CI_METRICS:
        if kind == "prop":
            low, upp = ac_bounds_sql(f"{name}_sum", f"{name}_n")
        else:
            low, upp = t_bounds_sql(f"{name}_mean", f"{name}_sd", f"{name}_n", kind == "t0")
        cells.append(f"{ci_cell_sql(f'{name}_mean', low, upp, d)} AS {name}")
    return with_fx(f"""
SELECT {g}, {', '.join(cells)}
FROM (SELECT {g}, {', '.join(aggs)} FROM per_iter GROUP BY {g}) b""",
                   "fx_eval", ("per_iter", per_iteration_sql(keys)))


CI_KEYS = ["Model", "Model_ret", "Difficulty"]
_pi = ["Model", "Model_ret", "Difficulty", "Iteration"]
register("per_iteration", with_fx(f"""
SELECT {', '.join(_pi)}, {r6('mean_cor_answer')} AS mean_cor_answer, {r6('mean_elapsed')} AS mean_elapsed,
       {r6('mean_tokens')} AS mean_tokens, {r6('mean_precision')} AS mean_precision,
       {r6('mean_throughput')} AS mean_throughput, {r6('sum_cost')} AS sum_cost, correct_answers,
       {r6('price_per_cost')} AS price_per_cost
FROM per_iter""", "fx_eval", ("per_iter", per_iteration_sql(CI_KEYS))))

register("ci_summary", ci_summary_sql(CI_KEYS))
register("ci_summary_no_difficulty", ci_summary_sql(["Model", "Model_ret"]))

_wide_cols = ", ".join(
    f"first({m}) FILTER (WHERE Difficulty = {q(v)}) AS {m}_{v}"
    for v in FX.DIFFICULTIES for m in ("cor_answer", "precision"))
register("ci_summary_wide", "WITH s AS (" + ci_summary_sql(CI_KEYS) + f""")
SELECT Model, Model_ret, {_wide_cols} FROM s GROUP BY Model, Model_ret""")

_ac = ac_bounds_sql("n_correct", "n")
register("agresti_coull", with_fx(f"""
SELECT Model, Model_ret, n_correct, n, {r6(_ac[0])} AS ci_low, {r6(_ac[1])} AS ci_upp
FROM (SELECT Model, Model_ret, CAST(sum(Cor_answer) AS BIGINT) AS n_correct, count(Cor_answer) AS n
      FROM fx_eval GROUP BY Model, Model_ret) g""", "fx_eval"))

_tb = t_bounds_sql("mean", "sd", "n")
register("t_interval", with_fx(f"""
SELECT Model, Model_ret, Iteration, n, {r6('mean')} AS mean, {r6(_tb[0])} AS ci_low, {r6(_tb[1])} AS ci_upp
FROM (SELECT Model, Model_ret, Iteration, avg(Elapsed) AS mean, stddev_samp(Elapsed) AS sd, count(Elapsed) AS n
      FROM fx_eval GROUP BY Model, Model_ret, Iteration) g""", "fx_eval"))

register("format_ci_cell", with_fx(f"""
SELECT Model, Model_ret, Difficulty, {ci_cell_sql('mean', _tb[0], _tb[1], 2)} AS cell
FROM (SELECT Model, Model_ret, Difficulty, avg(Elapsed) AS mean, stddev_samp(Elapsed) AS sd, count(Elapsed) AS n
      FROM fx_eval WHERE Difficulty IS NOT NULL GROUP BY Model, Model_ret, Difficulty) g""", "fx_eval"))


# ------------------------------------------------------------------ 2.9 answers, 2.4 key join

PERM_CTE = ("perm", """
SELECT Question_nr, list(i ORDER BY md5(concat('42:', CAST(Question_nr AS VARCHAR), ':', CAST(i AS VARCHAR))), i) AS perm
FROM (SELECT DISTINCT Question_nr FROM {src}) s, range(4) t(i) GROUP BY Question_nr""")


def perm_cte(src: str) -> tuple[str, str]:
    return (PERM_CTE[0], PERM_CTE[1].format(src=src))


def parse_answer_sql(r: str) -> str:
    tail = f"list_last(string_split(trim(regexp_replace({r}, '\\s+', ' ', 'g')), ':'))"
    return (f"CASE WHEN {r} IS NULL THEN '' WHEN {r} IN ('A', 'B', 'C', 'D') THEN {r} "
            f"ELSE coalesce(regexp_extract(upper(substr({tail}, 1, 10)), '([ABCD]).', 1), '') END")


def unpermute_sql(letter: str, perm: str) -> str:
    return (f"CASE WHEN {letter} IN ('A', 'B', 'C', 'D') "
            f"THEN substr('ABCD', CAST({perm}[instr('ABCD', {letter})] + 1 AS INT), 1) ELSE '' END")


register("permute_options", with_fx("""
SELECT m.Question_nr, array_to_string(perm, ',') AS quest_order,
  [m.A, m.B, m.C, m.D][perm[1] + 1] AS shown_A, [m.A, m.B, m.C, m.D][perm[2] + 1] AS shown_B,
  [m.A, m.B, m.C, m.D][perm[3] + 1] AS shown_C, [m.A, m.B, m.C, m.D][perm[4] + 1] AS shown_D,
  substr('ABCD', CAST(list_position(perm, instr('ABCD', m.Correct) - 1) AS INT), 1) AS shown_correct
FROM fx_mcq m JOIN perm USING (Question_nr)""", "fx_mcq", perm_cte("fx_mcq")))

register("parse_answer", with_fx(
    f"SELECT conv_id, turn, {parse_answer_sql('raw_response')} AS filt_resp FROM fx_responses", "fx_responses"))

RUN_PERM = ("rperm", """
SELECT conv_id, turn, list(i ORDER BY md5(concat('42:', CAST(conv_id AS VARCHAR), ':', CAST(Question_nr AS VARCHAR), ':',
                                                 CAST(i AS VARCHAR))), i) AS perm
FROM (SELECT conv_id, turn, Question_nr FROM fx_responses) s, range(4) t(i) GROUP BY conv_id, turn""")
SCORED_SQL = f"""
SELECT r.*, array_to_string(p.perm, ',') AS quest_order, {parse_answer_sql('r.raw_response')} AS filt_resp,
       {unpermute_sql(parse_answer_sql('r.raw_response'), 'p.perm')} AS answer
FROM fx_responses r JOIN rperm p USING (conv_id, turn)"""

register("unpermute_answer", with_fx("SELECT conv_id, turn, quest_order, filt_resp, answer FROM scored",
                                     "fx_responses", RUN_PERM, ("scored", SCORED_SQL)))

register("join_answer_key", with_fx("""
SELECT s.conv_id, s.turn, s.Question_nr, s.answer, k.Correct, k.Difficulty,
       coalesce(CAST(s.answer = k.Correct AS INT), 0) AS Cor_answer
FROM scored s LEFT JOIN fx_mcq k USING (Question_nr)""",
                                    "fx_responses", "fx_mcq", RUN_PERM, ("scored", SCORED_SQL)))

RUN_PAT = "^eval_([^_]+)_(.+?)_(no_perm|perm)_benchmark_([0-9]{8}-[0-9]{6})$"
PARSED_RUNS = f"""
SELECT file_id, file_name, sfx,
  CASE WHEN regexp_matches(core, '{RUN_PAT}') THEN regexp_extract(core, '{RUN_PAT}', 1) END AS model_short,
  CASE WHEN regexp_matches(core, '{RUN_PAT}') THEN regexp_extract(core, '{RUN_PAT}', 2) END AS vd_name,
  CASE WHEN regexp_matches(core, '{RUN_PAT}') THEN regexp_extract(core, '{RUN_PAT}', 3) END AS perm_label,
  CASE WHEN regexp_matches(core, '{RUN_PAT}') THEN regexp_extract(core, '{RUN_PAT}', 4) END AS timestamp,
  regexp_matches(core, '{RUN_PAT}') AS valid
FROM (SELECT *, CASE WHEN sfx THEN regexp_replace(stem, '_perm_q$', '') ELSE stem END AS core
      FROM (SELECT *, ends_with(stem, '_perm_q') AS sfx
            FROM (SELECT file_id, file_name, regexp_replace(file_name, '\\.[^.]*$', '') AS stem
                  FROM fx_run_files WHERE ends_with(file_name, '.json')) a) b) c"""

register("parse_run_name", with_fx("""
SELECT file_id, model_short, vd_name, perm_label, timestamp, CAST(sfx AS INT) AS perm_suffix,
       CAST(valid AS INT) AS valid FROM parsed""", "fx_run_files", ("parsed", PARSED_RUNS)))

register("iteration_number", with_fx("""
SELECT p.file_id, CAST(i.Iteration AS INT) AS Iteration
FROM parsed p JOIN (
  SELECT model_short, vd_name, perm_label, file_name,
         row_number() OVER (PARTITION BY model_short, vd_name, perm_label ORDER BY file_name) AS Iteration
  FROM (SELECT DISTINCT model_short, vd_name, perm_label, file_name FROM parsed WHERE valid) d) i
USING (model_short, vd_name, perm_label, file_name)
WHERE p.valid""", "fx_run_files", ("parsed", PARSED_RUNS)))


def ordinal_sql(c: str, values) -> str:
    return "CASE " + c + " " + " ".join(f"WHEN {q(v)} THEN {i}" for i, v in enumerate(values)) + " END"


register("filter_categories", with_fx(f"""
SELECT event_id, Model_ret, CAST({ordinal_sql('Model_ret', FX.RETRIEVERS)} AS INT) AS ret_ordinal
FROM fx_eval WHERE Model_ret IN {in_list(FX.RETRIEVERS)}""", "fx_eval"))

register("sort_full_report", with_fx(f"""
SELECT event_id, Model, Model_ret, CAST({ordinal_sql('Model_ret', FX.RETRIEVERS)} AS INT) AS category_ordinal,
       Iteration, Question_nr, CAST(row_number() OVER (ORDER BY Model, {ordinal_sql('Model_ret', FX.RETRIEVERS)} NULLS LAST,
       Iteration, Question_nr, event_id) AS INT) AS row_number
FROM fx_eval""", "fx_eval"))

register("union_runs", with_fx("""
SELECT event_id, Model, Model_ret, Question_nr, Cor_answer, round(Elapsed, 4) AS Elapsed, Total_tokens
FROM fx_eval WHERE Iteration % 2 = 1
UNION ALL BY NAME
SELECT event_id, Model, Model_ret, Question_nr, Cor_answer, Difficulty FROM fx_eval WHERE Iteration % 2 = 0""",
                               "fx_eval"))


# ------------------------------------------------------------------ 2.5 report aggregates

EV_CAT = ("ev", f"SELECT * FROM fx_eval WHERE Model IN {in_list(FX.MODELS)} AND Model_ret IN {in_list(FX.RETRIEVERS)}")
EV_HIT = ("evh", f"SELECT *, {hit_sql('Paper_id', 'Context_papers')} AS hit FROM ev")

register("run_accuracy", with_fx("""
SELECT Model, Model_ret, Iteration, round(avg(Cor_answer), 4) AS accuracy
FROM fx_eval GROUP BY Model, Model_ret, Iteration""", "fx_eval"))

register("accuracy_pivot", with_fx(
    "SELECT Model, Model_ret, " + ", ".join(
        f"round(avg(Cor_answer) FILTER (WHERE Difficulty = {q(d)}), 4) AS {d}" for d in FX.DIFFICULTIES)
    + " FROM ev WHERE Difficulty IS NOT NULL GROUP BY Model, Model_ret", "fx_eval", EV_CAT))

register("majority_vote", with_fx("""
SELECT Model, Model_ret, round(avg(CASE WHEN n_correct >= ceil(n_runs / 2) THEN 1 ELSE 0 END), 4) AS majority_accuracy
FROM (SELECT Model, Model_ret, Question_nr, Difficulty, sum(Cor_answer) AS n_correct, count(Cor_answer) AS n_runs
      FROM ev WHERE Difficulty IS NOT NULL GROUP BY Model, Model_ret, Question_nr, Difficulty) v
GROUP BY Model, Model_ret""", "fx_eval", EV_CAT))


def sd_sql(keys: list[str], where: str = "TRUE", cor_name: str = "Cor_answer", hit_name: str = "hit") -> str:
    g = ", ".join(keys)
    return f"""
SELECT {g}, {mean_sd_sql('avg(Cor_answer)', 'stddev_samp(Cor_answer)')} AS {cor_name},
       {mean_sd_sql('avg(hit)', 'stddev_samp(hit)')} AS {hit_name}
FROM evh WHERE {where} GROUP BY {g}"""


SD_DIFF = ("sd_diff", sd_sql(["Model", "Model_ret", "Difficulty"], f"Difficulty IN {in_list(FX.DIFFICULTIES)}"))
SD_WIDE = ("sd_wide", "SELECT Model, Model_ret, " + ", ".join(
    f"first({m}) FILTER (WHERE Difficulty = {q(d)}) AS {m}_{d}" for d in FX.DIFFICULTIES for m in ("Cor_answer", "hit"))
    + " FROM sd_diff GROUP BY Model, Model_ret")
SD_ALL = ("sd_all", sd_sql(["Model", "Model_ret"], "TRUE", "Cor_answer_summary", "hit_summary"))

register("sd_summary", with_fx("SELECT * FROM sd_diff", "fx_eval", EV_CAT, EV_HIT, SD_DIFF))
register("sd_summary_wide", with_fx("SELECT * FROM sd_wide", "fx_eval", EV_CAT, EV_HIT, SD_DIFF, SD_WIDE))
register("sd_overall", with_fx("SELECT * FROM sd_all", "fx_eval", EV_CAT, EV_HIT, SD_ALL))
register("join_summaries", with_fx("SELECT * FROM sd_wide JOIN sd_all USING (Model, Model_ret)",
                                   "fx_eval", EV_CAT, EV_HIT, SD_DIFF, SD_WIDE, SD_ALL))

register("summary_grouping_sets", with_fx(f"""
SELECT Model, Model_ret, Difficulty, CAST(GROUPING(Model, Model_ret, Difficulty) AS INT) AS level,
       {mean_sd_sql('avg(Cor_answer)', 'stddev_samp(Cor_answer)')} AS Cor_answer,
       {mean_sd_sql('avg(hit)', 'stddev_samp(hit)')} AS hit
FROM evh GROUP BY GROUPING SETS ((Model, Model_ret, Difficulty), (Model, Model_ret))
HAVING NOT (GROUPING(Model, Model_ret, Difficulty) = 0 AND Difficulty IS NULL)""", "fx_eval", EV_CAT, EV_HIT))

TWO_STEP_VARS = {"Cor_answer": "proportion", "Elapsed": "mean", "Latency": "mean", "Price": "mean",
                 "is_paper_id_in_context": "mean"}
EV2 = ("ev2", f"""SELECT *, {throughput_sql()} AS Latency, {cost_sql()} AS Price,
       {precision_sql('Paper_id', 'Context_papers', 10)} AS is_paper_id_in_context FROM fx_eval""")


def two_step_sql(keys: list[str], text: bool) -> str:
    g = ", ".join(keys)
    per_q = (f"SELECT {g}, Question_nr, " + ", ".join(f"avg({v}) AS {v}" for v in TWO_STEP_VARS)
             + f" FROM ev2 WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in [*keys, "Question_nr"])
             + f" GROUP BY {g}, Question_nr")
    aggs = ", ".join(f"avg({v}) AS {v}__mean, stddev_samp({v}) AS {v}__sd, count({v}) AS {v}__n, sum({v}) AS {v}__sum"
                     for v in TWO_STEP_VARS)
    outs = []
    for v, kind in TWO_STEP_VARS.items():
        if kind == "proportion":
            low, upp = ac_bounds_sql(f"{v}__sum", f"{v}__n")
        else:
            low, upp = t_bounds_sql(f"{v}__mean", f"{v}__sd", f"{v}__n", v in ("Latency", "Price"))
        if text:
            outs.append(f"{interval_text_sql(f'{v}__mean', low, upp)} AS {v}")
        else:
            outs.append(f"{v}__mean AS mean_{v}, {low} AS ci_low_{v}, {upp} AS ci_upp_{v}")
    return f"SELECT {g}, {', '.join(outs)} FROM (SELECT {g}, {aggs} FROM ({per_q}) pq GROUP BY {g}) a"


register("two_step_summary", with_fx(two_step_sql(["Model", "Model_ret"], True), "fx_eval", EV2))


def _two_stage_sql() -> str:
    g = "Model, Model_ret"
    aggs = ", ".join(f"avg(mean_{v}) AS {v}__mean, stddev_samp(mean_{v}) AS {v}__sd, count(mean_{v}) AS {v}__n"
                     for v in TWO_STEP_VARS)
    outs = []
    for v in TWO_STEP_VARS:
        low, upp = t_bounds_sql(f"{v}__mean", f"{v}__sd", f"{v}__n", v in ("Latency", "Price"))
        outs.append(f"{interval_text_sql(f'{v}__mean', low, upp)} AS {v}")
    return f"SELECT {g}, {', '.join(outs)} FROM (SELECT {g}, {aggs} FROM stage1 GROUP BY {g}) a"


register("two_stage_analysis", with_fx(_two_stage_sql(), "fx_eval", EV2,
                                       ("stage1", two_step_sql(["Model", "Model_ret", "Iteration"], False))))


# ------------------------------------------------------------------ 2.4 retrieval


def dot_sql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda t: CAST(t[1] AS DOUBLE) * CAST(t[2] AS DOUBLE)))"


def norm_sql(a: str) -> str:
    return f"sqrt(list_sum(list_transform({a}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


def unit_sql(a: str) -> str:
    return f"list_transform({a}, lambda x: CAST(x AS DOUBLE) / {norm_sql(a)})"


def topk_sql(src: str, k: int, qid: str = "query_id", pid: str = "point_id", extra: str = "") -> str:
    return f"""
SELECT {qid}, CAST("rank" AS INT) AS "rank", {pid}, round(score, 4) AS score{extra}
FROM (SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY score DESC, {pid}) AS "rank" FROM {src}) r
WHERE "rank" <= {k}"""


EQ = ("q", "SELECT b.item_id AS query_id, e.embedding AS qv FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id")
EP = ("p", "SELECT vec_id AS point_id, embedding AS pv FROM embeddings")
COS = ("s", f"SELECT query_id, point_id, {dot_sql('pv', 'qv')} / ({norm_sql('pv')} * {norm_sql('qv')}) AS score FROM p, q")
DOT = ("s", f"SELECT query_id, point_id, {dot_sql('pv', 'qv')} AS score FROM p, q")

register("dense_topk", with_fx(topk_sql("s", 5), EQ, EP, COS))
register("dense_topk_arrow", with_fx(topk_sql("s", 5), EQ, EP, COS))
register("topk_per_query", with_fx(topk_sql("s", 10), EQ, EP, DOT))
register("rescore_topk", with_fx(topk_sql("s", 5), EQ, EP, DOT))

PAYLOAD_POINTS = ("pp", """SELECT *, vec_id AS point_id,
  CASE WHEN type IN ('text', 'table') THEN concat('chunk ', CAST(vec_id AS VARCHAR)) ELSE '' END AS page_content
FROM fx_points""")
TENANT_HITS = ("th", f"""SELECT * FROM (
  SELECT pp.*, q.query_id, {dot_sql('pp.embedding', 'q.qv')} / ({norm_sql('pp.embedding')} * {norm_sql('q.qv')}) AS score,
         row_number() OVER (PARTITION BY q.query_id ORDER BY
           {dot_sql('pp.embedding', 'q.qv')} / ({norm_sql('pp.embedding')} * {norm_sql('q.qv')}) DESC, pp.point_id) AS "rank"
  FROM pp JOIN (SELECT b.item_id AS query_id, f.embedding AS qv, f.username FROM benchmark b
                JOIN fx_points f ON f.vec_id = b.item_id) q
    ON pp.username = q.username) r WHERE "rank" <= 5""")
DENSE_HITS = ("dh", f"""SELECT * FROM (
  SELECT pp.*, q.query_id, {dot_sql('pp.embedding', 'q.qv')} / ({norm_sql('pp.embedding')} * {norm_sql('q.qv')}) AS score,
         row_number() OVER (PARTITION BY q.query_id ORDER BY
           {dot_sql('pp.embedding', 'q.qv')} / ({norm_sql('pp.embedding')} * {norm_sql('q.qv')}) DESC, pp.point_id) AS "rank"
  FROM pp, (SELECT b.item_id AS query_id, e.embedding AS qv FROM benchmark b
            JOIN embeddings e ON e.vec_id = b.item_id) q) r WHERE "rank" <= 5""")

register("dense_topk_tenant", with_fx("""
SELECT query_id, CAST("rank" AS INT) AS "rank", point_id, round(score, 4) AS score, username, document_name FROM th""",
                                      "fx_points", PAYLOAD_POINTS, TENANT_HITS))


def maxsim_sql(patches: str, tokens: str, on: str = "", normalize: bool = False) -> str:
    pv = unit_sql("p.embedding") if normalize else "p.embedding"
    tv = unit_sql("t.embedding") if normalize else "t.embedding"
    join = f"{patches} p JOIN {tokens} t ON {on}" if on else f"{patches} p, {tokens} t"
    m = (f"SELECT t.query_id, t.token_no, p.page_key, max({dot_sql(pv, tv)}) AS m FROM {join} "
         f"GROUP BY t.query_id, t.token_no, p.page_key")
    return f"SELECT query_id, page_key, sum(m) AS score FROM ({m}) mm GROUP BY query_id, page_key"


register("maxsim_topk", with_fx(topk_sql("ms", 5, pid="page_key"), "fx_patches", "fx_qtokens",
                                ("ms", maxsim_sql("fx_patches", "fx_qtokens"))))
register("maxsim_topk_packed", ORACLE["maxsim_topk"])
register("maxsim_cosine_topk", with_fx(
    topk_sql("ms", 5, pid="page_key"), "fx_patches", "fx_qtokens",
    ("sp", "SELECT page_key, patch_no, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (patch_no + 1)) "
           "AS embedding FROM fx_patches"),
    ("ms", maxsim_sql("sp", "fx_qtokens", normalize=True))))
register("maxsim_topk_tenant", with_fx(
    topk_sql("ms", 5, pid="page_key"), "fx_patches", "fx_qtokens",
    ("ms", maxsim_sql("fx_patches", "fx_qtokens", on="'user' || CAST(p.page_key % 5 AS VARCHAR) = "
                                                   "'user' || CAST(t.query_id % 5 AS VARCHAR)"))))

PAGE_HITS = ("ph", f"""SELECT query_id, "rank", page_key,
  concat('Paper', CAST(page_key % 25 + 1 AS VARCHAR), '_pg_', CAST(page_key AS VARCHAR)) AS label
FROM ({topk_sql('ms', 5, pid='page_key')}) h""")
CTX = ("ctx", """SELECT query_id, count(*) AS n,
  concat('[', string_agg(concat('''', label, ''''), ', ' ORDER BY "rank"), ']') AS Context_papers
FROM ph GROUP BY query_id""")
MS = ("ms", maxsim_sql("fx_patches", "fx_qtokens"))

register("context_lists", with_fx("SELECT query_id, Context_papers FROM ctx",
                                  "fx_patches", "fx_qtokens", MS, PAGE_HITS, CTX))
register("no_context", with_fx("""
SELECT m.Question_nr, CAST(coalesce(c.n, 0) AS INT) AS n_context, coalesce(c.Context_papers, '[]') AS Context_papers
FROM fx_mcq m LEFT JOIN ctx c ON m.Question_nr = c.query_id""",
                               "fx_mcq", "fx_patches", "fx_qtokens", MS, PAGE_HITS, CTX))


def ref_label_sql(doc: str, page_no: str, file_name: str = "NULL", page_id: str = "NULL") -> str:
    d = f"coalesce(nullif({doc}, ''), nullif({file_name}, ''), 'doc')"
    page = (f"CASE WHEN {page_no} IS NOT NULL AND {page_no} <> 0 THEN CAST({page_no} AS VARCHAR) "
            f"ELSE CAST({page_id} AS VARCHAR) END")
    return f"CASE WHEN ({page}) IS NULL THEN {d} ELSE concat({d}, '_pg_', {page}) END"


CTX_ENTRY = f"""CASE WHEN type IN ('image', 'pdf_page') THEN 'image' ELSE 'text' END AS ctx_type,
  CASE WHEN type IN ('text', 'table') THEN page_content ELSE '' END AS ctx_text,
  img_link AS image_path, {ref_label_sql('document_name', 'page_no')} AS reference"""

register("project_context", with_fx(f"""
SELECT query_id, CAST("rank" AS INT) AS "rank", {CTX_ENTRY}, round(score, 4) AS score FROM th""",
                                    "fx_points", PAYLOAD_POINTS, TENANT_HITS))

P_IMG, P_TXT = q("Describe the figure."), q("Summarise the passage: ")

register("joined_context", with_fx(f"""
SELECT query_id,
  coalesce(string_agg(img_link, '|' ORDER BY "rank") FILTER (WHERE type = 'image'), '') AS img_links,
  coalesce(string_agg(page_content, chr(10) ORDER BY "rank") FILTER (WHERE type IN ('text', 'table')), '') AS text_joined,
  concat('text:', {P_IMG},
         coalesce(string_agg(page_content, chr(10) ORDER BY "rank") FILTER (WHERE type IN ('text', 'table')), ''),
         coalesce(string_agg(concat(' || image_url:', img_link), '' ORDER BY "rank") FILTER (WHERE type = 'image'), '')
  ) AS message
FROM dh GROUP BY query_id""", "fx_points", PAYLOAD_POINTS, DENSE_HITS))

register("per_hit_prompts", with_fx(f"""
SELECT query_id, CAST("rank" AS INT) AS "rank", type,
  CASE WHEN type = 'image' THEN concat('text:', {P_IMG}, ' || image_url:', coalesce(img_link, ''))
       WHEN type IN ('text', 'table') THEN concat('text:', {P_TXT}, coalesce(page_content, ''))
       ELSE concat('text:', {P_TXT}) END AS message
FROM dh""", "fx_points", PAYLOAD_POINTS, DENSE_HITS))

register("single_message", with_fx(f"""
SELECT query_id, concat('text:', {P_IMG},
  coalesce(string_agg(concat(' || image_url:', img_link), '' ORDER BY "rank") FILTER (WHERE type = 'image'), '')) AS message
FROM dh GROUP BY query_id""", "fx_points", PAYLOAD_POINTS, DENSE_HITS))


def choices_sql(a: str, b: str, c: str, d: str, sep: str) -> str:
    s = f", {sep}, " if sep else ", "
    return f"concat('A. ', {a}{s}'B. ', {b}{s}'C. ', {c}{s}'D. ', {d})"


def instruction_sql(question: str, a: str, b: str, c: str, d: str) -> str:
    return (f"concat({q(EXP1_HEAD)}, 'Question: ', {question}, chr(10) || 'Choices:' || chr(10), "
            f"{choices_sql(a, b, c, d, 'chr(10)')}, chr(10), {q(EXP1_TAIL)})")


EXP1_Q = ("eq", f"""SELECT m.*, {instruction_sql('m.question', '[m.A, m.B, m.C, m.D][perm[1] + 1]',
                                                '[m.A, m.B, m.C, m.D][perm[2] + 1]', '[m.A, m.B, m.C, m.D][perm[3] + 1]',
                                                '[m.A, m.B, m.C, m.D][perm[4] + 1]')} AS instruction
FROM fx_mcq m JOIN perm USING (Question_nr)""")

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
ENTRIES = ("en", f"""SELECT query_id AS Question_nr, "rank", ctx_type, ctx_text, image_path, reference,
  concat(CASE WHEN ctx_type = 'image' AND image_path IS NOT NULL AND image_path <> ''
              THEN concat(' || image_url:', image_path) ELSE '' END,
         CASE WHEN ctx_text IS NOT NULL AND {STRIP.format(x='ctx_text')} <> ''
              THEN concat(' || text:[', reference, '] ', {STRIP.format(x='ctx_text')}) ELSE '' END) AS parts,
  (ctx_type = 'image' AND image_path IS NOT NULL AND image_path <> '')
  OR (ctx_text IS NOT NULL AND {STRIP.format(x='ctx_text')} <> ''
      AND row_number() OVER (PARTITION BY query_id, reference ORDER BY "rank") = 1) AS keep_ref
FROM (SELECT query_id, "rank", {CTX_ENTRY} FROM dh) x""")

register("message_parts", with_fx("""
SELECT e.Question_nr, concat('text:', e.instruction, coalesce(g.parts, '')) AS message,
       coalesce(g.refs, '') AS context_refs
FROM eq e LEFT JOIN (
  SELECT Question_nr, string_agg(parts, '' ORDER BY "rank") AS parts,
         string_agg(reference, '|' ORDER BY "rank") FILTER (WHERE keep_ref) AS refs
  FROM en GROUP BY Question_nr) g USING (Question_nr)""",
                                  "fx_mcq", perm_cte("fx_mcq"), EXP1_Q, "fx_points", PAYLOAD_POINTS, DENSE_HITS,
                                  ENTRIES))

_PAGE_MESSAGE = """
SELECT m.Question_nr, concat('text:', m.question, ' || text:Context information:', coalesce(g.parts, '')) AS message
FROM fx_mcq m JOIN (SELECT query_id, string_agg({part}, '' ORDER BY "rank") AS parts FROM ph GROUP BY query_id) g
  ON m.Question_nr = g.query_id"""
register("image_context_message", with_fx(_PAGE_MESSAGE.format(
    part="concat(' || image_url:/pages/', CAST(page_key AS VARCHAR), '.jpg')"),
    "fx_mcq", "fx_patches", "fx_qtokens", MS, PAGE_HITS))
register("message_payloads", with_fx(_PAGE_MESSAGE.format(
    part="CASE WHEN page_key % 2 = 0 THEN concat(' || image_url:data:image/png;base64,', "
         "base64(encode(concat('image of page ', CAST(page_key AS VARCHAR))))) ELSE '' END"),
    "fx_mcq", "fx_patches", "fx_qtokens", MS, PAGE_HITS))

register("two_stage_prompt", with_fx(f"""
SELECT m.Question_nr, concat('text:', m.question, {q(CONTEXT_LEAD)}, s.joined) AS message
FROM fx_mcq m JOIN (
  SELECT query_id AS Question_nr,
         string_agg(concat('summary of ', document_name, ' ', page_content), chr(10) ORDER BY "rank") AS joined
  FROM dh GROUP BY query_id) s USING (Question_nr)""",
                                     "fx_mcq", "fx_points", PAYLOAD_POINTS, DENSE_HITS))


# ------------------------------------------------------------------ 2.9 text functions

register("choice_string", with_fx(f"""
SELECT Question_nr, {choices_sql('A', 'B', 'C', 'D', 'chr(10)')} AS choices_exp1,
       {choices_sql('A', 'B', 'C', 'D', '')} AS choices_exp2 FROM fx_mcq""", "fx_mcq"))

register("instruction_block", with_fx("SELECT Question_nr, instruction FROM eq", "fx_mcq", perm_cte("fx_mcq"),
                                      EXP1_Q))

register("exp2_prompts", with_fx(f"""
SELECT Question_nr, concat(question, {q(EXP2_RETRIEVAL_MID)}, {choices_sql('A', 'B', 'C', 'D', '')}) AS retrieval_prompt,
       concat({q(EXP2_HEAD)}, question, {q(EXP2_MID)}, {choices_sql('A', 'B', 'C', 'D', '')})
         AS model_prompt
FROM fx_mcq""", "fx_mcq"))

register("reference_label", with_fx(f"""
SELECT vec_id, {ref_label_sql('document_name', 'page_no', 'file_name', 'page_id')} AS label,
       concat(split_part(coalesce(file_name, 'x.y'), '.', 1), '_pg_', CAST(vec_id AS VARCHAR)) AS page_label
FROM (SELECT vec_id,
        CASE WHEN vec_id % 7 = 0 THEN '' ELSE document_name END AS document_name,
        CASE WHEN vec_id % 11 = 0 THEN NULL ELSE concat('file', CAST(vec_id AS VARCHAR), '.png') END AS file_name,
        CASE WHEN vec_id % 5 = 0 THEN 0 ELSE page_no END AS page_no,
        CASE WHEN vec_id % 3 = 0 THEN NULL ELSE vec_id END AS page_id
      FROM fx_points) x""", "fx_points"))

register("truncate_response", with_fx("""
SELECT conv_id, turn, substr(raw_response, 1, 50) AS resp_init, substr(raw_response, 1, 1500) AS resp_cut
FROM fx_responses""", "fx_responses"))

register("image_payload", f"""
SELECT conv_id, turn, concat('data:image/jpeg;base64,', base64(encode(text))) AS url FROM conversations""")

register("extract_content", with_fx("""
SELECT conv_id, turn,
  CASE json_type(j, '$.content') WHEN 'VARCHAR' THEN j ->> '$.content'
       WHEN 'ARRAY' THEN array_to_string(list_transform(from_json(j -> '$.content', '[{"text":"VARCHAR"}]'),
                                                        lambda x: coalesce(x.text, '')), '')
       ELSE '' END AS content
FROM (SELECT conv_id, turn,
        CASE WHEN turn % 2 = 0 THEN json_object('content', raw_response)::VARCHAR
             ELSE json_object('content', [json_object('type', 'text', 'text', raw_response),
                                          json_object('type', 'text', 'text', '!')])::VARCHAR END AS j
      FROM fx_responses) r""", "fx_responses"))


# ------------------------------------------------------------------ 2.1 collections

register("create_collection", with_fx("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim, label FROM fx_points",
                                      "fx_points"))

register("upsert_points", """
SELECT vec_id, label, version FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY version DESC, src DESC) AS rn FROM (
    SELECT vec_id, label, 1 AS version, 0 AS src FROM embeddings
    UNION ALL SELECT vec_id, label + 100, 2, 1 FROM embeddings WHERE vec_id % 3 = 0) u) r
WHERE rn = 1""")

register("scroll_points", with_fx("""
SELECT vec_id, document_name, type FROM fx_points
WHERE username = 'user3' AND type IN ('text', 'table') AND NOT coalesce(document_name = '', false)""", "fx_points"))

DEL = "(document_name IN ('Paper1.pdf', 'Paper2.pdf', 'Paper3.pdf') AND username = 'user3')"
register("delete_points", with_fx(f"SELECT vec_id FROM fx_points WHERE NOT coalesce({DEL}, false)", "fx_points"))

register("distinct_links", with_fx(f"""
SELECT DISTINCT link FROM (
  SELECT img_link AS link FROM fx_points WHERE {DEL}
  UNION ALL SELECT img_link FROM fx_points WHERE type = 'pdf_page' AND {DEL}) u
WHERE link IS NOT NULL AND link <> '' ORDER BY link""", "fx_points"))

register("distinct_documents", with_fx("""
SELECT DISTINCT document_name, document_link FROM fx_points
WHERE document_name IS NOT NULL AND document_name <> '' ORDER BY document_name""", "fx_points"))

register("collection_inventory", with_fx("""
SELECT DISTINCT d.document_name, d.document_link, f.path
FROM (SELECT DISTINCT document_name, document_link FROM fx_points WHERE document_name <> '') d
JOIN (SELECT DISTINCT concat('/corpus/', CASE WHEN page_id % 3 = 0 THEN 'old_' ELSE '' END, 'Paper',
                             CAST(page_id % 30 + 1 AS VARCHAR), '.pdf') AS path FROM pages) f
  ON instr(f.path, d.document_name) > 0""", "fx_points"))

register("tenant_copy", with_fx("""
SELECT vec_id, 'alice' AS username,
  CASE WHEN img_link <> '' THEN concat('./src/vectordb/user_data/alice/',
       array_to_string(string_split(img_link, '/')[greatest(2, len(string_split(img_link, '/')) - 1):], '/'))
       ELSE img_link END AS img_link
FROM fx_points""", "fx_points"))

register("batch_rows", with_fx("""
SELECT vec_id, label, CAST(floor((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) / 4) AS INTEGER) AS batch
FROM fx_points""", "fx_points"))

register("filter_types", with_fx("""
SELECT point_id, CASE WHEN type = 'image' THEN 'image' ELSE 'text' END AS route,
  CASE WHEN type = 'image' THEN '' WHEN type IN ('text', 'table') THEN page_content ELSE '' END AS route_content,
  CASE WHEN type = 'image' THEN img_link END AS route_image
FROM pp""", "fx_points", PAYLOAD_POINTS))

register("filter_models", with_fx("""
SELECT model_name, model_id,
  CASE WHEN 5 = count(*) OVER () THEN ['MM_A', 'MM_B', 'MM_C', 'MM_D', 'MM_E'][CAST(row_number() OVER (ORDER BY model_name) AS INTEGER)] END AS vd_mm
FROM (SELECT model_name, CASE WHEN model_name = 'error' THEN 'Not_working' ELSE model_name END AS model_id
      FROM (SELECT DISTINCT Model_ret AS model_name FROM fx_eval) d) m
QUALIFY model_id <> 'Not_working'""", "fx_eval"))


# ------------------------------------------------------------------ 2.1 sources and sinks


register("align_links", """
SELECT printf('page_%05d.pdf', page_id) AS name, trim(url) AS link FROM pages WHERE trim(url) <> ''""")

register("scan_questions", with_fx("""
SELECT Question_nr, concat('Paper', CAST(Question_nr % 25 + 1 AS VARCHAR)) AS Paper_id, question, A, B, C, D,
       Correct, Difficulty FROM fx_mcq""", "fx_mcq"))

register("shuffle_questions", with_fx("""
SELECT *, CAST(row_number() OVER (ORDER BY shuffle_key, Question_nr) AS INT) AS row_number
FROM (SELECT Question_nr, md5(concat('42:', CAST(Question_nr AS VARCHAR))) AS shuffle_key FROM fx_mcq) s""", "fx_mcq"))

register("scan_config", with_fx("""
SELECT DISTINCT Model AS model_name, upper(Model) AS model_short, concat('MM_', Model) AS mm_vd FROM fx_eval""",
                                "fx_eval"))

register("scan_runs", with_fx("""
SELECT event_id, Model_ret, Question_nr, Cor_answer, round(Elapsed, 4) AS Elapsed, NULL::VARCHAR AS Difficulty,
  'gen-a' AS model_short, 'mm_RAG' AS vd_name, 'perm' AS perm_label, '20250101-101500' AS file_timestamp,
  '20250101-101500' AS run_timestamp, 1 AS permuted_answers, NULL::DOUBLE AS elapsed_time, 1 AS valid
FROM fx_eval WHERE Iteration % 2 = 1
UNION ALL
SELECT event_id, Model_ret, Question_nr, Cor_answer, NULL::DOUBLE, Difficulty, 'gen-b', 'text_RAG', 'no_perm',
  '20250102-110000', '20250102-235959', 1, 12.5, 1
FROM fx_eval WHERE Iteration % 2 = 0""", "fx_eval"))

register("merge_runs", with_fx("SELECT event_id, Model, Model_ret, Iteration, Question_nr, Cor_answer FROM fx_eval",
                               "fx_eval"))
register("write_run", with_fx("SELECT event_id, Model, Model_ret, Iteration, Question_nr, Cor_answer FROM fx_eval",
                              "fx_eval"))

register("write_report", ORACLE["ci_summary"])

register("clean_newlines", """
SELECT conv_id, turn, role, replace(replace(text, chr(10), '\\n'), '\\n', chr(10)) AS text FROM conversations""")

register("embedding_cache", f"""
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dim,
       round(CAST(embedding[1] AS DOUBLE) / {norm_sql('embedding')}, 4) AS first_component FROM embeddings""")

register("embedding_cache_fill", ORACLE["embedding_cache"])

register("export_requests", with_fx("""
SELECT CAST(Question_nr AS VARCHAR) AS custom_id, 'gen_a' AS model, instruction AS prompt FROM eq""",
                                    "fx_mcq", perm_cte("fx_mcq"), EXP1_Q))

register("import_responses", with_fx("""
SELECT r.custom_id, coalesce(a.n, 0) AS n_responses, CASE WHEN a.ok = 1 THEN a.content END AS content,
       CASE WHEN a.n IS NULL THEN 'missing' WHEN a.ok = 1 THEN 'ok' ELSE 'failed' END AS status
FROM (SELECT concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS custom_id
      FROM conversations WHERE role = 'user') r
LEFT JOIN (
  SELECT custom_id, count(*) AS n,
         max(CASE WHEN content IS NOT NULL AND NOT regexp_matches(content, '^\\[error\\]') THEN 1 ELSE 0 END) AS ok,
         arg_max(content, (CASE WHEN content IS NOT NULL AND NOT regexp_matches(content, '^\\[error\\]') THEN 1 ELSE 0 END,
                           content)) AS content
  FROM (SELECT concat(CAST(conv_id AS VARCHAR), '-', CAST(turn - 1 AS VARCHAR)) AS custom_id,
               raw_response AS content FROM fx_responses) x
  GROUP BY custom_id) a USING (custom_id)""", "fx_responses"))


# ------------------------------------------------------------------ 2.2 ingestion


# the rules of element extraction, written out on their own
_KINDS = {"title": "title", **{f"h{i}": "heading" for i in range(1, 7)}, "p": "text", "li": "list_item",
          "td": "table_cell", "th": "table_cell"}
_BLOCKS = ("title h1 h2 h3 h4 h5 h6 p li td th html head body div section article main header footer nav aside ul ol dl "
           "dt dd table caption thead tbody tfoot tr blockquote pre figure figcaption address form fieldset hr")
_drop = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<!doctype[^>]*>"
_block = r"(?i)<(/?(?:" + _BLOCKS.replace(" ", "|") + r"))(?:\s[^>]*)?/?>"


def _decode_sql(x: str) -> str:
    """Numeric references by chr(), then the named ones."""
    digits = "regexp_extract(p, '^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});', 1)"
    code = (f"CASE WHEN lower({digits}[1]) = 'x' THEN ('0x' || {digits}[2:])::BIGINT ELSE {digits}::BIGINT END")
    x = (f"(SELECT string_split({x}, '&#')[1] || coalesce(array_to_string(list_transform(string_split({x}, '&#')[2:], "
         f"lambda p: CASE WHEN {digits} = '' THEN '&#' || p ELSE chr(({code})::INT) || "
         f"regexp_replace(p, '^([0-9]{{1,7}}|[xX][0-9a-fA-F]{{1,6}});', '') END), ''), ''))")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "\'"), ("&nbsp;", " "), ("&copy;", "©"),
                         ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return x


_kind_case = "CASE tag " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in _KINDS.items()) + " ELSE 'text' END"
register("extract_elements", f"""
SELECT page_id, pos, tag, kind, text FROM (
  SELECT page_id, pos, tag, {_kind_case} AS kind,
         trim(regexp_replace({_decode_sql("regexp_replace(regexp_replace(inner_html, '(?i)<br\\b[^>]*>', ' ', 'g'), '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, CAST(pos AS INTEGER) AS pos,
               CASE WHEN contains(part, chr(2)) AND part[1] <> '/' THEN lower(string_split(part, chr(2))[1])
                    ELSE 'text' END AS tag,
               CASE WHEN contains(part, chr(2)) THEN string_split(part, chr(2))[2] ELSE part END AS inner_html
        FROM (SELECT page_id, unnest(range(len(parts))) AS pos, unnest(parts) AS part
              FROM (SELECT page_id, string_split(regexp_replace(regexp_replace(html, {q(_drop)}, '', 'g'), {q(_block)},
                           chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM pages) a) b) c) d
WHERE text <> ''""")

_cells = """array_to_string(list_transform(regexp_extract_all(menu, '<li>(.*?)</li>', 1),
    lambda c: trim(replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '&amp;', '&'))), ' | ')"""
register("html_tables", f"""
SELECT page_id, CAST(n AS INT) AS table_no, 'Menu & more' AS caption, '| ' || cells || ' |' AS markdown,
       'Menu & more | ' || cells || ' |' AS page_content
FROM (SELECT page_id, n, {_cells} AS cells
      FROM (SELECT page_id, unnest(range(len(menus))) AS n, unnest(menus) AS menu
            FROM (SELECT page_id, regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1) AS menus FROM pages) a) b) c""")
register("html_images", """
SELECT page_id, CAST(n AS INT) AS image_no, '/img/1.png' AS img_link, 'Figure <1>' AS caption
FROM (SELECT page_id, unnest(range(len(regexp_extract_all(html, '<h1>')))) AS n FROM pages) p""")
register("page_image_links", with_fx("""
SELECT vec_id, concat('pages/', replace(document_name, '.pdf', ''), '_', printf('%03d', page_no), '.png') AS img_link
FROM fx_points""", "fx_points"))

ELEM = ("el", "SELECT *, CAST(floor(pos / 40) + 1 AS INTEGER) AS page_no FROM fx_elements")
# greedy packing: pieces of lines, the piece that opens the chunk after one opened at each piece, and the walk along these
CHUNKS = (
    ("pc", """
SELECT *, CAST(sum(n) OVER w AS BIGINT) AS upto, CAST(sum(n) OVER w AS BIGINT) - n AS before, row_number() OVER w AS i
FROM (SELECT *, least(lo + 512, ntok) - lo AS n, array_to_string(w[lo + 1:lo + 512], ' ') AS part
      FROM (SELECT *, unnest(range(0, greatest(ntok, 1), 512)) AS lo
            FROM (SELECT *, len(w) AS ntok FROM (SELECT *,
                    list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS w FROM el) t) u) v) x
WINDOW w AS (PARTITION BY doc_id ORDER BY pos, lo ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    ("nx", """
SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 513 - n FOLLOWING AND UNBOUNDED FOLLOWING)
  AS follow FROM pc"""),
    ("st", """
WITH RECURSIVE s AS (SELECT doc_id, min(i) AS i, 0 AS chunk FROM pc GROUP BY doc_id
  UNION ALL SELECT s.doc_id, follow, chunk + 1 FROM s JOIN nx ON nx.doc_id = s.doc_id AND nx.i = s.i
  WHERE follow IS NOT NULL) SELECT * FROM s"""),
    ("ch", """
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(count(*) AS INTEGER) AS n_lines, CAST(sum(n) AS BIGINT) AS n_tokens,
  arg_min(page_no, i) AS first_page,
  string_agg(concat('#/lines/', CAST(pos AS VARCHAR)), ' ' ORDER BY i) AS ref,
  string_agg(CASE WHEN n = ntok THEN line ELSE part END, chr(10) ORDER BY i) AS text,
  (count(*) = 1 AND arg_min(type, i) = 'table') AS lone_table
FROM (SELECT pc.*, st.chunk FROM pc ASOF JOIN st ON pc.doc_id = st.doc_id AND pc.i >= st.i) c
GROUP BY doc_id, chunk"""))
TABLES_SQL = ("tb", """
SELECT t.doc_id, t.pos, coalesce(p.line, '') AS caption,
  CASE WHEN coalesce(p.line, '') <> '' THEN concat_ws(' ', p.line, t.line) ELSE t.line END AS page_content
FROM el t LEFT JOIN el p ON p.doc_id = t.doc_id AND p.pos = t.pos - 1 AND p.type = 'text'
WHERE t.type = 'table'""")

register("chunk_text", with_fx("""
SELECT doc_id, chunk, n_lines, n_tokens, first_page, ref, text, CAST(lone_table AS INTEGER) AS lone_table FROM ch""",
                               "fx_elements", ELEM, *CHUNKS))

register("table_elements", with_fx("SELECT doc_id, CAST(pos AS INTEGER) AS pos, caption, page_content FROM tb",
                                   "fx_elements", ELEM, TABLES_SQL))

register("image_elements", with_fx("""
SELECT vec_id AS point_id,
  concat(CASE WHEN vec_id % 3 = 0 THEN '' ELSE concat('Figure ', CAST(vec_id AS VARCHAR), ':') END,
         array_to_string([concat('label ', CAST(label AS VARCHAR)), concat('page ', CAST(page_no AS VARCHAR))], ' '))
    AS page_content
FROM fx_points WHERE type = 'image'""", "fx_points"))

register("number_assets", with_fx("""
SELECT doc_id, CAST(pos AS INTEGER) AS pos, type, CAST(n AS INTEGER) AS asset_no,
  concat('./vd/doc', CAST(doc_id AS VARCHAR), '_', CASE WHEN type = 'image' THEN 'img' ELSE type END, '_',
         printf('%03d', n), '.png') AS img_link
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, type ORDER BY pos) AS n FROM el) x""", "fx_elements", ELEM))

register("corpus_variants", with_fx("""
SELECT 'multimodal' AS variant, doc_id, concat('chunk-', CAST(chunk AS VARCHAR)) AS element_id, 'text' AS type,
       text AS page_content FROM ch WHERE NOT lone_table
UNION ALL SELECT 'multimodal', doc_id, concat('table-', CAST(pos AS VARCHAR)), 'table', page_content FROM tb
UNION ALL SELECT 'text_only', doc_id, concat('chunk-', CAST(chunk AS VARCHAR)), 'text', text FROM ch""",
                                    "fx_elements", ELEM, *CHUNKS, TABLES_SQL))

register("element_counts", with_fx("""
SELECT doc_id, count(*) FILTER (WHERE type = 'text') AS text, count(*) FILTER (WHERE type = 'table') AS "table",
       CAST(0 AS BIGINT) AS image, count(*) AS total
FROM el GROUP BY doc_id""", "fx_elements", ELEM))

register("needs_ocr", with_fx("""
SELECT doc_id, CAST(count(*) FILTER (WHERE page_no = 1 AND type = 'text') = 0 AS INTEGER) AS needs_ocr
FROM el GROUP BY doc_id""", "fx_elements", ELEM))

register("vectorise_text", """
WITH tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^0-9A-Za-z_]+'), lambda w: w <> '')) AS w
             FROM documents),
tf AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 768 AS b, count(*) AS tf FROM tok GROUP BY ALL),
idf AS (SELECT b, ln(((SELECT count(DISTINCT doc_id) FROM documents) + 1.0) / (count(*) + 1.0)) AS idf FROM tf GROUP BY b),
w AS (SELECT doc_id, b, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS norm
      FROM tf JOIN idf USING (b))
SELECT d.doc_id, 768 AS dim, CAST(count(w.b) FILTER (WHERE w.w <> 0) AS INT) AS nnz,
  round(coalesce(sum(CASE WHEN norm > 0 THEN w.w / norm * (w.b + 1) END), 0.0), 4) AS weighted_sum
FROM documents d LEFT JOIN w USING (doc_id) GROUP BY d.doc_id""")

register("overlay_descriptions", with_fx(f"""
SELECT c.model, c.point_id, c.type,
  CASE WHEN c.type = 'image' THEN coalesce(d.description, c.page_content) ELSE c.page_content END AS page_content
FROM (SELECT point_id, type, page_content, unnest({'[' + ', '.join(q(m) for m in FX.MODELS) + ']'}) AS model FROM pp) c
LEFT JOIN (SELECT point_id, model, concat(model, ' describes ', CAST(point_id AS VARCHAR)) AS description
           FROM (SELECT point_id, unnest({'[' + ', '.join(q(m) for m in FX.MODELS) + ']'}) AS model FROM pp
                 WHERE type = 'image') i
           WHERE (point_id + CASE model WHEN {q(FX.MODELS[0])} THEN 0 WHEN {q(FX.MODELS[1])} THEN 1 ELSE 2 END) % 2 = 0) d
  ON c.point_id = d.point_id AND c.model = d.model""", "fx_points", PAYLOAD_POINTS))


# ------------------------------------------------------------------ 2.6 rank tests


_ia = ("ia", "SELECT Model, Question_nr, " + ", ".join(
    f"avg(Cor_answer) FILTER (WHERE Model_ret = {q(r)}) AS {r}" for r in FX.RETRIEVERS)
    + " FROM fx_eval GROUP BY Model, Question_nr")
_pairs = ("pairs", " UNION ALL ".join(
    f"SELECT Model, {q(a)} AS cond_1, {q(b)} AS cond_2, Question_nr, {a} AS x, {b} AS y FROM ia"
    for a, b in combinations(FX.RETRIEVERS, 2)))
_ranks = ("rk", """
SELECT Model, cond_1, cond_2, Question_nr, d, abs_d,
  rank() OVER (PARTITION BY Model, cond_1, cond_2 ORDER BY abs_d)
    + (count(*) OVER (PARTITION BY Model, cond_1, cond_2, abs_d) - 1) / 2.0 AS "rank",
  count(*) OVER (PARTITION BY Model, cond_1, cond_2, abs_d) AS tie_size
FROM (SELECT *, x - y AS d, abs(x - y) AS abs_d FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL AND x - y <> 0) t""")


def two_sided_p_sql(z: str) -> str:
    """erfc(|z| / sqrt 2) by the published fit of relative error 1.2e-7, written out here on its own."""
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.5 * {x}))"
    inner = (f"-1.26551223 + {t} * (1.00002368 + {t} * (0.37409196 + {t} * (0.09678418 + {t} * (-0.18628806 + {t} * "
             f"(0.27886807 + {t} * (-1.13520398 + {t} * (1.48851587 + {t} * (-0.82215223 + {t} * 0.17087277))))))))")
    return f"({t} * exp(({inner}) - {x} * {x}))"


_z = "((V - n * (n + 1) / 4.0 - sign(V - n * (n + 1) / 4.0) * 0.5) / sigma)"
_tests = ("tests", f"""
SELECT u.Model, u.cond_1, u.cond_2, u.n_items_used, coalesce(a.V, 0.0) AS statistic,
  CASE WHEN a.n > 0 AND a.sigma > 0 THEN {two_sided_p_sql(_z)} END AS p_value
FROM (SELECT Model, cond_1, cond_2, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n_items_used
      FROM pairs GROUP BY Model, cond_1, cond_2) u
LEFT JOIN (
  SELECT r.Model, r.cond_1, r.cond_2, r.n, r.V,
         sqrt(r.n * (r.n + 1) * (2 * r.n + 1) / 24.0 - coalesce(t.tie_term, 0.0) / 48.0) AS sigma
  FROM (SELECT Model, cond_1, cond_2, CAST(count(*) AS DOUBLE) AS n,
               sum(CASE WHEN d > 0 THEN "rank" ELSE 0.0 END) AS V FROM rk GROUP BY Model, cond_1, cond_2) r
  LEFT JOIN (SELECT Model, cond_1, cond_2, sum(pow(t, 3) - t) AS tie_term
             FROM (SELECT Model, cond_1, cond_2, abs_d, CAST(count(*) AS DOUBLE) AS t FROM rk
                   GROUP BY Model, cond_1, cond_2, abs_d) g GROUP BY Model, cond_1, cond_2) t
  USING (Model, cond_1, cond_2)) a
USING (Model, cond_1, cond_2)""")

register("item_pairs", with_fx("""
SELECT Model, cond_1, cond_2, Question_nr, round(x, 4) AS x, round(y, 4) AS y FROM pairs""", "fx_eval", _ia, _pairs))
register("wilcoxon_ranks", with_fx("""
SELECT Model, cond_1, cond_2, Question_nr, round(d, 4) AS d, round("rank", 4) AS "rank", tie_size FROM rk""",
                                   "fx_eval", _ia, _pairs, _ranks))
register("wilcoxon_test", with_fx("""
SELECT Model, cond_1, cond_2, n_items_used, round(statistic, 4) AS statistic, round(p_value, 4) AS p_value FROM tests""",
                                  "fx_eval", _ia, _pairs, _ranks, _tests))
register("bonferroni", with_fx("""
SELECT Model, cond_1, cond_2, n_items_used, round(statistic, 4) AS statistic, round(p_value, 4) AS p_value,
       round(least(1.0, p_value * count(*) OVER (PARTITION BY Model)), 4) AS p_bonferroni FROM tests""",
                               "fx_eval", _ia, _pairs, _ranks, _tests))


# ------------------------------------------------------------------ 2.4 plans, 2.9 descriptions

_modes = " UNION ALL ".join(f"SELECT {q(m)} AS mode, {q(v)} AS vector_db, {q(t)} AS eval_type" for m, v, t in EXP1_MODES)
register("run_plan", with_fx(f"""
SELECT model_short, perm_label, CAST(r AS INTEGER) AS "repeat", mode, vector_db, eval_type,
  concat('eval_', model_short, '_', mode, '_', perm_label, '_benchmark') AS output_stub,
  CASE WHEN permute THEN 'Yes' ELSE '' END AS perm_quest,
  CAST(lower(CASE WHEN permute THEN 'Yes' ELSE '' END) IN ('yes', 'true', '1') AS INTEGER) AS permuted
FROM (SELECT DISTINCT replace(Model, '_', '-') AS model_short FROM fx_eval) m,
     (SELECT true AS permute, 'perm' AS perm_label UNION ALL SELECT false, 'no_perm') p,
     range(1, 6) rr(r), ({_modes}) md""", "fx_eval"))

register("exp2_plan", with_fx(f"""
SELECT generator, retriever, CAST(i AS INT) AS iteration
FROM (SELECT DISTINCT Model AS generator FROM fx_eval) g, (SELECT unnest({'[' + ', '.join(q(r) for r in FX.RETRIEVERS) + ']'})
      AS retriever) r, range(1, 6) t(i)""", "fx_eval"))
register("reject_run_files", with_fx("""
SELECT file_id, regexp_replace(file_name, '_benchmark_[0-9]+-[0-9]+', '_benchmark_x') AS file_name
FROM fx_run_files WHERE file_id % 7 = 0 AND file_name LIKE '%.json'""", "fx_run_files"))

_display = {"cor_answer": "Cor_answer", "elapsed": "Elapsed", "tokens": "Total_tokens", "precision": "P@5",
            "throughput": "Throughput", "cost": "Cost", "price_per_correct": "Price-per-cost"}
_desc_case = "CASE Metric " + " ".join(f"WHEN {q(m)} THEN {q(d)}" for m, d in DESCRIPTIONS) + " END"
register("metric_descriptions", "WITH s AS (" + ci_summary_sql(CI_KEYS) + "), long AS ("
         + " UNION ALL ".join(f"SELECT {q(v)} AS Metric, {k} AS cell FROM s" for k, v in _display.items())
         + f""")
SELECT Metric, {_desc_case} AS Description, count(*) FILTER (WHERE cell <> 'N/A') AS n_groups
FROM long GROUP BY Metric""")


# ------------------------------------------------------------------ 2.10 streaming

register("stream_upsert", ORACLE["upsert_points"])
register("stream_run_accuracy", with_fx("""
SELECT Model, Model_ret, round(avg(Cor_answer), 4) AS accuracy, count(*) AS n_rows FROM fx_eval GROUP BY Model, Model_ret""",
                                        "fx_eval"))


# ------------------------------------------------------------------ output rounding

def stable_round_sql(x: str) -> str:
    """Two-step rounding as on the Spark side (catalog.r6): nano-units first
    (absorbs summation-order noise), then half-to-even on integers."""
    x = f"CAST({x} AS DOUBLE)"
    nano = f"CAST(floor(abs({x}) * 1e9 + 0.5) AS BIGINT)"
    r = f"({nano} % 1000)"
    qq = f"({nano} // 1000)"
    up = f"(CASE WHEN {r} > 500 OR ({r} = 500 AND {qq} % 2 = 1) THEN 1 ELSE 0 END)"
    return (f"(CASE WHEN {x} IS NULL OR isnan({x}) THEN NULL "
            f"ELSE (CASE WHEN {x} < 0 THEN -1 ELSE 1 END) * ({qq} + {up}) / 1e6 END)")


def _stable_rounding(sql: str) -> str:
    """Replace each round(expr, 4) of the compared outputs by stable_round_sql(expr)."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            if sql[k] == "(":
                depth += 1
            elif sql[k] == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        inner = sql[j + 6:k]
        if inner.endswith(", 4"):
            out.append(sql[i:j])
            out.append(stable_round_sql(_stable_rounding(inner[:-3])))
        else:
            out.append(sql[i:k + 1])
        i = k + 1


for _k in list(ORACLE):
    ORACLE[_k] = _stable_rounding(ORACLE[_k])
