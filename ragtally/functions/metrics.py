"""Per-row evaluation metrics as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._util import col

def parse_context_list(text) -> Column:
    """A serialised list of strings (Python repr or JSON) -> array<string>.

    Text not starting with '[' or that does not parse gives null.
    """
    c = col(text)
    return F.when(c.startswith("["), F.from_json(c, "array<string>"))


def _gold_matches(paper_id: Column, items: Column) -> Column:
    """Items whose part before '_pg_' equals the gold id, case-insensitive."""
    gold = F.lower(paper_id)
    return F.filter(items, lambda x: F.lower(F.split(x, "_pg_").getItem(0)) == gold)


def hit_at_k(paper_id, context_papers) -> Column:
    """1.0 if any retrieved label names the gold paper, 0.0 if none or no list;
    null when the gold id does not start with 'paper' (any case)."""
    pid = col(paper_id)
    items = parse_context_list(context_papers)
    hit = F.exists(items, lambda x: F.lower(F.split(x, "_pg_").getItem(0)) == F.lower(pid))
    return (F.when(pid.isNull() | ~F.lower(pid).startswith("paper"), F.lit(None).cast("double"))
            .otherwise(F.when(F.coalesce(hit, F.lit(False)), 1.0).otherwise(0.0)))


def precision_at_k(paper_id, context_papers, k: int) -> Column:
    """Matches of the gold paper among the retrieved labels divided by k.

    Null unless the gold id starts with 'Paper' (case-sensitive); 0 when the
    list is missing or malformed.  The denominator is k, not the list length.
    """
    pid = col(paper_id)
    items = parse_context_list(context_papers)
    n = F.coalesce(F.size(_gold_matches(pid, items)), F.lit(0))
    return (F.when(pid.isNull() | ~pid.startswith("Paper"), F.lit(None).cast("double"))
            .otherwise(F.when(items.isNull(), F.lit(0.0)).otherwise(n.cast("double") / F.lit(float(k)))))


def throughput(total_tokens="Total_tokens", elapsed="Elapsed") -> Column:
    """Tokens per second; null (not an error) when elapsed is 0."""
    return F.try_divide(col(total_tokens).cast("double"), col(elapsed).cast("double"))


def cost(model="Model", total_tokens="Total_tokens", prices: Mapping[str, float] | None = None) -> Column:
    """USD cost: tokens / 1e6 x output price of the model; null for unknown models.

    The price list is a literal map (a handful of entries), so the lookup stays
    inside generated code with no join.
    """
    if prices is None:
        raise ValueError("prices: mapping model -> USD per 1M output tokens")
    price_map = F.create_map(*[x for m, p in prices.items() for x in (F.lit(m), F.lit(float(p)))])
    return (col(total_tokens).cast("double") / F.lit(1_000_000.0)) * F.try_element_at(price_map, col(model))


# Report cells as SQL text over column names or expressions.

def format_decimal_sql(x: str, decimals: int) -> str:
    """Fixed-point text of x at `decimals` digits, rounding half to even."""
    return f"format_string('%.{decimals}f', bround({x}, {decimals}))"


def format_ci_cell_sql(mean: str, low: str, upp: str, decimals: int = 3) -> str:
    """'mean\\n[low, upp]' with low floored at 0; 'N/A' when any part is null."""
    return (f"CASE WHEN ({mean}) IS NULL OR ({low}) IS NULL OR ({upp}) IS NULL THEN 'N/A' ELSE "
            f"concat({format_decimal_sql(mean, decimals)}, '\\n[', "
            f"{format_decimal_sql(f'greatest(0.0D, {low})', decimals)}, ', ', "
            f"{format_decimal_sql(upp, decimals)}, ']') END")


def float_text_sql(x: str) -> str:
    """Shortest text of a double as Python prints it ('0.5', '1.0'); null -> 'nan'."""
    return f"coalesce(CAST({x} AS STRING), 'nan')"


def interval_text_sql(mean: str, low: str, upp: str, decimals: int = 3) -> str:
    """'m [l-u]' with each part rounded half-even to `decimals` ('nan' for null)."""
    f = lambda e: float_text_sql(f"bround({e}, {decimals})")
    return f"concat({f(mean)}, ' [', {f(low)}, '-', {f(upp)}, ']')"


def mean_sd_text_sql(mean: str, sd: str, decimals: int = 3) -> str:
    """'m (SD=s)' with both rounded half-even to `decimals`."""
    f = lambda e: float_text_sql(f"bround({e}, {decimals})")
    return f"concat({f(mean)}, ' (SD=', {f(sd)}, ')')"


def format_ci_cell(mean: str, low: str, upp: str, decimals: int = 3) -> Column:
    return F.expr(format_ci_cell_sql(mean, low, upp, decimals))
