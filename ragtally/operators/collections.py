"""Vector collections as parquet tables: create (with a dimension check),
upsert by id, filtered scroll, delete with asset-link listing, inventory,
per-user copies and fixed-size batching."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table_exists
from .ordering import sequence_by_sort

# Characters of the grams that the inventory join blocks on.
QGRAM = 6


def create_collection(points: DataFrame, vec_col: str, dim: int, distance: str = "cosine") -> DataFrame:
    """Attach {dim, distance} metadata to the vector column and fail any row
    whose vector has another size (checked row by row inside the plan)."""
    v = F.col(vec_col)
    checked = F.when(F.size(v) == dim, v).otherwise(
        F.raise_error(F.concat(F.lit(f"vector size != {dim}: "), F.size(v).cast("string"))))
    return points.withColumn(vec_col, checked.alias(vec_col, metadata={"dim": dim, "distance": distance}))


def ensure_collection(spark, path: str, schema, vec_col: str, dim: int, distance: str = "cosine") -> DataFrame:
    """Create an empty collection table at `path` unless one exists, then read
    it with the {dim, distance} metadata and the size check attached."""
    if not table_exists(spark, path):
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return create_collection(spark.read.schema(schema).parquet(path), vec_col, dim, distance)


def upsert_points(existing: DataFrame, updates: DataFrame, id_col: str, version_col: str) -> DataFrame:
    """Last write wins per id: the row with the highest version (updates win
    ties over existing rows).  Aggregated with max_by, which combines
    map-side, so each task ships one row per id it saw."""
    cols = [c for c in existing.columns]
    tagged = (existing.withColumn("_src", F.lit(0))
              .unionByName(updates.select(*cols).withColumn("_src", F.lit(1))))
    payload = F.struct(*[F.col(c) for c in cols if c != id_col])
    best = tagged.groupBy(id_col).agg(
        F.max_by(payload, F.struct(F.col(version_col), F.col("_src"))).alias("_row"))
    return best.select(id_col, "_row.*").select(*cols)


def match_filter(must: Mapping[str, object] | None = None,
                 must_not: Mapping[str, object] | None = None) -> Column:
    """Scroll filter: each `must` key equals the value (or is in a list) and
    no `must_not` key does.  Null fields never match a must condition."""
    cond = F.lit(True)
    for key, val in (must or {}).items():
        c = F.col(key)
        cond = cond & F.coalesce(c.isin(list(val)) if isinstance(val, (list, tuple, set)) else (c == val),
                                 F.lit(False))
    for key, val in (must_not or {}).items():
        c = F.col(key)
        hit = c.isin(list(val)) if isinstance(val, (list, tuple, set)) else (c == val)
        cond = cond & ~F.coalesce(hit, F.lit(False))
    return cond


def scroll_points(points: DataFrame, must=None, must_not=None, order_by: str | None = None,
                  limit: int | None = None) -> DataFrame:
    """Filtered scan (filters reach the parquet scan); with `limit` a page of
    that many rows in `order_by` order (a top-N, not a global sort)."""
    out = points.where(match_filter(must, must_not))
    if limit is not None:
        out = out.orderBy(order_by).limit(limit)
    return out


def delete_points(points: DataFrame, selector: Column) -> DataFrame:
    """The collection without the selected rows (null-safe negation)."""
    return points.where(~F.coalesce(selector, F.lit(False)))


def deleted_links(collections: Sequence[DataFrame], selector_fn, link_col: str = "img_link") -> DataFrame:
    """Sorted distinct non-empty asset links of the rows a delete removes,
    over several collections."""
    parts = [c.where(F.coalesce(selector_fn(c), F.lit(False))).select(F.col(link_col).alias("link"))
             for c in collections]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.where(F.col("link").isNotNull() & (F.col("link") != "")).distinct().orderBy("link")


def distinct_documents(points: DataFrame, name_col: str = "document_name",
                       link_col: str = "document_link") -> DataFrame:
    """Distinct (name, link) pairs with a non-empty name, sorted by name."""
    return (points.where(F.col(name_col).isNotNull() & (F.col(name_col) != ""))
            .select(name_col, link_col).distinct().orderBy(name_col, link_col))


def collection_inventory(points: DataFrame, files: DataFrame, path_col: str = "path",
                         name_col: str = "document_name", link_col: str = "document_link",
                         owner: str | None = None, owner_col: str = "username") -> DataFrame:
    """Documents of a collection (of one owner, if given) matched to corpus
    files whose path contains the document name (substring test), one row per
    (document, file) match.

    Exact for any number and length of names, without a loop over pairs: a
    name joins on the one of its grams (QGRAM characters, or the whole of a
    shorter name) that the fewest paths have, then containment is tested.  A
    gram that no path has rules its name out.  Names that share a beginning
    still differ in their rarest gram, so no key gathers them."""
    if owner is not None:
        points = points.where(F.col(owner_col) == owner)
    docs = distinct_documents(points, name_col, link_col)
    size = F.least(F.length(name_col), F.lit(QGRAM))

    def grams(text: str, n: Column) -> Column:
        """Distinct substrings of n characters (none in a shorter text)."""
        at = F.sequence(F.lit(1), F.length(text) - n + 1)
        cut = F.transform(at, lambda i: F.substring(F.col(text), i, n))
        return F.explode(F.array_distinct(F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))))

    # lengths of the names' grams: at most QGRAM values
    sizes = sorted(r[0] for r in docs.select(size.alias("n")).distinct().collect())
    paths = files.select(path_col).where(F.col(path_col).isNotNull()).distinct()
    if not sizes:
        return docs.withColumn(path_col, F.lit(None).cast("string")).where(F.lit(False))
    of_paths = None
    for n in sizes:
        g = paths.select(path_col, grams(path_col, F.lit(n)).alias("_g"))
        of_paths = g if of_paths is None else of_paths.unionByName(g)
    counts = of_paths.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    of_names = docs.select(name_col, link_col, F.size(F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(name_col) - size + 1), lambda i: F.substring(F.col(name_col), i, size)))).alias("_all"),
        grams(name_col, size).alias("_g"))
    rarest = of_names.join(counts, "_g").groupBy(name_col, link_col, "_all").agg(
        F.min_by("_g", F.struct("_n", "_g")).alias("_g"), F.count(F.lit(1)).alias("_found"))
    rarest = rarest.where("_found = _all").select(name_col, link_col, "_g")
    return (rarest.join(of_paths, "_g").where(F.instr(F.col(path_col), F.col(name_col)) > 0)
            .select(name_col, link_col, path_col).distinct().orderBy(name_col, path_col))


def tenant_copy(points: DataFrame, username: str, prefix: str, user_col: str = "username",
                link_col: str = "img_link") -> DataFrame:
    """Copy of a collection for a user: owner set, non-empty asset links moved
    to '{prefix}user_data/{user}/' + the link's last two path parts (one part
    if the link has a single '/', none if it has no '/')."""
    parts = F.split(F.col(link_col), "/")
    tail = F.array_join(F.slice(parts, F.greatest(F.lit(2), F.size(parts) - 1), 2), "/")
    new_link = F.concat(F.lit(f"{prefix}user_data/{username}/"), tail)
    return (points.withColumn(user_col, F.lit(username))
            .withColumn(link_col, F.when(F.col(link_col) != "", new_link).otherwise(F.col(link_col))))


def batch_rows(df: DataFrame, n: int, partition_cols: Sequence[str], order_col: str,
               out_col: str = "batch") -> DataFrame:
    """Batch number floor((row_number - 1) / n) in `order_col` order within
    each partition (run, collection); never a global window, and skew-safe
    numbering (a collection holding most rows is spread over many tasks)."""
    numbered = sequence_by_sort(df, partition_cols, [order_col], "_seq")
    return numbered.withColumn(out_col, F.floor((F.col("_seq") - 1) / n).cast("int")).drop("_seq")


def route_types(df: DataFrame, type_col: str = "type", content_col: str = "page_content",
                link_col: str = "img_link") -> DataFrame:
    """Summary routing: image -> image prompt + its link; text/table -> text
    prompt + content; any other type -> text prompt with empty content."""
    t = F.col(type_col)
    return df.select(
        "*",
        F.when(t == "image", "image").otherwise("text").alias("route"),
        F.when(t == "image", F.lit("")).when(t.isin("text", "table"), F.col(content_col))
         .otherwise(F.lit("")).alias("route_content"),
        F.when(t == "image", F.col(link_col)).alias("route_image"))


def available_models(models: DataFrame, collections: Sequence[str] | None, order_col: str,
                     status_col: str = "model_id", down: str = "Not_working") -> DataFrame:
    """Models in `order_col` order, each paired with the collection of the same
    position when the counts agree; models marked `down` are dropped."""
    m = sequence_by_sort(models, [], [order_col], "_pos")
    if collections is not None:
        names = F.array(*[F.lit(c) for c in collections])
        same = models.count() == len(collections)  # a model list: a handful of rows
        m = m.withColumn("vd_mm", F.element_at(names, F.col("_pos")) if same else F.lit(None).cast("string"))
    return m.where(F.col(status_col) != down).drop("_pos")
