"""Readers: corpus listings, link files, question sheets, model configs and
run files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import answers as A
from ..operators.ordering import sequence_by_sort
from .csv_records import scan_csv

# Question sheet (fixed schema, no inference).
QUESTION_SCHEMA = T.StructType([
    T.StructField("Question_nr", T.LongType()),
    T.StructField("Paper_id", T.StringType()),
    T.StructField("Nr_data_suppl", T.IntegerType()),
    T.StructField("doi", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("A", T.StringType()),
    T.StructField("B", T.StringType()),
    T.StructField("C", T.StringType()),
    T.StructField("D", T.StringType()),
    T.StructField("Correct", T.StringType()),
    T.StructField("Difficulty", T.StringType()),
])

MODEL_CONFIG_SCHEMA = T.StructType([
    T.StructField(n, T.StringType()) for n in
    ("model_name", "model_short", "port", "text_vd", "mm_vd", "late_inter", "late_inter_short")])

# The default model configuration used when no config file is given.
DEFAULT_MODEL_CONFIG = [
    ("gpt-4o-2024-11-20", "gpt-4o", "9999", "RAG_TEXT", "MM_04_GPT_4o", "vidore/colpali-v1.3-merged", "COL_PALI"),
    ("gpt-4o-mini-2024-07-18", "gpt-4o-mini", "9999", "RAG_TEXT", "MM_05_GPT_4o_mini",
     "vidore/colpali-v1.3-merged", "COL_PALI"),
    ("google/gemma-3-27b-it", "Gemma3-27b", "8006", "RAG_TEXT", "MM_07_GEMMA3_27B",
     "vidore/colpali-v1.3-merged", "COL_PALI"),
]

CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"'}


def scan_corpus(spark: SparkSession, directory: str, suffix: str = ".pdf") -> DataFrame:
    """Files of `directory` whose name ends with `suffix` (any case), sorted
    by name -> (path, name, length).  The file content is not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory)
             .select("path", "length"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return (files.withColumn("name", name)
            .where(F.lower("name").endswith(suffix.lower()))
            .select("path", "name", "length").orderBy("name"))


def align_links(spark: SparkSession, files: DataFrame, links_path: str | None, name_col: str = "name",
                defaults: list[str] | None = None) -> DataFrame:
    """Pair the i-th file (by name) with the i-th non-blank line of a link
    file.  Raises when the counts differ.  Without a file: the first n
    defaults, or '' for every file when there are fewer defaults than files.

    Positions are computed without Python rows: files are numbered in name
    order, lines by file name, split and scan id (which follows the offsets
    within a split), both with the skew-safe numbering of operators.ordering."""
    ordered = sequence_by_sort(files.select(name_col), [], [name_col], "_idx")
    n = ordered.count()
    if links_path is None:
        vals = list(defaults or [])
        vals = vals[:n] if len(vals) >= n else [""] * n
        arr = F.array(*[F.lit(v) for v in vals]) if vals else F.array().cast("array<string>")
        return ordered.orderBy("_idx").select(name_col, F.element_at(arr, F.col("_idx")).alias("link"))
    order = ["_file", "_split", "_scan"]
    lines = (spark.read.text(links_path)
             .select(F.trim("value").alias("link"), F.col("_metadata.file_name").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_scan"))
             .where(F.col("link") != ""))
    lines = sequence_by_sort(lines, [], order, "_idx").drop(*order)
    m = lines.count()
    if m != n:
        raise ValueError(f"link file contains {m} entries, but {n} files were found")
    return ordered.join(lines, "_idx").orderBy("_idx").select(name_col, "link")


def scan_questions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Question sheet with the fixed schema (CSV with header, read in splits, or parquet)."""
    if fmt == "csv":
        return scan_csv(spark, path, QUESTION_SCHEMA, CSV_OPTIONS).drop("file_path", "block", "line")
    return spark.read.parquet(path).select(*[F.col(f.name).cast(f.dataType) for f in QUESTION_SCHEMA.fields])


def shuffle_questions(questions: DataFrame, seed: int = 42, key: str = "Question_nr") -> DataFrame:
    """Seeded random order: by md5('{seed}:{key}').  Deterministic, so a
    retried or re-run job sees the same order."""
    k = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return questions.withColumn("shuffle_key", k).orderBy("shuffle_key")


def scan_config(spark: SparkSession, path: str | None) -> DataFrame:
    """Model configuration: a JSON array file (or JSON lines), else the defaults."""
    if path is None:
        return spark.createDataFrame(DEFAULT_MODEL_CONFIG, MODEL_CONFIG_SCHEMA)
    return spark.read.option("multiLine", "true").schema(MODEL_CONFIG_SCHEMA).json(path)


def scan_runs(spark: SparkSession, csv_path: str | None, json_path: str | None,
              csv_schema: T.StructType | None = None, json_schema: T.StructType | None = None) -> DataFrame:
    """All run files of a folder (CSV and JSON lines), each row tagged with
    its file path and its run's metadata; layouts unioned by name.

    The run's name is the file's, or its folder's where the file is a written
    part ('part-*').  The name gives model_short, vd_name, perm_label and
    file_timestamp; a run header's columns (model, elapsed_time, timestamp,
    permuted_answers) come first where the file has them: run_timestamp and
    permuted_answers fall back to the name.  With `csv_schema`, CSV files are
    read in splits; types are inferred a file a task."""
    frames = []
    if csv_path:
        if csv_schema is not None:
            frames.append(scan_csv(spark, csv_path, csv_schema, CSV_OPTIONS).drop("block", "line"))
        else:
            r = spark.read.options(**CSV_OPTIONS).option("inferSchema", "true")
            frames.append(r.csv(csv_path).withColumn("file_path", F.col("_metadata.file_path")))
    if json_path:
        r = spark.read
        r = r.schema(json_schema) if json_schema is not None else r
        frames.append(r.json(json_path).withColumn("file_path", F.col("_metadata.file_path")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    header = {c: F.col(f"_{c}") for c in ("timestamp", "permuted_answers") if c in out.columns}
    out = out.withColumnsRenamed({c: f"_{c}" for c in header})
    last = F.substring_index("file_path", "/", -1)
    folder = F.substring_index(F.substring_index("file_path", "/", -2), "/", 1)
    out = A.with_run_name(out.withColumn("file_name", F.when(last.startswith("part-"), folder).otherwise(last)), "file_name")
    return out.withColumnRenamed("timestamp", "file_timestamp").withColumns({
        "run_timestamp": F.coalesce(*([header["timestamp"]] if "timestamp" in header else []), F.col("file_timestamp")),
        "permuted_answers": F.coalesce(*([header["permuted_answers"]] if "permuted_answers" in header else []),
                                       F.col("perm_label") == "perm")}).drop(*[f"_{c}" for c in header])


def merge_runs(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "csv",
               pair_cols=("Model", "Model_ret"), out_col: str = "Iteration") -> DataFrame:
    """All run files under `path`, each row tagged with the iteration of its
    file: the file's number (in path order) among the files whose first row
    has the same (model, retriever) pair.  Empty files have no rows and are
    skipped.  Partition folders are not inferred (recursive listing).

    The first row of a file is the one that starts first (CSV: by split and
    line; JSON: by scan id, a run file is one split).  Numbering runs on the
    file list only and is joined back."""
    if fmt == "csv":
        parsed = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        rows, place = scan_csv(spark, path, parsed, CSV_OPTIONS, recursive=True), F.struct("block", "line")
    else:
        r = spark.read.schema(schema).option("recursiveFileLookup", "true")
        rows = (r.format(fmt).load(path).withColumn("file_path", F.col("_metadata.file_path"))
                .withColumns({"block": F.lit(0), "line": F.monotonically_increasing_id()}))
        place = F.col("line")
    pair = list(pair_cols)
    first = rows.groupBy("file_path").agg(
        F.min_by(F.struct(*[F.col(c) for c in pair]), place).alias("_first"))
    files = first.select("file_path", *[F.col(f"_first.{c}").alias(f"_pair_{c}") for c in pair])
    numbered = sequence_by_sort(files, [f"_pair_{c}" for c in pair], ["file_path"], out_col)
    return (rows.join(numbered.select("file_path", out_col), "file_path")
            .drop("block", "line"))
