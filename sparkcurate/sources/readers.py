"""Readers for JSON lines, JSON arrays, downloaded hub datasets and folders of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkcurate.functions.papers import INDEX_RECORD, arxiv_id, paper_id
from sparkcurate.functions.records import first_object, is_object, json_objects
from sparkcurate.functions.text import strip
from sparkcurate.operators.rows import settled
from sparkcurate.session import modified_millis

# Schemas of the records passed between the steps.
SAMPLE_SCHEMA = "instruction string, output string, valid boolean, healed boolean, heal_methods array<string>"
PAPER_SAMPLE_SCHEMA = (
    "instruction string, output string, valid boolean, source_paper string, source_title string, "
    "authors array<string>, year int, abstract string, url string, doi string, source string, "
    "citation_count bigint, pdf_path string"
)


def read_jsonl(spark: SparkSession, path: str, schema: str = SAMPLE_SCHEMA) -> DataFrame:
    """Strict JSON lines: a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str = SAMPLE_SCHEMA) -> DataFrame:
    """JSON lines without the blank and the malformed ones."""
    return parse_lines(spark.read.text(path), schema).filter(~F.col("malformed")).drop("malformed")


def parse_lines(
    lines: DataFrame, schema: str = SAMPLE_SCHEMA, value: str = "value", original: str | None = None
) -> DataFrame:
    """Columns of the schema plus ``malformed`` for every line; blank lines are malformed.

    A line counts as a sample only when it is one JSON object; see :func:`json_objects` for what that may hold.
    Every line is parsed once. ``original`` names a column for the line itself, with all its fields.
    """
    kept = [c for c in lines.columns if c != value]
    stripped = lines.withColumn("_line", strip(F.col(value)))
    parsed = settled(stripped, {"_o": json_objects(F.col("_line"), schema)})
    good = is_object(F.col("_o"), F.col("_line"))
    whole = [F.col(value).alias(original)] if original else []
    return parsed.select(
        *kept, *whole, (~good).alias("malformed"), F.when(good, first_object(F.col("_o"))).alias("_r")
    ).select(*kept, *([original] if original else []), "malformed", "_r.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with ``file`` and its 1-based ``line_no`` in that file, blank lines included.

    A file may be cut into many splits. Within a split, lines come in order; a small table with
    one row per split gives the number of lines before it in its file. Nothing is sorted and
    no file is read as a whole.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = lines.groupBy("file", "_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first")
    )
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_o")
    )
    return lines.join(offsets, ["file", "_start"]).select(
        "file", (F.col("_id") + F.col("_o") + 1).alias("line_no"), "value"
    )


def read_jsonl_counted(spark: SparkSession, path: str, schema: str = SAMPLE_SCHEMA) -> DataFrame:
    """Every line as a sample with ``file``, ``line_no`` and ``malformed``."""
    return parse_lines(read_lines(spark, path), schema)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of objects, one row per element."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def choose_split(available: Sequence[str], wanted: str | None = None) -> str:
    """The wanted split if there is one, else ``train``, else the first."""
    if wanted and wanted in available:
        return wanted
    return "train" if "train" in available else available[0]


def read_hub_dataset(
    spark: SparkSession, splits: dict[str, str], wanted: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """A downloaded hub dataset: ``splits`` maps split names to the paths of their files."""
    return spark.read.format(fmt).load(splits[choose_split(list(splits), wanted)])


def _one_slash(path):
    return F.regexp_replace(path, "^([a-z0-9]+):/+", "$1:/")


def list_files(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """Files of a folder by name: path, size, non-blank lines, modification time.

    Spark lists the folder, with many files in parallel. Of the first scan no content is read, of the second one
    the lines are counted. Scans leave empty files out; only those are looked up one by one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    # Both sides as file:/a/b, however many slashes a scan writes.
    scanned = files.select(
        "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"),
        _one_slash(F.col("path")).alias("_path"),
    )
    names = spark.createDataFrame([(n,) for n in files.inputFiles()], "name string")
    names = names.select("name", _one_slash(F.col("name")).alias("_path"))
    empty = [(r.name, modified_millis(spark, r.name)) for r in names.join(scanned, "_path", "left_anti").collect()]
    listing = scanned.unionByName(
        spark.createDataFrame(empty, "path string, at bigint").select(
            "path", F.lit(0).cast("bigint").alias("size_bytes"), F.timestamp_millis("at").alias("modified"),
            _one_slash(F.col("path")).alias("_path"),
        )
    )
    counts = (
        spark.read.option("pathGlobFilter", pattern).text(folder)
        .filter(F.length(strip(F.col("value"))) > 0)
        .groupBy(_one_slash(F.col("_metadata.file_path")).alias("_path"))
        .agg(F.count(F.lit(1)).alias("line_count"))
    )
    file_name = F.element_at(F.split("path", "/"), -1)
    return (
        listing.join(counts, "_path", "left")
        .select(
            F.regexp_replace(file_name, r"\.[^.]*$", "").alias("name"), "path", "size_bytes",
            F.coalesce("line_count", F.lit(0)).alias("line_count"), "modified",
        )
        .orderBy("name")
    )


def normalise_index_records(raw: DataFrame, record: str = "record") -> DataFrame:
    """Paper rows from raw JSON text of the citation index; other columns are carried along."""
    r = F.col("_r")
    carried = [c for c in raw.columns if c != record]
    return raw.withColumn("_r", F.from_json(F.col(record), INDEX_RECORD)).select(
        *carried,
        paper_id(r["externalIds"]["ArXiv"], r["externalIds"]["DOI"], r["paperId"]).alias("paper_id"),
        F.coalesce(r["title"], F.lit("")).alias("title"),
        F.coalesce(
            F.transform(r["authors"], lambda a: F.coalesce(a["name"], F.lit(""))),
            F.array().cast("array<string>"),
        ).alias("authors"),
        F.coalesce(r["abstract"], F.lit("")).alias("abstract"),
        r["year"].alias("year"),
        r["externalIds"]["DOI"].alias("doi"),
        F.coalesce(r["url"], F.lit("")).alias("url"),
        r["openAccessPdf"]["url"].alias("pdf_url"),
        F.lit("semantic_scholar").alias("source"),
        F.coalesce(r["citationCount"], F.lit(0)).cast("bigint").alias("citation_count"),
        F.lit(None).cast("string").alias("full_text"),
    )


def normalise_arxiv_records(raw: DataFrame) -> DataFrame:
    """Paper rows from arXiv entries: (entry_id, title, authors, summary, published, doi, pdf_url)."""
    known = ("entry_id", "title", "authors", "summary", "published", "doi", "pdf_url")
    carried = [c for c in raw.columns if c not in known]
    return raw.select(
        *carried,
        F.concat(F.lit("arxiv:"), arxiv_id(F.col("entry_id"))).alias("paper_id"),
        "title", "authors", F.col("summary").alias("abstract"), F.year("published").alias("year"),
        "doi", F.col("entry_id").alias("url"), "pdf_url", F.lit("arxiv").alias("source"),
        F.lit(0).cast("bigint").alias("citation_count"), F.lit(None).cast("string").alias("full_text"),
    )

