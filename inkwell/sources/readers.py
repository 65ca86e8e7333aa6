"""Readers and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPLOAD_LIMIT = 10 * 1024 * 1024

PAPER = T.StructType([T.StructField(n, t) for n, t in (
    ("title", T.StringType()), ("authors", T.ArrayType(T.StringType())), ("abstract", T.StringType()), ("keywords", T.ArrayType(T.StringType())), ("paper_type", T.StringType()),
    ("field", T.StringType()), ("year", T.StringType()), ("doi", T.StringType()), ("content", T.StringType()), ("filename", T.StringType()), ("word_count", T.LongType()))])


def html_text(c: Column) -> Column:
    """Text of markup: scripts, styles and tags dropped, white space collapsed."""
    c = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def _windows_1252() -> tuple[str, str, str]:
    """Latin-1 characters that the Windows code page names otherwise, its characters, and those it lacks."""
    low, high, none = "", "", ""
    for b in range(0x80, 0xA0):
        try:
            high += bytes([b]).decode("cp1252")
            low += chr(b)
        except UnicodeDecodeError:
            none += chr(b)
    return low, high, none


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 (with or without mark), else as Windows-1252, else as Latin-1."""
    utf8, latin = content.cast("string"), F.decode(content, "ISO-8859-1")
    low, high, none = _windows_1252()
    windows = F.when(latin.rlike(f"[{none}]"), latin).otherwise(F.translate(latin, low, high))
    return F.regexp_replace(F.when(F.is_valid_utf8(utf8), utf8).otherwise(windows), "^\ufeff", "")


def read_uploads(spark: SparkSession, path: str, limit: int = UPLOAD_LIMIT) -> DataFrame:
    """``(path, text, error)`` of files; PDF files by suffix or signature.

    Files over the limit, empty ones and PDF files without text have an error instead of text; no file raises.
    """
    from inkwell.sources.pdf import pdf_column

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    pdf = F.lower("path").endswith(".pdf") | (F.substring(F.col("content"), 1, 5) == F.lit("%PDF-").cast("binary"))
    rows = rows.select("path", (F.col("length") > limit).alias("large"), pdf.alias("pdf"), F.when(F.col("length") <= limit, F.col("content")).alias("content"))
    pages = rows.where("pdf").withColumn("text", pdf_column(F.col("content")))
    other = rows.where("not pdf").withColumn("text", decoded(F.col("content")))
    rows = pages.unionByName(other)
    empty = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == ""
    error = F.when(F.col("large"), "file too large").when(empty & F.col("pdf"), "Error: no extractable text").when(empty, "empty file")
    return rows.select("path", F.when(error.isNull(), F.col("text")).alias("text"), error.alias("error"))


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a ``{"papers": [...]}`` dataset."""
    schema = T.StructType([T.StructField("papers", T.ArrayType(PAPER))])
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("papers").alias("p")).select("p.*")


def read_answers(spark: SparkSession, path: str, least: int = 200) -> DataFrame:
    """``(text, label)`` of JSON lines with human (0) and machine (1) answers; bad lines and short texts go."""
    rows = spark.read.schema("human_answers array<string>, chatgpt_answers array<string>").option("mode", "DROPMALFORMED").json(path)
    one = lambda c, y: rows.select(F.explode(c).alias("text"), F.lit(y).alias("label"))
    return one("human_answers", 0).unionByName(one("chatgpt_answers", 1)).where(F.length("text") >= least)


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """``(path, text)`` of all text and Markdown files, whole."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def inline(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_report(rows: DataFrame, path: str, title: str) -> None:
    """One text line for each row, below the title of its file."""
    line = F.concat_ws(" | ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns])
    rows.select(F.concat(F.lit(f"{title} | "), line).alias("value")).write.mode("overwrite").text(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, dealt out evenly if its scan has fewer splits than the session has cores.

    Such a table is small, since splits of under 4 MB a core aren't made for larger ones, and its file may be one row group, which
    one task reads whatever the splits. Larger tables are read as they lie.
    """
    rows, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if 1 <= rows.rdd.getNumPartitions() < cores else rows
