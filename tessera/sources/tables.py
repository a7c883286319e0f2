"""Sources: page snapshots, files of HTML, and schema files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.schemas import Schema

PAGE_COLUMNS = {
    "url": "string", "html": "string", "text": "string", "title": "string", "status": "int",
    "content_type": "string", "fetched_at": "timestamp", "links": "array<string>",
}


def read_pages(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """A snapshot of fetched pages; the columns of PAGE_COLUMNS that it lacks are null, others stay."""
    df = spark.read.format(form).load(path)
    for name, kind in PAGE_COLUMNS.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, html): one row for each file, whole; the file's path is the URL."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))


def usable(pages: DataFrame) -> DataFrame:
    """Pages that can be cleaned: not empty, and answered with 200 where a status is known."""
    return pages.filter("html is not null and html <> ''").filter("status is null or status = 200")


def fetch_errors(pages: DataFrame) -> DataFrame:
    """``pages`` with ``error_kind``: the challenge class, http-<status> or null."""
    from tessera.operators.pages import challenge_class

    kind = challenge_class(F.col("title"), F.col("html"))
    status = F.when(F.col("status") != 200, F.concat(F.lit("http-"), F.col("status").cast("string")))
    return pages.withColumn("error_kind", F.coalesce(F.nullif(kind, F.lit("")), status))


def read_schema(path: str) -> Schema:
    return Schema.load(path)
