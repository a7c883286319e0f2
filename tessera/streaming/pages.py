"""Cleaning as a stream: a folder of pages in, JSON lines out, each URL once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions import url as U
from tessera.operators.pages import clean_html, enough_content
from tessera.sources.sinks import jsonl_column


def page_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string", max_files: int = 64) -> DataFrame:
    """Pages of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def once_per_url(pages: DataFrame) -> DataFrame:
    """The first page of each normalised URL. The visited URLs are the stream's state."""
    return pages.withColumn("visited", U.normalize(F.col("url"))).filter("visited <> ''").dropDuplicates(["visited"]).drop("visited")


def cleaned_stream(pages: DataFrame, clean: str = "default", output: str = "text", least: int = 0) -> DataFrame:
    rows = once_per_url(pages).withColumn("content", clean_html(F.col("html"), clean, output=output)).drop("html")
    return rows.filter(enough_content(F.col("content"), least)) if least else rows


def write_jsonl(rows: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch as JSON lines in a folder named by its number: writing one again replaces it."""

    def put(batch: DataFrame, number: int) -> None:
        batch.select(jsonl_column(batch).alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    w = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
