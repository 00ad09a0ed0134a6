"""Structured Streaming forms of the page and scoring jobs.

The original has no stream; these run the same stateless column expressions
on a file stream of stored pages (new files are picked up incrementally), with
the checkpoint under the shared folder so a restarted query resumes where it
stopped. Top-N scoring is row-local (the class probabilities are sorted inside
each row), so a fitted classifier scores a stream directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codelens.functions import html as H
from codelens.functions import text as X
from codelens.session import shared_path

PAGES_SCHEMA = "page_id bigint, url string, html string"


def page_text_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int = 64) -> DataFrame:
    """Streaming (page_id, site, text): extracted, junk dropped, normalized."""
    pages = spark.readStream.schema(PAGES_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)
    return pages.select("page_id", H.site_root("url").alias("site"),
                        X.kept_value(H.html_to_text("html"), lambda v: ~X.junk_rule(v), then=X.normalize_text).alias("text"))


def start_page_text(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint: str | None = None,
                    available_now: bool = True) -> StreamingQuery:
    """Write the page-text stream to parquet; exactly-once through the checkpoint."""
    ckpt = checkpoint or shared_path(spark, "streams/page_text")
    w = page_text_stream(spark, source_dir).writeStream.format("parquet").option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(sink_dir)


def start_scoring(spark: SparkSession, stream: DataFrame, model, entity: str, text_col: str, top_n: int,
                  sink_dir: str, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Score a stream with a fitted classifier and append the top-N codes per
    entity to parquet (exactly-once through the checkpoint)."""
    from codelens.operators.ml import score_top_n

    ckpt = checkpoint or shared_path(spark, "streams/scoring")
    top = score_top_n(model, stream, entity, text_col, top_n)
    w = top.writeStream.format("parquet").option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(sink_dir)
