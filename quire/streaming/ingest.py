"""Incremental ingest: a stream of fetched pages becomes articles of an archive, each address once.

A micro-batch is extracted, freed of known addresses, numbered and written under its batch number.
A batch that runs again overwrites its own output only, so a restart neither loses nor repeats rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quire.functions.url import url_key
from quire.operators.articles import number
from quire.operators.extract import extract

PAGE = T.StructType([T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("fetched_at", T.TimestampType())])


def read_pages(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of pages from Parquet files as they arrive."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", max_files).parquet(path)


def known(spark: SparkSession, out: str, before: int) -> DataFrame | None:
    """Articles of earlier batches; None if there are none."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    except AnalysisException:
        return None
    return df.where(F.col("batch") < before)


def write_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """Extract the new pages of a batch and write them as batch=<id>."""
    spark = batch.sparkSession
    key = url_key(F.col("url"))
    first = batch.where("url IS NOT NULL").groupBy(key.alias("key")).agg(F.max_by(F.struct("url", "html", "fetched_at"), F.struct("fetched_at", "url")).alias("v")).select("key", "v.*")
    old = known(spark, out, batch_id)
    start = 0
    if old is not None:
        start = old.agg(F.coalesce(F.max("idx"), F.lit(0))).first()[0]
        first = first.join(old.select("key").distinct(), "key", "left_anti")
    done = extract(first).drop("html")
    number(done, ["fetched_at", "key"], start).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")


def start(pages: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run the ingest; with `available_now` it ends when everything that is there is in."""
    w = pages.writeStream.foreachBatch(lambda df, i: write_batch(df, i, out)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def first_seen(log: DataFrame, delay: str = "1 day") -> DataFrame:
    """A crawl log's stream with each address once within the watermark."""
    return log.withWatermark("fetched_at", delay).withColumn("key", url_key(F.col("url"))).dropDuplicatesWithinWatermark(["key"])


def hourly(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Pages and failures of a crawl log by hour of the fetch, for a stream or a table."""
    return log.withWatermark("fetched_at", delay).groupBy(F.window("fetched_at", "1 hour").alias("w")).agg(F.count("*").alias("pages"), F.count_if(~F.col("ok")).alias("failed")).select(F.col("w.start").alias("hour"), "pages", "failed")
