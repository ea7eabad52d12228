"""The same filters over a stream: files that arrive are filtered batch by batch and survivors appended once.

Filters that look at one sample at a time give a stream the result they give the whole. Filters over all samples
(collapse, duplicates) run as a second pass over what was written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.filters import REASON


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "parquet", files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(kind).schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.load(path)


def curate(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that applies `stage` to what is there and ends. Survivors go to out/kept, counts to out/counts.

    A batch is written to folders named by its number, so one that is repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = stage(batch).persist()
        try:
            done.filter(F.col(REASON).isNull()).drop(REASON).write.mode("overwrite").parquet(f"{out}/kept/batch={number}")
            counts = done.groupBy(F.coalesce(F.col(REASON), F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))
            counts.write.mode("overwrite").parquet(f"{out}/counts/batch={number}")
        finally:
            done.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/kept").parquet(f"{out}/kept/batch=*").drop("batch")


def counts(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", f"{out}/counts").parquet(f"{out}/counts/batch=*").groupBy("reason").agg(F.sum("n").alias("n"))


def running_counts(stream: DataFrame, field: str) -> DataFrame:
    """(field, n) as a running aggregate, for a sink in complete or update mode."""
    return stream.groupBy(field).agg(F.count("*").alias("n"))
