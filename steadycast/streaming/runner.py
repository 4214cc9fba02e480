"""Running a stream over what is available, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from steadycast.session import run_dir
from steadycast.streaming.replay import ROCKSDB

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_stream(
    spark: SparkSession, directory: str, glob: str, max_files: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream; the schema is taken from the stored files."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(directory).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process everything available in micro-batches and return the stored result.

    Append results go to a file sink. Update results overwrite nothing: every changed row
    of every batch is kept with its batch number.
    """
    spark = stream.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)
    target, checkpoint = run_dir(spark, "stream"), run_dir(spark, "stream-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", target).start()
    else:
        def store(batch: DataFrame, number: int) -> None:
            # A repeated batch replaces its own folder.
            batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

        query = writer.foreachBatch(store).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target) if mode == "append" else spark.read.parquet(target)
