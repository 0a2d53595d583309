"""New record files imported as they appear, and results delivered batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import route_results
from ..plans.importing import import_files
from ..sources.gedcom import RECORD_FILES

FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_import(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    sink: Callable[[dict[str, DataFrame], int], None],
    files_per_trigger: int = 200,
    once: bool = True,
):
    """Start a query that imports new record files.

    Only paths travel through the stream, at most ``files_per_trigger`` a time; the
    files are then read in splits by the batch import.
    """
    listing = (
        spark.readStream.format("binaryFile")
        .schema(FILES)
        .option("pathGlobFilter", RECORD_FILES)
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(path)
        .select("path")
    )

    def import_batch(batch: DataFrame, number: int) -> None:
        paths = [row["path"] for row in batch.collect()]
        if paths:
            sink(import_files(spark, paths), number)

    writer = listing.writeStream.option("checkpointLocation", checkpoint).foreachBatch(import_batch)
    return (writer.trigger(availableNow=True) if once else writer).start()


def deliver_results(
    stream: DataFrame, prefix: str, bucket: str, out: str, checkpoint: str, once: bool = True
):
    """Write result contents that have no address yet and the routing row of every result."""

    def write(batch: DataFrame, number: int) -> None:
        routed = route_results(batch, prefix, bucket).persist()
        try:
            kept = routed.where("must_write").select("target_uri", F.col("content").alias("value"))
            kept.write.mode("overwrite").parquet(f"{out}/contents/batch={number}")
            routed.drop("content").write.mode("overwrite").parquet(f"{out}/routes/batch={number}")
        finally:
            routed.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
