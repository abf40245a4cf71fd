"""The metadata cache kept up to date by a stream of new image files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import images

FILES = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, cache: str, checkpoint: str, trim: bool = False, content: bool = True, perceptual: bool = False) -> StreamingQuery:
    """Append the metadata of new files below folder to the Parquet table at cache; ends once all files there are read.

    Each batch is written under its own number, so a batch that is run again replaces itself.
    """
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", True).load(folder)

    def add(batch: DataFrame, number: int) -> None:
        fresh = images.metadata(images.only_images(batch), trim, content, perceptual).where("error is null").drop("error")
        fresh.withColumns({"trim": F.lit(trim), "cached_at": F.current_timestamp()}).write.mode("overwrite").parquet(f"{cache}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, cache: str) -> DataFrame:
    """The cache with the last row of each path and trim."""
    rows = spark.read.parquet(cache)
    rest = [c for c in rows.columns if c not in ("path", "trim")]
    return rows.groupBy("path", "trim").agg(F.max_by(F.struct(*rest), F.struct("mtime", "batch")).alias("_r")).select("path", "trim", "_r.*").drop("batch")
