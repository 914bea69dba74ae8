"""Drawings that arrive as files in a folder: checked, read and kept, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tesselar.sources import tags
from tesselar.sources.sinks import Log
from tesselar.streaming.reviews import arrivals

FILES = "path string, modificationTime timestamp, length long, content binary"
SEGMENTS = "path string, layer string, x1 double, y1 double, x2 double, y2 double"
CHECKED = "path string, length long, check string"


def files_stream(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """path and length of new files, at most so many in a batch. Contents are not read here."""
    read = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most)
    return read.load(path).select("path", "length")


def ingest(files: DataFrame, out: str) -> DataStreamWriter:
    """Checks of all files, and the segments of those that pass, as saves of two logs below ``out``, one save for each batch.

    A batch that is run again after a failure finds its number taken and leaves what is there. ``start`` needs a checkpoint location.
    """
    spark = files.sparkSession

    def batch(rows: DataFrame, n: int) -> None:
        checked = arrivals(rows).select("path", "length", "check").persist()
        good = [r.path for r in checked.where("check = 'ok'").select("path").collect()]  # at most the files of a batch
        if good:
            found = tags.segments(tags.entities(tags.read_tags(spark, good, "*")))
            Log(spark, f"{out}/segments").save_as(n + 1, found.select(F.col("drawing").alias("path"), "layer", "x1", "y1", "x2", "y2"))
        Log(spark, f"{out}/checks").save_as(n + 1, checked)
        checked.unpersist()

    return files.writeStream.foreachBatch(batch)
