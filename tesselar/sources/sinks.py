"""Writers: reports as CSV or Parquet, tag text, snapshots and versions."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_parquet(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def _lines(*x):
    """Lines of text; a plain string stands for itself."""
    return F.concat_ws("\n", *(v.cast("string") if not isinstance(v, str) else F.lit(v) for v in x))


def line_tags(segments: DataFrame) -> DataFrame:
    """drawing and the tags of each segment (drawing, layer, x1, y1, x2, y2) as a LINE."""
    c = F.col
    return segments.select("drawing", _lines("0", "LINE", "8", c("layer"), "10", c("x1"), "20", c("y1"), "11", c("x2"), "21", c("y2")).alias("tags"))


def ring_tags(rings: DataFrame, layer: str = "REGIONS") -> DataFrame:
    """drawing and the tags of each ring (drawing, ring) as a closed polyline on a layer."""
    points = F.array_join(F.transform("ring", lambda p: _lines("10", p["x"], "20", p["y"])), "\n")
    return rings.select("drawing", _lines("0", "LWPOLYLINE", "8", layer, "70", "1", points).alias("tags"))


def write_tag_files(entities: DataFrame, path: str, layers: DataFrame | None = None, sheet: int = 200_000) -> None:
    """Tag files of entities (drawing, tags) below ``path/drawing=…/sheet=…``: each is complete by itself, with all layers (drawing, layer) of its drawing
    and at most about ``sheet`` entities, so that no task and no row holds a whole drawing."""
    sheets = entities.groupBy("drawing").agg(F.ceil(F.count("*") / sheet).cast("int").alias("sheets"))
    tables = F.lit("")
    if layers is not None:
        listed = layers.select("drawing", "layer").distinct().groupBy("drawing").agg(F.array_sort(F.collect_list("layer")).alias("layers"))  # a drawing has some dozens
        sheets = sheets.join(listed, "drawing", "left")
        tables = F.array_join(F.transform(F.coalesce("layers", F.array().cast("array<string>")), lambda x: _lines("0", "LAYER", "2", x, "")), "")
    head = F.concat(_lines("0", "SECTION", "2", "TABLES", ""), tables, _lines("0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"))
    ends = sheets.withColumns({"sheet": F.explode(F.sequence(F.lit(0), F.col("sheets") - 1)), "head": head})
    row = lambda df, place, text: df.select("drawing", "sheet", F.lit(place).alias("place"), text.alias("value"))
    own = entities.join(sheets.select("drawing", "sheets"), "drawing").withColumn("sheet", F.pmod(F.xxhash64("tags"), F.col("sheets")).cast("int"))
    rows = row(own, 1, F.col("tags")).unionByName(row(ends, 0, F.col("head"))).unionByName(row(ends, 2, _lines("0", "ENDSEC", "0", "EOF")))
    order = ["drawing", "sheet"]
    rows.repartition(*order).sortWithinPartitions(*order, "place").select("value", *order).write.mode("overwrite").partitionBy(*order).text(path)


class Log:
    """A table of saves: data in a folder for each save, and a log with one small file for each save that has come through.

    A save writes its data first and then creates the next number's log file, which succeeds for one writer alone; a writer that finds the number taken tries the next.
    Readers see what the log lists: a writer that fails leaves a folder that nobody reads, and two writers at once give two saves. Numbers by key are
    the order in which the log lists the key, so data is never written again when a number was taken.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, rows: DataFrame) -> int:
        """The save's number, from 1."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return self._commit(name)

    def save_as(self, n: int, rows: DataFrame) -> bool:
        """The save of this number, once: false, and nothing is written, if the log has it. For writers that repeat themselves after a failure."""
        if n in self._numbers():
            return False
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return self._create(f"{self.path}/log/{n:010d}", name)

    def _commit(self, name: str) -> int:
        n = max(self._numbers(), default=0) + 1
        while not self._create(f"{self.path}/log/{n:010d}", name):
            n += 1
        return n

    def _create(self, path: str, text: str) -> bool:
        """A file with this text, if there is none of that name: a link on one machine, elsewhere a rename that replaces nothing."""
        jvm = self.spark.sparkContext._jvm
        target, draft = self._path(path), self._path(f"{self.path}/log/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":
                os.link(draft.toUri().getPath(), target.toUri().getPath())
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                kinds = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(draft, target, kinds)
            return True
        except (FileExistsError, Py4JJavaError) as e:
            if isinstance(e, Py4JJavaError) and "FileAlreadyExists" not in str(e.java_exception):
                raise
            return False
        finally:
            self._fs.delete(draft, False)

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/log")
        if not self._fs.exists(folder):
            self._fs.mkdirs(folder)
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, schema: StructType) -> DataFrame:
        """All rows of all saves with ``save``, the number of theirs."""
        if not self._numbers():
            return self.spark.createDataFrame([], schema).withColumn("save", F.lit(0).cast("long"))
        listed = self.spark.read.text(f"{self.path}/log").select(F.col("value").alias("name"), F.col("_metadata.file_name").cast("long").alias("save"))
        names = {r.name: r.save for r in listed.collect()}  # one small row for each save
        data = self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{n}" for n in names))
        where = F.regexp_extract(F.col("_metadata.file_path"), r"/data/([0-9a-f]{32})/", 1)
        return data.select(*[f.name for f in schema], where.alias("name")).join(listed, "name").select(*[f.name for f in schema], "save")

    def versions(self, schema: StructType, *by: str) -> DataFrame:
        """Rows with ``version``: 1 for the first save that has the key, and so on."""
        rows = self.read(schema)
        place = F.dense_rank().over(Window.partitionBy(*by).orderBy("save")).cast("int")
        saves = rows.select(*by, "save").distinct().withColumn("version", place)  # a key's saves
        return rows.join(saves, [*by, "save"]).select(*[f.name for f in schema], "version")

    def latest(self, schema: StructType, *by: str) -> DataFrame:
        """Rows of the last save of each key: a save replaces a key as a whole."""
        rows = self.read(schema)
        last = rows.groupBy(*by).agg(F.max("save").alias("save"))
        return rows.join(last, [*by, "save"], "left_semi").select(*[f.name for f in schema])


def delivery_manifest(files: DataFrame) -> DataFrame:
    """path, category and SHA-256 of delivered files (a binaryFile table)."""
    low = F.lower("path")
    kind = F.when(low.rlike(r"\.(csv|xlsx)$"), "schedule").when(low.rlike(r"\.dxf$"), "drawing").when(low.rlike(r"\.(json|yaml)$"), "data").when(low.rlike(r"\.(md|pdf)$"), "report").otherwise("other")
    return files.select("path", kind.alias("category"), "length", F.sha2("content", 256).alias("sha256"))
