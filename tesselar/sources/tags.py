"""ASCII tag files (pairs of lines: code, value): catalog, entities, layers, block inserts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselar.operators.state import Steps


def drawing_catalog(spark: SparkSession, path: str, pattern: str = "*.dxf") -> DataFrame:
    """Files below a folder: path, length, time. The content is not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime").dropDuplicates(["path"])


def read_tag_files(spark: SparkSession, path: str, pattern: str = "*.dxf") -> DataFrame:
    """drawing and its whole text, one row by file."""
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("drawing"), F.col("value").alias("text"))


def read_tags(spark: SparkSession, path: str | list[str], pattern: str = "*.dxf") -> DataFrame:
    """drawing (the file's path), pos, code, value, section and record (the place of the tag that opens it) of all files below a folder, or of those named.

    Files are read in ranges of bytes, a large one by many tasks. A first pass counts each range's lines, which tells of every line whether it is a code or a
    value; a pair that two ranges share is put together from its halves. What a range cannot know by itself, the record and the section that are
    open where it begins, comes from a table with a row for each range. Nothing is grouped by file. The tags are written to the shared folder.
    """
    steps = Steps(spark)
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("drawing"), F.col("_metadata.file_block_start").alias("block"), "value")
    before = Window.partitionBy("drawing").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # the ranges of a file
    counts = lines.groupBy("drawing", "block").agg(F.count("*").alias("n"))
    first = {(r.drawing, r.block): r.first for r in counts.select("drawing", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")).toLocalIterator()}  # a number for each range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line, open_, code = None, 0, None, None
        for batch in batches:
            names, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            for name, block, text in zip(names, blocks, batch.column(2).to_pylist(), strict=True):
                if (name, block) != now:
                    if now and line % 2:
                        out.append((*now, line // 2, code, None, open_, True))
                    now, line, open_, code = (name, block), first[name, block], None, None
                text = text.strip()
                if line % 2 == 0:
                    code = int(text) if text.removeprefix("-").isdigit() and text.isascii() else None
                    open_ = line // 2 if code == 0 else open_
                elif line == first[now]:
                    out.append((*now, line // 2, None, text, None, True))
                elif code is not None:
                    out.append((*now, line // 2, code, text, open_, False))
                line += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=columns)
        if now and line % 2:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*now, line // 2, code, None, open_, True), kinds, strict=True)], names=columns)

    columns = ["drawing", "block", "pos", "code", "value", "record", "half"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_()]
    rows = steps.cut(lines.mapInArrow(run, "drawing string, block long, pos long, code int, value string, record long, half boolean"))
    joined = rows.where("half").groupBy("drawing", "pos").agg(F.min("block").alias("block"), F.max("code").alias("code"), F.max("value").alias("value"), F.max("record").alias("record"))
    joined = joined.where("code is not null and value is not null")
    whole = rows.where("not half").select("drawing", "block", "pos", "code", "value", "record").unionByName(joined.select("drawing", "block", "pos", "code", "value", "record"))
    opened = rows.groupBy("drawing", "block").agg(F.max("record").alias("r")).select("drawing", "block", F.last("r", ignorenulls=True).over(before).alias("carried"))
    whole = whole.join(opened, ["drawing", "block"], "left").withColumn("record", F.coalesce("record", "carried")).drop("block", "carried")
    named = whole.where("code = 2").select("drawing", "pos", F.col("value").alias("section"))
    starts = whole.where("code = 0 and value = 'SECTION'").select("drawing", (F.col("pos") + 1).alias("pos")).join(named, ["drawing", "pos"])
    until = F.coalesce(F.lead("pos").over(Window.partitionBy("drawing").orderBy("pos")), F.lit(1 << 62))  # a file has some ten sections
    sections = starts.select(F.col("drawing").alias("of"), "section", F.col("pos").alias("from_pos"), until.alias("to_pos"))
    at = (F.col("drawing") == F.col("of")) & (F.col("pos") >= F.col("from_pos")) & (F.col("pos") < F.col("to_pos"))
    return whole.join(sections, at, "left").select("drawing", "pos", "code", "value", "section", "record")


def tags(drawings: DataFrame) -> DataFrame:
    """drawing, pos, code, value, section and record (a number that code 0 moves on) of drawings that are one text each: small ones only."""
    lines = F.split(F.regexp_replace("text", "\r", ""), "\n")
    odd = lambda k: F.filter(lines, lambda _, i: i % 2 == k)
    rows = drawings.select("drawing", F.posexplode(F.arrays_zip(odd(0).alias("code"), odd(1).alias("value"))).alias("pos", "t"))
    rows = rows.select("drawing", "pos", F.trim("t.code").try_cast("int").alias("code"), F.trim("t.value").alias("value")).where("code is not null")
    order = Window.partitionBy("drawing").orderBy("pos")
    opened = F.when((F.col("code") == 2) & (F.lag("code").over(order) == 0) & (F.lag("value").over(order) == "SECTION"), F.col("value"))
    rows = rows.withColumn("opened", opened)
    return rows.select("drawing", "pos", "code", "value", F.last("opened", ignorenulls=True).over(order).alias("section"), F.sum((F.col("code") == 0).cast("long")).over(order).alias("record"))


def records(tag_rows: DataFrame, section: str) -> DataFrame:
    """One row by record of a section: type, name (2), layer (8) and the coordinate lists by code."""
    at = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("code") == c, F.struct("pos", F.col("value").try_cast("double").alias("v"))))), lambda p: p["v"])
    text = lambda c: F.min(F.when(F.col("code") == c, F.col("value")))
    own = tag_rows.where(F.col("section") == section).groupBy("drawing", "record")
    return own.agg(text(0).alias("type"), text(2).alias("name"), text(8).alias("layer"), F.min(F.when(F.col("code") == 70, F.col("value").try_cast("int"))).alias("flag"), *(at(c).alias(f"c{c}") for c in (10, 20, 11, 21, 40, 50, 51)))


def entities(tag_rows: DataFrame) -> DataFrame:
    """drawing, record, type, layer, vertices, closed; a record without coordinates goes to neither and is counted by type alone."""
    own = records(tag_rows, "ENTITIES").where("type not in ('SECTION', 'ENDSEC', 'EOF')")
    xs, ys = F.concat("c10", "c11"), F.concat("c20", "c21")
    vertices = F.transform(F.arrays_zip(xs.alias("x"), ys.alias("y")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return own.select("drawing", "record", "type", "layer", "name", vertices.alias("vertices"), (F.coalesce("flag", F.lit(0)).bitwiseAND(1) == 1).alias("closed"), F.try_element_at("c40", F.lit(1)).alias("radius"), F.try_element_at("c50", F.lit(1)).alias("start"), F.try_element_at("c51", F.lit(1)).alias("end"))


def layers(tag_rows: DataFrame) -> DataFrame:
    return records(tag_rows, "TABLES").where("type = 'LAYER'").select("drawing", "name").distinct()


def segments(found: DataFrame, arc_segments: int = 64) -> DataFrame:
    """LINE: 1; polyline: n - 1, and 1 more if closed with three points or more; ARC: a chain of its points."""
    from tesselar.functions.geom import arc_points

    first = F.try_element_at("vertices", F.lit(1))
    path = F.when(F.col("type") == "ARC", arc_points(first["x"], first["y"], F.col("radius"), F.col("start"), F.col("end"), arc_segments))
    path = path.when(F.col("closed") & (F.size("vertices") >= 3), F.concat("vertices", F.slice("vertices", 1, 1))).otherwise(F.col("vertices"))
    steps = found.where(F.col("type").isin("LINE", "LWPOLYLINE", "POLYLINE", "ARC")).withColumn("path", path).where(F.size("path") >= 2)
    sides = F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))
    return steps.select("drawing", "record", "layer", F.posexplode(sides).alias("part", "s")).select("drawing", "record", "part", "layer", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))

