"""Coverage of a drawing: what the five record builders report, counted by state and by category of miss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselar.plans import reviews as V
from tesselar.plans.filters import ACTIVE
from tesselar.plans.registry import query

TABLES = ("records", "entities", "layer_config", "segments")
#: Categories of a record without a miss, of unsupported entities and of ends that stay open.
NONE, UNSUPPORTED, UNRESOLVED = "none", "unsupported_entity_miss", "unknown_unresolved"


def covered(records: DataFrame, entities: DataFrame, config: DataFrame, segments: DataFrame) -> DataFrame:
    """drawing_id, kind (the builder), status, category and confidence of every record."""
    parts = {
        "detected": V.detected_records(records).join(records.select("face_id", "drawing_id"), "face_id").select("drawing_id", F.lit("detected").alias("status"), F.lit(NONE).alias("category"), "confidence"),
        "layer_miss": V.layer_miss_records(entities, config),
        "gap_miss": V.gap_miss_records(segments),
        "entity_miss": V.entity_miss_records(entities, segments).withColumns({"status": F.lit("at_risk"), "category": F.lit(UNSUPPORTED)}),
        "topology": V.topology_records(segments).withColumn("category", F.lit(UNRESOLVED)),
    }
    out = None
    for kind, df in parts.items():
        one = df.select("drawing_id", F.lit(kind).alias("kind"), "status", "category", F.col("confidence").cast("double").alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out


COVERED = (
    f"select drawing_id, 'detected' as kind, 'detected' as status, 'none' as category, 0.9 as confidence from records where source = 'auto' and {ACTIVE} "
    f"union all select drawing_id, 'layer_miss', status, category, confidence from ({V.LAYER_MISSES}) l union all select drawing_id, 'gap_miss', status, category, confidence from ({V.MISSED}) m "
    f"union all select drawing_id, 'entity_miss', 'at_risk', '{UNSUPPORTED}', confidence from ({V.ENTITY_MISSES}) e union all select drawing_id, 'topology', status, '{UNRESOLVED}', confidence from ({V.OPEN_AFTER}) t"
)


@query(*TABLES, sql=f"select kind, drawing_id, status, category, cast(count(*) as bigint) as n, round(avg(confidence), 4) as confidence from ({COVERED}) c group by 1, 2, 3, 4")
def coverage_union(records: DataFrame, entities: DataFrame, config: DataFrame, segments: DataFrame) -> DataFrame:
    return covered(records, entities, config, segments).groupBy("kind", "drawing_id", "status", "category").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


def _states() -> list:
    return [F.count_if(F.col("status") == s).alias(s) for s in ("detected", "missed", "at_risk")]


_STATES = ", ".join(f"cast(count(*) filter (where status = '{s}') as bigint) as {s}" for s in ("detected", "missed", "at_risk"))


@query(*TABLES, sql=f"select drawing_id, {_STATES} from ({COVERED}) c group by 1")
def coverage_counts(records: DataFrame, entities: DataFrame, config: DataFrame, segments: DataFrame) -> DataFrame:
    return covered(records, entities, config, segments).groupBy("drawing_id").agg(*_states())


@query(*TABLES, sql=f"select drawing_id, category, cast(count(*) as bigint) as n from ({COVERED}) c where category <> 'none' group by rollup (drawing_id, category)")
def miss_by_category(records: DataFrame, entities: DataFrame, config: DataFrame, segments: DataFrame) -> DataFrame:
    return covered(records, entities, config, segments).where(F.col("category") != NONE).rollup("drawing_id", "category").agg(F.count("*").alias("n"))


@query(*TABLES, sql=f"select category, cast(count(*) as bigint) as n from ({COVERED}) c where category <> 'none' group by 1")
def miss_global(records: DataFrame, entities: DataFrame, config: DataFrame, segments: DataFrame) -> DataFrame:
    return covered(records, entities, config, segments).where(F.col("category") != NONE).groupBy("category").agg(F.count("*").alias("n"))


@query(*TABLES, sql=f"select drawing_id, {_STATES}, string_agg(distinct case when category <> 'none' then category end, ',' order by case when category <> 'none' then category end) as categories, round(avg(confidence), 4) as confidence from ({COVERED}) c group by 1")
def coverage_analysis(records: DataFrame, entities: DataFrame, config: DataFrame, segments: DataFrame) -> DataFrame:
    """One row by drawing: its records by state, the categories of miss that it has, and how sure they are."""
    names = F.array_join(F.array_sort(F.collect_set(F.when(F.col("category") != NONE, F.col("category")))), ",")
    return covered(records, entities, config, segments).groupBy("drawing_id").agg(*_states(), F.when(names != "", names).alias("categories"), F.round(F.avg("confidence"), 4).alias("confidence"))


@query(*TABLES, sql=f"select kind, status, cast(count(*) as bigint) as n from ({COVERED}) c group by 1, 2")
def coverage_export(records: DataFrame, entities: DataFrame, config: DataFrame, segments: DataFrame) -> DataFrame:
    """All records written as CSV, a folder for each kind, and the totals of what is read back."""
    from tesselar.operators.state import Steps

    spark = records.sparkSession
    path = f"{Steps(spark).path}/coverage"
    covered(records, entities, config, segments).write.option("header", "true").partitionBy("kind").csv(path)
    back = spark.read.option("header", "true").schema("drawing_id long, status string, category string, confidence double, kind string").csv(path)
    return back.groupBy("kind", "status").agg(F.count("*").alias("n"))
