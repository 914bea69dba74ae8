"""Tables that cut the lineage of iterated steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


class Steps:
    """Writes a step's rows below ``spark.checkpoint.dir`` and reads them again; the folder goes with the driver's Python."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base or "file:///tmp/checkpoints"  # one machine
        self.path = f"{base.rstrip('/')}/steps-{uuid.uuid4().hex}"
        atexit.register(self._remove)

    def _remove(self) -> None:
        try:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended
            pass

    def tasks(self) -> int:
        """Tasks for work that grows with more than a row's bytes: Spark joins partitions by their size alone, unless their number is given."""
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def cut_and_count(self, df: DataFrame, condition) -> tuple[DataFrame, int]:
        """The written rows, and for how many the condition holds, counted while they are written."""
        seen = Observation()
        out = self.cut(df.observe(seen, F.count_if(condition).alias("n")))
        return out, seen.get["n"]


_shared: dict[tuple, object] = {}


def kept(name: str, make, *inputs: DataFrame):
    """``make(*inputs)`` made once in a session for these inputs.

    Inputs are told by their plans and files. The files are taken as fixed while a session lasts.
    """
    key = (inputs[0].sparkSession.sparkContext.applicationId, name, *((d.semanticHash(), *sorted(d.inputFiles())) for d in inputs))
    if key not in _shared:
        _shared[key] = make(*inputs)
    return _shared[key]


def shared(name: str, make, *inputs: DataFrame) -> DataFrame:
    """``make(*inputs)`` written once in a session for these inputs: queries that build on it read the table."""
    return kept(name, lambda *of: Steps(inputs[0].sparkSession).cut(make(*of)), *inputs)


def placed(rows: DataFrame, key: str, order: list, steps: Steps, name: str) -> DataFrame:
    """The rows with their place (from 1) in the key's order, which must be total. Ranges of rows go to tasks, which count their own, and a range adds what lies before it: no task has all rows of a key."""
    dealt = rows.repartitionByRange(steps.tasks(), key, *order).sortWithinPartitions(key, *order)
    dealt = steps.cut(dealt.select("*", F.monotonically_increasing_id().alias("_at")).withColumn("_part", F.shiftright("_at", 33)))
    ranges = dealt.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = steps.cut(ranges.withColumn("_before", before).drop("_n"))
    return dealt.join(ranges, [key, "_part"]).withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")).drop("_at", "_part", "_first", "_before")
