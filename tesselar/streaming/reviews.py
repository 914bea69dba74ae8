"""Review events as streams: funnels by window, state of polygons by session, undo and redo."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH = 30
EDITS = ("recover", "approve", "delete")
STEP = "case action when 'open_gap' then 1 when 'select' then 2 when 'recover' then 3 when 'approve' then 4 end"


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Event time as a timestamp (the tables may hold it without a zone), with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def funnel(events: DataFrame) -> DataFrame:
    """By day the sessions that found, clicked, recovered and found useful."""
    reached = events.groupBy(F.to_date("ts").alias("day"), "session_id").agg(F.max(F.expr(STEP)).alias("s"))
    names = ["found", "clicked", "recovered", "useful"]
    return reached.groupBy("day").agg(*(F.count_if(F.col("s") >= k + 1).alias(n) for k, n in enumerate(names)))


def funnel_stream(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts of each action by window, for a stream with late rows up to the watermark."""
    return _timed(events, late).groupBy(F.window("ts", width), "action").agg(F.count("*").alias("n"))


def reviewer_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Spells of work: a session window by reviewer."""
    return _timed(events, late).groupBy(F.session_window("ts", gap), "session_id").agg(F.count("*").alias("n"))


def history(actions: list[str], undo: int = 1, redo: int = 0) -> tuple[int, int]:
    """Depths after actions: an edit pushes (at most DEPTH) and clears redo; undo needs more than one entry."""
    for a in actions:
        if a in EDITS:
            undo, redo = min(DEPTH, undo + 1), 0
        elif a == "open_gap" and undo > 1:
            undo, redo = undo - 1, redo + 1
        elif a == "select" and redo:
            undo, redo = min(DEPTH, undo + 1), redo - 1
    return undo, redo


def replay_history(events: DataFrame) -> DataFrame:
    """Batch form: each session's events in order, as batches, with two numbers of state."""
    ordered = events.select("session_id", "ts", "event_id", "action").repartition("session_id").sortWithinPartitions("session_id", "ts", "event_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, state = None, (1, 0)
        for pdf in batches:
            done = []
            for s, part in pdf.groupby("session_id", sort=False):
                if session is not None and s != session:
                    done.append((session, *state))
                    state = (1, 0)
                session, state = s, history(part["action"].tolist(), *state)
            yield pd.DataFrame(done, columns=["session_id", "undo", "redo"]).astype("int64")
        if session is not None:
            yield pd.DataFrame([(session, *state)], columns=["session_id", "undo", "redo"]).astype("int64")

    return ordered.mapInPandas(run, "session_id long, undo long, redo long")


def history_stream(events: DataFrame) -> DataFrame:
    """Stream form: the two depths are the state of a session."""

    def update(key, batches, state):
        undo, redo = state.get if state.exists else (1, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        undo, redo = history(rows["action"].tolist(), undo, redo)
        state.update((undo, redo))
        yield pd.DataFrame({"session_id": [key[0]], "undo": [undo], "redo": [redo]})

    return events.groupBy("session_id").applyInPandasWithState(update, "session_id long, undo long, redo long", "undo long, redo long", "update", "NoTimeout")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])


def arrivals(drawings: DataFrame, most_bytes: int = 200 << 20) -> DataFrame:
    """Uploaded files (a binaryFile stream or table) with the first check that they fail, or ok."""
    low = F.lower("path")
    reason = F.when(~low.rlike(r"\.(dxf|dwg)$"), "suffix").when(F.col("length") == 0, "empty").when(F.col("length") > most_bytes, "too large").otherwise("ok")
    return drawings.select("path", "length", reason.alias("check"))
