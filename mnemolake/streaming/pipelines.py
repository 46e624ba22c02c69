"""Structured Streaming: dedup, failure bursts, idle closing, cursors, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduped(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """First row per key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def idle_sessions(stream: DataFrame, key: str, at: str, gap: str = "2 hours", delay: str = "10 minutes") -> DataFrame:
    """Closed stretches of activity: ended by a gap."""
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("opened"), F.col("w.end").alias("closes"), "n")


def _bursts(window: int, most: int) -> Callable[[tuple, Iterable[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def run(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps = list(state.get[0]) if state.exists else []
        good = state.get[1] if state.exists else -(1 << 60)
        # a micro-batch's rows of a tool come in any order, over many blocks
        rows = pd.concat([b[["step", "failed"]] for b in batches]).sort_values(["step", "failed"])
        out = []
        for step, bad in zip(rows.step.tolist(), rows.failed.tolist(), strict=True):
            if bad:
                steps = [s for s in steps if s > step - window] + [step]
                if len(steps) >= most and good <= step - window:
                    out.append((key[0], step, len(steps)))
            else:
                good, steps = step, [s for s in steps if s >= step]
        state.update((steps, good))
        yield pd.DataFrame(out, columns=["tool", "step", "failures"])

    return run


def failure_bursts(stream: DataFrame, window: int = 5, most: int = 3) -> DataFrame:
    """(tool, step, failures) for rows (tool, step, failed); the state of a tool is at most
    `window` steps. Micro-batches follow each other in order of steps; within one, rows may come
    in any order, and a task holds a tool's steps of it."""
    return stream.groupBy("tool").applyInPandasWithState(_bursts(window, most), "tool string, step long, failures long", "steps array<long>, good long", "append", GroupStateTimeout.NoTimeout)


def advance_watermark(target: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch: appends the batch's newest time per source under its batch number, so
    that a batch that runs twice replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        batch.groupBy("source").agg(F.max("at").alias("seen_at")).write.mode("overwrite").parquet(str(PurePosixPath(target) / f"batch={number}"))

    return run


def run_to_end(stream: DataFrame, name: str, folder: str) -> DataFrame:
    """Drives a finite stream to its end. Rows are appended as Parquet under the folder, which
    driver and executors share, beside the query's checkpoint; what is read back is theirs."""
    out = f"{folder}/{name}"
    stream.writeStream.format("parquet").queryName(name).option("path", out).option("checkpointLocation", f"{folder}/{name}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
