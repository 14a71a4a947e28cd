"""Stateful streams: dedup, worklists, circuit breakers, stage durations, windows.

State is keyed and held by Spark's state store, so a query resumes from its checkpoint instead of rebuilding
what it has seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A parquet folder as a stream of some files a batch."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(path)


def first_seen(stream: DataFrame, keys: list[str], at: str | None = None, within: str | None = None) -> DataFrame:
    """Each key once. Without a bound the state grows with the keys; with one, repeats later than it pass again (extension)."""
    if at and within:
        return stream.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def breaker(stream: DataFrame, key: str, ok: str, order: list[str], thresholds: tuple[tuple[int, int], ...] = ((3, 120), (6, 300)), trip: int = 10) -> DataFrame:
    """(key, failures, pause_s, state) per batch and key: consecutive failures with what they bring.

    state is CLOSED, OPEN (a pause was due) or TRIPPED; a success closes an open breaker, never a tripped one.
    The outcomes of a batch count in the order of `order` (event time and what breaks ties), not of arrival; a
    batch holds what maxFilesPerTrigger lets in. What comes in a later batch counts after it.
    """
    out = f"{key} string, failures int, pause_s int, state string"

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, tripped = state.get if state.exists else (0, False)
        pause = 0
        batch = pd.concat([f[[*order, ok]] for f in frames]).sort_values(order)
        for good in batch[ok]:
            n = 0 if good else n + 1
            tripped = tripped or n >= trip
            pause = 0 if good or tripped else next((p for t, p in thresholds if n == t), pause)
        state.update((n, tripped))
        yield pd.DataFrame({key: [k[0]], "failures": [n], "pause_s": [pause], "state": ["TRIPPED" if tripped else "OPEN" if pause else "CLOSED"]})

    return stream.select(key, ok, *order).groupBy(key).applyInPandasWithState(run, out, "n int, tripped boolean", "update", GroupStateTimeout.NoTimeout)


def stage_durations(stream: DataFrame, key: str, event: str, at: str) -> DataFrame:
    """(key, started, ended, seconds) of bracketed stages."""
    g = stream.groupBy(key).agg(F.min(F.when(F.col(event) == "start", F.col(at))).alias("started"), F.max(F.when(F.col(event) == "end", F.col(at))).alias("ended"))
    return g.withColumn("seconds", F.unix_timestamp("ended") - F.unix_timestamp("started"))


def windowed_counts(stream: DataFrame, at: str, window: str, keys: list[str], late: str) -> DataFrame:
    """T15 (extension): counts by tumbling window; rows later than `late` are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(F.count("*").alias("n"))


def drain(result: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Runs a stream over all that is there and stops; the checkpoint holds offsets and state."""
    result.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def drain_batches(result: DataFrame, each, checkpoint: str, mode: str = "update") -> None:
    """As drain(), with a function of (batch, number) as the sink."""
    result.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
