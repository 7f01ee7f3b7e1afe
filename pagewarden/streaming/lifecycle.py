"""Scan lifecycle from an event stream."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewarden.sources.sinks import SnapshotTable
from pagewarden.streaming import append_stream

EVENTS = "scan_run_id bigint, website_id bigint, status string, at timestamp"


def run_states(events: DataFrame, delay: str = None) -> DataFrame:
    """Current state of every run.

    The state of a run is its latest event; at equal times an end state beats
    Running.  Works on a table and, with ``delay``, as a streaming aggregate in
    update or complete mode.
    """
    rows = events.withWatermark("at", delay) if delay else events
    order = F.struct("at", F.col("status") != "Running", "status")
    return rows.groupBy("scan_run_id").agg(
        F.max("website_id").alias("website_id"),
        F.min("at").alias("started_at"),
        F.max_by("status", order).alias("status"),
        F.max(F.when(F.col("status") != "Running", F.col("at"))).alias("finished_at"),
    )


def stuck_runs(states: DataFrame, now, limit: str) -> DataFrame:
    """Runs still Running after a time limit; ``now`` is an input."""
    return states.where(
        (F.col("status") == "Running")
        & (F.col("started_at") + F.expr(f"INTERVAL {limit}") < F.lit(now).cast("timestamp")))


STATE = ("scan_run_id bigint, website_id bigint, started_at timestamp, finished_at timestamp, "
         "latest struct<at:timestamp,ended:boolean,status:string>")


def _merged(rows: DataFrame) -> DataFrame:
    """One row per run from rows of STATE; only minima and maxima, so repeats change nothing."""
    return rows.groupBy("scan_run_id").agg(
        F.max("website_id").alias("website_id"), F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"), F.max("latest").alias("latest"))


def _as_states(events: DataFrame) -> DataFrame:
    ended = F.col("status") != "Running"
    return events.select(
        "scan_run_id", "website_id", F.col("at").alias("started_at"),
        F.when(ended, F.col("at")).alias("finished_at"),
        F.struct("at", ended.alias("ended"), "status").alias("latest"))


def stored_states(spark: SparkSession, path: str) -> DataFrame:
    """The states that ``start_lifecycle`` has stored, as ``run_states`` gives them."""
    return _merged(SnapshotTable(path, STATE).read(spark)).select(
        "scan_run_id", "website_id", "started_at", F.col("latest.status").alias("status"),
        "finished_at")


def start_lifecycle(events: DataFrame, path: str, checkpoint: str):
    """Folds new events into a stored table of run states, until the input is used up.

    A batch adds a part with the runs it names and no more; parts are merged as they add up
    (``SnapshotTable.add``). The stream itself keeps no state, nothing comes to the driver, and a
    repeated batch changes nothing.
    """
    table = SnapshotTable(path, STATE)

    def fold(batch: DataFrame, number: int) -> None:
        table.add(_merged(_as_states(batch)), _merged)

    return events.writeStream.foreachBatch(fold).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


STUCK = "scan_run_id bigint, started_at timestamp"
_TIMED = "runs binary, first binary, latest binary, due binary"  # 64-bit integers, one for each run
RUN_GROUPS = 2048


def stuck_stream(events: DataFrame, limit: str, delay: str = "1 hour", groups: int = RUN_GROUPS) -> DataFrame:
    """Runs that are still Running when the watermark reaches their start and ``limit``, as a stream.

    Every run has an event-time timer, set anew while an earlier start may still come in. When it goes off the run
    is reported or, if it has ended, passed over; either way its state is dropped. An event after that
    starts the run's clock again. Runs are followed in ``groups`` hash groups, each by whole columns (32 bytes for a
    run), with one Spark timer for the next of its runs; the number stays as long as the checkpoint lives.
    """
    allowed = pd.Timedelta(limit).value // 1000

    def per_run(runs, first, latest, due, fresh):
        """One entry per run: its least start, its greatest latest event, its timer and whether it came just now."""
        order = np.argsort(runs, kind="stable")
        runs = runs[order]
        cut = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
        return (runs[cut], np.minimum.reduceat(first[order], cut), np.maximum.reduceat(latest[order], cut),
                np.maximum.reduceat(due[order], cut), np.logical_or.reduceat(fresh[order], cut))

    def follow(key, batches, state):
        now = state.getCurrentWatermarkMs()
        kept = [np.frombuffer(c, dtype="i8") for c in state.get] if state.exists else [np.empty(0, "i8")] * 4
        rows = [] if state.hasTimedOut else [b for b in batches if len(b)]
        come = [np.concatenate([b[c].to_numpy("i8") for b in rows] or [np.empty(0, "i8")])
                for c in ("scan_run_id", "first", "latest")]
        columns = [np.concatenate(pair) for pair in zip(kept, [*come, np.zeros(len(come[0]), "i8")])]
        fresh = np.arange(len(columns[0])) >= len(kept[0])
        runs, first, latest, due, fresh = per_run(*columns, fresh)
        due = np.where(fresh, np.maximum((first + allowed) // 1000, now + 1), due)
        off = ~fresh & (due < now)
        if off.all():
            if state.exists:
                state.remove()
        else:
            state.update(tuple(c[~off].tobytes() for c in (runs, first, latest, due)))
            state.setTimeoutTimestamp(max(int(due[~off].min()), now + 1))
        stuck = off & (latest % 2 == 0)
        if stuck.any():
            yield pd.DataFrame({"scan_run_id": runs[stuck], "first": first[stuck]})

    # The latest event as a number: its time, then whether it ended the run.
    ended = F.when(F.col("status") == "Running", 0).otherwise(1)
    return events.where("scan_run_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", delay).select(
        F.pmod(F.xxhash64("scan_run_id"), F.lit(groups)).alias("of"), "scan_run_id", "at",
        F.unix_micros("at").alias("first"), (F.unix_micros("at") * 2 + ended).alias("latest")
    ).groupBy("of").applyInPandasWithState(
        follow, "scan_run_id bigint, first bigint", _TIMED, "append", "EventTimeTimeout"
    ).select("scan_run_id", F.timestamp_micros("first").alias("started_at"))


def start_stuck_report(events: DataFrame, out: str, checkpoint: str, limit: str, delay: str = "1 hour",
                       partitions: int = None):
    """Appends stuck runs as they are found, until the input is used up."""
    return append_stream(stuck_stream(events, limit, delay), out, checkpoint, partitions)
