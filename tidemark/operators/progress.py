"""Workflow progress from event tables: step states, heartbeats, time-outs, durations.

The state of a step follows from its last event and from the last start of a later
step, so it is found by aggregates with map-side combine; a run with a very large
share of the events is no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import workflow as W
from tidemark.operators.keyed import previous_in_key, running_sum

ORDER = ["ts", "event_no"]


def step_states(events: DataFrame, steps: list[str]) -> DataFrame:
    """Latest state of every step seen in a run.

    ``events``: run_id, step, status, message, duration_ms, ts, event_no. A step that is
    still active when a later step starts counts as completed.
    """
    at = F.struct(*ORDER)
    has_message = F.coalesce("message", F.lit("")) != ""
    seen = events.withColumn("step_index", W.step_index(F.col("step"), steps)).filter(F.col("step_index").isNotNull())
    last = seen.groupBy("run_id", "step", "step_index").agg(
        F.max_by("status", at).alias("status"),
        F.max(at).alias("at"),
        F.max_by("duration_ms", F.when(F.col("duration_ms").isNotNull(), at)).alias("duration_ms"),
        F.max_by("message", F.when(has_message, at)).alias("server_message"),
        F.max_by("message", at).alias("_message"),
        F.max(F.when(F.col("status") == "active", at)).alias("started"),
    )
    # a run has at most one row per step here
    later = Window.partitionBy("run_id").orderBy("step_index").rowsBetween(1, Window.unboundedFollowing)
    overtaken = (F.col("status") == "active") & (F.max("started").over(later) > F.col("at"))
    status = F.when(F.coalesce(overtaken, F.lit(False)), F.lit("completed")).otherwise(F.col("status"))
    return last.select(
        "run_id",
        "step",
        "step_index",
        status.alias("status"),
        "duration_ms",
        "server_message",
        F.when(F.col("status") == "error", F.col("_message")).alias("error_message"),
    )


def mark_failed_runs(states: DataFrame, errors: DataFrame, steps: list[str]) -> DataFrame:
    """Step states of failed runs: the active step, or the one after the last completed, is in error.

    ``errors``: run_id, message of the run error (one row per run).
    """
    run = Window.partitionBy("run_id")
    flagged = states.join(errors.select("run_id", F.col("message").alias("_error")), "run_id", "left")
    active = F.min(F.when(F.col("status") == "active", F.col("step_index"))).over(run)
    done = F.max(F.when(F.col("status") == "completed", F.col("step_index"))).over(run)
    flagged = flagged.withColumn("_target", F.coalesce(active, done + 1, F.lit(0)))
    hit = F.col("_error").isNotNull() & (F.col("step_index") == F.col("_target"))
    known = flagged.select(
        "run_id",
        "step",
        "step_index",
        F.when(hit, F.lit("error")).otherwise(F.col("status")).alias("status"),
        "duration_ms",
        F.when(hit, F.col("_error")).otherwise(F.col("server_message")).alias("server_message"),
        F.when(hit, F.col("_error")).otherwise(F.col("error_message")).alias("error_message"),
    )
    # the step in error may not have been seen yet
    heads = flagged.filter(F.col("_error").isNotNull()).groupBy("run_id").agg(
        F.first("_target").alias("step_index"), F.first("_error").alias("message"), F.collect_set("step_index").alias("_seen")
    )
    pending = heads.filter(~F.array_contains("_seen", F.col("step_index")) & (F.col("step_index") < len(steps)))
    names = F.array(*[F.lit(s) for s in steps])
    return known.unionByName(
        pending.select(
            "run_id",
            F.get(names, F.col("step_index")).alias("step"),
            "step_index",
            F.lit("error").alias("status"),
            F.lit(None).cast(states.schema["duration_ms"].dataType).alias("duration_ms"),
            F.col("message").alias("server_message"),
            F.col("message").alias("error_message"),
        )
    )


def completed_steps(states: DataFrame) -> DataFrame:
    return states.groupBy("run_id").agg(F.count(F.when(F.col("status") == "completed", 1)).alias("completed"))


def _sliced(events: DataFrame, slice_seconds: int) -> DataFrame:
    return events.withColumn("_slice", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (slice_seconds * 1_000_000)))


def event_gaps(events: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """Adds the seconds since the event before in the same run (null for the first one)."""
    rows = previous_in_key(_sliced(events, slice_seconds), ["run_id"], "_slice", ORDER, ["ts"])
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))
    return rows.withColumn("gap_seconds", micros / 1_000_000).drop("_slice", "prev_ts")


def idle_gaps(events: DataFrame, idle_seconds: float = fixed.HEARTBEAT_SECONDS) -> DataFrame:
    """Silences of at least ``idle_seconds``, with the heartbeats a listener would have got."""
    late = event_gaps(events).filter(F.col("gap_seconds") >= idle_seconds)
    return late.withColumn("heartbeats", F.floor(F.col("gap_seconds") / idle_seconds).cast("bigint"))


def timed_out_runs(
    events: DataFrame, timeout_seconds: float = fixed.TIMEOUT_SECONDS, as_of: Column | None = None
) -> DataFrame:
    """Runs with a silence longer than the time-out, up to ``as_of`` where it is given."""
    gaps = event_gaps(events)
    longest = gaps.groupBy("run_id").agg(F.max("gap_seconds").alias("longest"), F.max("ts").alias("last_ts"))
    if as_of is not None:
        tail = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))
        longest = longest.withColumn("longest", F.greatest("longest", tail / 1_000_000))
    return longest.filter(F.col("longest") > timeout_seconds).select("run_id", "last_ts", "longest")


def sessions(events: DataFrame, gap_seconds: float, slice_seconds: int = 86_400) -> DataFrame:
    """Stretches of a run without a silence above ``gap_seconds``: start, end and events.

    A stretch is numbered by the silences before it, counted in slices, so a busy run is many tasks' work.
    """
    gaps = event_gaps(events.withColumn("ts", F.col("ts").cast("timestamp")), slice_seconds)
    opens = F.when(F.col("gap_seconds").isNull() | (F.col("gap_seconds") > gap_seconds), 1).otherwise(0)
    numbered = running_sum(_sliced(gaps, slice_seconds), ["run_id"], "_slice", ORDER, opens, "_session")
    return (
        numbered.groupBy("run_id", "_session")
        .agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("events"))
        .drop("_session")
    )


def step_durations(events: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """Milliseconds from the start of a step to its completion, per completed event.

    An event counts when the event before it in the same run and step is a start.
    """
    rows = previous_in_key(_sliced(events, slice_seconds), ["run_id", "step"], "_slice", ORDER, ["ts", "status"])
    done = rows.filter((F.col("status") == "completed") & (F.col("prev_status") == "active"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev_ts").cast("timestamp"))
    return done.select("run_id", "step", "event_no", F.floor(micros / 1000).cast("bigint").alias("duration_ms"))


def terminal_events(events: DataFrame) -> DataFrame:
    """The event that ends each run (completed, or a typed error), where there is one."""
    ends = events.filter(F.col("event").isin("complete", "error"))
    first = ends.groupBy("run_id").agg(F.min_by(F.struct("event", "error_type", "message", "ts"), F.struct(*ORDER)).alias("e"))
    return first.select("run_id", "e.*")
