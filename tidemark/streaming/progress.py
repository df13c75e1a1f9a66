"""Workflow progress as a stream: step states per run, heartbeats, time-outs, terminal events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from tidemark import fixed
from tidemark.functions import workflow as W

EVENT_SCHEMA = (
    "run_id string, event string, step string, status string, message string, duration_ms long, "
    "error_type string, ts timestamp, event_no long"
)
STATE_SCHEMA = (
    "run_id string, kind string, step string, step_index int, status string, duration_ms long, "
    "server_message string, error_message string, at timestamp"
)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The state store the stateful operator needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class StepStates(StatefulProcessor):
    """Keeps the last event of each step of a run.

    Events may come late: a step only takes an event that is newer than its last one, so
    the result does not depend on the order of arrival. Silence is noticed by event-time
    timers; a terminal event or a time-out ends the run. Of an ended run a mark stays for
    ``keep`` seconds, by which late events are told from a new run and left out.
    """

    def __init__(self, steps: list[str], idle: float, timeout: float, keep: float = 86_400) -> None:
        self.order = W.step_order(steps)
        self.steps, self.idle, self.timeout, self.keep = steps, idle, timeout, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", StructType([StructField("json", StringType())]))

    def _load(self) -> dict:
        return json.loads(self.state.get()[0]) if self.state.exists() else {"steps": {}, "last": 0, "beats": 0}

    def _save(self, run: dict) -> None:
        self.state.update((json.dumps(run),))

    def _end(self, run: dict) -> None:
        self._save({"ended": True})
        self.handle.registerTimer(int(run["last"] // 1000 + self.keep * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, ended = self._load(), None
        if "ended" in run:
            return
        for batch in rows:
            for e in batch.to_dict("records"):
                at = [pd.Timestamp(e["ts"]).value // 1000, int(e["event_no"])]
                run["last"] = max(run["last"], at[0])
                if e["event"] in ("complete", "error"):
                    ended = e if ended is None or at < ended["at"] else ended
                    ended["at"] = at
                elif e["step"] in self.order:
                    self._apply(run["steps"].setdefault(e["step"], {}), e, at)
        run["beats"] = 0
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ended is not None:
            if ended["event"] == "error":
                self._fail(run, ended["message"])
            self._end(run)
            yield self._rows(key[0], run, ended)
            return
        self._save(run)
        self.handle.registerTimer(int(run["last"] // 1000 + self.idle * 1000))
        yield self._rows(key[0], run, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = self._load()
        if "ended" in run:
            self.state.clear()
            return
        run["beats"] += 1
        silent = run["beats"] * self.idle
        kind = "timeout" if silent >= self.timeout else "heartbeat"
        at = pd.Timestamp(run["last"] + int(silent * 1_000_000), unit="us")
        if kind == "timeout":
            self._end(run)
        else:
            self._save(run)
            self.handle.registerTimer(int(run["last"] // 1000 + (run["beats"] + 1) * self.idle * 1000))
        yield self._frame([(key[0], kind, None, None, None, None, None, None, at)])

    @staticmethod
    def _apply(step: dict, e: dict, at: list[int]) -> None:
        def newest(name: str, value) -> None:
            if at >= step.get(name + "_at", at):
                step[name], step[name + "_at"] = value, at

        newest("status", e["status"])
        newest("message", e["message"])
        if not pd.isna(e["duration_ms"]):
            newest("duration_ms", int(e["duration_ms"]))
        if e["message"]:
            newest("server_message", e["message"])
        if e["status"] == "active":
            newest("started", True)

    def _states(self, run: dict) -> dict[str, str]:
        """Status per step; an active step that a later one has overtaken is completed."""
        out = {}
        for name, step in run["steps"].items():
            later = [s["started_at"] for n, s in run["steps"].items() if self.order[n] > self.order[name] and "started_at" in s]
            overtaken = step["status"] == "active" and any(t > step["status_at"] for t in later)
            out[name] = "completed" if overtaken else step["status"]
        return out

    def _fail(self, run: dict, message: str) -> None:
        states = self._states(run)
        active = [self.order[n] for n, s in states.items() if s == "active"]
        done = [self.order[n] for n, s in states.items() if s == "completed"]
        target = min(active) if active else max(done, default=-1) + 1
        if target < len(self.steps):
            step = run["steps"].setdefault(self.steps[target], {})
            step.update(status="error", message=message, server_message=message)
            step.setdefault("status_at", [run["last"], 0])

    def _rows(self, run_id: str, run: dict, ended: dict | None) -> pd.DataFrame:
        at = pd.Timestamp(run["last"], unit="us")
        rows = []
        for name, status in self._states(run).items():
            step = run["steps"][name]
            error = step.get("message") if step["status"] == "error" else None
            rows.append(
                (run_id, "step", name, self.order[name], status, step.get("duration_ms"), step.get("server_message"), error, at)
            )
        if ended is not None:
            rows.append((run_id, ended["event"], None, None, None, None, ended["message"], ended["error_type"], at))
        return self._frame(rows)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        names = [f.split()[0] for f in STATE_SCHEMA.split(", ")]
        frame = pd.DataFrame(rows, columns=names)
        return frame.astype({"step_index": "Int32", "duration_ms": "Int64"})


def step_state_stream(
    events: DataFrame,
    steps: list[str],
    watermark: str = "10 minutes",
    idle: float = fixed.HEARTBEAT_SECONDS,
    timeout: float = fixed.TIMEOUT_SECONDS,
) -> DataFrame:
    """Step states of each run after every batch, with heartbeat, time-out and terminal rows."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy("run_id")
        .transformWithStateInPandas(
            statefulProcessor=StepStates(steps, idle, timeout),
            outputStructType=STATE_SCHEMA,
            outputMode="Update",
            timeMode="EventTime",
        )
    )
