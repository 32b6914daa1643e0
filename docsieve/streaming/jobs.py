"""Document jobs as a keyed state machine.

Events of a job (started, done, partial, busy, retryable, fatal, retry) move it through its phases. ``step`` is the
whole rule and is pure; ``fold`` applies it to a table of events, ``stream`` to a stream with Spark's state store.

A job's events are numbered by seq from 0 on, and act in that order once each: an event that was applied before is
dropped, one that comes too early is held until those before it have come. So a stream gives, however its events are
split into batches, shuffled and repeated, the transitions that the fold gives of all of them; events after one that
never comes act in neither. A stream keeps one small state for each job and drops it when a timer of event time runs
out, two lifetimes after the job's last event; events as far behind the stream's newest are late and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed values of the rule, in seconds.
PHASES = ["UPLOADING", "QUEUED", "SUBMITTING", "OCR", "COLLECTING", "RENDERING"]
TERMINAL = ["SUCCEEDED", "PARTIAL_SUCCESS", "FAILED"]
START_WITHIN, LIFETIME, POLL, MOST_FAILURES = 3600, 6 * 86400, 15, 5
STATE = "phase string, created long, failures int, due long, retry_phase string, error string, revision int"
OUT = "job_id string, at long, event string, before string, phase string, due long, failures int, error string, revision int"
PENDING = "at long, event string, error string"
#: The state store that a stream needs: spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAMES = [x.split()[0] for x in STATE.split(", ")]


def new_job(at: int) -> dict:
    """A job as it is made."""
    return dict(zip(_NAMES, ("UPLOADING", at, 0, at, None, None, 0), strict=True))


def step(job: dict, event: str, at: int, error: str | None = None) -> dict:
    """The job after an event; an event that does not apply leaves it as it is."""
    new, phase = dict(job), job["phase"]
    age = at - job["created"]
    if event == "started" and phase == "UPLOADING":
        if age <= START_WITHIN:
            new |= {"phase": "QUEUED", "due": at}
    elif event == "retry" and phase == "FAILED":
        if job["retry_phase"] and age <= LIFETIME:
            new |= {"phase": job["retry_phase"], "failures": 0, "error": None, "retry_phase": None, "due": at}
    elif phase in TERMINAL or phase == "UPLOADING":
        pass
    elif age > LIFETIME:
        new |= {"phase": "FAILED", "error": "HANDLE_EXPIRED", "retry_phase": None}
    elif event == "busy":
        new["due"] = at + POLL
    elif event in ("done", "partial"):
        if phase == "RENDERING":
            new |= {"phase": "SUCCEEDED" if event == "done" else "PARTIAL_SUCCESS", "failures": 0, "error": None}
        else:
            new |= {"phase": PHASES[PHASES.index(phase) + 1], "failures": 0, "due": at}
    elif event == "retryable":
        tries = job["failures"] + 1
        if tries >= MOST_FAILURES:
            new |= {"phase": "FAILED", "failures": tries, "error": error or "FAILURE_LIMIT", "retry_phase": phase}
        else:
            new |= {"failures": tries, "due": at + min(300, 10 * 2 ** job["failures"]), "error": error}
    elif event == "fatal":
        new |= {"phase": "FAILED", "error": error or "FATAL", "retry_phase": phase}
    if new != job:
        new["revision"] = job["revision"] + 1
    return new


def _apply(job_id: str, job: dict | None, events: list[tuple]) -> tuple[dict | None, list[tuple]]:
    """The job after events (at, event, error) in their order, and its transitions."""
    rows = []
    for at, event, error in events:
        job = job or new_job(at)
        new = step(job, event, at, error)
        if new != job:
            rows.append((job_id, at, event, job["phase"], new["phase"], new["due"], new["failures"], new["error"], new["revision"]))
        job = new
    return job, rows


def _numbered(events: pd.DataFrame) -> dict[int, tuple]:
    """Events (at, event, error) by seq; of different ones with one seq the least."""
    out: dict[int, tuple] = {}
    for e in events.itertuples(index=False):
        if pd.isna(e.seq):
            continue
        one = (int(e.at), e.event, None if pd.isna(e.error) else e.error)
        seq = int(e.seq)
        out[seq] = min(out.get(seq, one), one, key=lambda x: (x[0], x[1], x[2] or ""))
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])
    return out.astype({"at": "int64", "due": "Int64", "failures": "int32", "revision": "int32"})


def fold(events: DataFrame) -> DataFrame:
    """All transitions of a table of events (job_id, at, seq, event, error)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        known = _numbered(group)
        ready = []
        while len(ready) in known:
            ready.append(known[len(ready)])
        return _frame(_apply(group["job_id"].iloc[0], None, ready)[1])

    slim = events.select("job_id", "at", "seq", "event", "error").filter("job_id is not null")
    return slim.groupBy("job_id").applyInPandas(run, OUT)


class JobProcessor(StatefulProcessor):
    """A job's phase, the number of the event that it waits for, and the events that came before their turn."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", f"{STATE}, next int, timer long")
        self.early = handle.getMapState("early", "seq int", PENDING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.job.get() if self.job.exists() else None
        job = dict(zip(_NAMES, state, strict=False)) if state else None
        if job and job["phase"] is None:
            job = None
        waits, timer = (state[-2], state[-1]) if state else (0, None)
        known = {seq: e for seq, e in _numbered(pd.concat(list(rows))).items() if seq >= waits}
        for seq, e in known.items():
            if not self.early.containsKey((seq,)):
                self.early.updateValue((seq,), e)
        ready = []
        while self.early.containsKey((waits,)):
            e = self.early.getValue((waits,))
            ready.append((int(e[0]), e[1], e[2]))
            self.early.removeKey((waits,))
            waits += 1
        job, out = _apply(key[0], job, ready)
        if timer is not None:
            self.handle.deleteTimer(timer)
        newest = (max((e[0] for e in known.values()), default=0) + 2 * LIFETIME) * 1000
        timer = max(timer or 0, newest, timerValues.getCurrentWatermarkInMs() + 1)
        self.handle.registerTimer(timer)
        self.job.update((*(job[n] if job else None for n in _NAMES), waits, timer))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.job.clear()
        self.early.clear()
        yield _frame([])

    def close(self) -> None:
        pass


def stream(events: DataFrame) -> DataFrame:
    """Transitions of a stream of events, each once; the session's state store must be ``STATE_STORE``."""
    slim = events.select("job_id", "at", "seq", "event", "error", F.timestamp_seconds(F.col("at") + 1).alias("ts")).filter("job_id is not null")
    timed = slim.withWatermark("ts", f"{2 * LIFETIME} seconds")
    return timed.groupBy("job_id").transformWithStateInPandas(JobProcessor(), OUT, "Append", "EventTime")


def wake_ups(transitions: DataFrame, now: int, most: int = 100) -> DataFrame:
    """The jobs that are due at ``now``, the longest waiting first, at most ``most`` a sweep."""
    last = transitions.groupBy("job_id").agg(F.max_by(F.struct("phase", "due"), "revision").alias("s")).select("job_id", "s.*")
    return last.filter((F.col("due") <= now) & ~F.col("phase").isin([*TERMINAL, "UPLOADING"])).orderBy("due", "job_id").limit(most)
