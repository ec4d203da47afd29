"""Undo and redo of an editor: edits folded by editor, as a batch and as a stream with the same step.

A history is what lies before, what is shown, and what was undone.  An edit puts what is shown into the past, of which
the newest `limit` stay, and forgets what was undone; a drag's further moves only change what is shown, so that a whole
drag is one edit.  An edit to what is shown already changes nothing.  After `idle` seconds without an event an editor
begins anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quoin.plans.bindings import bound
from quoin.registry import query

#: Edits that can be undone, the value an editor begins with, seconds until a history is dropped.
LIMIT, START, IDLE = 50, 0, 86_400
OUT = "editor long, event_id long, shown long, past long, future long"
NAMES = [f.split()[0] for f in OUT.split(", ")]


class History(NamedTuple):
    past: tuple = ()
    shown: int = START
    future: tuple = ()
    dragging: bool = False
    at: float = 0.0


def step(held: History, at: float, action: str, value: int, limit: int, idle: float) -> History:
    """The history after an event: edit and drag take a value, undo and redo don't; other actions only end a drag."""
    if at - held.at > idle:
        held = History()
    past, shown, future = held.past, held.shown, held.future
    if action in ("edit", "drag"):
        if value != shown:
            past = past if action == "drag" and held.dragging else (*past, shown)[-limit:]
            shown, future = value, ()
    elif action == "undo" and past:
        past, shown, future = past[:-1], past[-1], (shown, *future)
    elif action == "redo" and future:
        past, shown, future = (*past, shown)[-limit:], future[0], future[1:]
    return History(past, shown, future, action == "drag", at)


def fold(edits: DataFrame, limit: int = LIMIT, idle: float = IDLE) -> DataFrame:
    """editor, event_id, shown, past, future (how many edits can be undone and redone) after each event.

    edits: editor, ts (seconds), event_id, action, value, in the order of (ts, event_id).  Events of an editor lie side by
    side in a sorted partition and stream through, so a task holds one history, however many events an editor has.
    Events without an editor are left out; a null value counts as START.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        editor, held = None, History()
        for batch in batches:
            out = []
            for who, at, event, action, value in batch.itertuples(index=False, name=None):
                held = step(History(at=at) if who != editor else held, at, action, value, limit, idle)
                editor = who
                out.append((who, event, held.shown, len(held.past), len(held.future)))
            yield pd.DataFrame(out, columns=NAMES)

    return _ready(edits).repartition("editor").sortWithinPartitions("editor", "ts", "event_id").mapInPandas(run, OUT)


def _ready(edits: DataFrame) -> DataFrame:
    kept = edits.where("editor is not null and ts is not null and event_id is not null")
    return kept.select("editor", "ts", "event_id", F.coalesce("action", F.lit("")).alias("action"), F.coalesce("value", F.lit(START)).cast("long").alias("value"))


class Histories(StatefulProcessor):
    """The same for a stream: past and future are list states, and a timer drops a history that lies idle."""

    def __init__(self, limit: int, idle: float):
        self.limit, self.idle = limit, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "shown long, dragging boolean, at double")
        self.past, self.future = handle.getListState("past", "value long"), handle.getListState("future", "value long")

    def _load(self, at: float) -> History:
        if not self.now.exists():
            return History(at=at)
        shown, dragging, last = self.now.get()
        rows = [tuple(v[0] for v in s.get()) if s.exists() else () for s in (self.past, self.future)]
        return History(rows[0], shown, rows[1], dragging, last)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held, out = self._load(float(events["ts"].iloc[0])), []
        for at, event, action, value in events[["ts", "event_id", "action", "value"]].itertuples(index=False, name=None):
            held = step(held, at, action, value, self.limit, self.idle)
            out.append((key[0], event, held.shown, len(held.past), len(held.future)))
        self.now.update((held.shown, held.dragging, held.at))
        for state, values in ((self.past, held.past), (self.future, held.future)):
            state.put([(v,) for v in values]) if values else state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # A millisecond later than an event could still belong to this history.
        self.handle.registerTimer(int((held.at + self.idle) * 1000) + 1)
        yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.now, self.past, self.future):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def fold_stream(edits: DataFrame, limit: int = LIMIT, idle: float = IDLE, delay: str = "0 seconds") -> DataFrame:
    """The same rows from a stream, appended micro-batch by micro-batch.

    Events must come in order from one micro-batch to the next; inside one they are sorted.  An event behind the watermark
    by more than `delay` is dropped, as Spark does.  State lies in the RocksDB store, which the session must name.
    """
    timed = _ready(edits).withColumn("time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("time", delay)
    return timed.groupBy("editor").transformWithStateInPandas(Histories(limit, idle), OUT, "Append", "EventTime")


def table_edits(events: DataFrame) -> DataFrame:
    """Edits from the event table: its five types as edit, drag, undo and redo, and one digit of the value."""
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "purchase", "redo").when(F.col("event_type") == "view", "drag").otherwise("edit")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select(F.col("user_id").alias("editor"), seconds.alias("ts"), "event_id", action.alias("action"), (F.floor("value") % 10).cast("long").alias("value"))


@query("edit_history", (193, 285), """
WITH RECURSIVE e AS (SELECT user_id AS editor, event_id, CASE event_type WHEN 'error' THEN 'undo' WHEN 'purchase' THEN 'redo' WHEN 'view' THEN 'drag' ELSE 'edit' END AS action, CAST(floor(value) AS BIGINT) % 10 AS v,
 row_number() OVER w AS n, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 86400000000, true) AS anew, coalesce(lag(event_type) OVER w = 'view', false) AS dragged FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
h AS (SELECT DISTINCT editor, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST([] AS BIGINT[]) AS past, CAST(0 AS BIGINT) AS shown, CAST([] AS BIGINT[]) AS future FROM e
 UNION ALL SELECT editor, n, event_id,
  CASE WHEN action IN ('edit', 'drag') AND v <> s AND NOT (action = 'drag' AND dragged AND NOT anew) OR action = 'redo' AND len(f) > 0 THEN list_slice(list_append(p, s), greatest(len(p) - 6, 1), len(p) + 1) WHEN action = 'undo' AND len(p) > 0 THEN p[1:len(p)-1] ELSE p END,
  CASE WHEN action IN ('edit', 'drag') THEN v WHEN action = 'undo' AND len(p) > 0 THEN p[len(p)] WHEN action = 'redo' AND len(f) > 0 THEN f[1] ELSE s END,
  CASE WHEN action IN ('edit', 'drag') AND v <> s THEN [] WHEN action = 'undo' AND len(p) > 0 THEN list_prepend(s, f) WHEN action = 'redo' AND len(f) > 0 THEN f[2:] ELSE f END
 FROM (SELECT e.*, CASE WHEN anew THEN [] ELSE h.past END AS p, CASE WHEN anew THEN 0 ELSE h.shown END AS s, CASE WHEN anew THEN [] ELSE h.future END AS f FROM h JOIN e ON e.editor = h.editor AND e.n = h.n + 1))
SELECT editor, event_id, shown, CAST(len(past) AS BIGINT) AS past, CAST(len(future) AS BIGINT) AS future FROM h WHERE n > 0""")
def edit_history(spark, d):
    """Every event's history, of which eight edits can be undone."""
    return fold(table_edits(bound(spark, d, "events")), limit=8)
