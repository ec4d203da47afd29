"""Job state machine: events folded by job, as a batch and as a stream with the same transition table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.plans.bindings import bound
from quoin.registry import query

# Fixed values: (event, states it is taken from, state it leads to, whether the version grows).
REVIEWABLE = ("needs_review", "model_generated", "blocked", "generation_failed")
TRANSITIONS = [
    ("upload_invalid", ("created",), "rejected", False),
    ("discard", ("created",), "discarded", False),
    ("start", ("created",), "processing", False),
    ("worker_ok", ("processing",), "needs_review", False),
    ("worker_failed", ("processing",), "failed", False),
    ("save", REVIEWABLE, "saving_corrections", False),
    ("save_ok", ("saving_corrections",), "needs_review", True),
    ("save_failed", ("saving_corrections",), "restored", False),
    ("generate", REVIEWABLE, "generating", False),
    ("generate_ok", ("generating",), "model_generated", True),
    ("generate_blocked", ("generating",), "blocked", False),
    ("generate_failed", ("generating",), "generation_failed", False),
    ("timeout", ("processing",), "failed", False),
    ("timeout", ("generating",), "generation_failed", False),
]
#: Seconds after which a working job is given up; states that work.
LIMIT, WORKING = 900, ("processing", "generating")
RESTART = {"processing": "failed", "generating": "generation_failed", "saving_corrections": "needs_review"}
TABLE = {(event, state): (to, bump) for event, states, to, bump in TRANSITIONS for state in states}


def step(state: str, before: str, version: int, event: str) -> tuple[str, str, int, bool]:
    """(state, state to restore, version, taken); an event that the state doesn't take changes nothing."""
    if event == "restart":
        return RESTART.get(state, state), before, version, state in RESTART
    if (event, state) not in TABLE:
        return state, before, version, False
    to, bump = TABLE[event, state]
    if to == "saving_corrections":
        before = state
    return before if to == "restored" else to, before, version + bump, True


def fold(events: DataFrame, limit: float | None = None) -> DataFrame:
    """job, state, version, taken, refused: events (job, ts in seconds, event_id, event) in the order of (ts, event_id).

    A job that works for more than `limit` seconds when its next event comes has run into its timeout before that.
    """

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        state, before, version, taken, since = "created", "created", 0, 0, 0.0
        for at, event in part.sort_values(["ts", "event_id"])[["ts", "event"]].itertuples(index=False):
            if limit is not None and state in WORKING and at - since > limit:
                state, before, version, _ = step(state, before, version, "timeout")
            was = state
            state, before, version, ok = step(state, before, version, event)
            since = at if state != was else since
            taken += ok
        return pd.DataFrame([(key[0], state, version, taken, len(part) - taken)], columns=["job", "state", "version", "taken", "refused"])

    return events.groupBy("job").applyInPandas(run, "job long, state string, version long, taken long, refused long")


def fold_stream(events: DataFrame, limit: float | None = None) -> DataFrame:
    """The same over a stream: a row for each job and micro-batch with its state by then.

    With a limit a timer runs while a job works; a job without an event until it rings has its timeout then.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    columns = ["job", "state", "version", "taken", "refused"]

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, before, version, taken, refused = held.get if held.exists else ("created", "created", 0, 0, 0)
        if held.hasTimedOut:
            state, before, version, _ = step(state, before, int(version), "timeout")
        else:
            rows = pd.concat(list(parts))
            for event in rows.sort_values(["ts", "event_id"])["event"]:
                state, before, version, ok = step(state, before, int(version), event)
                taken, refused = taken + ok, refused + (not ok)
        held.update((state, before, int(version), int(taken), int(refused)))
        if limit is not None and state in WORKING:
            held.setTimeoutDuration(int(limit * 1000))
        yield pd.DataFrame([(key[0], state, version, taken, refused)], columns=columns)

    out = "job long, state string, version long, taken long, refused long"
    kept = "state string, before string, version long, taken long, refused long"
    timer = GroupStateTimeout.NoTimeout if limit is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy("job").applyInPandasWithState(run, out, kept, "update", timer)


def job_events(events: DataFrame) -> DataFrame:
    """Job events from the event table: the event's kind by its number."""
    kinds = [*dict.fromkeys(t[0] for t in TRANSITIONS if t[0] != "timeout"), "restart"]
    which = F.when(F.col("event_id") % 3 == 0, F.lit(kinds.index("start"))).otherwise((F.col("event_id") * 7 + F.col("user_id")) % F.lit(len(kinds)))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select(F.col("user_id").alias("job"), seconds.alias("ts"), "event_id", F.get(F.array(*map(F.lit, kinds)), which.cast("int")).alias("event"))


_STATES = ", ".join(f"('{event}', '{state}', '{to}', {int(bump)})" for (event, state), (to, bump) in TABLE.items())
_RESTART = ", ".join(f"('restart', '{state}', '{to}', 0)" for state, to in RESTART.items())


@query("job_fsm", (275, 276, 277, 278, 280, 281, 306, 307), f"""
WITH RECURSIVE e AS (SELECT user_id AS job, epoch_us(ts)/1e6 AS secs, CASE WHEN event_id % 3 = 0 THEN 'start' ELSE ['upload_invalid', 'discard', 'start', 'worker_ok', 'worker_failed', 'save', 'save_ok', 'save_failed', 'generate', 'generate_ok', 'generate_blocked', 'generate_failed', 'restart'][(event_id*7 + user_id) % 13 + 1] END AS event,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), t(event, state, goal, bump) AS (VALUES {_STATES}, {_RESTART}),
j AS (SELECT DISTINCT job, CAST(0 AS BIGINT) AS n, 'created' AS state, 'created' AS before, CAST(0 AS BIGINT) AS version, CAST(0 AS BIGINT) AS taken, CAST(0 AS BIGINT) AS refused, 0e0 AS since FROM e UNION ALL
 SELECT x.job, x.n, CASE WHEN t.goal IS NULL THEN s WHEN t.goal = 'restored' THEN before ELSE t.goal END, CASE WHEN t.goal = 'saving_corrections' THEN s ELSE before END, version + coalesce(t.bump, 0),
  taken + CASE WHEN t.goal IS NULL THEN 0 ELSE 1 END, refused + CASE WHEN t.goal IS NULL THEN 1 ELSE 0 END, CASE WHEN t.goal IS NULL OR CASE WHEN t.goal = 'restored' THEN before ELSE t.goal END = s THEN since ELSE secs END
 FROM (SELECT e.*, j.before, j.version, j.taken, j.refused, j.since, CASE WHEN j.state = 'processing' AND e.secs - j.since > {LIMIT * 3600} THEN 'failed' WHEN j.state = 'generating' AND e.secs - j.since > {LIMIT * 3600} THEN 'generation_failed' ELSE j.state END AS s FROM j JOIN e ON e.job = j.job AND e.n = j.n + 1) x
 LEFT JOIN t ON t.event = x.event AND t.state = x.s)
SELECT job, state, version, taken, refused FROM j QUALIFY row_number() OVER (PARTITION BY job ORDER BY n DESC) = 1""")
def job_fsm(spark, d):
    return fold(job_events(bound(spark, d, "events")), LIMIT * 3600)  # events lie hours apart


@query("review_staleness", (246, 284), """
WITH e AS (SELECT user_id, event_id, event_type, sha256(props) AS print, ts FROM events),
l AS (SELECT user_id, event_type, arg_max(print, ts) AS latest, arg_min(print, ts) AS reviewed FROM e GROUP BY ALL)
SELECT user_id, event_type, CASE WHEN latest = reviewed THEN 'confirmed' ELSE 'stale' END AS state FROM l""")
def review_staleness(spark, d):
    """A review holds while the fingerprint that it saw is the latest."""
    e = bound(spark, d, "events").withColumn("print", F.sha2("props", 256))
    l = e.groupBy("user_id", "event_type").agg(F.max_by("print", "ts").alias("latest"), F.min_by("print", "ts").alias("reviewed"))
    return l.select("user_id", "event_type", F.when(F.col("latest") == F.col("reviewed"), "confirmed").otherwise("stale").alias("state"))
