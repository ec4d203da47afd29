"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of token ids with a share of the mixture.  Round w gives queue s the quantum Q = window * share;
what can't be given in whole tokens is the queue's deficit, which the next round adds, so that after w rounds queue s
has given floor(w * Q) tokens.  The form is closed: deficits carry over windows and partitions without passing state.
Rounds follow each other in one stream, which is cut every `window` tokens; a sequence so starts within one token a
queue of its round, and holds every source in proportion.  In the round in which a queue runs dry it gives what it
has; then the shares of the others grow in proportion (a new phase; at most one phase a queue).

A document needs only its place in its queue: its running sum in its own task, plus the totals of the tasks before.
Token ids are encoded once and written to the shared folder; only per-task totals are shuffled.

With more than MAX_QUEUES sources the same stream is laid out by shuffles: a document's runs, one a round, find their
places by running sums over rounds and within a round, so that no task holds the weights of all queues.  The driver
holds each queue's total and weights.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm import common

#: Token that ends each document.
END = 1
#: Queues whose phases every task holds; with more, runs are laid out by shuffles, to the same result.
MAX_QUEUES = 1024
#: Rounds that one task adds up.
ROUNDS = 10_000
#: Rows of the table of per-task bases (about 60 bytes each) up to which it is broadcast; beyond, it is joined.
BROADCAST_ROWS = 200_000
TOKENS = "doc_id long, queue string, part int, start_in_part long, n_tokens long, ids binary"
RUNS = "doc_id long, start long, length long, doc_tokens long, queue string, place long, phase int, round long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, source string, ids binary"


@dataclass(frozen=True)
class Phase:
    """Full rounds 0 to rounds - 1 and a last one; the stream's tokens from `at` on.

    weights are shares in `total`; before, last: by queue, tokens given before the phase and in its last round.
    """

    at: int
    rounds: int
    total: int
    index: dict
    weights: list
    before: list
    last: list

    def given(self, w: int, i: int, window: int) -> int:
        return w * window * self.weights[i] // self.total


def phases(totals: dict[str, int], window: int, targets: dict[str, float] | None = None) -> list[Phase]:
    """targets: wanted shares by queue, on any scale; queues without one weigh as their tokens do."""
    left = {s: n for s, n in sorted(totals.items()) if n > 0}
    corpus = sum(left.values())
    named = sum((targets or {}).get(s, 0) for s in left) or 1
    weight = dict(left)
    if targets:
        weight = {s: max(1, round((targets.get(s, 0) / named or n / corpus) * 10**9)) for s, n in left.items()}
    out, done, at = [], dict.fromkeys(left, 0), 0
    while left:
        names = list(left)
        total = sum(weight[s] for s in names)
        # Rounds that queue s can give in full: the most w with floor(w * Q) <= left.
        rounds = min(((left[s] + 1) * total - 1) // (window * weight[s]) for s in names)
        last = [min((rounds + 1) * window * weight[s] // total, left[s]) - rounds * window * weight[s] // total for s in names]
        out.append(Phase(at, rounds, total, {s: i for i, s in enumerate(names)}, [weight[s] for s in names], [done[s] for s in names], last))
        for i, s in enumerate(names):
            took = out[-1].given(rounds, i, window) + last[i]
            done[s] += took
            left[s] -= took
            at += took
            if not left[s]:
                del left[s]
    return out


def cuts(place: int, n: int, queue: str, plan: list[Phase], window: int):
    """(start in document, length, sequence, offset) of the tokens [place, place + n) of a queue."""
    start = 0
    for phase in plan:
        i = phase.index.get(queue)
        if i is None:
            continue
        weight, total, before = phase.weights[i], phase.total, phase.before[i]
        full = phase.given(phase.rounds, i, window)
        while start < n and place - before < full + phase.last[i]:
            y = place - before
            if y < full:
                w = ((y + 1) * total + window * weight - 1) // (window * weight) - 1
                low, high = phase.given(w, i, window), phase.given(w + 1, i, window)
            else:
                w, low, high = phase.rounds, full, full + phase.last[i]
            floors = [w * window * x // total for x in phase.weights]
            if w < phase.rounds:
                ahead = sum((w + 1) * window * x // total for x in phase.weights[:i]) - sum(floors[:i])
            else:
                ahead = sum(phase.last[:i])
            at = phase.at + sum(floors) + ahead + y - low
            run = min(n - start, high - y)
            while run:
                length = min(run, window - at % window)
                yield start, length, at // window, at % window
                start, place, at, run = start + length, place + length, at + length, run - length
        if start == n:
            return


def encode(docs: DataFrame, json_path: str) -> DataFrame:
    """doc_id, source, text -> TOKENS: ids with the end token, and each document's place in its task's queue."""

    def run(batches):
        from collections import defaultdict

        import pandas as pd
        from pyspark import TaskContext

        packed = common.byte_bpe(json_path).packed
        part, ends, end = TaskContext.get().partitionId(), defaultdict(int), END.to_bytes(2, "little")
        for batch in batches:
            rows = []
            for doc_id, queue, text in zip(batch["doc_id"], batch["queue"], batch["text"]):
                ids = packed(text) + end
                rows.append((doc_id, queue, part, ends[queue], len(ids) // 2, ids))
                ends[queue] += len(ids) // 2
            out = pd.DataFrame(rows, columns=["doc_id", "queue", "part", "start_in_part", "n_tokens", "ids"])
            out["doc_id"] = batch["doc_id"].astype("Int64").to_numpy() if len(out) else out["doc_id"]
            yield out

    return docs.mapInPandas(common.roomy(run, "tokenizers"), TOKENS)


def pack(docs: DataFrame, window: int = 2048, targets: dict[str, float] | None = None, json_path: str | None = None) -> DataFrame:
    """One row per piece (PIECES): ids is little-endian unsigned 32-bit, start counts the document's ids before it.

    Every id of every row, with one end token a row, lies in exactly one piece, and every sequence but the last is
    exactly `window` ids: no padding.  Null and empty texts are one end token; a null source is a queue of its own;
    rows that repeat an id are packed each; null ids stay null.  An empty table gives no pieces.
    """
    spark = docs.sparkSession
    json_path = json_path or common.default_tokenizer()
    source = F.coalesce(F.col("source").cast("string"), F.lit("\x00"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("queue"), common.text_or_empty().alias("text"))
    tokens = common.settle(encode(base, json_path), "tokens")
    sums = tokens.groupBy("part", "queue").agg(F.sum("n_tokens").alias("n"))
    totals = {r["queue"]: r["n"] for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # a row a source
    plan = phases(totals, window, targets)
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = common.settle(sums.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    if len(totals) > MAX_QUEUES:
        return laid_out(tokens, bases, plan, window)
    placed = tokens.join(F.broadcast(bases) if bases.count() <= BROADCAST_ROWS else bases, ["part", "queue"])

    def run(batches):
        import numpy as np
        import pandas as pd

        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "source", "ids"]
        for batch in batches:
            rows, at = [], []
            for i, (queue, place, n, ids) in enumerate(zip(batch["queue"], batch["place"], batch["n_tokens"], batch["ids"])):
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
                name = None if queue == "\x00" else queue
                for start, length, sequence, offset in cuts(place, n, queue, plan, window):
                    rows.append((None, start, length, n, sequence, offset, name, wide[4 * start : 4 * (start + length)]))
                    at.append(i)
                if len(rows) >= 20_000:
                    yield _framed(pd.DataFrame(rows, columns=names), batch, at)
                    rows, at = [], []
            yield _framed(pd.DataFrame(rows, columns=names), batch, at)

    return placed.select("doc_id", "queue", (F.col("base") + F.col("start_in_part")).alias("place"), "n_tokens", "ids").mapInPandas(common.roomy(run), PIECES)


def runs(place: int, n: int, plan, window: int):
    """(start in document, length, phase, round) of the tokens [place, place + n) of a queue with these phases."""
    start = 0
    for p in plan:
        weight, total = int(p["weight"]), int(p["total"])
        full = p["rounds"] * window * weight // total
        while start < n and place - p["before"] < full + p["last"]:
            y = place - p["before"]
            w, high = p["rounds"], full + p["last"]
            if y < full:
                w = ((y + 1) * total + window * weight - 1) // (window * weight) - 1
                high = (w + 1) * window * weight // total
            run = min(n - start, high - y)
            yield start, run, p["phase"], w
            start, place = start + run, place + run
        if start == n:
            return


def laid_out(tokens: DataFrame, bases: DataFrame, plan: list[Phase], window: int) -> DataFrame:
    """PIECES of any number of queues: rounds follow each other, and in a round the queues in the order of their names."""
    spark = tokens.sparkSession
    rows = [(q, k, str(p.weights[i]), str(p.total), p.rounds, p.before[i], p.last[i]) for k, p in enumerate(plan) for q, i in p.index.items()]
    table = spark.createDataFrame(rows, "queue string, phase int, weight string, total string, rounds long, before long, last long")
    table = table.groupBy("queue").agg(F.sort_array(F.collect_list(F.struct("phase", "weight", "total", "rounds", "before", "last"))).alias("plan"))
    bases = common.settle(bases.join(table, "queue"), "planned")
    placed = tokens.join(F.broadcast(bases) if bases.count() <= BROADCAST_ROWS // 10 else bases, ["part", "queue"])

    def run(batches):
        import numpy as np
        import pandas as pd

        names = ["doc_id", "start", "length", "doc_tokens", "queue", "place", "phase", "round", "ids"]
        for batch in batches:
            rows, at = [], []
            for i, (queue, place, n, ids, phased) in enumerate(zip(batch["queue"], batch["place"], batch["n_tokens"], batch["ids"], batch["plan"])):
                wide = np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes()
                for start, length, phase, w in runs(place, n, phased, window):
                    rows.append((None, start, length, n, queue, place + start, phase, w, wide[4 * start : 4 * (start + length)]))
                    at.append(i)
                if len(rows) >= 20_000:
                    yield _framed(pd.DataFrame(rows, columns=names), batch, at)
                    rows, at = [], []
            yield _framed(pd.DataFrame(rows, columns=names), batch, at)

    found = placed.select("doc_id", "queue", (F.col("base") + F.col("start_in_part")).alias("place"), "n_tokens", "ids", "plan").mapInPandas(common.roomy(run), RUNS)
    found = common.settle(found, "runs")
    sums = found.groupBy("phase", "round").agg(F.sum("length").alias("n")).withColumn("block", F.floor(F.col("round") / ROUNDS))
    sums = common.settle(sums, "rounds")
    before = Window.orderBy("phase", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sums.groupBy("phase", "block").agg(F.sum("n").alias("n")).select("phase", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("phase", "block").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("n", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(blocks, ["phase", "block"])
    starts = starts.select("phase", "round", (F.col("base") + F.col("n")).alias("at"))
    ahead = Window.partitionBy("phase", "round").orderBy("queue", "place").rowsBetween(Window.unboundedPreceding, -1)
    dealt = found.withColumn("ahead", F.coalesce(F.sum("length").over(ahead), F.lit(0))).join(starts, ["phase", "round"])
    dealt = dealt.withColumn("at", F.col("at") + F.col("ahead")).withColumn("end", F.col("at") + F.col("length"))
    number = lambda x: F.floor(x / window).cast("long")
    cut = dealt.withColumn("sequence_id", F.explode(F.sequence(number(F.col("at")), number(F.col("end") - 1))))
    low = F.greatest("at", F.col("sequence_id") * window)
    cut = cut.withColumn("low", low).withColumn("length", F.least("end", (F.col("sequence_id") + 1) * window) - F.col("low")).withColumn("skip", F.col("low") - F.col("at"))
    return cut.select(
        "doc_id", (F.col("start") + F.col("skip")).alias("start"), "length", "doc_tokens", "sequence_id",
        (F.col("low") - F.col("sequence_id") * window).alias("offset"), F.when(F.col("queue") != "\x00", F.col("queue")).alias("source"),
        F.substring("ids", (4 * F.col("skip") + 1).cast("int"), (4 * F.col("length")).cast("int")).alias("ids"),
    )


def _framed(out, batch, at):
    out["doc_id"] = batch["doc_id"].astype("Int64").take(at).to_numpy()
    return out


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Shares are the corpus's own, so every window holds every source in its corpus proportion."""
    pieces = pack(common.table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
