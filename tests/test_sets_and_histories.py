"""Published sets that survive a commit stopped anywhere, and edit histories as batch and stream."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quoin.sources.artifacts import ArtifactStore, Conflict, Missing, promote, publish_batches
from quoin.sources.folders import shared_folder
from quoin.streaming import history

SET = ("walls", "rooms")


@pytest.fixture
def store(spark):
    held = ArtifactStore(spark, shared_folder(spark, "set"), SET)
    held.commit(tables(spark, 1))
    return held


def tables(spark, k):
    return {name: spark.range(k, k + 3).withColumn("version", F.lit(k)) for name in SET}


def whole(store) -> int:
    """The version of the rows that readers see, which is one for all tables."""
    seen = {r.version for name in SET for r in store.read(name).collect()}
    assert len(seen) == 1 and all(store.read(n).count() == 3 for n in SET)
    return seen.pop()


class Killed(BaseException):
    pass


def test_a_commit_stopped_between_any_two_writes(spark, store):
    """Old or new, and whole; what was written for nothing goes, and the next commit works."""
    steps = ["write rooms", "write walls", "write manifest", "publish"]
    for at, name in enumerate(steps):
        taken = []

        def stop(step, name=name, taken=taken):
            taken.append(step)
            if step == name:
                raise Killed

        other = ArtifactStore(spark, store.root, SET)
        other.before = stop
        with pytest.raises(Killed):
            other.commit(tables(spark, 9))
        assert taken == steps[: at + 1] and whole(store) == 1 and store.version() == 1
    assert store.vacuum() == []
    assert store.commit(tables(spark, 2)) == 2 and whole(store) == 2


def test_a_commit_that_dies_without_cleaning_up(spark, store, monkeypatch):
    """A lost driver leaves folders and a manifest without its name; readers don't see them and vacuum removes them."""
    other = ArtifactStore(spark, store.root, SET)
    monkeypatch.setattr(other, "_discard", lambda revision: None)
    monkeypatch.setattr(other, "_publish", lambda manifest: (_ for _ in ()).throw(Killed()))
    with pytest.raises(Killed):
        other.commit(tables(spark, 9))
    assert whole(store) == 1 and len(store.vacuum()) == 1 and whole(store) == 1


def test_two_commits_at_once(spark, store):
    """The second to publish finds its version taken, and its tables go."""
    slow = ArtifactStore(spark, store.root, SET)
    slow.before = lambda step: store.commit(tables(spark, 5)) if step == "publish" else None
    with pytest.raises(Conflict):
        slow.commit(tables(spark, 6))
    assert whole(store) == 5 and store.version() == 2 and store.vacuum() == []
    with pytest.raises(Conflict):
        store.commit(tables(spark, 7), expected=1)
    assert store.commit(tables(spark, 7), expected=2) == 3 and whole(store) == 7


def test_sets_that_lack_tables(spark, store):
    with pytest.raises(Missing, match="walls"):
        store.commit({"rooms": spark.range(1)})
    assert store.commit({"rooms": tables(spark, 1)["rooms"]}, keep=True) == 2 and whole(store) == 1
    with pytest.raises(KeyError):
        store.read("doors")


def test_rolling_back(spark, store):
    store.commit(tables(spark, 2))
    store.commit(tables(spark, 3))
    assert store.roll_back(1) == 4 and whole(store) == 1 and store.read("walls", 3).first().version == 3
    store.vacuum(keep=1)
    assert store.versions() == [4] and whole(store) == 1


def test_promotion_checks_and_rewrites(spark, store):
    staging = shared_folder(spark, "staged")
    rows = spark.createDataFrame([(1, f"{staging}/a.png"), (1, f"{staging}"), (1, f"{staging}x/a"), (1, None)], "version int, path string")
    rows.write.parquet(f"{staging}/walls")
    with pytest.raises(Missing, match="rooms"):
        promote(store, staging)
    rows.write.parquet(f"{staging}/rooms")
    rows.write.parquet(f"{staging}/hints")
    assert promote(store, staging + "/", optional=("hints", "none"), expected=1) == 2
    want = {f"{store.root}/a.png", store.root, f"{staging}x/a", None}
    assert all({r.path for r in store.read(n).collect()} == want for n in ("walls", "rooms", "hints"))


def test_batches_are_published_once(spark, store, tmp_path):
    """A batch that a restarted stream repeats changes nothing."""
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    publish = publish_batches(store, "corrections", lambda batch: {"walls": batch.withColumn("version", F.lit(1))})

    def run():
        stream = spark.readStream.schema("id long").parquet(source)
        stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    spark.range(10, 13).write.parquet(source)
    run()
    assert store.version() == 2 and store.manifest()["writers"] == {"corrections": 0} and {r.id for r in store.read("walls").collect()} == {10, 11, 12}
    publish(spark.range(99, 100), 0)
    assert store.version() == 2 and whole(store) == 1
    spark.range(20, 23).write.mode("append").parquet(source)
    run()
    assert store.version() == 3 and store.manifest()["writers"] == {"corrections": 1}


EDITS = "editor long, ts double, event_id long, action string, value long"


def test_steps():
    held = history.History()
    for at, (action, value, want) in enumerate([
        ("undo", 0, ((), 0, ())), ("edit", 5, ((0,), 5, ())), ("edit", 5, ((0,), 5, ())), ("drag", 6, ((0, 5), 6, ())), ("drag", 7, ((0, 5), 7, ())), ("edit", 8, ((0, 5, 7), 8, ())),
        ("undo", 0, ((0, 5), 7, (8,))), ("undo", 0, ((0,), 5, (7, 8))), ("redo", 0, ((0, 5), 7, (8,))), ("drag", 9, ((0, 5, 7), 9, ())), ("redo", 0, ((0, 5, 7), 9, ())), ("", 3, ((0, 5, 7), 9, ())), ("drag", 1, ((5, 7, 9), 1, ())),
    ]):
        held = history.step(held, float(at), action, value, 3, 100.0)
        assert (held.past, held.shown, held.future) == want, action
    assert history.step(held, 500.0, "undo", 0, 3, 100.0)[:3] == ((), 0, ())


def edits(seed: int, editors: int, n: int):
    r, rows, clock = random.Random(seed), [], 0.0
    for event in range(n):
        clock += r.choice([0.0, 1.0, 5.0, 400.0])
        rows.append((r.choice([*range(editors), None]), clock, event, r.choice(["edit", "edit", "drag", "drag", "undo", "redo", None]), r.choice([None, 0, 1, 2, 3, 10**17 + 1])))
    return rows


def replayed(rows, limit, idle):
    out, held = [], {}
    for editor, at, event, action, value in sorted(rows, key=lambda x: (x[1], x[2])):
        if editor is not None:
            held[editor] = h = history.step(held.get(editor, history.History(at=at)), at, action or "", value or 0, limit, idle)
            out.append((editor, event, h.shown, len(h.past), len(h.future)))
    return sorted(out)


def test_batch(spark):
    rows = edits(3, 4, 600)
    given = spark.createDataFrame(rows, EDITS).repartition(6)
    got = sorted(map(tuple, history.fold(given, 5, 1000.0).collect()))
    assert got == replayed(rows, 5, 1000.0) and len(got) < 600
    with_small_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, history.fold(given, 5, 1000.0).collect())) == got
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_small_batches)
    assert history.fold(given.limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    """Micro-batch by micro-batch, with timers that drop idle histories on the way."""
    rows, source = edits(5, 3, 240), str(tmp_path / "in")
    cuts = [0, 50, 51, 120, 200, 240]
    for a, b in itertools.pairwise(cuts):
        spark.createDataFrame(rows[a:b], EDITS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EDITS).parquet(source)
        with_store = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        try:
            done = history.fold_stream(stream, 5, 1000.0, "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint"))
            done.outputMode("append").trigger(availableNow=True).start().awaitTermination()
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", with_store) if with_store else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*history.NAMES).collect()))
    assert got == replayed(rows, 5, 1000.0)
