"""Order-dependent kernels, text and plan documents on hand-made cases."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quoin.functions import geometry, text
from quoin.operators import grouped, intervals, polygons, rules, scale
from quoin.sources import plans
from quoin.streaming import jobs


def test_running_overlap_sees_nested_intervals(spark):
    rows = spark.createDataFrame([(1, "a", 0.0, 10.0), (1, "b", 1.0, 2.0), (1, "c", 3.0, 4.0)], "plan long, id string, s double, e double")
    assert intervals.overlaps_adjacent(rows, ["plan"]).count() == 1
    assert intervals.overlaps_running(rows, ["plan"]).count() == 2
    assert [tuple(r)[1:] for r in intervals.complement(rows, ["plan"], -1.0, 11.0).orderBy("s").collect()] == [(-1.0, 0.0), (10.0, 11.0)]


@pytest.mark.parametrize(
    ("given", "state", "width", "height", "unit"),
    [
        ("Bedroom (10'3 x 12')", "value", 3.1242, 3.6576, "ft"),
        ("10′6½″ x 12′", "value", 3.2131, 3.6576, "ft"),
        ("10 x 12 ft", "value", 3.048, 3.6576, "ft"),
        ("599X340", "value", 5.99, 3.40, "context_cm"),
        ("3 m x 12 ft", "value", 3.0, 3.6576, "mixed"),
        ("10'13 x 12'", "error", None, None, None),
        ("10'6/0\" x 12'", "error", None, None, None),
        ("86\"x5", "error", None, None, None),
        ("10'3/ x 12'", "none", None, None, None),
        ("abc3 x 4m", "none", None, None, None),
        (None, "none", None, None, None),
    ],
)
def test_dimension_pair(spark, given, state, width, height, unit):
    got = spark.createDataFrame([(given,)], "t string").select(text.dimension_pair(F.col("t")).alias("p")).first()["p"]
    assert got["state"] == state and got["unit"] == unit
    for mine, want in ((got["width_m"], width), (got["height_m"], height)):
        assert mine is want is None or abs(mine - want) < 1e-4


def test_classify(spark):
    rows = spark.createDataFrame([("Toilet 86\"x5",), ("Main Stair",), ("Lift A",), ("3 x 4 m",), ("garage",), ("Balcony",)], "t string")
    assert [r[0] for r in rows.select(text.classify(F.col("t"))).collect()] == ["room_label", "stair_label", "lift_label", "dimension", "text", "balcony_label"]


def test_half_even_and_positive_modulo(spark):
    got = spark.range(1).select(geometry.snap(F.lit(0.025)).alias("a"), F.rint(F.lit(2.5)).alias("b"), F.pmod(F.lit(-7.5), F.lit(360.0)).alias("c")).first()
    assert (got.a, got.b, got.c) == (0.0, 2.0, 352.5)


CONSTRAINT = "plan long, ord int, tier string, m0 double, m1 double, e0 double, e1 double, weight double"


def solved(spark, rows):
    c = spark.createDataFrame([(1, i, t, p, p, 1.0, 1.0, 1.0) for i, (t, p) in enumerate(rows)], CONSTRAINT)
    got = scale.solve(c).collect()
    return (round(got[0].ppm, 6), got[0].source) if got else None, {r.ord: r.reason for r in scale.audit(c).collect()}


def test_scale_tiers(spark):
    assert solved(spark, [("room_dimension", 100.0), ("door_width", 140.0), ("door_width", 140.0)])[0] == (100.0, "room_dimension")
    assert solved(spark, [("plan_extent", 80.0), ("door_width", 125.0)])[0] == (80.0, "plan_extent")
    got, reasons = solved(spark, [("room_dimension", 5000.0), ("door_width", 90.0)])
    assert got == (90.0, "door_width") and reasons[0] == "pixels_per_metre_out_of_range"
    assert solved(spark, [("door_width", 5000.0)])[0] is None
    _, reasons = solved(spark, [("room_dimension", 100.0)] + [("wall_thickness", 200.0)] * 5)
    assert list(reasons.values()).count("superseded_by_room_dimension_tier") == 5


def test_matching():
    edges = [(1, "a", "x"), (2, "a", "y"), (3, "b", "x")]
    assert grouped.most_pairs(edges) == [("a", "y"), ("b", "x")]
    chain = [e for k in range(3000) for e in ((k, k, k), (k + 0.5, k, k - 1 if k else 3000))][::-1]
    assert len(grouped.most_pairs(chain)) == 3000
    r = random.Random(4)
    for _ in range(300):  # as many pairs as any set of edges without a common end has
        few = [(r.random(), a, b) for a in range(r.randint(1, 5)) for b in range(4) if r.random() < 0.5]
        got = grouped.most_pairs(few)
        most = max(len(c) for n in range(len(few) + 1) for c in itertools.combinations(few, n) if len({x[1] for x in c}) == len({x[2] for x in c}) == n) if len(few) < 12 else len(got)
        assert len(got) == most and len({a for a, _ in got}) == len({b for _, b in got}) == len(got) and set(got) <= {(a, b) for _, a, b in few}


def test_line_gaps():
    assert grouped.line_gaps([(0, 0.0, 0.0, 1.5), (1, 0.0, 2.4, 4.0)], 0.18) == [(0, 1, 1.5, 2.4)]
    assert grouped.line_gaps([(0, 0.0, 5.0, 10.0), (1, 0.17, 0.0, 4.0)], 0.18) == [(1, 0, 4.0, 5.0)]
    assert grouped.line_gaps([(0, 0.0, 0.0, 9.0), (1, 0.0, 1.0, 2.0), (2, 0.0, 3.0, 4.0)], 0.18) == []


def test_routes():
    free = {(x, y) for x in range(5) for y in range(5)} - {(2, y) for y in range(4)}
    assert grouped.breadth_first(free, (0, 0))[4, 0] == 12
    path = grouped.a_star(free, (0, 0), (4, 0))
    assert len(path) == 13 and (2, 4) in path
    assert grouped.a_star(free - {(2, 4)}, (0, 0), (4, 0)) is None
    assert grouped.nearest_free({(1, 0), (0, 1)}, (0, 0), 3) == (1, 0)


def test_quality_states(spark):
    parts = {k: 1.0 for k in rules.WEIGHTS}
    row = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 4, 0), (0, 0, 1), (0, 0, 2)], "errors int, warnings int, severe int")
    got = rules.quality(row.withColumns({k: F.lit(v) for k, v in parts.items()})).collect()
    assert [r.state for r in got] == ["high", "review_required", "review_required", "failed", "failed"]


def test_plan_documents(spark, tmp_path):
    old = {
        "schema_version": "2.1",
        "walls": [{"start": {"x": 0, "y": 0}, "end": {"x": 4, "y": 0}}, {"id": "w", "start": {"x": 4, "y": 0}, "end": {"x": 4, "y": 4}}],
        "doors": [{"wall_id": "0", "offset_m": 2.0, "width_m": 0}],
        "windows": [{"wall_id": "w", "offset_m": 1.0, "width_m": 1.0, "start_offset_m": 0.25, "end_offset_m": 0.75}],
        "rooms": [{"name": "Hall"}, {"id": "r1"}],
        "metadata": {"a": 1},
        "surprise": 1,
    }
    (tmp_path / "p.json").write_text(json.dumps(old, indent=1))
    read = plans.read_plans(spark, str(tmp_path / "p.json"))
    assert [r.field for r in plans.unknown_fields(spark, str(tmp_path / "p.json")).collect()] == ["surprise"]
    new = plans.name_walls(plans.migrate(read))
    doc = new.first()
    assert doc.schema_version == "3.0" and [w.id for w in doc.walls] == ["wall_000", "w"]
    assert (doc.doors[0].wall_id, doc.doors[0].start_offset_m, doc.doors[0].end_offset_m) == ("wall_000", 1.55, 2.45)
    assert (doc.windows[0].start_offset_m, doc.windows[0].end_offset_m) == (0.25, 0.75)
    assert [r.face_id for r in doc.rooms] == ["legacy_face_000", "r1"]
    assert plans.elements(new, "walls").count() == 2
    plans.write_plans(new.drop("metadata"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first()["schema_version"] == "3.0"


def test_job_stream_is_the_batch(spark, tmp_path):
    names = ["start", "worker_ok", "save", "generate", "save_ok", "generate", "restart", "save", "save_failed"]
    rows = [(1, i, i, e) for i, e in enumerate(names)]
    batch = jobs.fold(spark.createDataFrame(rows, "job long, ts long, event_id long, event string")).first()
    assert (batch.state, batch.version, batch.taken, batch.refused) == ("generation_failed", 1, 8, 1)
    for k in range(3):
        spark.createDataFrame(rows[3 * k : 3 * k + 3], "job long, ts long, event_id long, event string").coalesce(1).write.json(str(tmp_path / f"in{k}"))
    stream = spark.readStream.schema("job long, ts long, event_id long, event string").option("maxFilesPerTrigger", 100).json(str(tmp_path / "in*"))
    run = jobs.fold_stream(stream).writeStream.outputMode("update").format("memory").queryName("jobs").trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = spark.sql("select * from jobs order by taken + refused desc").first()
    assert tuple(last) == tuple(batch)


SQUARE = [(0.0, 0.0, 4.0, 0.0), (4.0, 0.0, 4.0, 4.0), (4.0, 4.0, 0.0, 4.0), (0.0, 4.0, 0.0, 0.0)]


def test_faces():
    assert [polygons.ring_area(r) for r in polygons.faces(SQUARE)] == [16.0]
    assert [polygons.ring_area(r) for r in polygons.faces([*SQUARE, (2.0, 0.0, 2.0, 4.0)])] == [8.0, 8.0]
    assert len(polygons.faces([*SQUARE, (2.0, 0.0, 2.0, 3.0)])) == 1
    assert len(polygons.faces([*SQUARE, (2.0, -1.0, 2.0, 5.0), (-1.0, 2.0, 5.0, 2.0)])) == 4
    assert len(polygons.faces([*SQUARE, (2.0, 0.0, 2.0, 4.0), (2.05, 0.0, 2.05, 4.0)])) == 2
    assert polygons.faces(SQUARE[:3]) == []


def test_overlay():
    a = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    b = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    assert polygons.convex_overlap(a, b) == 1.0 and polygons.convex_overlap(a, [(x + 5, y) for x, y in b]) == 0.0
    assert polygons.covered_area([(0, 0, 2, 2), (1, 1, 3, 3)]) == 7.0 and polygons.covered_area([]) == 0.0


def test_masks():
    mask = np.zeros((6, 6), dtype=bool)
    mask[0, 0] = mask[1, 1] = mask[5, 5] = True
    assert polygons.labelled(mask)[1] == 2
    assert polygons.dilated(mask, 1)[:3, :3].all() and not polygons.dilated(mask, 1)[3, 3]
    assert polygons.drawn([(1.0, 1.0, 5.0, 1.0, 0.5)], 6, 1.0)[0:2, 1:5].any()


def test_suppression_and_merging(spark):
    from quoin.operators.furnishing import dedupe

    items = [(1, 0, "a", 0.0, 0.0, 2.0, 2.0), (1, 1, "a", 0.1, 0.0, 1.0, 1.0), (1, 2, "b", 0.1, 0.0, 1.0, 1.0)]
    given = spark.createDataFrame(items, "plan long, ord int, category string, x double, y double, w double, d double")
    assert sorted(r.ord for r in dedupe(given).collect()) == [0, 2]
    assert [r.ord for r in dedupe(given, same_kind=False, of_both=True, part=0.5, most=80).collect()] == [0]
    assert [r.ord for r in dedupe(given, most=1).collect()] == [0]
    walls = [(0, 0.0, 0.0, 1.0, 0.1), (1, 0.1, 1.1, 2.0, 0.3), (2, 3.0, 0.0, 1.0, 0.1)]
    assert [m[:2] for m in grouped.merged(walls, 0.2, 0.15)] == [(0, 2), (2, 1)]
    assert grouped.pulled([(0, 0), (1, 0), (2, 0)], lambda p, q: True) == [(0, 0), (2, 0)]


def test_jobs_time_out_and_are_discarded(spark):
    rows = [(1, 0.0, 1, "start"), (1, 2000.0, 2, "worker_ok"), (2, 0.0, 1, "start"), (2, 100.0, 2, "worker_ok"), (3, 0.0, 1, "discard"), (3, 1.0, 2, "start"), (4, 0.0, 1, "start"), (4, 1.0, 2, "discard")]
    got = {r.job: (r.state, r.taken) for r in jobs.fold(spark.createDataFrame(rows, "job long, ts double, event_id long, event string"), 900).collect()}
    assert got == {1: ("failed", 1), 2: ("needs_review", 2), 3: ("discarded", 1), 4: ("processing", 1)}


def test_affine_texts():
    from quoin.functions.transforms import affine

    assert affine("") == affine("  ") == (1, 0, 0, 1, 0, 0) and affine(None) is None
    assert affine("translate(3)scale(2)") == (2, 0, 0, 2, 3, 0) and affine("scale(2),translate(3 4)") == (2, 0, 0, 2, 6, 8)
    assert affine("rotate(90)") == pytest.approx((0, 1, -1, 0, 0, 0), abs=1e-12) and affine("rotate(180, 5, 1)") == pytest.approx((-1, 0, 0, -1, 10, 2), abs=1e-12)
    assert affine("scale()") is affine("rotate(1 2)") is affine("skewX(1)") is affine("scale(2) rest") is affine("scale(nan)") is None


def test_walls_are_reconstructed(spark):
    from quoin.operators import reconstruction, rooms

    raw = [(0, 0, 2, 0.05, 0.1), (2.1, 0, 4, 0, 0.2), (4.05, -0.1, 4.05, 3, 0.1), (0, 3, 4.2, 3, 0.1), (0, 0.1, 0, 2.9, 0.1), (1, 1, 1.1, 1, 0.1)]
    slanting = [(10.0, 0.0, 12.0, 1.0, 0.1), (12.1, 0.05, 14.0, 0.0, 0.3), (11.0, -0.2, 11.5, 5.0, 0.1), (14.2, 0.1, 14.2, 0.2, 0.1)]
    walls = spark.createDataFrame([(p, i, *map(float, w)) for p, rows in ((1, raw), (2, slanting)) for i, w in enumerate(rows)], "plan long, ord int, x1 double, y1 double, x2 double, y2 double, thickness double")
    found = {p: sorted((w.level, *(round(v, 6) for v in (w.line, w.s, w.e, w.thickness))) for w in reconstruction.reconstruct(walls).collect() if w.plan == p) for p in (1, 2)}
    assert found[1] == [(False, 0.0, 0.0125, 3.0, 0.1), (False, 4.05, 0.0125, 3.0, 0.1), (True, 0.0125, 0.0, 4.05, 0.2), (True, 3.0, 0.0, 4.05, 0.1)]
    # A slanting wall merges by its lower end's line; an upright one that is near enough is drawn onto it.
    assert found[2] == [(False, 11.25, 0.0125, 5.0, 0.1), (True, 0.0125, 10.0, 14.0, 0.3)]
    assert reconstruction.reconstruct(walls.limit(0)).count() == 0
    got = [(s, c, e, c, t) if level else (c, s, c, e, t) for level, c, s, e, t in found[1]]
    (ring,) = rooms.rooms_of(got)
    assert len(ring) >= 4 and abs(rooms.ring_area(ring) - 4.05 * 3) < 0.3


def test_faces_keep_the_names_of_rooms(spark):
    from quoin.operators import rooms

    box = lambda x0, y0, x1, y1: [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    faces = [(1, 0, box(0, 0, 4, 4)), (1, 1, box(4, 0, 7, 4)), (1, 2, box(0, 4, 2, 6)), (2, 0, box(0, 0, 1, 1))]
    before = [(1, 0, box(9, 9, 10, 10)), (1, 1, box(0, 0, 4, 3)), (1, 2, box(0, 0, 4, 4)), (1, 3, box(3, 0, 6, 4)), (1, 4, box(1, 1, 3, 5))]
    ring = "ring array<struct<x:double,y:double>>"
    got = rooms.carried(spark.createDataFrame(faces, f"plan long, face int, {ring}"), spark.createDataFrame(before, f"plan long, room int, {ring}"))
    # Rooms 1 and 2 lie wholly in the largest face, which takes the first; the next takes what shares two thirds of it.
    assert {tuple(x) for x in got.collect()} == {(1, 0, 1), (1, 1, 3)}


def test_rooms_need_closed_walls():
    from quoin.operators import rooms

    box = [(0.0, 0.0, 3.0, 0.0, 0.1), (3.0, 0.1, 3.0, 3.0, 0.1), (3.0, 3.0, 0.0, 3.0, 0.1), (0.0, 3.0, 0.0, 0.0, 0.1)]
    (ring,) = rooms.rooms_of(box)  # ends that miss each other both move
    assert abs(rooms.ring_area(ring) - 9) < 0.2
    gap = [(0.0, 0.0, 1.0, 0.0, 0.1), (1.15, 0.0, 3.0, 0.0, 0.1), *box[1:]]
    assert len(rooms.rooms_of(gap)) == 1 and rooms.rooms_of([(0.0, 0.0, 1.0, 0.0, 0.1), (2.0, 0.0, 3.0, 0.0, 0.1), *box[1:]]) == []
