"""Validation rules, quality score, evaluation figures, samples and state ladders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.operators import intervals
from quoin.operators.scale import SOLVED, solve
from quoin.plans.bindings import bound
from quoin.registry import query

# Component weights, penalties and limits of the quality score.
WEIGHTS = {"wall_mask_overlap": 0.20, "junction_support": 0.10, "rooms": 0.20, "openings": 0.20, "scale": 0.20, "exterior_closure": 0.10}
NO_EVIDENCE, PER_ERROR, PER_WARNING, WARNINGS_AT_MOST, PER_SEVERE = 0.4, 0.08, 0.02, 0.15, 0.40
FAILED_UNDER, REVIEW_UNDER, WARNINGS_FOR_REVIEW = 0.35, 0.70, 3


def issue(rows: DataFrame, code: str, severity: str, element="id") -> DataFrame:
    e = F.col(element) if isinstance(element, str) else element
    return rows.select("plan", F.lit(code).alias("code"), F.lit(severity).alias("severity"), e.cast("string").alias("element_id"))


def issues(walls: DataFrame, openings: DataFrame, rooms: DataFrame) -> DataFrame:
    """plan, code, severity, element_id: one SELECT a rule, joined by UNION ALL."""
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    plans = walls.select("plan").distinct()
    zero = issue(walls.where(length <= 1e-6), "zero_length_wall", "error")
    hosts = walls.select("plan", F.col("id").alias("wall_id"), (length * 16).alias("length"))
    hosted = openings.join(hosts, ["plan", "wall_id"], "left")
    lost = issue(hosted.where("length is null"), "opening_without_valid_wall", "error")
    outside = issue(hosted.where("s < -0.01 or e > length + 0.01"), "opening_outside_wall_span", "error")
    overlap = issue(intervals.overlaps_adjacent(openings.join(hosts.select("plan", "wall_id"), ["plan", "wall_id"], "left_semi"), ["plan", "wall_id"]), "openings_overlap", "error")
    a = rooms.select("plan", F.col("id").alias("a"), "ord", *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    pairs = a.join(rooms.select("plan", F.col("ord").alias("ord2"), "x0", "y0", "x1", "y1"), "plan").where("ord < ord2")
    w = F.least("a_x1", "x1") - F.greatest("a_x0", "x0")
    h = F.least("a_y1", "y1") - F.greatest("a_y0", "y0")
    smaller = F.least((F.col("a_x1") - F.col("a_x0")) * (F.col("a_y1") - F.col("a_y0")), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    rooms_overlap = issue(pairs.where(both > 0.05 * smaller), "room_polygons_overlap", "error", "a")
    none = F.lit(None).cast("string")
    roomless = issue(plans.join(rooms.select("plan").distinct(), "plan", "left_anti"), "no_closed_rooms", "warning", none)
    several = rooms.groupBy("plan").count().where("count >= 2").select("plan")
    unopened = issue(several.join(openings.select("plan").distinct(), "plan", "left_anti"), "no_openings_detected", "warning", none)
    out = zero
    for part in (lost, outside, overlap, rooms_overlap, roomless, unopened):
        out = out.unionByName(part)
    return out


def quality(plans: DataFrame) -> DataFrame:
    """score and state from components (null: no evidence), errors, warnings, severe."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * F.coalesce(F.col(name), F.lit(NO_EVIDENCE))
    raw = total - PER_ERROR * F.col("errors") - F.least(F.lit(WARNINGS_AT_MOST), PER_WARNING * F.col("warnings")) - PER_SEVERE * F.col("severe")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    state = (
        F.when((F.col("severe") > 0) | (F.col("score") < FAILED_UNDER), "failed")
        .when((F.col("errors") > 0) | (F.col("score") < REVIEW_UNDER) | (F.col("warnings") > WARNINGS_FOR_REVIEW), "review_required")
        .otherwise("high")
    )
    return plans.withColumn("score", score).withColumn("state", state)


_ISSUES = """
WITH w AS (SELECT *, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM {walls}), o AS (SELECT * FROM {openings}), r AS (SELECT * FROM {rooms}),
h AS (SELECT o.*, w.len*16 AS len FROM o LEFT JOIN w ON w.plan = o.plan AND w.id = o.wall_id),
i AS (SELECT plan, 'zero_length_wall' AS code, 'error' AS severity, id AS element_id FROM w WHERE len <= 1e-6
UNION ALL SELECT plan, 'opening_without_valid_wall', 'error', id FROM h WHERE len IS NULL
UNION ALL SELECT plan, 'opening_outside_wall_span', 'error', id FROM h WHERE s < -0.01 OR e > len + 0.01
UNION ALL SELECT plan, 'openings_overlap', 'error', id FROM (SELECT *, lag(e) OVER (PARTITION BY plan, wall_id ORDER BY s, e, id) AS b FROM h WHERE len IS NOT NULL) WHERE s < b - 0.01
UNION ALL SELECT a.plan, 'room_polygons_overlap', 'error', a.id FROM r a JOIN r b ON a.plan = b.plan AND a.ord < b.ord
  WHERE greatest(least(a.x1,b.x1)-greatest(a.x0,b.x0), 0)*greatest(least(a.y1,b.y1)-greatest(a.y0,b.y0), 0) > 0.05*least((a.x1-a.x0)*(a.y1-a.y0), (b.x1-b.x0)*(b.y1-b.y0))
UNION ALL SELECT plan, 'no_closed_rooms', 'warning', NULL FROM (SELECT DISTINCT plan FROM w) p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.plan = p.plan)
UNION ALL SELECT plan, 'no_openings_detected', 'warning', NULL FROM (SELECT plan FROM r GROUP BY plan HAVING count(*) >= 2) p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.plan = p.plan))
"""


def _bound_issues(spark, d):
    return issues(bound(spark, d, "walls"), bound(spark, d, "openings"), bound(spark, d, "rooms"))


@query("rule_issues", (232, 233), _ISSUES + "SELECT * FROM i")
def rule_issues(spark, d):
    return _bound_issues(spark, d)


@query("issue_dedupe", (163,), _ISSUES + "SELECT plan, code, severity, min(element_id) AS element_id, count(*) AS n FROM i GROUP BY plan, code, severity")
def issue_dedupe(spark, d):
    return _bound_issues(spark, d).groupBy("plan", "code", "severity").agg(F.min("element_id").alias("element_id"), F.count(F.lit(1)).alias("n"))


@query("quality_score", (149, 150, 151, 152), _ISSUES + """, c AS (SELECT plan, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings,
 count(*) FILTER (code = 'room_polygons_overlap') AS bad_rooms FROM i GROUP BY plan), n AS (SELECT plan, count(*) AS rooms, sum((x1-x0)*(y1-y0)) AS area FROM r GROUP BY plan),
m AS (SELECT o.plan, count(*) AS openings, count(k.id) AS attached, count(*) FILTER (o.ord % 4 = 3) AS unsure FROM o LEFT JOIN (SELECT plan, id FROM w) k ON k.plan = o.plan AND k.id = o.wall_id GROUP BY o.plan),
x AS (SELECT plan, greatest((max(greatest(x1, x2)) - min(least(x1, x2)))*(max(greatest(y1, y2)) - min(least(y1, y2))), 1e-6) AS box FROM w GROUP BY plan),
q AS (SELECT plan, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, CASE WHEN coalesce(rooms, 0) = 0 THEN 0 ELSE greatest(0.2, 1 - 0.3*coalesce(bad_rooms, 0)) END AS room_part,
 CASE WHEN coalesce(openings, 0) > 0 THEN attached/openings*(1 - 0.5*unsure/openings) WHEN coalesce(rooms, 0) >= 2 THEN 0.2 ELSE 0.4 END AS opening_part, coalesce(sc.confidence, 0) AS scale_part,
 CASE WHEN sc.confidence IS NULL THEN 1 ELSE 0 END AS severe, least(1, coalesce(area, 0)/box/0.7) AS closure FROM x LEFT JOIN c USING (plan) LEFT JOIN n USING (plan) LEFT JOIN m USING (plan) LEFT JOIN (""" + SOLVED + """) sc USING (plan)),
s AS (SELECT *, CAST(greatest(0, least(1, 0.2*0.4 + 0.1*0.4 + 0.2*room_part + 0.2*opening_part + 0.2*scale_part + 0.1*closure - 0.08*errors - least(0.15, 0.02*warnings) - 0.4*severe)) AS DOUBLE) AS score FROM q)
SELECT plan, errors, warnings, round(score, 6) AS score, CASE WHEN severe > 0 OR score < 0.35 THEN 'failed' WHEN errors > 0 OR score < 0.7 OR warnings > 3 THEN 'review_required' ELSE 'high' END AS state FROM s""")
def quality_score(spark, d):
    """All six components of each plan's score; without an image, overlap and junctions have no evidence.

    Openings: the share on a known wall times the certainty (unsure ones, every fourth here, count half).  Scale: the
    solver's confidence; a plan without a scale has a severe fault.  Closure: the rooms' area in the walls' bounding box.
    """
    walls, rooms, openings = (bound(spark, d, x) for x in ("walls", "rooms", "openings"))
    found = issues(walls, openings, rooms).groupBy("plan").agg(
        F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("code") == "room_polygons_overlap").alias("bad")
    )
    span = [F.max(F.greatest(f"{v}1", f"{v}2")) - F.min(F.least(f"{v}1", f"{v}2")) for v in "xy"]
    boxes = walls.groupBy("plan").agg(F.greatest(span[0] * span[1], F.lit(1e-6)).alias("box"))
    by_room = rooms.groupBy("plan").agg(F.count(F.lit(1)).alias("n_rooms"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    hosts = walls.select("plan", F.col("id").alias("wall_id"), F.lit(1).alias("host"))
    by_opening = openings.join(hosts, ["plan", "wall_id"], "left").groupBy("plan").agg(F.count(F.lit(1)).alias("n_openings"), F.count("host").alias("attached"), F.count_if(F.col("ord") % 4 == 3).alias("unsure"))
    scale = solve(bound(spark, d, "constraints")).select("plan", F.round("confidence", 5).alias("confidence"))
    plans = boxes.join(found, "plan", "left").join(by_room, "plan", "left").join(by_opening, "plan", "left").na.fill(0).join(scale, "plan", "left")
    n = F.col("n_openings")
    parts = plans.withColumns({
        "rooms": F.when(F.col("n_rooms") == 0, 0.0).otherwise(F.greatest(F.lit(0.2), 1 - 0.3 * F.col("bad"))),
        "openings": F.when(n > 0, F.try_divide(F.col("attached"), n) * (1 - 0.5 * F.try_divide(F.col("unsure"), n))).when(F.col("n_rooms") >= 2, 0.2).otherwise(0.4),
        "scale": F.coalesce("confidence", F.lit(0.0)), "severe": F.col("confidence").isNull().cast("int"),
        "exterior_closure": F.least(F.lit(1.0), F.col("area") / F.col("box") / 0.7),
        **{k: F.lit(None).cast("double") for k in ("wall_mask_overlap", "junction_support")},
    })
    return quality(parts).select("plan", "errors", "warnings", F.round("score", 6).alias("score"), "state")


@query("junction_support", (155,), """
WITH e AS (SELECT plan, CAST(round_even(x*2, 0) AS BIGINT) AS bx, CAST(round_even(y*2, 0) AS BIGINT) AS by_ FROM (SELECT plan, x1 AS x, y1 AS y FROM {walls} UNION ALL SELECT plan, x2, y2 FROM {walls}))
SELECT plan, count(*) AS junctions FROM (SELECT plan, bx, by_ FROM e GROUP BY ALL HAVING count(*) >= 2) GROUP BY plan""")
def junction_support(spark, d):
    w = bound(spark, d, "walls")
    ends = w.select("plan", F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(w.select("plan", F.col("x2").alias("x"), F.col("y2").alias("y")))
    cells = ends.groupBy("plan", F.rint(F.col("x") * 2).alias("bx"), F.rint(F.col("y") * 2).alias("by")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return cells.groupBy("plan").agg(F.count(F.lit(1)).alias("junctions"))


@query("evaluation_rollup", (157,), """
WITH s AS (SELECT l_orderkey AS plan, l_returnflag AS style, sum(l_quantity) AS pred, sum(l_linenumber * 8) AS truth, sum(least(l_quantity, l_linenumber * 8)) AS hit FROM lineitem GROUP BY ALL),
f AS (SELECT style, hit/pred AS p, hit/truth AS r, 2*hit/(pred+truth) AS f1, hit/(pred+truth-hit) AS iou FROM s)
SELECT coalesce(style, 'overall') AS style, count(*) AS scored, round(avg(p), 6) AS prec, round(avg(r), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(iou), 6) AS iou FROM f GROUP BY ROLLUP (style)""")
def evaluation_rollup(spark, d):
    """Precision, recall, F1 and IoU of predicted against true areas, by style and overall."""
    s = bound(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("plan"), F.col("l_returnflag").alias("style")).agg(
        F.sum("l_quantity").alias("pred"), F.sum(F.col("l_linenumber") * 8).alias("truth"), F.sum(F.least(F.col("l_quantity"), (F.col("l_linenumber") * 8).cast("double"))).alias("hit")
    )
    hit, pred, truth = F.col("hit"), F.col("pred"), F.col("truth")
    f = s.select("style", F.try_divide(hit, pred).alias("p"), F.try_divide(hit, truth).alias("r"), F.try_divide(2 * hit, pred + truth).alias("f1"), F.try_divide(hit, pred + truth - hit).alias("iou"))
    out = f.rollup("style").agg(F.count(F.lit(1)).alias("scored"), *[F.round(F.avg(a), 6).alias(b) for a, b in (("p", "prec"), ("r", "recall"), ("f1", "f1"), ("iou", "iou"))])
    return out.withColumn("style", F.coalesce("style", F.lit("overall")))


@query("status_histogram", (159, 312), "SELECT event_type AS status, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def status_histogram(spark, d):
    return bound(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("style_balanced_sample", (158,), """
WITH g AS (SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS n FROM g)
SELECT lang, source, doc_id, n FROM k QUALIFY row_number() OVER (ORDER BY n, lang) <= 24""")
def style_balanced_sample(spark, d):
    """Round-robin over languages of one document for each source, in the order of a hash; 24 in all."""
    g = bound(spark, d, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))
    k = g.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.sha2(F.col("doc_id").cast("string"), 256), "doc_id")))
    return k.orderBy("n", "lang").limit(24)


@query("duplicate_digest", (132,), "SELECT sha256(text) AS digest, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_digest(spark, d):
    return bound(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")


@query("tree_fingerprint", (160,), """
WITH f AS (SELECT source, doc_id // 1000 AS folder, sha256(string_agg(concat(doc_id, ':', sha256(text)), '|' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL)
SELECT source, sha256(string_agg(concat(folder, ':', h), '|' ORDER BY folder)) AS fingerprint FROM f GROUP BY source""")
def tree_fingerprint(spark, d):
    """A source's digest from those of its folders of 1,000 files, in order of name: no task holds a whole tree."""

    def digest(rows, keys, name, value):
        parts = F.array_sort(F.collect_list(F.struct(name, F.concat(F.col(name).cast("string"), F.lit(":"), value).alias("t"))))
        return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["t"]), "|"), 256).alias("fingerprint"))

    files = bound(spark, d, "documents").select("source", "doc_id", F.floor(F.col("doc_id") / 1000).alias("folder"), F.sha2("text", 256).alias("sha"))
    return digest(digest(files, ["source", "folder"], "doc_id", F.col("sha")), ["source"], "folder", F.col("fingerprint"))


@query("faces_by_area", (189, 190), "SELECT plan, ord, (x1-x0)*(y1-y0) AS area, row_number() OVER (PARTITION BY plan ORDER BY (x1-x0)*(y1-y0) DESC, ord) AS place FROM {rooms}")
def faces_by_area(spark, d):
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return bound(spark, d, "rooms").select("plan", "ord", area.alias("area"), F.row_number().over(Window.partitionBy("plan").orderBy(area.desc(), "ord")).alias("place"))


@query("draft_cap", (193, 194), """
WITH e AS (SELECT user_id, event_id, row_number() OVER w AS n, sum(CAST(value AS BIGINT) + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS size FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC))
SELECT user_id, event_id, n <= 5 AND size <= 200 AS draft FROM e WHERE n <= 50""")
def draft_cap(spark, d):
    """The last 50 edits of a user; of these, drafts are the last five while their sizes add up to 200 at most.

    A size is rounded to a whole number, halves to the even one.
    """
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    size = F.sum(F.rint("value").cast("long") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))
    e = bound(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("n"), size.alias("size"))
    return e.where("n <= 50").select("user_id", "event_id", ((F.col("n") <= 5) & (F.col("size") <= 200)).alias("draft"))


@query("history_cap", (), "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def history_cap(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return bound(spark, d, "events").withColumn("n", F.row_number().over(w)).where("n <= 5").select("user_id", "event_id")


@query("monotone_version", (282,), """
WITH e AS (SELECT user_id, event_id, epoch_ms(ts) // 60000 AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, event_id, max(m - n) OVER (PARTITION BY user_id ORDER BY n) + n AS version FROM e""")
def monotone_version(spark, d):
    """version = max(now, previous + 1), unrolled: the running maximum of now - n, plus n.

    Events without a time or id come last.  now is in whole minutes, cut towards 1970 from both sides.
    """
    w = Window.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    minute = F.call_function("div", F.unix_millis(F.col("ts").cast("timestamp")), F.lit(60000))
    e = bound(spark, d, "events").select("user_id", "event_id", "ts", minute.alias("m")).withColumn("n", F.row_number().over(w))
    return e.withColumn("version", F.max(F.col("m") - F.col("n")).over(Window.partitionBy("user_id").orderBy("n")) + F.col("n")).select("user_id", "event_id", "version")


@query("label_fallback", (196,), """
SELECT plan, name, 'local' AS origin FROM {labels_px} WHERE confidence >= 0.8
UNION ALL SELECT plan, name, 'fallback' FROM {labels_px} l WHERE confidence BETWEEN 0.6 AND 0.79 AND NOT EXISTS (SELECT 1 FROM {labels_px} k WHERE k.plan = l.plan AND k.confidence >= 0.8)""")
def label_fallback(spark, d):
    """Second-choice labels only for plans without a first-choice one."""
    l = bound(spark, d, "labels_px")
    first = l.where("confidence >= 0.8")
    second = l.where("confidence between 0.6 and 0.79").join(first.select("plan").distinct(), "plan", "left_anti")
    return first.select("plan", "name", F.lit("local").alias("origin")).unionByName(second.select("plan", "name", F.lit("fallback").alias("origin")))


@query("artifact_precedence", (3,), """
SELECT doc_id % 50 AS job, arg_min(doc_id, CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 WHEN 'es' THEN 2 ELSE 3 END * 1000000 + doc_id) AS chosen FROM documents GROUP BY 1""")
def artifact_precedence(spark, d):
    rank = F.when(F.col("lang") == "fr", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "es", 2).otherwise(3)
    return bound(spark, d, "documents").groupBy((F.col("doc_id") % 50).alias("job")).agg(F.min_by("doc_id", F.struct(rank, "doc_id")).alias("chosen"))
