"""Review findings that outlive a recomputation, labels from hints, cached hints, matrices and small predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.operators import rules
from quoin.plans.bindings import bound
from quoin.registry import query

# Least confidence of a hint, half the side of a label's box, furniture words that are labels, and their types.
SURE, BOX = 0.35, 5
LABEL_WORDS = ("stair", "lift", "balcony", "shelf", "counter", "entrance")
LABEL_TYPES = {"stair": "stair_label", "lift": "lift_label", "balcony": "balcony_label"}
# Parts of a category that make a hint structural.
STRUCTURAL = ("wall", "door", "window", "balcony", "lift", "stair", "entrance", "railing")
BALCONY_WORDS = ("balcony", "terrace")

_HINTS = """CASE ord % 5 WHEN 0 THEN concat(category, ' STAIR') WHEN 1 THEN 'Lift' WHEN 2 THEN 'balcony rail' ELSE category END"""


@query("hint_labels", (300, 304), f"""
WITH r AS (SELECT plan, ord, id AS text, 1 - ord*0.125e0 AS c, (x0+x1)/2/16*800 AS x, (1 - (y0+y1)/2/16)*600 AS y FROM {{rooms}}), f AS (SELECT plan, ord, {_HINTS} AS text, 1 - ord*0.125e0 AS c, x/16*800 AS x, y/16*600 AS y FROM {{furniture}}),
a AS (SELECT plan, ord, text, 'room_label' AS type, x, y FROM r WHERE c >= 0.35 UNION ALL SELECT plan, ord, text, CASE WHEN lower(text) LIKE '%stair%' THEN 'stair_label' WHEN lower(text) LIKE '%lift%' THEN 'lift_label' WHEN lower(text) LIKE '%balcony%' THEN 'balcony_label' ELSE 'text' END, x, y
 FROM f WHERE c >= 0.35 AND regexp_matches(lower(text), 'stair|lift|balcony|shelf|counter|entrance'))
SELECT plan, ord, text, type, x - 5 AS x0, y - 5 AS y0, x + 5 AS x1, y + 5 AS y1 FROM a""")
def hint_labels(spark, d):
    """Labels that detector hints give: rooms by name at the mean of their points, special furniture by its words.

    Normalised places become pixels of an image of 800 x 600; a label's box is 10 x 10.
    """
    sure = (1 - F.col("ord") * 0.125) >= SURE
    mid = lambda a, b: (F.col(a) + F.col(b)) / 2 / 16
    rooms = bound(spark, d, "rooms").where(sure).select("plan", "ord", F.col("id").alias("text"), F.lit("room_label").alias("type"), (mid("x0", "x1") * 800).alias("x"), ((1 - mid("y0", "y1")) * 600).alias("y"))
    f = bound(spark, d, "furniture").where(sure).select("plan", "ord", F.expr(_HINTS).alias("text"), (F.col("x") / 16 * 800).alias("x"), (F.col("y") / 16 * 600).alias("y"))
    low, kind = F.lower("text"), None
    for word, name in LABEL_TYPES.items():
        kind = F.when(low.contains(word), name) if kind is None else kind.when(low.contains(word), name)
    special = f.where(F.exists(F.array(*map(F.lit, LABEL_WORDS)), low.contains)).select("plan", "ord", "text", kind.otherwise("text").alias("type"), "x", "y")
    out = rooms.unionByName(special)
    return out.select("plan", "ord", "text", "type", *[(F.col(c) + s * BOX).alias(f"{c}{i}") for i, s in ((0, -1), (1, 1)) for c in "xy"])


_WARNINGS = """
WITH s AS (SELECT l_orderkey AS plan, ord, CASE l_linenumber % 3 WHEN 0 THEN 'overlap' WHEN 1 THEN 'missing_door' END AS kind, CASE WHEN l_linestatus = 'O' THEN concat('look at ', CAST(ord AS VARCHAR(9))) END AS description,
 CASE WHEN l_returnflag <> 'A' THEN (l_partkey % 100)/100e0 END AS x, (l_suppkey % 100)/100e0 AS y, l_returnflag = 'R' AND l_tax > 0.06 AS known FROM {lines})
"""


@query("semantic_issues", (201,), _WARNINGS + """,
e AS (SELECT plan, ord, concat('gemini_', coalesce(kind, 'review')) AS code, 'as saved' AS message FROM s WHERE known)
SELECT * FROM e UNION ALL SELECT plan, ord, concat('gemini_', coalesce(kind, 'review')), concat(coalesce(description, 'Review this area against the source plan'), CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN printf(' (at %.2f, %.2f normalized)', x, y) ELSE '' END)
FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.plan = s.plan)""")
def semantic_issues(spark, d):
    """A plan's saved semantic findings; where it has none, findings made again from the warnings in its metadata."""
    lines = bound(spark, d, "lines")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "overlap").when(F.col("l_linenumber") % 3 == 1, "missing_door")
    s = lines.select(
        F.col("l_orderkey").alias("plan"), "ord", F.concat(F.lit("gemini_"), F.coalesce(kind, F.lit("review"))).alias("code"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("look at "), F.col("ord").cast("string"))).alias("description"),
        F.when(F.col("l_returnflag") != "A", F.col("l_partkey") % 100 / 100).alias("x"), (F.col("l_suppkey") % 100 / 100).alias("y"),
        ((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.06)).alias("known"),
    )
    place = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.format_string(" (at %.2f, %.2f normalized)", "x", "y")).otherwise("")
    message = F.concat(F.coalesce("description", F.lit("Review this area against the source plan")), place)
    saved = s.where("known")
    again = s.join(saved.select("plan").distinct(), "plan", "left_anti")
    return saved.select("plan", "ord", "code", F.lit("as saved").alias("message")).unionByName(again.select("plan", "ord", "code", message.alias("message")))


# What rebuilt room boundaries are told apart by.
TRACE, FLOOR, OPEN = "reviewed_trace_invalidated", "inferred_open_floor_boundary_invalidated", "inferred_open_floor_boundary"


@query("carried_issues", (200,), """
WITH i AS (SELECT l_orderkey AS plan, concat('o', CAST(ord AS VARCHAR(9))) AS id, CASE l_partkey % 4 WHEN 0 THEN 'ambiguous_opening' WHEN 1 THEN 'unreconstructed_labeled_room' WHEN 2 THEN 'openings_overlap' ELSE 'stair_void' END AS code, l_returnflag = 'R' AS earlier FROM {lines}),
p AS (SELECT plan, bool_or(earlier) AS saved FROM i GROUP BY plan),
a AS (SELECT plan, code, id FROM i WHERE code = 'ambiguous_opening' AND NOT earlier
UNION ALL SELECT plan, code, id FROM i JOIN p USING (plan) WHERE code = 'unreconstructed_labeled_room' AND earlier = saved
UNION ALL SELECT plan, code, id FROM i WHERE code = 'stair_void' AND NOT earlier
UNION ALL SELECT plan, 'reviewed_trace_invalidated', NULL FROM p WHERE plan % 3 = 0 UNION ALL SELECT plan, 'inferred_open_floor_boundary_invalidated', NULL FROM p WHERE plan % 5 = 0
UNION ALL SELECT plan, 'inferred_open_floor_boundary', id FROM {rooms} WHERE ord % 4 = 1)
SELECT plan, code, id, count(*) AS n FROM a GROUP BY ALL""")
def carried_issues(spark, d):
    """Findings that a recomputation keeps, from six sources, each once.

    Its own ambiguous openings and stair voids; unreconstructed rooms of the saved model, or else its own; two marks in
    its metadata (here by the plan's number); rooms whose floor edge was inferred.
    """
    code = F.element_at(F.array(*map(F.lit, ("ambiguous_opening", "unreconstructed_labeled_room", "openings_overlap", "stair_void"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    i = bound(spark, d, "lines").select(F.col("l_orderkey").alias("plan"), code.alias("code"), F.concat(F.lit("o"), F.col("ord").cast("string")).alias("id"), (F.col("l_returnflag") == "R").alias("earlier"))
    saved = F.bool_or("earlier").over(Window.partitionBy("plan"))
    of_model = i.withColumn("saved", saved).where((F.col("code").isin("ambiguous_opening", "stair_void") & ~F.col("earlier")) | ((F.col("code") == "unreconstructed_labeled_room") & (F.col("earlier") == F.col("saved")))).select("plan", "code", "id")
    plans = i.select("plan").distinct()
    mark = lambda rows, code: rows.select("plan", F.lit(code).alias("code"), F.lit(None).cast("string").alias("id"))
    inferred = bound(spark, d, "rooms").where("ord % 4 = 1").select("plan", F.lit(OPEN).alias("code"), "id")
    out = of_model.unionByName(mark(plans.where("plan % 3 = 0"), TRACE)).unionByName(mark(plans.where("plan % 5 = 0"), FLOOR)).unionByName(inferred)
    return out.groupBy("plan", "code", "id").agg(F.count(F.lit(1)).alias("n"))


@query("issue_targets", (129,), rules._ISSUES + """
SELECT i.plan, i.code, i.element_id, coalesce(w.ord, o.ord, r.ord) AS place, CASE WHEN w.ord IS NOT NULL THEN 'wall' WHEN o.ord IS NOT NULL THEN 'opening' WHEN r.ord IS NOT NULL THEN 'room' ELSE 'plan' END AS target
FROM i LEFT JOIN w ON w.plan = i.plan AND w.id = i.element_id LEFT JOIN o ON o.plan = i.plan AND o.id = i.element_id LEFT JOIN r ON r.plan = i.plan AND r.id = i.element_id""")
def issue_targets(spark, d):
    """What each issue points at, found by id among walls, openings and rooms; the plan as a whole if by none."""
    walls, openings, rooms = (bound(spark, d, x) for x in ("walls", "openings", "rooms"))
    named = [rows.select("plan", F.col("id").alias("element_id"), F.lit(kind).alias("target"), F.col("ord").alias("place")) for rows, kind in ((walls, "wall"), (openings, "opening"), (rooms, "room"))]
    targets = named[0].unionByName(named[1]).unionByName(named[2])
    found = rules.issues(walls, openings, rooms).join(targets, ["plan", "element_id"], "left")
    return found.select("plan", "code", "element_id", "place", F.coalesce("target", F.lit("plan")).alias("target"))


@query("cached_hints", (18,), """
WITH w AS (SELECT doc_id, 3 AS version, sha256(text) AS sha, lang AS model FROM documents), c AS (SELECT doc_id, 2 + quality AS version, sha256(text) AS sha, lang AS model, toxic FROM labels JOIN documents USING (doc_id))
SELECT w.doc_id, CASE WHEN c.doc_id IS NOT NULL THEN 'cached' ELSE 'fresh' END AS origin, coalesce(c.toxic, -1) AS hint FROM w LEFT JOIN (SELECT DISTINCT * FROM c) c ON c.doc_id = w.doc_id AND c.version = w.version AND c.sha = w.sha AND c.model = w.model""")
def cached_hints(spark, d):
    """A cached analysis counts only if version, image checksum and model are all the same; else a fresh one is asked for."""
    docs = bound(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.col("lang").alias("model"))
    key = ["doc_id", "version", "sha", "model"]
    cache = bound(spark, d, "labels").join(docs, "doc_id").select("doc_id", (F.col("quality") + 2).alias("version"), "sha", "model", F.col("toxic").alias("hint"), F.lit("cached").alias("origin")).distinct()
    return docs.withColumn("version", F.lit(3)).join(cache, key, "left").select("doc_id", F.coalesce("origin", F.lit("fresh")).alias("origin"), F.coalesce("hint", F.lit(-1)).alias("hint"))


# Matrices as JSON: sound, off by little or much, of another shape, with a text, a truth value or no number in them.
_MATRIX = """CASE p_partkey % 8 WHEN 0 THEN '[[1.0, 0, 2.5], [0, 1, -3], [0, 0, 1]]' WHEN 1 THEN '[[1.0, 0, 2.5], [0, 1, -3.0000000001], [0, 0, 1]]' WHEN 2 THEN '[[1.0, 0, 2.5], [0, 1, -3.01], [0, 0, 1]]'
 WHEN 3 THEN '[[1.0, 0, 2.5], [0, 1, -3]]' WHEN 4 THEN '[[1.0, 0, 2.5], [0, "1", -3], [0, 0, 1]]' WHEN 5 THEN '[[1.0, 0, 2.5], [0, 1, -3], [0, 0, true]]' WHEN 6 THEN concat('[[1.0, 0, ', CAST(p_size AS VARCHAR(9)), '], [0, 1, -3], [0, 0, 1]]') ELSE '[1, 0, 2.5]' END"""
EXPECTED = (1.0, 0.0, 2.5, 0.0, 1.0, -3.0, 0.0, 0.0, 1.0)
_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


def matrix_ok(text: Column, expected=EXPECTED) -> Column:
    """Whether a JSON text is three rows of three plain numbers, each within 1e-9 (absolute and relative) of the expected."""
    row = rf"\s*\[\s*{_NUMBER}\s*,\s*{_NUMBER}\s*,\s*{_NUMBER}\s*\]\s*"
    numbers = F.transform(F.regexp_extract_all(text, F.lit(f"({_NUMBER})")), lambda x: x.cast("double"))
    near = F.forall(F.arrays_zip(numbers.alias("got"), F.array(*map(F.lit, expected)).alias("want")), lambda p: F.abs(p["got"] - p["want"]) <= 1e-9 + 1e-9 * F.abs(p["want"]))
    return F.coalesce(text.rlike(rf"^\s*\[{row},{row},{row}\]\s*$") & near, F.lit(False))


@query("matrix_checks", (340,), f"""
WITH m AS (SELECT p_partkey, CAST({_MATRIX} AS JSON) AS j FROM part), n AS (SELECT p_partkey, CAST(json_extract(j, '$[*][*]') AS JSON[]) AS v, json_array_length(j) = 3 AND list_min(list_transform(CAST(json_extract(j, '$[*]') AS JSON[]), lambda r: coalesce(json_array_length(r), 0) = 3)) AS shape FROM m)
SELECT p_partkey, shape AND len(v) = 9 AND list_min(list_transform(v, lambda x: json_type(x) IN ('BIGINT', 'UBIGINT', 'DOUBLE'))) AND coalesce(list_min(list_transform(range(1, 10), lambda i: abs(TRY_CAST(v[i] AS DOUBLE) - [1, 0, 2.5, 0, 1, -3, 0, 0, 1][i]) <= 1e-9 + 1e-9*abs([1, 0, 2.5, 0, 1, -3, 0, 0, 1][i]))), false) AS sound FROM n""")
def matrix_checks(spark, d):
    return bound(spark, d, "part").select("p_partkey", matrix_ok(F.expr(_MATRIX)).alias("sound"))


@query("giant_regions", (97,), """
WITH r AS (SELECT plan, ord, x1-x0 AS w, y1-y0 AS h, (x1-x0)*(y1-y0)*(0.3 + 0.1*ord) AS area FROM {rooms})
SELECT plan, ord, area/90 > 0.08 OR w*h/90 > 0.08 OR (w/10 > 0.72 AND h/9 > 0.10) OR (h/9 > 0.72 AND w/10 > 0.10) AS giant FROM r""")
def giant_regions(spark, d):
    return bound(spark, d, "rooms").select("plan", "ord", giant(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(10.0), F.lit(9.0), F.col("ord")).alias("giant"))


def giant(w: Column, h: Column, width: Column, height: Column, ord_: Column) -> Column:
    """Page-scale fills and bands by area, box and side as shares of the page."""
    area = w * h * (0.3 + 0.1 * ord_)
    a, b = w / width, h / height
    return (area / (width * height) > 0.08) | (w * h / (width * height) > 0.08) | ((a > 0.72) & (b > 0.10)) | ((b > 0.72) & (a > 0.10))


@query("hint_predicates", (99, 100, 220), f"""
WITH f AS (SELECT plan, ord, lower({_HINTS}) AS c, 1 - ord*0.125e0 AS sure FROM {{furniture}})
SELECT plan, ord, NOT regexp_matches(c, 'wall|door|window|balcony|lift|stair|entrance|railing') AS furniture, regexp_matches(c, '(^|[^a-z0-9])(balcony|terrace)($|[^a-z0-9])') AS balcony,
 sure >= 0.75 AND trim(c) <> '' AND NOT regexp_matches(c, '(^|[^a-z0-9])(balcony|terrace)($|[^a-z0-9])') AS confident FROM f""")
def hint_predicates(spark, d):
    """Whether a hint is furniture and not structure, whether a name is a balcony's, and whether a room label can be trusted."""
    f = bound(spark, d, "furniture").select("plan", "ord", F.expr(_HINTS).alias("c"), (1 - F.col("ord") * 0.125).alias("sure"))
    low = F.lower("c")
    balcony = F.arrays_overlap(F.split(low, "[^a-z0-9]+"), F.array(*map(F.lit, BALCONY_WORDS)))
    confident = (F.col("sure") >= 0.75) & (F.trim(low) != "") & ~balcony & (T.dimension_pair(F.col("c"))["state"] == "none")
    return f.select("plan", "ord", (~F.exists(F.array(*map(F.lit, STRUCTURAL)), low.contains)).alias("furniture"), balcony.alias("balcony"), confident.alias("confident"))


@query("label_warnings", (95,), """
SELECT l.plan, l.ord, l.name FROM {labels_px} l WHERE NOT EXISTS (SELECT 1 FROM {rooms} r WHERE r.plan = l.plan AND r.ord % 2 = 1 AND l.x BETWEEN r.x0 AND r.x1 AND l.y BETWEEN r.y0 AND r.y1)""")
def label_warnings(spark, d):
    """Warnings of wrong labels, less those inside a balcony (rooms at odd places)."""
    b = bound(spark, d, "rooms").where("ord % 2 = 1").select("plan", "x0", "y0", F.col("x1").alias("x9"), F.col("y1").alias("y9"))
    l = bound(spark, d, "labels_px")
    inside = F.col("x").between(F.col("x0"), F.col("x9")) & F.col("y").between(F.col("y0"), F.col("y9"))
    return l.join(b, (l.plan == b.plan) & inside, "left_anti").select("plan", "ord", "name")


@query("gap_messages", (305,), """
WITH g AS (SELECT plan, id, (lead(s) OVER (PARTITION BY plan, wall_id ORDER BY s, e, id) - e)/100 AS gap, lead(id) OVER (PARTITION BY plan, wall_id ORDER BY s, e, id) AS other FROM {openings})
SELECT plan, printf('unclosed gap of %.2f m between walls %s and %s', gap, id, coalesce(other, '?')) AS message FROM g WHERE gap > 0""")
def gap_messages(spark, d):
    """A warning's text for each gap that nothing closes."""
    w = Window.partitionBy("plan", "wall_id").orderBy("s", "e", "id")
    g = bound(spark, d, "openings").select("plan", "id", ((F.lead("s").over(w) - F.col("e")) / 100).alias("gap"), F.lead("id").over(w).alias("other")).where("gap > 0")
    return g.select("plan", F.format_string("unclosed gap of %.2f m between walls %s and %s", "gap", "id", F.coalesce("other", F.lit("?"))).alias("message"))
