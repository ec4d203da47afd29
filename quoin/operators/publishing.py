"""Tables of plans that are published as one set."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions import geometry as G
from quoin.plans.bindings import bound
from quoin.registry import query
from quoin.sources.artifacts import ArtifactStore, Conflict, Missing, promote
from quoin.sources.folders import shared_folder

#: Metres below which a correction drops a wall.
SHORT = 1.0


@query("committed_set", (25, 26), """
WITH w AS (SELECT plan, count(*) AS walls, max(concat('/', id, '.json')) AS last FROM {walls} WHERE sqrt((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)) >= 1 GROUP BY plan), r AS (SELECT plan, count(*) AS rooms FROM {rooms} GROUP BY plan)
SELECT coalesce(w.plan, r.plan) AS plan, walls, last, rooms, 2 AS version FROM w FULL JOIN r ON w.plan = r.plan""")
def committed_set(spark, d):
    """Walls and rooms by plan from the set that readers see after an analysis, a correction and two refused commits.

    A worker stages walls, each with the path of its evidence, and rooms; both are promoted together.  A correction
    replaces the walls and keeps the rooms.  One commit from an outdated version and one without rooms change nothing.
    """
    staging = shared_folder(spark, "staged")
    store = ArtifactStore(spark, shared_folder(spark, "set"), required=("walls", "rooms"))
    bound(spark, d, "walls").withColumn("evidence", F.concat(F.lit(f"{staging}/"), "id", F.lit(".json"))).write.parquet(f"{staging}/walls")
    bound(spark, d, "rooms").write.parquet(f"{staging}/rooms")
    first = promote(store, staging)
    corrected = store.read("walls").where(G.distance(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]) >= SHORT)
    store.commit({"walls": corrected}, expected=first, keep=True)
    for given, expected, refusal in (({"walls": corrected.limit(0)}, first, Conflict), ({"walls": corrected.limit(0)}, None, Missing)):
        try:
            store.commit(given, expected=expected)
        except refusal:
            continue
        raise AssertionError("a commit that should be refused was taken")
    end = F.substring("evidence", len(store.root) + 1, 1 << 20)
    walls = store.read("walls").groupBy("plan").agg(F.count(F.lit(1)).alias("walls"), F.max(end).alias("last"))
    rooms = store.read("rooms").groupBy("plan").agg(F.count(F.lit(1)).alias("rooms"))
    return walls.join(rooms, "plan", "full").select("plan", "walls", "last", "rooms", F.lit(store.version()).alias("version"))
