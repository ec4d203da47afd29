"""MinHash near-dedup with min-max hashing, confirmed on full sets.

Each of PERMUTATIONS hash permutations gives two signature values, the smallest and the largest hash of the document's
shingle set, so 160 values cost 80 evaluations; each agrees between two sets with probability equal to their
similarity.  BANDS bands of four values: two sets at the threshold 0.75 share no band with probability
(1 - 0.75**4)**40 = 2.6e-7.

Equal sets are one class, a node of the link graph, and only class representatives go on.  Buckets never emit all their pairs: a round links
every member to its bucket's leader, confirms the links on full sets, and merges classes into components.  Later rounds
only see buckets that still hold several components, with other leaders.  After STAR_ROUNDS, buckets of SMALL members at
most are compared pair by pair between different components.  Larger ones are joined into groups where they share
members, and a group is compared block by block (BLOCK documents or BLOCK_SHINGLES shingles in the mean), each pair of
blocks counting common shingles through an inverted index in one task and returning only links that merge components.  So no link that a shared band shows is lost, and no pair that
fails is ever a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm import common

SHINGLE, PERMUTATIONS, ROWS = 5, 80, 4
BANDS = 2 * PERMUTATIONS // ROWS
PERCENT = 75
STAR_ROUNDS = 2
#: Members of a bucket that are paired off; documents and shingles of a block of a large group.
SMALL, BLOCK, BLOCK_SHINGLES = 8, 500, 500_000
#: Edges that one task joins (about 300 bytes each).
EDGES_A_TASK = 300_000
#: Word hashes (about 180 bytes each) that a Python worker keeps.
WORDS_HELD = 200_000
#: Ids (8 bytes each) up to which a semi-join's side is broadcast; beyond, it is shuffled.
BROADCAST_IDS = 500_000
SIGNED = "doc_id long, text_hash long, n_shingles long, set_digest binary, bands array<long>"
_WORDS: dict[bytes, int] = {}
common.KEPT["words"] = _WORDS


def shingle_hashes(text: str | None):
    """Sorted distinct 64-bit hashes of the text's 5-word shingles (of all its words, if fewer)."""
    import numpy as np
    import xxhash

    words = common.ascii_lower_words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known, digest = _WORDS, xxhash.xxh3_64_intdigest
    if len(known) > WORDS_HELD:
        known.clear()
    for word in set(words).difference(known):
        known[word] = digest(word)
    ids = np.array([known[w] for w in words], dtype=np.uint64)
    size = min(SHINGLE, len(ids))
    with np.errstate(over="ignore"):
        mixed = np.full(len(ids) - size + 1, size, dtype=np.uint64)
        for i in range(size):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i : len(ids) - size + 1 + i]
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def permutations():
    """Odd multipliers by the splitmix64 rule: x -> x * a permutes the 64-bit numbers."""
    import numpy as np

    with np.errstate(over="ignore"):
        z = np.arange(1, PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) | np.uint64(1)


def min_max_signature(hashes, factors):
    """The minima, then the maxima, under each permutation."""
    import numpy as np

    low = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    high = np.zeros(len(factors), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):  # blocks that stay in the processor's cache
            block = hashes[None, at : at + 4096] * factors[:, None]
            np.minimum(low, block.min(axis=1), out=low)
            np.maximum(high, block.max(axis=1), out=high)
    return np.concatenate([low, high])


def band_hashes(signature):
    """One 64-bit key a band; a band takes the minima and maxima of ROWS / 2 permutations."""
    import numpy as np

    half = ROWS // 2
    rows = np.concatenate([signature[:PERMUTATIONS].reshape(BANDS, half), signature[PERMUTATIONS:].reshape(BANDS, half)], axis=1)
    with np.errstate(over="ignore"):
        key = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            key = (key ^ rows[:, i]) * np.uint64(0x94D049BB133111EB)
            key ^= key >> np.uint64(31)
    return key.view(np.int64)


def signed(docs: DataFrame) -> DataFrame:
    def run(batches):
        import hashlib

        import pandas as pd

        factors = permutations()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                hashes = shingle_hashes(text)
                bands = band_hashes(min_max_signature(hashes, factors)) if len(hashes) else []
                rows.append((len(hashes), hashlib.blake2b(hashes.tobytes(), digest_size=16).digest(), bands))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_digest", "bands"])
            out.insert(0, "text_hash", batch["text_hash"].to_numpy())
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    return _keyed(docs).mapInPandas(common.roomy(run), SIGNED)


def _keyed(docs: DataFrame) -> DataFrame:
    """A row is known by its id and the hash of its text (null as empty)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.text_or_empty()).alias("text_hash"), "text")


def confirm(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) whose full sets pass the threshold; texts: id, text, unique by id.

    A node `a` may have any number of edges: its text goes to RUNS places at most, not to one task.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        last, last_set = None, None
        for batch in batches:
            good = []
            for i, (a, x, y) in enumerate(zip(batch["a"], batch["text_a"], batch["text_b"])):
                if a != last:
                    last, last_set = a, shingle_hashes(x)
                other = shingle_hashes(y)
                both = len(np.intersect1d(last_set, other, assume_unique=True))
                if 100 * both >= PERCENT * (len(last_set) + len(other) - both) and both:
                    good.append(i)
            yield pd.DataFrame({"a": batch["a"].to_numpy()[good], "b": batch["b"].to_numpy()[good]})

    left = common.lookup(edges, texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), ["a"], ["b"])
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return left.join(right, "b").select("a", "b", "text_a", "text_b").mapInPandas(common.roomy(run), "a long, b long")


def forest(batches):
    """(id, root) of the nodes of a task's edges, joined as far as these edges do; the root is the least id."""
    import pandas as pd

    root: dict[int, int] = {}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(a, b)] = min(a, b)
    yield pd.DataFrame({"id": list(root), "root": [find(x) for x in root]}, dtype="int64")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of the nodes of edges (a, b): the least id that they reach.

    Tasks join EDGES_A_TASK edges each; where a node has got several roots, these become the edges of the next round.
    """
    edges = common.settle(edges.select("a", "b"), "edges")
    while True:
        tasks = -(-edges.count() // EDGES_A_TASK) or 1
        trees = common.settle(edges.repartition(tasks).mapInPandas(common.roomy(forest), "id long, root long"), "forest")
        if tasks == 1:
            return trees.withColumnRenamed("root", "component")
        ends = common.settle(trees.groupBy("id").agg(F.min("root").alias("low"), F.max("root").alias("high")), "ends")
        if not ends.where("low < high").limit(1).count():
            return ends.select("id", F.col("low").alias("component"))
        # Every node goes on with the label of its label, which halves the way to the least at least.
        labels = ends.select("id", "low")
        far = common.lookup(labels, labels.select(F.col("id").alias("low"), F.col("low").alias("far")), ["low"], ["id"])
        edges = far.select(F.coalesce("far", "low").alias("a"), F.col("id").alias("b")).where("a <> b")
        linked = trees.join(labels, "id").where("root <> low").select(F.col("low").alias("a"), F.col("root").alias("b"))
        edges = common.settle(edges.unionByName(linked).distinct(), "edges")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, text_hash, n_shingles, component_id (smallest doc_id reachable), kept, n_class.

    kept: this row's id is its component's.  n_class counts the rows with the same shingle set; text_hash is xxhash64 of
    the text (null as empty).  Texts without words (null, empty, white space) have no set and stand alone.  Rows that
    repeat an id are linked by each of their texts on its own and so may get different components; rows with a null id
    are not linked and are kept.  An empty table gives an empty result; other columns are ignored.
    """
    sets = common.settle(signed(docs), "signed")
    filled = sets.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy("set_digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("n_class"))
    # Classes are numbered once and for all as they are written.
    classes = common.settle(classes.select("set_digest", "first.*", "n", "n_class", F.monotonically_increasing_id().alias("id")), "classes")
    firsts = filled.join(classes.select("doc_id", "text_hash", "set_digest", "id"), ["doc_id", "text_hash", "set_digest"])
    banded = firsts.select("id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key")).distinct()
    leaves = banded.groupBy("key", common.run_of("id").alias("run")).agg(F.count(F.lit(1)).alias("c"))
    shared = common.settle(leaves.groupBy("key").agg(F.sum("c").alias("c")).where("c > 1").select("key"), "shared")
    members = common.settle(banded.join(shared, "key", "left_semi"), "members")
    nodes = common.settle(members.select("id").distinct(), "nodes")
    n_nodes = nodes.count()
    small = n_nodes <= BROADCAST_IDS
    reps = classes.join(nodes, "id", "left_semi").select("id", "doc_id", "text_hash")
    texts = _keyed(docs.where("text is not null")).join(F.broadcast(reps) if small else reps, ["doc_id", "text_hash"]).select("id", "text")
    texts = common.settle(texts, "texts")
    if texts.count() > n_nodes:  # rows that repeat id and text
        texts = common.settle(texts.groupBy("id").agg(F.min("text").alias("text")), "texts")
    spark = members.sparkSession
    labels, tried = common.empty(spark, "id long, component long"), None

    def joined(links: DataFrame) -> DataFrame:
        return components(links.unionByName(labels.where("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b"))))

    for round_ in range(STAR_ROUNDS + 1):
        labelled = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        labelled = common.settle(labelled, "labelled")
        ends = labelled.groupBy("key", common.run_of("id").alias("run")).agg(
            F.min("component").alias("low"),
            F.max("component").alias("high"),
            F.min(F.struct(F.xxhash64("id", F.lit(round_)).alias("h"), F.col("id"), F.col("component"), F.col("n"))).alias("pick"),
            F.min(F.struct("id", "component", "n")).alias("first"),
        )
        buckets = ends.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("pick").alias("pick"), F.min("first").alias("first"))
        open_ = common.settle(buckets.where("low < high"), "open")
        left = common.settle(labelled.join(open_.select("key"), "key", "left_semi"), "left")
        if round_ < STAR_ROUNDS:
            lead = "first" if round_ == 0 else "pick"
            leaders = open_.select("key", F.col(f"{lead}.id").alias("a"), F.col(f"{lead}.component").alias("ca"), F.col(f"{lead}.n").alias("na"))
            pairs = common.lookup(left, leaders, ["key"], ["id"]).where("ca <> component").select("a", "na", F.col("id").alias("b"), "n")
        else:
            sizes = common.settle(left.groupBy("key", common.run_of("id").alias("run")).agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("least")).groupBy("key").agg(F.sum("c").alias("c"), F.min("least").alias("least")), "sizes")
            found = _large_groups(left, sizes.where(F.col("c") > SMALL), texts)
            if found is not None:
                labels = joined(found)
            pairs = _across(left.join(sizes.where(F.col("c") <= SMALL).select("key"), "key", "left_semi"))
        alike = (F.least("na", "n") * 100 >= F.greatest("na", "n") * PERCENT)
        new = pairs.where(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = common.settle(new if tried is None else new.join(tried, ["a", "b"], "left_anti"), "pairs")
        if new.limit(1).count():
            tried = new if tried is None else tried.unionByName(new)
            labels = joined(common.settle(confirm(new, texts), "links"))
    # The smallest document of each component, then its members, then the rows of their classes.
    merged = common.settle(classes.join(labels, "id", "left").select("set_digest", "n_class", "id", "doc_id", F.coalesce("component", "id").alias("component")), "merged")
    least = merged.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    answers = common.lookup(merged, least, ["component"], ["id"]).select("set_digest", "n_class", "component_id")
    found = common.lookup(sets.drop("bands"), answers, ["set_digest"], ["doc_id"])
    real = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(real, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.select(
        "doc_id",
        "text_hash",
        "n_shingles",
        component.alias("component_id"),
        component.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.when(F.col("n_shingles") > 0, F.col("n_class")).otherwise(F.lit(1)).cast("long").alias("n_class"),
    )


def _across(left: DataFrame) -> DataFrame:
    """Pairs of a small bucket's members in different components."""
    a = left.select("key", F.col("id").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"))
    return a.join(left, "key").where("ca < component").select("a", "na", F.col("id").alias("b"), "n")


def _large_groups(left: DataFrame, large: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Confirmed links (a, b) between components in buckets of more than SMALL members; None if there are no such."""
    if not large.limit(1).count():
        return None
    held = common.settle(common.lookup(left, large.select("key", "least"), ["key"], ["id"]).where("least is not null"), "held")
    members = held.select("id", "component", "n").distinct()
    groups = components(held.select(F.col("least").alias("a"), F.col("id").alias("b")).distinct())
    grouped = common.settle(members.join(groups.withColumnRenamed("component", "grp"), "id"), "grouped")
    leaves = grouped.groupBy("grp", common.run_of("id").alias("run")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("shingles"))
    blocks = leaves.groupBy("grp").agg(F.ceil(F.greatest(F.sum("c") / BLOCK, F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    mine = common.lookup(grouped, blocks, ["grp"], ["id"]).withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), F.col("blocks")).cast("int"))
    # A document goes to the pairs of its block with each block of its group: once a block, not once a member.
    dealt = mine.join(texts, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "component", "text")

    def run(key, part):
        import pandas as pd

        rows = part.sort_values("id")
        return pd.DataFrame(links_of(rows["id"].tolist(), rows["component"].tolist(), rows["block"].tolist(), rows["text"].tolist(), key[1] != key[2]), columns=["a", "b"])

    return dealt.groupBy("grp", "low", "high").applyInPandas(run, "a long, b long")


def links_of(ids: list, components_: list, blocks: list, texts: list, across: bool) -> list[tuple]:
    """Links that merge components, between members of one block, or of two different blocks (across).

    Common shingles are counted document by document over the postings of its shingles: memory is that of the sets.
    """
    import numpy as np

    sets = [shingle_hashes(t) for t in texts]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    column = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    posting, begin = owner[order], np.concatenate([[0], np.cumsum(np.bincount(column))])
    start = np.concatenate([[0], np.cumsum(size)])
    block = np.array(blocks)
    root = {c: c for c in components_}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    for i in range(len(sets)):
        mine = column[start[i] : start[i + 1]]
        low, n = begin[mine], begin[mine + 1] - begin[mine]
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(posting[at], minlength=len(sets))
        good = 100 * both >= PERCENT * (size[i] + size - both)
        good[: i + 1] = False
        if across:
            good &= block != block[i]
        for j in np.flatnonzero(good).tolist():
            x, y = find(components_[i]), find(components_[j])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def op9_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents")).drop("text_hash")
