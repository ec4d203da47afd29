"""Removal of byte strings that occur again, by suffix sorting with recursive induction (induced_sort).

A string of LENGTH bytes has one anchor: the GRAM bytes in it with the smallest hash (the leftmost, if equal).  Equal
strings have equal anchors at equal places, so all starts of a document that share an anchor form a segment, and a
string can only occur again in a segment with the same anchor hash.  This splits the corpus exactly:

1. anchors whose hash occurs once are done: nothing of their segment occurs again;
2. equal segments form a class; in a class of two or more, every start occurs again;
3. a string has SIDE bytes before its anchor or SIDE bytes after it.  A class whose anchor has neither the bytes before
   nor the bytes after in common with another class has no string in common with it and is done;
4. where a hash keeps several classes and one of them is single, one segment of each goes to the shard of its hash.  Each
   shard is suffix sorted, and neighbours in the suffix array that share LENGTH bytes are marked.

A hash whose classes have more than GROUP_BYTES (a passage with other surroundings in every document) is split before
that: its segments fall into pieces of a few starts, by distance to the anchor (SPANS, ever fewer).  All strings of such
a piece hold the same core of bytes, so a piece only meets pieces with an equal core, and steps 2 and 4 hold for pieces
with the core in place of the anchor.  A task packs the groups of its shard into sorts of SHARD_BYTES at most, or one
group.

The sort carries common prefixes, up to LENGTH, through its recursion beside the suffix tuples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm import common

LENGTH, GRAM = 200, 32
SIDE = (LENGTH - GRAM) // 2
SHARD_BYTES, GROUP_BYTES = 1_000_000, 250_000
#: Starts of a piece; at one start, equal cores are equal strings.
SPANS = (24, 4, 1)
#: Anchor hashes (8 bytes each) and requested segments (about 50) up to which they are broadcast; beyond, they are joined.
BROADCAST_HASHES, BROADCAST_SEGMENTS = 4_000_000, 50_000
#: Bytes of texts that are hashed at a time.
CHUNK = 1 << 19
ROWS = "doc_id long, text_hash long, a int, n int, off int, hash long, seg long, many boolean"
ANCHORS = ROWS + ", before long, after long"


def anchors(texts: list[bytes]):
    """Arrays (text, first start, number of starts, place of the anchor after the first start, anchor hash), in order.

    Each start of LENGTH bytes of each text belongs to one anchor.
    """
    import numpy as np

    out, held, size = [], [], 0
    for i, data in enumerate(texts):
        for begin in range(0, max(0, len(data) - LENGTH + 1), CHUNK):
            held.append((i, begin, data[begin : begin + CHUNK + LENGTH - 1]))
            size += len(held[-1][2])
            if size >= CHUNK // 2:
                out.append(_anchors_of(held))
                held, size = [], 0
    if held:
        out.append(_anchors_of(held))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out))


def _anchors_of(parts: list[tuple]):
    import numpy as np

    size = np.array([len(p[2]) for p in parts])
    begins = np.cumsum(size) - size
    data = np.frombuffer(b"".join([p[2] for p in parts]) + bytes(8), dtype=np.uint8)
    words = np.lib.stride_tricks.as_strided(data, (len(data) - 8, 8), (1, 1)).copy().view("<u8").ravel()
    count = len(words) - GRAM + 1
    with np.errstate(over="ignore"):
        h = np.zeros(count, dtype=np.uint64)
        for k in range(0, GRAM, 8):
            h = (h ^ words[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    window = LENGTH - GRAM + 1
    low = np.uint64((1 << 21) - 1)
    # Sliding minimum from block-wise running minima; the low bits tell the leftmost place.
    full = np.full(-(-count // window) * window, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:count] = (h & ~low) | np.arange(count, dtype=np.uint64)
    blocks = full.reshape(-1, window)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = count - window + 1
    place = (np.minimum(right[:starts], left[window - 1 : window - 1 + starts]) & low).astype(np.int64)
    inside = np.arange(starts) + LENGTH <= np.repeat(begins + size, size)[:starts]  # within one text
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    first = np.flatnonzero(new)
    upto = np.cumsum(inside)
    n = np.diff(np.append(upto[first] - 1, upto[-1]))
    part = np.searchsorted(begins, first, "right") - 1
    text, offset = np.array([p[0] for p in parts])[part], np.array([p[1] for p in parts])[part]
    return text, first - begins[part] + offset, n, place[first] - first, h[place[first]].view(np.int64)


def _encoded(texts) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def found_anchors(docs: DataFrame, only=None) -> DataFrame:
    """ANCHORS of doc_id, text_hash, text; only: a broadcast sorted array of the hashes wanted."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import xxhash

        digest = xxhash.xxh3_64_intdigest

        def signed(values):
            return pd.arrays.IntegerArray(np.array([v or 0 for v in values], dtype=np.uint64).view(np.int64), np.array([v is None for v in values], dtype=bool))

        for batch in batches:
            data = _encoded(batch["text"])
            i, a, n, off, h = anchors(data)
            if only is not None and len(h):
                wanted = only.value
                at = np.minimum(np.searchsorted(wanted, h), max(len(wanted) - 1, 0))
                keep = np.flatnonzero(wanted[at] == h) if len(wanted) else np.zeros(0, dtype=np.int64)
                i, a, n, off, h = i[keep], a[keep], n[keep], off[keep], h[keep]
            seg, before, after = [], [], []
            views = [memoryview(d) for d in data]
            for k, x, m, o in zip(i.tolist(), a.tolist(), n.tolist(), off.tolist()):
                view, anchor, end = views[k], x + o, x + m + LENGTH - 1
                seg.append(digest(view[x:end], seed=o))
                before.append(digest(view[anchor - SIDE : anchor + GRAM]) if o >= SIDE else None)
                after.append(digest(view[anchor : anchor + GRAM + SIDE]) if end - anchor >= GRAM + SIDE else None)
            out = pd.DataFrame({"a": a, "n": n, "off": off, "hash": h, "seg": signed(seg), "many": False, "before": signed(before), "after": signed(after)})
            out.insert(0, "text_hash", batch["text_hash"].to_numpy()[i])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").take(i).to_numpy())
            yield out

    return docs.mapInPandas(run, ANCHORS)


def _hashes(docs: DataFrame) -> DataFrame:
    """Every anchor's hash, a row each."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame({"hash": anchors(_encoded(batch["text"]))[4]})

    return docs.select("text").mapInPandas(run, "hash long")


def _with_parts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, text_hash, text and the parts (ROWS less the id) that are wanted of it."""
    parts = F.collect_list(F.struct("a", "n", "off", "hash", "seg", "many")).alias("parts")
    by_doc = wanted.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(parts)
    by_doc = common.settle(by_doc, "wanted")  # a document's list is bounded by its length
    small = wanted.count() <= BROADCAST_SEGMENTS
    joined = docs.join(F.broadcast(by_doc) if small else by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    return joined.select("doc_id", "text_hash", "text", "parts")


def _segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted segments or pieces."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for data, parts in zip(_encoded(batch["text"]), batch["parts"]):
                rows += [(p["hash"], p["seg"], data[p["a"] : p["a"] + p["n"] + LENGTH - 1]) for p in parts]
            yield pd.DataFrame(rows, columns=["hash", "seg", "data"])

    return _with_parts(docs, wanted).mapInPandas(run, "hash long, seg long, data binary")


def _pieces(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """ROWS of the pieces of `span` starts at most of the wanted segments; `off` still leads to the anchor."""

    def run(batches):
        import pandas as pd
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        names = [f.split()[0] for f in ROWS.split(", ")]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            rows = []
            for doc_id, text_hash, data, parts in zip(batch["doc_id"].astype("Int64"), batch["text_hash"], _encoded(batch["text"]), batch["parts"]):
                view = memoryview(data)
                for p in parts:
                    a, n, anchor = p["a"], p["n"], p["a"] + p["off"]
                    for q in range((anchor - a - n + 1) // span, (anchor - a) // span + 1):
                        # Starts whose distance to the anchor is q * span to q * span + span - 1.
                        x, end = max(a, anchor - q * span - span + 1), min(a + n - 1, anchor - q * span) + LENGTH
                        core = anchor - q * span
                        h = digest(view[core : core + LENGTH + 1 - span], seed=(p["hash"] ^ q) & (2**64 - 1))
                        rows.append((doc_id, text_hash, x, end - LENGTH + 1 - x, anchor - x, signed(h), signed(digest(view[x:end], seed=core - x)), p["many"]))
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return _with_parts(docs, wanted).mapInPandas(run, ROWS)


def _runs(marks) -> list[dict]:
    """Runs of true values: start and length."""
    import numpy as np

    edge = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return [{"start": int(a), "n": int(b - a)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _sorted_shards(segments: DataFrame, shards: int) -> DataFrame:
    """(hash, seg, start, n): runs of starts that occur again, by suffix sorting each shard."""

    def run(key, mine):
        import pandas as pd

        from quoin.llm import induced_sort

        rows = []

        def sort(held):
            strings = [s for group in held for s in group["data"]]
            named = [x for group in held for x in zip(group["hash"], group["seg"])]
            for (h, seg), marks in zip(named, induced_sort.repeated_starts(strings, LENGTH)):
                rows.extend((h, seg, r["start"], r["n"]) for r in _runs(marks))

        held, size = [], 0
        for _, group in mine.groupby("hash", sort=False):
            n = sum(map(len, group["data"]))
            if held and size + n > SHARD_BYTES:
                sort(held)
                held, size = [], 0
            held.append(group)
            size += n
        sort(held)
        return pd.DataFrame(rows, columns=["hash", "seg", "start", "n"])

    dealt = segments.withColumn("shard", F.pmod(F.xxhash64("hash"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInPandas(run, "hash long, seg long, start int, n int")


def _in_common(classes: DataFrame) -> DataFrame:
    """Classes that have the bytes before or after their anchor in common with another class of their hash."""
    sides = F.explode(F.array(*[F.when(F.col(x).isNotNull(), F.xxhash64("hash", x, F.lit(i))) for i, x in enumerate(("before", "after"))]))
    keys = common.settle(classes.select("hash", "seg", sides.alias("key")).where("key is not null"), "sides")
    again = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit(True).alias("again"))
    near = common.lookup(keys, again, ["key"], ["seg"]).where("again").select("hash", "seg").distinct()
    return classes.join(near, ["hash", "seg"], "left_semi")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, begin, end): stretches of starts, as byte ranges to remove, of settled doc_id, text_hash, text."""
    spark = docs.sparkSession
    long_ = docs.where(F.octet_length("text") >= LENGTH)
    shared = common.settle(_hashes(long_).groupBy("hash").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("hash"), "hashes")
    if shared.count() <= BROADCAST_HASHES:
        import numpy as np

        only = spark.sparkContext.broadcast(np.sort(shared.toArrow().column("hash").to_numpy()))
        rows = found_anchors(long_, only)
    else:
        rows = found_anchors(long_).join(shared, "hash", "left_semi").select(*[f.split()[0] for f in ANCHORS.split(", ")])
    rows, ranges, to_sort = common.settle(rows, "anchors"), [], []
    for level in range(len(SPANS) + 1):
        first = F.min(F.struct("doc_id", "text_hash", "a", "n", "off")).alias("first")
        sides = [F.min(x).alias(x) for x in ("before", "after") if not level]
        classes = rows.groupBy("hash", "seg").agg(first, (F.max("many") | (F.count(F.lit(1)) > 1)).alias("many"), *sides)
        classes = common.settle(classes, "classes")
        whole = classes.where("many").select("hash", "seg", F.lit(True).alias("all"))
        ranges.append(
            common.lookup(rows.where("not many"), whole, ["hash", "seg"], ["doc_id"]).where("all")
            .select("doc_id", "text_hash", F.col("a").alias("begin"), (F.col("a") + F.col("n") + LENGTH - 1).alias("end"))
        )
        open_ = classes if level else common.settle(_in_common(classes), "open")
        # Where every class has two members or more, every start is known to occur again: nothing is left to sort.
        per_hash = open_.groupBy("hash").agg(
            F.count(F.lit(1)).alias("classes"), F.min(F.col("many").cast("int")).alias("least"), F.sum(F.col("first.n") + F.lit(LENGTH - 1)).alias("bytes")
        ).where("classes > 1 and least = 0")
        # A hash with many classes has one row here for each, so the look-up is spread.
        several = common.lookup(open_, per_hash.select("hash", (F.col("bytes") > GROUP_BYTES).alias("hot")), ["hash"], ["seg"]).where("hot is not null")
        wanted = common.settle(several.select("first.*", "hash", "seg", "many", "hot"), "several")
        if level == len(SPANS):
            to_sort.append(wanted)
            break
        to_sort.append(wanted.where("not hot"))
        hot = wanted.where("hot")
        if not hot.limit(1).count():
            break
        rows = common.settle(_pieces(docs, hot, SPANS[level]), "pieces")
    columns = ["doc_id", "text_hash", "a", "n", "off", "hash", "seg", "many"]
    wanted = to_sort[0].select(*columns)
    for more in to_sort[1:]:
        wanted = wanted.unionByName(more.select(*columns))
    segments = common.settle(_segments(docs, wanted), "segments")
    size = segments.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    inside = _sorted_shards(segments, max(1, size // SHARD_BYTES))
    single = wanted.where("not many").select("doc_id", "text_hash", "a", "hash", "seg")
    found = inside.withColumnRenamed("n", "m").join(single, ["hash", "seg"]).select(
        "doc_id", "text_hash", (F.col("a") + F.col("start")).alias("begin"), (F.col("a") + F.col("start") + F.col("m") + LENGTH - 1).alias("end")
    )
    for part in ranges:
        found = found.unionByName(part)
    return found


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, spans (begin, end of each removed run), kept (the bytes left).

    A byte goes if a string of LENGTH bytes over it also starts elsewhere, in the same document or another, judged on
    the input.  Null and empty texts, and those under LENGTH bytes, lose nothing.  Rows that repeat an id are rows of
    their own; rows that also repeat the text lose it in each.  An empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    ranges = repeated_runs(base)
    by_doc = ranges.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_list(F.struct("begin", "end")).alias("_ranges"))
    joined = base.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for text, ranges in zip(batch["text"], batch["_ranges"]):
                data = text.encode("utf-8", "surrogatepass")
                spans, kept, last = [], [], 0
                if ranges is not None and len(ranges):
                    for begin, end in sorted((r["begin"], r["end"]) for r in ranges):
                        if spans and begin <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], end)
                        else:
                            spans.append([begin, end])
                for begin, end in spans:
                    kept.append(data[last:begin])
                    last = end
                kept.append(data[last:])
                rows.append((len(data), sum(e - b for b, e in spans), [{"begin": b, "end": e} for b, e in spans], b"".join(kept)))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "spans", "kept"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    return joined.select("doc_id", "text", "_ranges").mapInPandas(
        run, "doc_id long, n_bytes long, n_removed long, spans array<struct<begin:int,end:int>>, kept binary"
    )


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
