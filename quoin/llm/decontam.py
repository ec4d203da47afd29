"""Benchmark decontamination by greedy string tiling.

Words are `\\w+` of the lower-cased text.  Every SEED words in a row of an item are a seed.  Documents are read once for
their seeds, which a filter of fixed size thins out to those that items may have; what is left is joined with the seeds of
the items, and gives the pairs of a document and an item that share so many that tiles could cover COVERAGE of the item.
For each such pair, running Karp-Rabin tiling marks the longest unmarked common match first, then shorter ones down to
SEED words, without overlap and in any order, so a passage whose sentences were moved about is still covered.  A document
is contaminated by an item when the tiles cover COVERAGE of the item's words.

An item of fewer than SEED words is a seed as a whole, and is found inside texts like any other.
"""

from __future__ import annotations

import heapq
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm import common

SEED = 5
COVERAGE = 0.6
#: Bits of the filter of seeds (2 MB); bytes of items and keys of documents up to which they are broadcast.
FILTER_BITS, BROADCAST_BYTES, BROADCAST_KEYS = 24, 8_000_000, 500_000
#: Word hashes that a Python worker keeps.
WORDS_HELD = 200_000
WORD = re.compile(r"\w+")
HITS = "doc_id long, text_hash long, item_id long, coverage double, tiles array<struct<doc_start:int,item_start:int,length:int>>"
BASE, MOD = 1_000_003, (1 << 61) - 1


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def tile(doc: list[int], item: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (doc start, item start, length) of the marked matches, at least `least` long.

    The longest match of unmarked words is marked first; of equally long ones the first in the item, then in the
    document.  Word numbers below 0 match nothing.
    """
    doc_free, item_free = [w >= 0 for w in doc], [w >= 0 for w in item]
    tiles, s = [], max(least, min(len(item), len(doc)) // 2)
    while True:
        table: dict[int, list[int]] = {}
        for at, h in _runs(item, item_free, s):
            table.setdefault(h, []).append(at)
        found = []
        for at, h in _runs(doc, doc_free, s):
            for other in table.get(h, ()):
                if at and other and doc[at - 1] == item[other - 1] and doc_free[at - 1] and item_free[other - 1]:
                    continue  # part of the match that starts one word before
                n = 0
                while at + n < len(doc) and other + n < len(item) and doc[at + n] == item[other + n] and doc_free[at + n] and item_free[other + n]:
                    n += 1
                if n >= s:
                    found.append((-n, other, at))
        heapq.heapify(found)
        while found:
            n, other, at = heapq.heappop(found)
            free = [doc_free[at + i] and item_free[other + i] for i in range(-n)]
            if all(free):
                tiles.append((at, other, -n))
                doc_free[at : at - n] = [False] * -n
                item_free[other : other - n] = [False] * -n
                continue
            begin = 0  # what other tiles have left of it, if it is long enough
            for i, is_free in enumerate([*free, False]):
                if not is_free:
                    if i - begin >= s:
                        heapq.heappush(found, (begin - i, other + begin, at + begin))
                    begin = i + 1
        if s == least:
            return sorted(tiles)
        s = max(least, s // 2)


def _runs(words: list[int], free: list[bool], s: int):
    """(start, Karp-Rabin hash) of each run of s free words; the hash rolls along."""
    top, h, n = pow(BASE, s - 1, MOD), 0, 0
    for i, w in enumerate(words):
        if not free[i]:
            h = n = 0
            continue
        if n == s:
            h = (h - (words[i - s] + 1) * top) % MOD
            n -= 1
        h = (h * BASE + w + 1) % MOD
        n += 1
        if n == s:
            yield i - s + 1, h


def regions(ids, places: list[int], length: int, seed: int = SEED) -> tuple[list[int], list[int]]:
    """The words within seeds at `places` and where they come from, stretches kept apart by -1, which matches nothing.

    An item of `length` words is covered by length / seed tiles at most.  Where the same `length` words stand at more
    places than that, one after the other, further ones can add nothing and are left out.
    """
    region, origin, last, seen = [], [], -1, {}
    for p in places:
        window = ids[p : p + length].tobytes()
        n, end = seen.get(window, (0, -1))
        if n > length // seed + 1 and p >= end:
            continue
        if p >= end:
            seen[window] = (n + 1, p + length)
        if p > last and region:
            region.append(-1)
            origin.append(-1)
        for q in range(max(p, last), p + seed):
            region.append(int(ids[q]))
            origin.append(q)
        last = p + seed
    return region, origin


def cover(doc: list[str], item: list[str]) -> tuple[float, list[tuple[int, int, int]]]:
    """The share of the item's words that tiles cover, and the tiles."""
    import numpy as np

    seed = seed_size(len(item))
    number: dict[str, int] = {}
    item_ids = np.array([number.setdefault(w, len(number)) for w in item], dtype=np.int64)
    ids = np.array([number.get(w, -1) for w in doc], dtype=np.int64)
    if not seed or len(ids) < seed:
        return 0.0, []
    known = np.concatenate([[0], np.cumsum(ids >= 0)])
    full = np.flatnonzero(known[seed:] - known[:-seed] == seed)
    places = full[np.isin(_combined(ids, seed)[full], _combined(item_ids, seed))]
    region, origin = regions(ids, places.tolist(), len(item), seed)
    tiles = [(origin[a], b, n) for a, b, n in tile(region, item_ids.tolist(), seed)]
    return sum(t[2] for t in tiles) / len(item), tiles


def seed_size(n_words: int) -> int:
    """Words of an item's seeds: SEED, or all that it has."""
    return min(SEED, n_words)


def _combined(ids, seed: int = SEED):
    """One hash for each `seed` numbers in a row; runs of another length have other hashes."""
    import numpy as np

    n = max(0, len(ids) - seed + 1)
    h = np.full(n, SEED - seed, dtype=np.uint64)
    values = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for i in range(seed if n else 0):
            h = (h ^ values[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


class _Hashes(dict):
    """64-bit hashes of words; at most WORDS_HELD are kept between texts."""

    def __missing__(self, word: str) -> int:
        import xxhash

        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def seeds_of(words: list[str], hashes: _Hashes, sizes):
    """64-bit hashes of the seeds of each of these sizes at each place."""
    import numpy as np

    if len(hashes) > WORDS_HELD:
        hashes.clear()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    return np.concatenate([_combined(ids, n) for n in sizes if n])


def item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item_id, item_hash, places, n_words): where an item has a seed at `places` places."""

    def run(batches):
        from collections import Counter

        import pandas as pd

        hashes = _Hashes()
        for batch in batches:
            rows = []
            for item_id, item_hash, text in zip(batch["item_id"], batch["item_hash"], batch["text"]):
                words = words_of(text)
                rows += [(seed, item_id, item_hash, n, len(words)) for seed, n in Counter(seeds_of(words, hashes, [seed_size(len(words))]).view("i8").tolist()).items()]
            yield pd.DataFrame(rows, columns=["seed", "item_id", "item_hash", "places", "n_words"])

    return items.mapInPandas(common.roomy(run), "seed long, item_id long, item_hash long, places long, n_words long")


def seed_filter(seeds: DataFrame) -> bytes:
    """A bit for each seed: others pass at times, no seed is missed."""
    import numpy as np

    def run(batches):
        import pandas as pd

        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            bits[batch["seed"].to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
        yield pd.DataFrame({"bits": [np.packbits(bits).tobytes()]})

    out = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for r in seeds.select("seed").mapInPandas(common.roomy(run), "bits binary").toLocalIterator():  # a row of 2 MB a task, one at a time
        out |= np.frombuffer(r["bits"], dtype=np.uint8)
    return out.tobytes()


def document_seeds(docs: DataFrame, bits: bytes, sizes: list[int]) -> DataFrame:
    """(doc_id, text_hash, seed): the different seeds of these sizes of each text that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # of a fixed size

    def run(batches):
        import numpy as np
        import pandas as pd

        wanted, hashes = np.unpackbits(np.frombuffer(shared.value, dtype=np.uint8)).astype(bool), _Hashes()
        for batch in batches:
            at, seeds = [], []
            for i, text in enumerate(batch["text"]):
                h = seeds_of(words_of(text), hashes, sizes)
                h = np.unique(h[wanted[h >> np.uint64(64 - FILTER_BITS)]])
                seeds.append(h)
                at.append(np.full(len(h), i))
            at = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
            out = pd.DataFrame({"text_hash": batch["text_hash"].to_numpy()[at], "seed": np.concatenate(seeds).view(np.int64) if seeds else at})
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").take(at).to_numpy())
            yield out

    return docs.mapInPandas(common.roomy(run), "doc_id long, text_hash long, seed long")


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """HITS: one row for each document row and item that it covers, with its tiles in words.

    Null and empty texts and items, and items with a null id, hit nothing; items of equal texts are hit each, and of
    items that share an id the one covered most counts.  Rows that repeat an id are told apart by text_hash (xxhash64
    of the text, null as empty); rows that also repeat the text are one.  Other columns are ignored.
    """
    spark = docs.sparkSession
    common.bound_batches(spark)
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.text_or_empty()).alias("text_hash"), "text")
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_hash"), "text")
    items = common.settle(items.dropDuplicates(["item_id", "item_hash"]), "items")
    seeds = common.settle(item_seeds(items), "item-seeds")
    sizes = sorted(r[0] for r in seeds.select(F.least("n_words", F.lit(SEED)).cast("int")).distinct().collect()) or [SEED]  # up to SEED rows
    hits = common.settle(document_seeds(ready, seed_filter(seeds), sizes), "document-seeds")
    met = common.lookup(hits, seeds, ["seed"], ["doc_id", "text_hash"]).where("item_id is not null")
    # A tile of n words has n - SEED + 1 seeds, which is n / SEED at least.
    pairs = met.groupBy("doc_id", "text_hash", "item_id", "item_hash").agg(F.sum("places").alias("places"), F.max("n_words").alias("n_words"))
    pairs = common.settle(pairs.where(F.col("places") * SEED >= F.col("n_words") * coverage).drop("places", "n_words"), "pairs")
    keys = common.settle(pairs.select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct(), "keys")
    same = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash"))
    texts = ready.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, same, "left_semi").dropDuplicates(["doc_id", "text_hash"])
    named = items.withColumnRenamed("text", "item")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES:
        asked = pairs.join(F.broadcast(named), ["item_id", "item_hash"])
    else:
        asked = common.lookup(pairs, named, ["item_id", "item_hash"], ["doc_id", "text_hash"])
    asked = asked.withColumnsRenamed({"doc_id": "k_id", "text_hash": "k_hash"})

    def run(batches):
        import pandas as pd

        names = [f.split()[0] for f in HITS.split(", ")]
        for batch in batches:
            rows, at = [], []
            for i, (text_hash, text, item_id, item) in enumerate(zip(batch["text_hash"], batch["text"], batch["item_id"], batch["item"])):
                share, tiles = cover(words_of(text), words_of(item))
                if share >= coverage and tiles:
                    rows.append((None, text_hash, item_id, share, [dict(zip(("doc_start", "item_start", "length"), t)) for t in tiles]))
                    at.append(i)
            out = pd.DataFrame(rows, columns=names)
            out["doc_id"] = batch["doc_id"].astype("Int64").take(at).to_numpy()
            yield out

    found = texts.join(asked, same).select("doc_id", "text_hash", "text", "item_id", "item").mapInPandas(common.roomy(run), HITS)
    best = F.max_by(F.struct("coverage", "tiles"), "coverage").alias("best")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", "best.*")


def marked(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The input rows with _contaminated, _n_items, _item_id and _coverage (of the item covered most).

    Input columns of these names are replaced; all others stay, whatever their names.
    """
    added = ["_contaminated", "_n_items", "_item_id", "_coverage"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    an_id, a_hash, n, item, most = common.free_names(docs.columns, "_id", "_hash", "_n", "_item", "_most")
    hits = common.settle(contamination(docs, benchmark, coverage), "hits")
    best = F.max_by("item_id", F.struct("coverage", (-F.col("item_id")).alias("i")))
    by_doc = hits.groupBy(F.col("doc_id").alias(an_id), F.col("text_hash").alias(a_hash)).agg(F.count(F.lit(1)).alias(n), best.alias(item), F.max("coverage").alias(most))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(an_id)) & (F.xxhash64(common.text_or_empty()) == F.col(a_hash))
    joined = docs.join(by_doc, same, "left")
    values = [F.col(n).isNotNull(), F.col(n), F.col(item), F.col(most)]
    return joined.select(*docs.columns, *[v.alias(name) for v, name in zip(values, added)])


def op6_decontam(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = marked(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("_contaminated").alias("contaminated"),
        F.coalesce("_n_items", F.lit(0)).cast("long").alias("n_items"),
        F.col("_item_id").alias("item_id"),
        F.coalesce("_coverage", F.lit(0.0)).alias("coverage"),
    )
