"""Each operator against a brute-force version, on documents with every awkward case."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quoin.llm import chat_quotes, common, cuckoo, decontam, exact_dedup, induced_sort, line_dedup, near_dup, packing, sharding, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, shard int, n_lines long, digest string"
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "Über", "naïve", "x1", "ZETA."]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(n))


def corpus() -> list[tuple]:
    """Copies, near copies, shared lines and passages, null and empty texts, a repeated row, a long text, hot groups."""
    base = prose(1, 120)
    texts = [base, base, base.replace(" ", "  "), base + " tail", None, "", " \t\n", "one two", "one two three four five", "word"]
    texts += [prose(2, 60) + "\nA shared line of words\n" + prose(3, 60), "a SHARED line of words \n" + prose(4, 30), "x\nA shared line of words\nA shared line of words"]
    near = prose(5, 200).split()
    for k in range(6):
        w = list(near)
        w[17 * k + 3] = "changed"
        texts.append(" ".join(w))
    texts += ["hot copy of a text that is everywhere " * 8] * 12
    texts += [prose(100 + i, 20 + i) for i in range(12)] + [prose(7, 9000), "<|endoftext|> in  the text ", "漢字 and emoji 🙂 " * 20]
    rows = [(i, t, "en", f"src{0 if i % 3 else i % 5}" if i % 7 else None, 1, True, 0.5, 3, 9, "d") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[5]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts() -> dict:
    return {r[0]: r[1] or "" for r in corpus()}


def test_exact_dedup(docs, none):
    norm = {k: re.sub(r"[\x20\x09-\x0d]+", " ", t) for k, t in texts().items()}
    groups = defaultdict(list)
    for r in corpus():
        groups[norm[r[0]]].append(r[0])
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        mine = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(mine), len(mine), min(mine) == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_merges_sorted_runs(docs):
    """The optimiser keeps every round's sort, and no round fills a hash table."""
    listed = exact_dedup.entries(docs).withColumn("run", common.run_of("doc_id"))
    with common.setting(docs.sparkSession, exact_dedup.SORTED, "true"):
        plan = exact_dedup.tree_merge(listed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Sort [run") == 3 and "SortAggregate" in plan and "HashAggregate" not in plan


def test_exact_dedup_null_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (4, "a"), (None, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.kept) for r in exact_dedup.exact_dedup(rows).collect()) == [(-1, -1, True), (-1, 4, False), (4, 4, True)]


def test_tokenizer_is_the_library(docs):
    bpe = common.byte_bpe(common.default_tokenizer())
    r, bits = random.Random(3), [" ", "\n", "\t", "a", "B", "é", "'s", "1", "<|endoftext|>", ".", "ß", "\x0b", "\xa0", "\x85", "漢", "ab"]
    for text in [*texts().values(), *("".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(3000))]:
        assert np.frombuffer(bpe.packed(text), dtype="<u2").tolist() == (bpe._library(text) if text else [])


def test_token_counts_use_the_cache(spark, docs, none, monkeypatch):
    path = common.fresh_path(spark, "cache")
    bpe = common.byte_bpe(common.default_tokenizer())
    first = token_counts.token_counts(docs, path).collect()
    assert len(first) == len(corpus())
    for r in first:
        t = texts()[r.doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(bpe._library(t)), len(bpe._library(t)) > 1024)
    held = token_counts.read_cache(spark, path).count()
    assert held == len(set(texts().values()))
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(900, "quite new"), (901, "word"), (None, "quite new")], "doc_id long, text string"))
    again = token_counts.token_counts(more, path)
    assert again.count() == len(corpus()) + 3 and token_counts.read_cache(spark, path).count() == held + 1
    assert token_counts.token_counts(none, path).count() == 0 and token_counts.read_cache(spark, path).count() == held + 1


@pytest.mark.parametrize("targets", [None, {"src0": 3.0, "src1": 1.0}])
def test_packing_round_trip(docs, targets):
    bpe = common.byte_bpe(common.default_tokenizer())
    pieces = packing.pack(docs, window=256, targets=targets).collect()
    ids = {k: [*bpe._library(t), packing.END] if t else [packing.END] for k, t in texts().items()}
    places, got = set(), Counter()
    for p in pieces:
        assert np.frombuffer(p.ids, dtype="<u4").tolist() == ids[p.doc_id][p.start : p.start + p.length] and p.doc_tokens == len(ids[p.doc_id])
        mine = {p.sequence_id * 256 + p.offset + i for i in range(p.length)}
        assert p.offset + p.length <= 256 and not mine & places
        places |= mine
        got.update((p.doc_id, p.start + i) for i in range(p.length))
    rows = Counter(r[0] for r in corpus())
    assert got == Counter({(k, i): n for k, n in rows.items() for i in range(len(ids[k]))})
    assert places == set(range(len(places)))


def test_packing_mixture():
    totals = {"a": 30_000, "b": 9_000, "c": 1_000}
    plan = packing.phases(totals, 512)
    held = defaultdict(Counter)
    for s, n in totals.items():
        for _, length, w, _ in packing.cuts(0, n, s, plan, 512):
            held[w][s] += length
    for w in list(held)[:-1]:
        assert sum(held[w].values()) == 512 and all(abs(held[w][s] - 512 * n / 40_000) <= 4 for s, n in totals.items())


@pytest.mark.parametrize("targets", [None, {"s7": 3.0, "s8": 1.0}])
def test_packing_many_sources(spark, targets, monkeypatch):
    """More than MAX_QUEUES sources: each is a queue of its own, to the result that one table of phases gives."""
    rows = [(i if i % 90 else None, f"text {i} of words " * (1 + i % 9), f"s{i}" if i < 1100 else "s7" if i % 4 else None) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    docs.count()
    got = Counter(tuple(r) for r in packing.pack(docs, 512, targets).collect())
    monkeypatch.setattr(packing, "MAX_QUEUES", 10_000)
    assert got == Counter(tuple(r) for r in packing.pack(docs, 512, targets).collect())
    assert {r[6] for r in got} == {r[2] for r in rows}


def test_packing_empty(none):
    assert packing.pack(none).count() == 0


def test_sharding(docs, none):
    rows = sharding.shard(docs, 4).collect()
    size = Counter()
    slots, groups = defaultdict(list), defaultdict(set)
    for r in rows:
        t = texts()[r.doc_id]
        assert r["size"] == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes"
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        groups[t].add(r.shard)
    assert len(rows) == len(corpus()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard(none).count() == 0


def test_places_of_keys():
    from bisect import bisect_right

    r = random.Random(2)
    for _ in range(200):
        bounds = sorted({(r.randint(0, 5), r.choice([0, r.randint(-3, 3)])) for _ in range(r.randint(0, 12))})
        keys = [(r.randint(0, 6), r.randint(-4, 4)) for _ in range(20)]
        got = sharding.places(bounds, np.array([k[0] for k in keys]), np.array([k[1] for k in keys]))
        assert got.tolist() == [bisect_right(bounds, k) for k in keys]


def test_sharding_of_repeated_and_null_ids(spark, none):
    rows = [(None, "a"), (None, None), (3, "a"), (3, "a"), (3, ""), (4, "x" * 5000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len((t or "").encode()) + 1) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_is_even_and_keeps_groups(spark):
    many = [(i, prose(i % 700, 10 + i % 40)) for i in range(1500)] + [(5000 + i, "hot text " * 30) for i in range(900)]
    rows = sharding.shard(spark.createDataFrame(many, "doc_id long, text string")).collect()
    size, groups = Counter(), defaultdict(set)
    for r in rows:
        size[r.shard] += r["size"]
        groups[r.text_crc32].add(r.shard)
    mean = sum(size.values()) / 8
    assert len(size) == 8 and max(size.values()) < 1.03 * mean and min(size.values()) > 0.97 * mean
    assert sum(len(s) > 1 for s in groups.values()) <= 8


def drop_lines(rows: list[tuple]) -> dict:
    key = lambda line: line.strip(common.WHITE).encode().lower() if len(line.strip(common.WHITE)) >= 10 else None
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if key(line) is not None:
                holders[key(line)].add(doc_id)
    out = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) is None or len(holders[key(x)]) < 2 or min(holders[key(x)]) == doc_id]
        out[doc_id, text or ""] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(docs, none):
    want = drop_lines([(r[0], r[1]) for r in corpus()])
    out = line_dedup.dedup_lines(docs)
    assert out.columns[-3:] == ["text", "n_lines", "n_dropped"] and len(out.columns) == len(docs.columns) + 1
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect())
    assert got == sorted((r[0], *want[r[0], r[1] or ""]) for r in corpus())
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_index_is_reversible(spark, docs):
    a = docs.where("doc_id % 2 = 0").select("doc_id", "text")
    b = docs.where("doc_id % 2 = 1").select("doc_id", "text")
    index = line_dedup.LineIndex(spark)
    index.insert(common.settle(line_dedup.references(a)))
    before = sorted(map(tuple, index.counts().collect()))
    index.insert(common.settle(line_dedup.references(b)))
    assert sorted(map(tuple, index.counts().collect())) != before
    index.delete(b)
    assert sorted(map(tuple, index.counts().collect())) == before
    held = sum(len(cuckoo.CuckooFilter.from_bytes(r["filter"])) for r in index.filters.collect())
    assert held == len(before)


def held_prints(index) -> int:
    return sum(len(cuckoo.CuckooFilter.from_bytes(r["filter"])) for r in index.filters.collect())


def test_line_index_overflows_reopens_and_deletes(spark, monkeypatch, tmp_path):
    """Filters that overflow, are split into more shards, and are opened again hold one fingerprint for each live key."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 60)
    path = f"file://{tmp_path}/index"
    lines = lambda i, n: "\n".join(f"line number {i} {k} of a document" for k in range(n))
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    insert = lambda index, rows: index.insert(common.settle(line_dedup.references(frame(rows))))
    index = line_dedup.LineIndex(spark, path)
    insert(index, [(1, lines(1, 100)), (2, lines(1, 30))])
    before = sorted(map(tuple, index.counts().collect()))
    shards = index.shards
    monkeypatch.setattr(line_dedup.LineIndex, "_split", lambda self, n: setattr(self, "shards", self.shards or 1))
    insert(index, [(k, lines(k, 4000)) for k in range(3, 8)])  # overflows: rebuilt from the log
    assert held_prints(index) == 100 + 5 * 4000 and index.shards == shards
    monkeypatch.undo()
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 60)
    index = line_dedup.LineIndex(spark, path)
    assert held_prints(index) == 100 + 5 * 4000
    seen = insert(index, [(9, lines(1, 20) + "\n" + lines(9, 50)), (1, lines(1, 100))])
    assert {bytes(r.digest) for r in seen.collect()} >= {hashlib.blake2b(x.encode(), digest_size=16).digest() for x in lines(1, 20).split("\n")}
    assert index.shards > shards and held_prints(index) == 100 + 5 * 4000 + 50
    index = line_dedup.LineIndex(spark, path)
    index.delete(frame([(k, "") for k in range(3, 10)]))
    assert sorted(map(tuple, index.counts().collect())) == before and held_prints(index) == 100
    assert sorted(map(tuple, line_dedup.LineIndex(spark, path).counts().collect())) == before


@pytest.mark.parametrize("clash", ["_id", "_HASH", "_drop", "owner", "n_lines", "n_dropped", "digest"])
def test_line_dedup_leaves_clashing_columns(spark, clash):
    rows = spark.createDataFrame([(1, "one shared line\nx", 77), (2, "one shared line\ny", 78), (None, "one shared line", 79)], f"doc_id long, text string, `{clash}` long")
    got = sorted((r[1], r[2]) for r in line_dedup.dedup_lines(rows, counts=None).collect())
    assert got == [("one shared line", 79), ("one shared line\nx", 77), ("y", 78)]


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(5000)]
    f = cuckoo.grown(keys[:4000])
    assert f.contains(keys[:4000]).all() and f.contains(keys[4000:]).mean() < 0.01 and len(f) == 4000
    f.delete(keys[:2000])
    assert f.contains(keys[2000:4000]).all() and len(f) == 2000
    with pytest.raises(cuckoo.Full):
        small = cuckoo.CuckooFilter(8)
        small.insert(keys[:200])


def reachable(rows: list[tuple]) -> dict:
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    label[a] = label[b] = min(label[a], label[b])
    return {k: (len(sets[k]), label[k]) for k in sets}


@pytest.mark.parametrize("small", [8, 1])
def test_near_duplicates(docs, none, small, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", small)
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    want = reachable(list({r[0]: (r[0], r[1]) for r in corpus()}.values()))
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert near_dup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("size", [5, 40, 1000])
def test_components(spark, size, monkeypatch):
    """A chain, a star and pairs, in few and many tasks."""
    monkeypatch.setattr(near_dup, "EDGES_A_TASK", size)
    edges = [(k + 1, k) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(300 + 2 * k, 301 + 2 * k) for k in range(20)]
    got = {r.id: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, **{300 + k: 300 + k // 2 * 2 for k in range(40)}}
    assert near_dup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_about_the_threshold(spark, monkeypatch):
    """Many near copies that mostly don't link: large open buckets, compared in blocks."""
    monkeypatch.setattr(near_dup, "SMALL", 3)
    monkeypatch.setattr(near_dup, "BLOCK", 10)
    origin, rows = prose(9, 100).split(), []
    for i in range(45):
        r, w = random.Random(i), list(origin)
        for p in r.sample(range(100), 3 if i % 3 else 2):
            w[p] = f"new{i}_{p}"
        rows.append((i, " ".join(w)))
    want = reachable(rows)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len({c for _, c in want.values()}) > 1


def test_suffix_array():
    """Order and common prefixes, with queues that spill, long runs, periods and a limit."""
    r = random.Random(5)
    for k in range(600):
        unit = [r.randint(1, r.choice([1, 2, 3, 200])) for _ in range(r.randint(1, 12))]
        x = (unit * r.randint(1, 12) if k % 2 else [r.randint(1, r.choice([1, 2, 200])) for _ in range(r.randint(0, 60))])[: r.randint(1, 90)] + [0]
        limit = r.choice([None, 1, 7, 30])
        order, common = induced_sort.suffix_array(np.array(x), run=r.choice([7, 10**6]), limit=limit)
        want = sorted(range(len(x)), key=lambda i: x[i:])
        assert order.tolist() == want
        for i, (a, b) in enumerate(zip(want, want[1:])):
            n = next(n for n in range(len(x)) if a + n == len(x) or b + n == len(x) or x[a + n] != x[b + n])
            assert common[i + 1] == (n if limit is None else min(n, limit)), (x, a, b)


@pytest.mark.parametrize("group, spans", [(250_000, (24, 4, 1)), (1, (24, 4, 1)), (1, (50,)), (500, (7, 3))])
def test_remove_repeats(spark, docs, none, group, spans, monkeypatch):
    """Also where every group counts as too large and is cut into pieces, and with a passage that has many surroundings."""
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group)
    monkeypatch.setattr(suffix_dedup, "SPANS", spans)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    passage, half = prose(77, 45), prose(78, 14)
    more = [(1000 + i, f"{prose(300 + i, 20)}{i % 3} {passage if i % 2 else half} {i % 2}{prose(400 + i, 20)}") for i in range(24)]
    rows = [(r[0], (r[1] or "").encode()) for r in corpus()] + [(k, t.encode()) for k, t in more]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    seen = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    want = {}
    for doc_id, b in rows:
        gone = np.zeros(len(b) + 1, dtype=np.int8)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = 1
        want[doc_id] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), bytes(x for x, g in zip(b, gone) if not g))
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) == want[r.doc_id]
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_anchors_of_long_texts_meet(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    texts = [prose(3, 400).encode(), b"", b"short", prose(4, 90).encode(), b"x" * 200, b"y" * 199]
    i, a, n, off, h = suffix_dedup.anchors(texts)
    for k, data in enumerate(texts):
        mine = i == k
        assert n[mine].sum() == max(0, len(data) - 199)
        assert a[mine].tolist() == np.concatenate([[0], np.cumsum(n[mine])])[: mine.sum()].tolist()


def test_tiling_finds_moved_parts():
    item = "the quick brown fox jumps over the lazy dog while seven small mice watch from afar".split()
    moved = item[9:] + ["filler"] * 4 + item[:9]
    number = {}
    ids = lambda ws: [number.setdefault(w, len(number)) for w in ws]
    assert sorted(n for _, _, n in decontam.tile(ids(moved), ids(item), 5)) == [7, 9]
    assert decontam.tile(ids(["none", "of", "it"]), ids(item), 5) == []


def naive_tiles(doc: list, item: list, least: int) -> list:
    """The longest match of unmarked words again and again."""
    doc, item, tiles = list(doc), list(item), []
    while True:
        best = (0, 0, 0)
        for b in range(len(item)):
            for a in range(len(doc)):
                n = 0
                while a + n < len(doc) and b + n < len(item) and doc[a + n] is not None and doc[a + n] == item[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return sorted(tiles)
        tiles.append((a, b, n))
        doc[a : a + n] = [None] * n
        item[b : b + n] = ["marked"] * n


def test_tiling_is_greedy():
    r = random.Random(11)
    for k in range(1500):
        letters = "ab" if k % 2 else "abcdefgh"
        item = [r.choice(letters) for _ in range(r.randint(1, 30))]
        doc = [r.choice(letters) for _ in range(r.randint(0, 10))]
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(item))
            doc += item[i : i + r.randint(1, 20)] + [r.choice(letters) for _ in range(r.randint(0, 4))]
        ids = lambda ws: [ord(w) for w in ws]
        least = r.choice([1, 2, 3, 5])
        assert decontam.tile(ids(doc), ids(item), least) == naive_tiles(doc, item, least)
        share, tiles = decontam.cover(doc, item)
        assert share == sum(t[2] for t in naive_tiles(doc, item, min(5, len(item)))) / len(item)
        assert all(doc[a : a + n] == item[b : b + n] for a, b, n in tiles)


def test_tiling_of_repetitive_texts_is_bounded():
    import time

    began = time.time()
    share, _ = decontam.cover(["same"] * 300_000, ["same"] * 100)
    assert share == 1 and decontam.cover(["a", "b", "c"] * 100_000, ["a", "b", "c", "d"] * 25)[0] == 0
    assert time.time() - began < 60


def test_decontamination(spark, none):
    item = "the quick brown fox jumps over the lazy dog while seven small mice watch from afar"
    w = item.split()
    items = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, ""), (None, "x"), (5, item.upper()), (2, "tiny item")], "item_id long, text string")
    rows = [(1, "start " + item + " end"), (2, " ".join(w[9:]) + " and then " + " ".join(w[:9])), (3, "the quick brown fox jumps high"), (4, None), (5, ""), (6, "Tiny, Item!"), (6, "other"), (7, prose(1, 5000)), (8, "a long story of a tiny item told"), (None, item), (1, "start " + item + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(1, 1), (1, 5), (2, 1), (2, 5), (6, 2), (8, 2), (-1, 1), (-1, 5)])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id) for r in decontam.contamination(docs, items).collect()) == want
    for clash in ("_id", "_HASH", "_n_items", "item", "k_id", "seed"):
        got = decontam.marked(docs.withColumn(clash, common.F.lit(7)), items)
        assert sorted(str(r.doc_id) for r in got.where("_contaminated").collect()) == ["1", "1", "2", "6", "8", "None"] and got.count() == len(rows)
        assert clash == "_n_items" or {r[0] for r in got.select(clash).collect()} == {7}
    assert decontam.contamination(none, items).count() == 0 and decontam.contamination(docs, items.limit(0)).count() == 0


def test_decontamination_by_brute_force(spark, monkeypatch):
    """Every pair of documents and items tiled, and items too large to broadcast."""
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontam, "BROADCAST_KEYS", 0)
    r = random.Random(8)
    items = [(k, prose(900 + k, r.randint(1, 40))) for k in range(30)]
    docs = []
    for i in range(120):
        parts = [prose(2000 + i, r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            w = r.choice(items)[1].split()
            cut = r.randint(0, len(w))
            parts += [" ".join(w[cut:]), prose(3000 + i, r.randint(0, 3)), " ".join(w[: max(0, cut - r.randint(0, 12))])]
        docs.append((i, " ".join(parts)))
    want = {}
    for i, text in docs:
        for k, item in items:
            a, b = decontam.words_of(text), decontam.words_of(item)
            share = sum(t[2] for t in naive_tiles(a, b, min(5, len(b)))) / len(b)
            if share >= 0.6:
                want[i, k] = share
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id): x.coverage for x in got} == want and len(want) > 20


def labelled():
    r, rows, labels = random.Random(1), [], []
    for i in range(700):
        words = [r.choice(WORDS) + str(r.randint(0, 60)) for _ in range(r.randint(30, 80))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(r.randint(2, 5)):
                words.insert(r.randrange(len(words)), r.choice(["nasty", "vile", "grubbo", "grubbi", "grubba"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = labelled()
    extra = [(9000, None), (9001, ""), (9002, "grubbu grubbe nasty words here"), (9003, "alpha beta " * 3000)]
    docs = spark.createDataFrame([*rows, *extra], "doc_id long, text string").withColumn("score", common.F.lit(1))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    truth = {i: t for i, _, t in labels}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert sum(got[k].predicted == truth[k] for k in held) / len(held) > 0.95
    assert got[9002].predicted == 1 and got[9000].predicted == got[9001].predicted == got[9003].predicted == 0


def test_toxicity_without_labels(spark, none):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert toxicity.toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()[0].score == 0
    assert toxicity.toxicity(none, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).count() == 0


class Local:
    """Stands for a table: keeps the function that tasks would run."""

    def mapInPandas(self, f, schema):
        self.run = f
        return self

    select = groupBy = agg = lambda self, *a: self


def test_toxicity_counts_make_room_in_their_worker(spark):
    """Tokenizers that packing left in a worker go before words and n-grams are counted, and few counts are held."""
    import pandas as pd

    texts = [" ".join(f"{'abcdefghij'[i % 10]}{i}" for i in range(k, k + 900)) for k in range(0, 225_000, 900)]
    words = [w for t in texts for w in t.split()]
    for count, batches in (
        (toxicity.count_words, [pd.DataFrame({"toxic": i % 2, "text": texts[i : i + 25]}) for i in range(0, len(texts), 25)]),
        (toxicity.count_grams, [pd.DataFrame({"toxic": i % 2, "w": words[i : i + 1000], "n": 2}) for i in range(0, 100_000, 1000)]),
    ):
        assert common.byte_bpe(common.default_tokenizer()).packed("some words") and common._OPEN
        table, total, most = Local(), 0, 0
        count(table)
        for frame in table.run(iter(batches)):
            assert not common._OPEN
            most = max(most, len(frame))
            total += int(frame["n"].sum())
        assert most <= 110_000
        given = sum(len(set(t.split())) for t in texts) if count is toxicity.count_words else sum(2 * len(toxicity.grams_of(w)) for w in words[:100_000])
        assert total == given


def test_toxicity_is_kneser_ney(spark, monkeypatch):
    """Counts, shared backoff and log ratios against plain Python, with words of the corpus that no labelled text has."""
    monkeypatch.setattr(toxicity, "HELD", 150)
    r, order = random.Random(3), toxicity.ORDER
    words = ["".join(r.choice("abé") for _ in range(r.randint(1, 16))) for _ in range(200)]
    rows = [(c, " ".join(r.choices(words[60 * c :][:120], k=30))) for c in (0, 1, 0, 0) for _ in range(8)]
    corpus = [None, "", "Zq zq zq1", *(t for _, t in rows), *(" ".join(r.choices(words, k=30)) for _ in range(20))]

    def spelt(texts):
        found = Counter()
        for t in texts:
            for w in set(re.findall(r"\w+", (t or "").lower())):
                s = "^" + w + "$"
                found.update(s[max(0, i + 1 - order) : i + 1] for i in range(1, len(s)))
        return found

    top = spelt(corpus)
    strings = {g[j:] for g in top for j in range(len(g))}
    count = Counter(top)
    count.update(g[1:] for g in strings if len(g) > 1)
    after = defaultdict(Counter)
    for g, n in count.items():
        after[g[:-1]][g] = n
    discount = {}
    for size in range(1, order + 1):
        n1, n2 = (sum(n == k and len(g) == size for g, n in count.items()) for k in (1, 2))
        discount[size] = n1 / (n1 + 2 * n2) if n1 else 0.5
    letters = sum(len(g) == 1 for g in strings)

    def shared(g):
        if not g:
            return 1 / letters
        mine, d = after[g[:-1]], discount[len(g)]
        return (max(mine[g] - d, 0) + d * len(mine) * shared(g[1:])) / sum(mine.values())

    own, total, left = {}, defaultdict(Counter), defaultdict(Counter)
    for c in (0, 1):
        mine = spelt(t for k, t in rows if k == c)
        n1, n2 = (sum(n == k for n in mine.values()) for k in (1, 2))
        own[c] = {g: max(0, n - 1 - n1 / (n1 + 2 * n2)) for g, n in mine.items()}
        for g, n in mine.items():
            total[c][g[:-1]] += n
            left[c][g[:-1]] += own[c][g]
    want = {}
    for g in {*own[0], *own[1]}:
        h = g[:-1]
        if left[0][h] and left[1][h]:
            mass = min(left[c][h] / total[c][h] for c in (0, 1))
            p = [mass * own[c].get(g, 0) / left[c][h] + (1 - mass) * shared(g) for c in (0, 1)]
            if p[0] != p[1]:
                want[g] = float(np.log(p[1] / p[0]))
    classes = common.settle(toxicity.count_grams(toxicity.count_words(spark.createDataFrame(rows, "toxic int, text string"))))
    everything = toxicity.count_words(spark.createDataFrame([(0, t) for t in corpus], "toxic int, text string"))
    assert {x.w: x.n for x in everything.collect()} == Counter(w for t in corpus for w in set(toxicity.words_of(t)))
    grams = common.settle(toxicity.count_grams(everything).select("gram", "n"))
    assert {x.gram: x.n for x in grams.collect()} == top
    backoff = toxicity.shared_probability(grams, classes.select("gram"))
    assert all(abs(x.shared - shared(x.gram)) < 1e-12 for x in backoff.collect())
    got = {x.gram: x.r for x in toxicity.log_ratios(classes, backoff).collect()}
    assert set(want) <= set(got) and len(want) > 50
    assert all(abs(got[g] - want.get(g, 0)) < 1e-9 for g in got)
    names = sorted(got)
    hashed = toxicity.gram_hashes(names)
    at = np.argsort(hashed)
    model = toxicity.Model(hashed[at], np.array([got[g] for g in names])[at])
    for w, ratio in zip(words, toxicity.word_ratios(words, model)):
        assert abs(ratio - sum(want.get(g, 0) for g in toxicity.grams_of(w))) < 1e-9


CHAT = "conv_id long, turn int, role string, text string, source string"


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nThanks", "s"),
        (1, 1, "assistant", "> How do  I sort?\nUse sorted.", "s"),
        (1, 2, "user", ">> How do I sort?\n> Use sorted.\nBut in place?", "s"),
        (1, 3, "user", "> Thanks\nYou are welcome", "s"),
        (1, 4, "user", None, "s"),
        (1, 5, "user", "> never said\n", "s"),
        (2, 7, "user", "> How do I sort?", "s"),
        (3, 0, "user", "", None),
        (3, 0, "user", "", None),
    ]
    got = {(r.conv_id, r.turn): r for r in chat_quotes.link_quotes(spark.createDataFrame(rows, CHAT)).collect()}
    links = {k: (r.reply_to, r.linked, r.n_quoted, r.n_linked, r.quote_level) for k, r in got.items()}
    assert links == {
        (1, 0): (None, False, 0, 0, 0), (1, 1): (0, True, 1, 1, 1), (1, 2): (1, True, 2, 2, 2), (1, 3): (0, True, 1, 1, 1),
        (1, 4): (3, False, 0, 0, 0), (1, 5): (4, False, 1, 0, 1), (2, 7): (None, False, 1, 0, 1), (3, 0): (None, False, 0, 0, 0),
    }
    assert got[1, 2].text == "But in place?" and got[1, 2].position == 2 and got[2, 7].text == ""
    assert {k: r.depth for k, r in got.items()} == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 3): 1, (1, 4): 2, (1, 5): 3, (2, 7): 0, (3, 0): 0}
    assert chat_quotes.link_quotes(spark.createDataFrame([], CHAT)).count() == 0


def test_replies_are_told_before_later_turns(spark):
    """A reply to an early message stands behind that message, and repeated and nameless rows keep their places."""
    rows = [
        (1, 0, "a", "first"), (1, 1, "b", "second"), (1, 2, "c", "> second\nof second"), (1, 3, "d", "> first\nof first"),
        (1, 4, "e", "> of second\ndeep"), (1, 4, "e", "> of second\ndeep"), (1, 5, "f", "> second\nagain"), (1, 9, "g", "alone"),
        (1, None, "h", "when"), (None, 3, "i", "where"), (None, 1, "j", "where"), (None, None, None, None),
    ]
    got = chat_quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    told = sorted((r.position, r.turn, r.depth) for r in got if r.conv_id == 1 and r.turn is not None)
    assert told == [(1, 0, 0), (2, 1, 1), (3, 2, 2), (4, 4, 3), (5, 4, 3), (6, 5, 2), (7, 3, 1), (8, 9, 0)]
    assert [(r.position, r.depth) for r in got if r.conv_id == 1 and r.turn is None] == [(0, 0)]
    assert sorted((r.position, r.turn or -1) for r in got if r.conv_id is None) == [(0, -1), (1, 1), (2, 3)]


def test_reply_order_is_depth_first(spark, monkeypatch):
    """Random trees, a chain, a star and a reply to nowhere against a recursive walk, over several blocks of places."""
    monkeypatch.setattr(chat_quotes, "BLOCK", 16)
    rng, rows = random.Random(8), []
    for conv in range(6):
        rows += [(conv, t, rng.choice([None, *range(t)])) for t in range(rng.randrange(1, 40))]
    rows += [(10, t, t - 1 if t else None) for t in range(150)] + [(11, 7 * t, 0 if t else None) for t in range(150)] + [(12, 3, 1), (12, 4, 3)]
    expected = set()
    for conv in {r[0] for r in rows}:
        mine = {t: p for c, t, p in rows if c == conv}
        replies, stack, place = defaultdict(list), [], 0
        for t, p in mine.items():
            replies[p if p in mine else None].append(t)
        stack = [(t, 0) for t in sorted(replies[None], reverse=True)]
        while stack:
            t, depth = stack.pop()
            expected.add((conv, t, place, depth))
            place += 1
            stack += [(c, depth + 1) for c in sorted(replies[t], reverse=True)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, reply_to long")
    assert {tuple(r) for r in chat_quotes.reply_order(given).collect()} == expected


def test_repeated_rows_are_worked_on_once(spark, monkeypatch):
    """500 equal rows, some without an id: only distinct texts are encoded or tiled, and lines are dropped once each."""
    shared, long = "a line that two documents share", prose(77, 40)
    rows = [(1, f"{shared}\nx"), (2, f"{shared}\ny"), (2, f"{shared}\ny"), *[(None, long)] * 500, *[(5, "five " + long)] * 300]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    encoded = []
    real = token_counts.encode_misses
    monkeypatch.setattr(token_counts, "encode_misses", lambda texts, path: encoded.append(texts.count()) or real(texts, path))
    got = token_counts.token_counts(docs, common.fresh_path(spark, "cache")).collect()
    assert encoded == [4] and len(got) == len(rows) and len({r.n_tokens for r in got if r.doc_id is None}) == 1
    dropped = {(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs).where("doc_id < 3").collect()}
    assert dropped == {(1, 2, 0, f"{shared}\nx"), (2, 2, 1, "y")}
    hits = decontam.contamination(docs, spark.createDataFrame([(1, long)], "item_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.coverage) for r in hits) == [(-1, 1.0), (5, 1.0)]


def test_sharding_of_many_empty_texts(spark):
    """Rows without bytes are a group that is split as well: no shard and no range takes them all."""
    rows = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN '' ELSE repeat('w ', CAST(id % 50 AS INT)) || id END AS text")
    got = sharding.shard(rows).collect()
    size = Counter()
    for r in got:
        size[r.shard] += r.size
    assert len(got) == 6000 and max(size.values()) <= 1.05 * sum(size.values()) / 8
    for k in range(8):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_tables_without_rows_need_no_python_workers(spark):
    """createDataFrame([]) goes through a Python RDD, whose daemon and workers stay in each executor."""
    schema = "digest binary, doc_id long, sign int"
    made = common.empty(spark, schema)
    assert made.schema == spark.createDataFrame([], schema).schema and made.count() == 0
    assert "ExistingRDD" not in made._jdf.queryExecution().toString()
    plan = line_dedup.LineIndex(spark).log()._jdf.queryExecution().toString()
    assert "ExistingRDD" not in plan and "Range" in plan


def test_tasks_leave_nothing_in_their_worker(spark):
    """Words and tokenizers go before and after other work; packing's own tasks keep the tokenizer from one to the next."""
    import pandas as pd
    from pyspark import cloudpickle

    def left():
        return [name for name, kept in common.KEPT.items() if kept]

    def tasks_of(make):
        table = Local()
        make(table)
        return cloudpickle.loads(cloudpickle.dumps(table.run))  # as a worker gets it

    text = prose(1, 60)
    rows = pd.DataFrame({"doc_id": [1], "text_hash": [5], "toxic": [1], "queue": ["s"], "text": [text], "item_id": [1], "item": [text], "item_hash": [7]})
    near_dup.shingle_hashes(text)
    common.byte_bpe(common.default_tokenizer()).packed(text)
    assert sorted(left()) == ["tokenizers", "words"]
    held = tasks_of(toxicity.count_words)
    near_dup.shingle_hashes(text)
    for frame in held(iter([rows])):
        assert not left() and len(frame)
    for make in (lambda t: toxicity.count_words(t), lambda t: decontam.item_seeds(t)):
        near_dup.shingle_hashes(text)
        common.byte_bpe(common.default_tokenizer())
        assert sum(len(f) for f in tasks_of(make)(iter([rows]))) and not left()
    near_dup.shingle_hashes(text)
    common.byte_bpe(common.default_tokenizer())
    common.make_room("tokenizers")
    assert left() == ["tokenizers"]
    common.make_room()
    assert not left()
