"""The pipeline's stages against plain Python, on documents with every awkward case, and in a row."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from quoin.llm import common, toxicity
from tests.llm.test_operators import drop_lines, labelled, naive_tiles, prose, reachable

STAGES = dict(corpus_pipeline.STAGES)
#: Columns of documents, and others whose names the stages might use for themselves.
EXTRA = ["_id", "_HASH", "_drop", "_score", "n_lines", "n_dropped", "kept", "component_id", "seed"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in EXTRA)
ITEM = "the quick brown fox jumps over the lazy dog while seven small mice watch from afar"


def row(doc_id, text, source="s"):
    return (doc_id, text, "en", source, len(text or ""), *range(len(EXTRA)))


def documents() -> list[tuple]:
    near = prose(5, 200).split()
    texts = [(1, near), (2, [*near[:60], "changed", *near[61:]]), (3, prose(6, 90).split()), (4, near)]
    rows = [row(i, " ".join(w)) for i, w in texts]
    rows += [row(5, None), row(5, None), row(6, ""), row(7, "   "), row(None, "a null id"), row(None, " ".join(near), None)]
    rows += [row(8, prose(8, 50)), row(8, prose(8, 50)), row(8, prose(9, 50)), row(8, " ".join(near))]  # an id with three texts, one twice
    rows += [row(9, "first words of nine\nA line that is shared\n" + prose(10, 40)), row(10, "a LINE that is shared \n" + prose(11, 40)), row(10, "other\na line that is shared")]
    w = ITEM.split()
    rows += [row(11, prose(12, 30) + " " + ITEM), row(12, " ".join(w[8:]) + " and so " + " ".join(w[:8])), row(12, prose(13, 30)), row(13, prose(14, 2500), None)]
    return rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    rows, labels = labelled()
    docs = documents() + [row(10_000 + i, t) for i, t in rows] + [row(20_000, "nasty vile grubbo nasty " + prose(77, 20)), row(20_000, prose(78, 20))]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(10_000 + i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def counted(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())


def test_toxicity_drops_what_it_flags(spark, sf):
    docs = common.table(spark, sf, "documents")
    out = STAGES["toxicity"](spark, docs, sf)
    assert out.columns == docs.columns
    flagged = Counter(r.doc_id for r in toxicity.toxicity(docs, common.table(spark, sf, "labels")).where("predicted = 1").collect())
    all_rows = counted(docs)
    gone = all_rows - counted(out)
    assert Counter(r[0] for r in gone.elements()) == flagged and not counted(out) - all_rows
    assert flagged[20_000] == 1 and not any(k is None or k < 14 for k in flagged)


def test_lines_near_copies_and_benchmark_by_brute_force(spark, sf):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = STAGES["line dedup"](spark, docs, sf)
    lines = drop_lines([r[:2] for r in rows if r[0] is not None])
    want = Counter((r[0], t := lines[r[0], r[1] or ""][2] if r[0] is not None else r[1] or "", *r[2:4], len(t), *r[5:]) for r in rows)
    assert out.columns == docs.columns and counted(out) == want

    out = STAGES["near dedup"](spark, docs, sf)
    keyed = {(r[0], r[1] or "") for r in rows if r[0] is not None}
    names = {k: i for i, k in enumerate(sorted(keyed))}
    label = {i: c for i, (_, c) in reachable([(i, t) for (_, t), i in names.items()]).items()}
    first = {c: min(k[0] for k, i in names.items() if label[i] == c) for c in label.values()}
    want = Counter({r: 1 if r[0] is not None else n for r, n in Counter(rows).items() if r[0] is None or first[label[names[r[0], r[1] or ""]]] == r[0]})
    assert out.columns == docs.columns and counted(out) == want and sum(want.values()) < len(rows) - 4

    out = STAGES["decontamination"](spark, docs, sf)
    item = ITEM.split()
    covered = lambda t: sum(n for _, _, n in naive_tiles((t or "").lower().split(), item, 5)) >= 0.6 * len(item)
    assert out.columns == docs.columns and counted(out) == Counter(r for r in rows if not covered(r[1]))


def test_stages_take_empty_tables(spark, sf):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.settle(stage(spark, kept, sf), "stage")
        assert sorted(kept.columns) == sorted(docs.columns)
    pieces = corpus_pipeline.run(spark, sf)
    want = {r.doc_id for r in kept.select("doc_id").collect()}
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == want and docs.count() > len(want) > 0.5 * docs.count()
