"""Fill-in-middle, resampling and page extraction against plain versions, on texts with every awkward case."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quoin.llm import common, fill_in_middle, html_extract, labelled_pages, page_blocks, resampling
from tests.llm.test_operators import SCHEMA, corpus

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def rows() -> list[tuple]:
    more = ["a <P> inside", "<S>", "x<M>y z", "  leading", "trailing \n", "<", "P>", "a <", "P> b", "é", "\x0b\x0c", "漢 字", "<<P", "\x1c x \x85 y", "word " * 3000]
    extra = [(200 + i, t, None, None, None, None, None, None, None, None) for i, t in enumerate(more)]
    return [*corpus(), *extra, (None, "null id one two", *[None] * 8), (None, "null id one two", *[None] * 8), (-3, "minus three", *[None] * 8)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def h(doc_id, k: int) -> int:
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(digest[8 * k : 8 * k + 8], 16)


def plain_fim(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h(doc_id, 0) % (n + 1), h(doc_id, 1) % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h(doc_id, 2) % 100 >= 50:
        return (doc_id, n, "plain", None, None, text)
    if h(doc_id, 3) % 100 < 80:
        return (doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize("window, buffer", [(1 << 20, 1 << 22), (7, 64)])
def test_fill_in_middle(docs, none, monkeypatch, window, buffer):
    monkeypatch.setattr(fill_in_middle, "WINDOW", window)
    monkeypatch.setattr(fill_in_middle, "BUFFER", buffer)
    made = [fill_in_middle.fill_in_middle(docs.where("length(text) < 9000 or text is null"))] if window == 7 else [fill_in_middle.fill_in_middle(docs)]
    got = sorted((tuple(r) for r in made[0].collect()), key=key)
    assert got == sorted((plain_fim(r[0], r[1]) for r in rows() if window > 7 or len(r[1] or "") < 9000), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.restore(fill_in_middle.fill_in_middle(none), ["doc_id"]).count() == 0


def test_fill_in_middle_restores_from_output_and_form(spark, docs):
    made = fill_in_middle.fill_in_middle(docs, rate=100)
    back = sorted(((r.doc_id, r.text) for r in fill_in_middle.restore(made, ["doc_id"]).collect()), key=key)
    assert back == sorted(((r[0], r[1] or "") for r in rows()), key=key)
    odd = [(1, "psm", "<P>a<S>b<M>c", "acb"), (2, "spm", "<P>a<S>b<M>c", None), (3, "psm", "no marks", None), (4, None, "x", None), (5, "plain", None, None), (6, "plain", "<P>", "<P>"), (7, "psm", "<P>a<S>b<M>c<P>", None)]
    given = spark.createDataFrame([r[:3] for r in odd], "text long, form string, output string")
    assert sorted(tuple(r) for r in fill_in_middle.restore(given.withColumnRenamed("text", "_form"), ["_form"]).collect()) == [(r[0], r[3]) for r in odd]


def test_displacements_add_up_over_windows(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "WINDOW", 4)
    found = np.concatenate([m for _, _, m in fill_in_middle.displacements(np.array([0, 2, 2, 9]), np.array([5, 7, -1, 3]), 11)])
    assert found.tolist() == [5, 5, -1, -1, -1, -1, -1, -1, -1, 3, 3]


def test_buffers_cover_all_rows_once(monkeypatch):
    monkeypatch.setattr(fill_in_middle, "BUFFER", 5)
    texts = ["", "abc", "", "defghijk", "l", "m", "", "nopqr", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]).slice(1)
    got = []
    for rows_, data, offsets in fill_in_middle.buffers(batch):
        assert rows_.start == len(got) and len(offsets) == rows_.stop - rows_.start + 1
        got += [data[a:b].tobytes().decode() for a, b in itertools.pairwise(offsets)]
    assert got == texts[1:]


def plain_features(text) -> list[int]:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(all_rows, target, percent=5, min_words=20):
    held = [(r[0], r[1], plain_features(r[1])) for r in all_rows]
    s, t = Counter(b for *_, f in held for b in f), Counter(b for x in target for b in plain_features(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in range(10000)]
    out = []
    for doc_id, text, f in held:
        weight = sum(gain[b] for b in f)
        noise = math.floor(-1000 * math.log(-math.log((h(doc_id, 0) + 0.5) / 4294967296)))
        out.append([doc_id, len(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))), len(f), weight, weight + noise, None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=key)


TARGET = ["alpha1 beta2 gamma3", "the of the of delta9", "Über naïve x1 zeta", None, ""]


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_resampling(spark, docs, none, monkeypatch, piece):
    monkeypatch.setattr(resampling, "PIECE", piece)
    target = spark.createDataFrame([(i, t) for i, t in enumerate(TARGET)], "item_id long, text string")
    got = sorted((tuple(r) for r in resampling.resample(docs, target, percent=40).collect()), key=key)
    assert got == plain_resample(rows(), TARGET, percent=40)
    assert resampling.resample(none, target).count() == 0
    assert resampling.resample(docs, target.limit(0)).where("rank is not null").count() == 5 * sum(len(WORD.findall(r[1] or "")) >= 20 for r in rows()) // 100


def test_resampling_of_equal_rows_without_ids(spark):
    """Rows that agree in all keys still get ranks of their own."""
    docs = spark.createDataFrame([(None, "same words again and " * 10)] * 300 + [(7, "other words here now " * 10)] * 2, "doc_id long, text string")
    got = resampling.resample(docs, docs.limit(1), percent=50)
    assert sorted(r["rank"] for r in got.where("rank is not null").collect()) == list(range(1, 152))


def test_crc_of_ngrams_from_two_prefixes():
    shift, r = resampling.Shift(), random.Random(4)
    words = ["".join(chr(r.randint(97, 122)) for _ in range(n)) for n in (1, 3, 255, 256, 257, 700, 5, 70000, 2, 9)]
    ends, lengths = resampling.prefixes(" ".join(words) + " ")
    for n, (at, crc) in enumerate(resampling.ngram_crcs(ends, lengths, np.zeros(len(words), dtype=int), shift), 1):
        assert crc.tolist() == [zlib.crc32(" ".join(words[i : i + n]).encode()) for i in at]
        assert at.tolist() == list(range(len(words) - n + 1))


SENTENCES = ["The old bridge was closed after the flood, and nobody knew why.", "She wrote three letters that winter.", "Prices rose again in the spring; wages did not.",
             "A short line.", "Le pont fut fermé après la crue.", "Der alte Turm steht noch immer am Fluss, obwohl das Dorf fort ist."]


@pytest.fixture(scope="module")
def model():
    return html_extract.fit_chains([html_extract.chain_of(p) for p in labelled_pages.labelled_pages(SENTENCES, 500, seed=1)])


def test_labelled_pages_held_out(model):
    chains = [html_extract.chain_of(p) for p in labelled_pages.labelled_pages(SENTENCES, 200, seed=2)]
    right = [a == label for chain in chains for a, (*_, label) in zip(model.decode([(f, s) for f, s, _ in chain]), chain)]
    assert sum(right) / len(right) > 0.97


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/>Home</a><a href=/b>B</a></nav><article><h1>A title here</h1><p>First &amp; second,\n  line&nbsp;two.<p><b>Open bold<br>goes on.<script>var a='<p>no</p>'</script></p></article>"
     "<footer>&copy; me</footer></body></html>", "A title here\nFirst & second, line two.\nOpen bold goes on."),
    ("<body><div class='cookie-banner'><p>We use cookies to improve.</p><button>OK</button></div><header class=masthead><a href=/>The daily site</a></header><main><article><h1>News of the day</h1><p>The old bridge was closed after the flood, and nobody knew why.</p>"
     "<aside class=related><h3>Related</h3><li><a href=1>Other news of the week</a></li></aside><p>She wrote three letters that winter.</p></article></main><section id=comments><h3>Comments</h3><div class=comment><p>Nice article, thanks for it!</p></div></section></body>",
     "News of the day\nThe old bridge was closed after the flood, and nobody knew why.\nShe wrote three letters that winter."),
    ("<div id=content class=post><h1>Plain layout</h1><p>The old bridge was closed after the flood, and nobody knew why.</p><p>Prices rose again in the spring; wages did not.</p></div><div class=sidebar><ul><li><a href=a>Recent posts</a><li><a href=b>Older</a></ul></div>"
     "<form action=/s><label>Search</label><input></form>", "Plain layout\nThe old bridge was closed after the flood, and nobody knew why.\nPrices rose again in the spring; wages did not."),
    (None, ""), ("", ""), ("   ", ""), ("<nav><a href=x>Menu</a></nav>", ""), ("<!-- only a comment --><script>x", ""),
]


def test_pages(spark, model):
    given = spark.createDataFrame([(i if i else None, f"u{i}", p, "x", 3) for i, (p, _) in enumerate(PAGES)] * 2, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((int(r.url[1:]), r.text, r.n_chars) for r in html_extract.extract(given, model).collect())
    assert got == sorted((i, t, len(t)) for i, (_, t) in enumerate(PAGES) for _ in range(2))
    assert html_extract.extract(given.limit(0)).count() == 0


def test_given_pages(spark):
    """Every page of the table gives its article, block by block."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {r.page_id: "\n".join(t for t, *_ in page_blocks.blocks("<body>" + re.search("<article>(.*)</article>", r.html, re.S)[1])) for r in pages.collect()}
    assert {r.page_id: r.text for r in html_extract.extract(pages).collect()} == want


@pytest.mark.parametrize("html, texts", [
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", ["a", "b", "c", "d"]), ("<table><tr><td>a<td>b<tr><td><p>c</table>", ["a", "b", "c"]), ("<p>a<div>b</p>c</div>", ["a", "b", "c"]),
    ("<dl><dt>a<dd>b<dt>c</dl>", ["a", "b", "c"]), ("x &lt;y&gt; &#233;&nbsp;&unknown; <![CDATA[z]]> <!x>", ["x <y> é &unknown;"]), ("<p>a <i>b</p><p>c</i> d", ["a b", "c d"]), ("a</div>b</p>c", ["ab", "c"]),
    ("<h1>a<h2>b</h2>c", ["a", "b", "c"]), ("<head><title>t</title><p>a", ["a"]), ("<p>one<hr>two<p hidden>three", ["one", "two", "three"]), ("<select><option>x</select>y<svg><text>z</text></svg>", ["y"]), ("<div><p>a" * 2000, ["a"] * 2000),
])
def test_leaf_blocks(html, texts):
    assert [t for t, *_ in page_blocks.blocks(html)] == texts


def test_viterbi_and_likelihood_by_enumeration():
    r = np.random.default_rng(5)
    for n in range(1, 7):
        moves, scores, sibling = r.normal(size=(2, 2, 2)), r.normal(size=n), r.integers(0, 2, n)
        def value(y):
            return sum(scores[t] * y[t] for t in range(n)) + sum(moves[sibling[t], y[t - 1], y[t]] for t in range(1, n))
        every = list(itertools.product((0, 1), repeat=n))
        crf = html_extract.Crf({f"f{t}": scores[t] for t in range(n)}, 0.0, moves)
        assert crf.decode([([f"f{t}"], bool(sibling[t])) for t in range(n)]) == list(max(every, key=value))
        y = every[r.integers(len(every))]
        pad = 2
        put = lambda x, fill: np.concatenate([x, [fill] * pad])[None]
        args = (put(sibling, 0), put(np.array(y), 0), put(np.ones(n, dtype=bool), False))
        got, by_score, by_move = html_extract.likelihood(put(scores, 0.0), *args, moves)
        assert got == pytest.approx(value(y) - math.log(sum(math.exp(value(x)) for x in every)))
        for t in range(n):  # gradients by differences
            up = put(scores, 0.0).copy()
            up[0, t] += 1e-6
            assert (html_extract.likelihood(up, *args, moves)[0] - got) / 1e-6 == pytest.approx(by_score[0, t], abs=1e-4)
        for at in itertools.product((0, 1), repeat=3):
            up = moves.copy()
            up[at] += 1e-6
            assert (html_extract.likelihood(put(scores, 0.0), *args, up)[0] - got) / 1e-6 == pytest.approx(by_move[at], abs=1e-4)
