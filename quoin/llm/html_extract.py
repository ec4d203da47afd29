"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

Every page is one chain: its leaf blocks in page order, with features of the elements and names around a block and
of its text (page_blocks).  The model has a weight for each feature, one for each pair of neighbouring labels inside
one parent and across parents, and is fitted by the likelihood of labelled pages (labelled_pages).  Spark deals the
pages; a task reads a page, decodes it by Viterbi and keeps the blocks of the article.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm import common, labelled_pages, page_blocks

#: The model's training set: pages of the table whose words are used, their greatest length, and pages laid out.
WORD_PAGES, WORD_PAGE_CHARS, LABELLED_PAGES = 200, 100_000, 1000
STEPS, RATE, RIDGE = 200, 0.15, 0.004
#: A feature counts from so many blocks on; a word from so many pages, so that words of articles stay out.
RARE, RARE_WORD = 3, 12


class Crf:
    """Labels 0 and 1; a block's score is that of label 1 over label 0."""

    def __init__(self, weights: dict[str, float], bias: float, moves: np.ndarray):
        #: moves[s][a][b]: label a, then b; s is 1 inside one parent.
        self.weights, self.bias, self.moves = weights, bias, moves

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features)

    def decode(self, chain: list[tuple[list[str], bool]]) -> list[int]:
        """The likeliest labels of a chain of (features, whether inside the parent of the block before); ties to 0."""
        moves, back = self.moves.tolist(), []
        best = None
        for features, sibling in chain:
            s = self.score(features)
            if best is None:
                best = (0.0, s)
                continue
            m = moves[int(sibling)]
            to0, to1 = (best[0] + m[0][0], best[1] + m[1][0]), (best[0] + m[0][1], best[1] + m[1][1])
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            best = (max(to0), max(to1) + s)
        if best is None:
            return []
        labels = [int(best[1] > best[0])]
        for came in reversed(back):
            labels.append(came[labels[-1]])
        return labels[::-1]


def likelihood(scores: np.ndarray, sibling: np.ndarray, labels: np.ndarray, held: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of padded chains (pages x blocks) and its gradients by block scores and by moves."""
    pages, blocks = scores.shape
    emit = np.stack([np.zeros_like(scores), scores], axis=2)
    forward, backward = np.zeros((pages, blocks, 2)), np.zeros((pages, blocks, 2))
    forward[:, 0] = emit[:, 0]
    for t in range(1, blocks):
        step = np.logaddexp.reduce(forward[:, t - 1, :, None] + moves[sibling[:, t]], axis=1) + emit[:, t]
        forward[:, t] = np.where(held[:, t, None], step, forward[:, t - 1])
    for t in range(blocks - 2, -1, -1):
        step = np.logaddexp.reduce(moves[sibling[:, t + 1]] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
        backward[:, t] = np.where(held[:, t + 1, None], step, 0.0)
    total = np.logaddexp.reduce(forward[:, -1], axis=1)
    chance = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None])
    by_score = np.where(held, labels - chance, 0.0)
    value = (np.where(held, labels * scores, 0.0)).sum() - total.sum()
    by_move = np.zeros_like(moves)
    later = held[:, 1:]
    pair = np.exp(forward[:, :-1, :, None] + moves[sibling[:, 1:]] + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
    for s in (0, 1):
        mine = later & (sibling[:, 1:] == s)
        by_move[s] -= pair[mine].sum(axis=0)
        np.add.at(by_move[s], (labels[:, :-1][mine], labels[:, 1:][mine]), 1.0)
        value += moves[s][labels[:, :-1][mine], labels[:, 1:][mine]].sum()
    return float(value), by_score, by_move


def fit_chains(chains: list[list[tuple[list[str], bool, int]]]) -> Crf:
    """Fit to labelled chains of (features, sibling, label), by gradient steps on all of them (Adam, with a ridge)."""
    chains = [c for c in chains if c]
    if not chains:
        return Crf({}, 0.0, np.zeros((2, 2, 2)))
    counts = Counter(f for chain in chains for features, _, _ in chain for f in set(features))
    spread = Counter(f for chain in chains for f in {f for features, _, _ in chain for f in features if f.startswith("word:")})
    index = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= RARE and spread.get(f, RARE_WORD) >= RARE_WORD))}
    shape = (len(chains), max(map(len, chains)))
    sibling, labels, held = np.zeros(shape, dtype=int), np.zeros(shape, dtype=int), np.zeros(shape, dtype=bool)
    place, feature = [], []
    for p, chain in enumerate(chains):
        for t, (features, same, label) in enumerate(chain):
            sibling[p, t], labels[p, t], held[p, t] = same, label, True
            mine = [index[f] for f in set(features) if f in index]
            feature += mine
            place += [p * shape[1] + t] * len(mine)
    place, feature = np.array(place, dtype=int), np.array(feature, dtype=int)
    size = len(index) + 9
    theta, mean, square = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        weights, bias, moves = theta[: len(index)], theta[len(index)], theta[len(index) + 1 :].reshape(2, 2, 2)
        scores = np.bincount(place, weights[feature], minlength=shape[0] * shape[1]).reshape(shape) + bias
        _, by_score, by_move = likelihood(scores, sibling, labels, held, moves)
        slope = np.concatenate([np.bincount(feature, by_score.ravel()[place], minlength=len(index)), [by_score.sum()], by_move.ravel()])
        slope = slope / len(chains) - RIDGE * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        theta = theta + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    moves = theta[len(index) + 1 :].reshape(2, 2, 2)
    return Crf({f: float(theta[i]) for f, i in index.items() if abs(theta[i]) > 1e-4}, float(theta[len(index)]), moves)


def sentences_of(pages: DataFrame) -> list[str]:
    """Sentences of a bounded sample of the table's pages, the same in every run: WORD_PAGES of at most WORD_PAGE_CHARS."""
    sample = pages.where(F.length("html").between(1, WORD_PAGE_CHARS)).select("html", F.xxhash64("html").alias("_order"))
    # First the order of the sample, then its pages: tasks send numbers to the driver, and each page comes once.
    order = [r[0] for r in sample.select("_order").orderBy("_order").limit(WORD_PAGES).collect()]
    if not order:
        return []
    found = set()
    for row in sample.where(F.col("_order") <= order[-1]).groupBy("_order").agg(F.first("html").alias("html")).collect():
        for text, *_ in page_blocks.blocks(row["html"]):
            found.update(s + "." for s in text.split(". ") if len(s.split()) > 2)
    return sorted(found)


def chain_of(html: str) -> list[tuple[list[str], bool, int]]:
    return [(features, same, int(main)) for _, features, same, main in page_blocks.blocks(html)]


def fit(pages: DataFrame, n: int = LABELLED_PAGES, seed: int = 0) -> Crf:
    """The model from n labelled pages; a table without words gives a model that takes nothing for an article."""
    sentences = sentences_of(pages)
    return fit_chains([chain_of(p) for p in labelled_pages.labelled_pages(sentences, n, seed)] if sentences else [])


def main_text(html: str | None, model: Crf) -> tuple[str, int, int]:
    """(text, blocks of the page, blocks kept)."""
    found = page_blocks.blocks(html)
    labels = model.decode([(features, same) for _, features, same, _ in found])
    kept = [text for (text, *_), label in zip(found, labels) if label]
    return "\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept for each row.

    text is empty for null and empty html and for pages without an article; blocks are joined by one line feed, in page
    order, and nothing else is dropped or cut.  Null ids and urls and repeated rows are kept as they are.  Other columns
    are left out.  An empty table gives an empty result.
    """
    spark = pages.sparkSession
    model = model or fit(pages)
    common.bound_batches(spark)

    def run(batches: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([main_text(html, model) for html in batches], columns=["text", "n_blocks", "n_kept"])

    found = F.pandas_udf(run, "text string, n_blocks long, n_kept long")(F.col("html"))
    read = pages.select("page_id", "url", found.alias("found"))
    return read.select("page_id", "url", "found.text", F.length("found.text").cast("long").alias("n_chars"), "found.n_blocks", "found.n_kept")


def op13_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
