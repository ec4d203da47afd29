"""Toxicity by two class-conditional Kneser-Ney models.

Words are spelt by letter n-grams: the model of a class predicts each letter (and the end of a word) after the ORDER - 1
letters before it in the word.  An n-gram counts once for each document and distinct word that has it, less a discount:
all of a count of one, for one document says little about a class, and one plus the Kneser-Ney discount of larger
counts.  What the discounts leave goes to the shared backoff, an interpolated Kneser-Ney model of every word of every
document, whose lower orders count the different letters that an n-gram follows.  Both classes give the backoff the same
mass after the same letters (the larger of their two), so that an expression that neither class knows, or that is too
rare to tell, has the same probability in both and says nothing.

A text's score compares two log-likelihoods, each divided by the number of words: that all of its words come from the
ordinary model, and that a share SHARE of them comes from the toxic one.  One slope and one offset, fit on PARTS -
FIT_PARTS parts of the labelled sample which the models have not seen, turn the difference into a probability.

Only the sample is bounded, by MAX_ROWS labelled rows and MAX_BYTES of text of each class, in the order of a hash.
Counts of words and n-grams are distributed tables without a limit, those of the shared backoff over all documents.
The ratios that tasks need, one for each n-gram of the labelled sample, are broadcast as 12 bytes each: MAX_BYTES bounds
how many there can be.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm import common

MAX_ROWS = {1: 8_000, 0: 16_000}
MAX_BYTES = 64_000_000
#: Letters of an n-gram; what begins and what ends a word.
ORDER, START, STOP = 7, "^", "$"
SHARE = 0.01
PARTS, FIT_PARTS = 4, 3
PREDICT_AT = 0.7
#: Words or n-grams that a worker counts before it hands them on (about 150 bytes each), and word scores that it keeps.
HELD, SCORES_HELD = 100_000, 200_000
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def grams_of(word: str) -> list[str]:
    """The n-gram that ends at each letter of the word, and at its end."""
    s = START + word + STOP
    return [s[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(s))]


def held_out(doc_id="doc_id"):
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """Sorted hashes of n-grams, the log ratio of each, and the offset and slope of the score."""

    hashes: object
    ratios: object
    weights: tuple = (0.0, 1.0)


def _rolling(letters, place):
    """Hash of the n-gram that ends at each letter; place: that of the letter in its word."""
    import numpy as np

    h = np.zeros(len(letters), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ORDER - 1, -1, -1):
            at = np.flatnonzero(place >= k)
            x = (h[at] ^ (letters[at - k].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
            h[at] = x ^ (x >> np.uint64(32))
    return h


def _spelt(strings: list[str]):
    """Code points of all strings, the place of each in its string, and where each string begins."""
    import numpy as np

    size = np.array([len(s) for s in strings], dtype=np.int64)
    begin = np.cumsum(size) - size
    letters = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return letters, np.arange(len(letters)) - np.repeat(begin, size), begin


def gram_hashes(grams: list[str]):
    letters, place, begin = _spelt(grams)
    return _rolling(letters, place)[begin + [len(g) - 1 for g in grams]]


def word_ratios(words: list[str], model: Model):
    """log P(word | toxic) - log P(word | ordinary) of each word."""
    import numpy as np

    if not len(words) or not len(model.hashes):
        return np.zeros(len(words))
    letters, place, begin = _spelt([START + w + STOP for w in words])
    h = _rolling(letters, place)
    at = np.minimum(np.searchsorted(model.hashes, h), len(model.hashes) - 1)
    got = np.where((model.hashes[at] == h) & (place > 0), model.ratios[at], 0.0)
    return np.add.reduceat(got, begin)


class Scorer:
    """The difference of the two log-likelihoods a word; keeps the scores of words seen."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, texts):
        import numpy as np

        split = [words_of(t) for t in texts]
        if len(self.known) > SCORES_HELD:
            self.known.clear()
        new = list({w for words in split for w in words}.difference(self.known))
        ratio = np.clip(word_ratios(new, self.model), -30, 30)
        self.known.update(zip(new, np.log1p(SHARE * np.expm1(ratio)).tolist()))
        return np.array([sum(map(self.known.__getitem__, words)) / max(1, len(words)) for words in split])


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, part: a bounded sample of the rows that may be learned from."""
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id", F.lit(11)))
    chosen = [ids.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(n) for c, n in MAX_ROWS.items()]
    picked = common.settle(chosen[0].unionByName(chosen[1]), "sample-ids")
    # At most sum(MAX_ROWS) ids of 24 bytes, here and below.
    sizes = docs.join(F.broadcast(picked), "doc_id").groupBy("toxic", "doc_id", "h").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size"))
    upto = F.sum("size").over(Window.partitionBy("toxic").orderBy("h", "doc_id"))
    inside = sizes.withColumn("upto", upto).where(F.col("upto") <= MAX_BYTES).select("doc_id", "toxic", F.pmod("h", F.lit(PARTS)).cast("int").alias("part"))
    inside = common.settle(inside, "sample")
    return docs.select("doc_id", "text").join(F.broadcast(inside), "doc_id").select("text", "toxic", "part")


def tally(batches, most: int, keys) -> Iterator[pd.DataFrame]:
    """Frames (toxic, key, n) of what keys(batch) gives as (toxic, strings, n), added up until `most` strings are held."""
    from collections import Counter

    held: dict[int, Counter] = {}

    def frames():
        while held:
            toxic, found = held.popitem()
            yield pd.DataFrame({"toxic": toxic, "key": list(found), "n": list(found.values())})

    for batch in batches:
        for toxic, strings, n in keys(batch):
            counts = held.setdefault(toxic, Counter())
            if n == 1:
                counts.update(strings)
            else:
                for x in strings:
                    counts[x] += n
            if sum(map(len, held.values())) > most:
                del counts
                yield from frames()
    yield from frames()


def count_words(rows: DataFrame) -> DataFrame:
    """(toxic, w, n): in how many rows (toxic, text) of each class each word is."""
    most = HELD

    def words(batch):
        return ((toxic, set(words_of(text)), 1) for toxic, text in zip(batch["toxic"].tolist(), batch["text"]))

    found = rows.select("toxic", "text").mapInPandas(common.roomy(lambda batches: tally(batches, most, words)), "toxic int, key string, n long")
    return found.groupBy("toxic", F.col("key").alias("w")).agg(F.sum("n").alias("n"))


def count_grams(words: DataFrame) -> DataFrame:
    """(toxic, gram, n) of the words (toxic, w, n)."""
    most = HELD

    def grams(batch):
        return ((toxic, grams_of(w), n) for toxic, w, n in zip(batch["toxic"].tolist(), batch["w"], batch["n"].tolist()))

    found = words.select("toxic", "w", "n").mapInPandas(common.roomy(lambda batches: tally(batches, most, grams)), "toxic int, key string, n long")
    return found.groupBy("toxic", F.col("key").alias("gram")).agg(F.sum("n").alias("n"))


def kneser_ney(n1: int, n2: int) -> float:
    return n1 / (n1 + 2 * n2) if n1 else 0.5


def _before(column="gram"):
    """An n-gram less its last letter."""
    return F.expr(f"substring({column}, 1, length({column}) - 1)")


def _tails(column="gram"):
    """An n-gram and what is left of it as its first letters go, one by one."""
    return F.transform(F.sequence(F.lit(1), F.length(column)), lambda j: F.substring(column, j, F.lit(ORDER)))


def shared_probability(grams: DataFrame, names: DataFrame) -> DataFrame:
    """(gram, shared): the backoff's probability of the last letter of each gram in `names` after the letters before it.

    grams: settled (gram, n), the corpus's counts of the highest order.  Strings below it, unless they begin a word,
    count the strings that they end.
    """
    strings = grams.select(F.explode(_tails()).alias("gram")).distinct()
    follows = strings.where(F.length("gram") > 1).select(F.substring("gram", F.lit(2), F.lit(ORDER)).alias("gram"), F.lit(1).cast("long").alias("n"))
    counts = common.settle(grams.select("gram", "n").unionByName(follows).groupBy("gram").agg(F.sum("n").alias("n")), "gram-counts")
    ones = counts.groupBy(F.length("gram").alias("l")).agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2)], F.count(F.lit(1)).alias("all"))
    levels = {r["l"]: r for r in ones.collect()}  # at most ORDER rows
    if not levels:
        return names.select("gram", F.lit(1.0).alias("shared")).limit(0)
    contexts = counts.groupBy(_before().alias("before")).agg(F.sum("n").alias("o"), F.count(F.lit(1)).alias("t"))
    needed = names.select(F.explode(_tails()).alias("gram")).distinct()
    d = F.element_at(F.create_map(*[F.lit(x) for size, r in levels.items() for x in (size, kneser_ney(r["n1"], r["n2"]))]), F.length("gram"))
    rows = counts.join(needed, "gram").withColumn("before", _before()).join(contexts, "before")
    # P(last | before) = a + b * P(last | before less its first letter)
    steps = common.settle(rows.select("gram", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("o")).alias("a"), (d * F.col("t") / F.col("o")).alias("b")), "steps")
    level = steps.where(F.length("gram") == 1).select("gram", (F.col("a") + F.col("b") / levels[1]["all"]).alias("shared"))
    found = level = common.settle(level, "level-1")
    for size in range(2, ORDER + 1):
        longer = steps.where(F.length("gram") == size).withColumn("tail", F.substring("gram", 2, ORDER))
        level = longer.join(level.withColumnRenamed("gram", "tail"), "tail").select("gram", (F.col("a") + F.col("b") * F.col("shared")).alias("shared"))
        level = common.settle(level, f"level-{size}")
        found = found.unionByName(level)
    return found


def log_ratios(classes: DataFrame, shared: DataFrame) -> DataFrame:
    """(gram, r): log P(last letter | before) in the toxic class less that in the ordinary one.

    classes: settled (toxic, gram, n).
    """
    both = classes.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == c, F.col("n"))), F.lit(0)).alias(f"c{c}") for c in (0, 1)])
    ones = {r["toxic"]: r for r in classes.groupBy("toxic").agg(*[F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2)]).collect()}  # a row a class
    own = [F.greatest(F.col(f"c{c}") - (1 + kneser_ney(ones[c]["n1"], ones[c]["n2"])), F.lit(0.0)) for c in (0, 1)]
    both = common.settle(both.withColumn("before", _before()).withColumns({f"s{c}": own[c] for c in (0, 1)}), "class-grams")
    contexts = both.groupBy("before").agg(*[F.sum(x).alias(x.replace("c", "o").replace("s", "m")) for x in ("c0", "c1", "s0", "s1")])
    mass = F.least(F.col("m0") / F.col("o0"), F.col("m1") / F.col("o1"))
    rows = both.join(contexts.where("m0 > 0 and m1 > 0"), "before").withColumn("mass", mass).join(shared, "gram")
    p = [F.col("mass") * F.col(f"s{c}") / F.col(f"m{c}") + (1 - F.col("mass")) * F.col("shared") for c in (0, 1)]
    return rows.select("gram", F.log(p[1] / p[0]).alias("r")).where("r <> 0")


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """None if a class has no words to learn from."""
    import numpy as np

    rows = sample(docs, labels)
    classes = common.settle(count_grams(count_words(rows.where(F.col("part") < FIT_PARTS))), "class-counts")
    if classes.select("toxic").distinct().count() < 2:
        return None
    everything = common.settle(count_words(docs.select(F.lit(0).alias("toxic"), "text")), "corpus-words")
    grams = common.settle(count_grams(everything).select("gram", "n"), "corpus-grams")
    ratios = log_ratios(classes, shared_probability(grams, classes.select("gram")))

    def hashed(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"h": gram_hashes(batch["gram"].tolist()).view(np.int64), "r": batch["r"].to_numpy(dtype=np.float32)})

    table = common.settle(ratios.mapInPandas(hashed, "h long, r float"), "ratios").toArrow()  # bounded as the sample is
    h = table.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    model = Model(h[order], table.column("r").to_numpy()[order])
    seen = common.settle(rows.where(F.col("part") >= FIT_PARTS).select(_difference(rows.sparkSession, model).alias("x"), "toxic"), "features")
    model.weights = _logistic([(r["x"], r["toxic"]) for r in seen.collect()])  # two numbers for each row of the sample
    return model


def _difference(spark, model: Model):
    """Column: the difference of the log-likelihoods a word of the column `text`."""
    shared = spark.sparkContext.broadcast((model.hashes, model.ratios))  # bounded by MAX_BYTES

    @F.pandas_udf("double")
    def difference(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        common.make_room()
        scorer = Scorer(Model(*shared.value))
        for texts in batches:
            yield pd.Series(scorer(texts))
        del scorer
        common.make_room()

    return difference(F.col("text"))


def _logistic(rows: list, penalty: float = 1e-2, rounds: int = 60) -> tuple[float, float]:
    """Offset and slope by Newton's method with a ridge on the standardised value; a fixed rule where a class is missing."""
    import numpy as np

    x, y = (np.array(v, dtype=float) for v in zip(*rows)) if rows else (np.zeros(0), np.zeros(0))
    if not len(y) or y.min() == y.max():
        return -4.0, 200.0
    mean, spread = x.mean(), x.std() + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z.T * s) @ z + penalty * np.eye(2), z.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] - w[1] * mean / spread), float(w[1] / spread)


def score(spark, model: Model | None):
    """Column: the score (0 to 1) of the column `text`; without a model 0."""
    if model is None:
        return F.lit(0.0)
    offset, slope = model.weights
    return 1 / (1 + F.exp(-(F.lit(offset) + F.lit(slope) * _difference(spark, model))))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from PREDICT_AT).

    Null and empty texts, and texts without words, get the score that no evidence gives.  Labels other than 0 and 1,
    and those of rows without an id, are not learned from; a row with two labels counts as toxic.  Rows that repeat an
    id are scored each by their text.  Without words of both classes every score is 0.  An empty table gives an empty
    result; columns other than doc_id and text are ignored.
    """
    model = fit(docs, labels)
    out = docs.select("doc_id", score(docs.sparkSession, model).alias("score"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
