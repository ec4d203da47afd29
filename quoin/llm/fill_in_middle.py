"""Fill-in-middle transformation by displacement scatter.

A batch's texts lie one after another in one byte buffer.  A scan for the ends of tokens gives two cuts a text; each
of the three pieces between them moves by one displacement, so the list of displacements is a difference array over
the batch's bytes: its running sum says for every byte how far it moves.  Adding that to the byte's place and
scattering builds all outputs at once; restoring finds the marks in the outputs, derives the displacements from
their places, and gathers.  The running sum is taken a window at a time, so a text of any length needs memory for
itself, its output and one window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm import common

#: Marks before the prefix, the suffix and the middle; all of one length.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
#: Bytes of text that are moved as one buffer (a longer text is a buffer of its own), and that one window displaces.
BUFFER, WINDOW = 1 << 22, 1 << 20
WHITE = np.zeros(256, dtype=bool)
WHITE[list(common.WHITE.encode())] = True


def buffers(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of rows of up to BUFFER bytes: (rows, bytes, offsets from 0) of their last column, a string without nulls."""
    column = batch.column(batch.num_columns - 1)
    if not len(column):
        return
    _, places, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(places, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BUFFER, side="right")) - 1)
        yield slice(first, last), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def displacements(places: np.ndarray, moves: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """For each window (from, to): the displacement of its bytes, when bytes from places[i] on move by moves[i].

    places rise; of equal places the last one counts, since the differences before it cancel out.
    """
    steps = np.diff(moves, prepend=0)
    carried = 0
    for low in range(0, size, WINDOW):
        high = min(low + WINDOW, size)
        i, j = np.searchsorted(places, [low, high])
        difference = np.zeros(high - low, dtype=np.int64)
        np.add.at(difference, places[i:j] - low, steps[i:j])
        difference[0] += carried
        moved = np.cumsum(difference)
        carried = moved[-1]
        yield low, high, moved


def token_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends of all tokens, each text's first one's index there, and its number of tokens.

    A token is white space and the word behind it, or white space at a text's end.
    """
    white = WHITE[data]
    stop = ~white
    stop[:-1] &= white[1:]
    stop[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    ends = np.flatnonzero(stop) + 1
    bounds = np.searchsorted(ends, offsets, side="right")
    return ends, bounds[:-1], np.diff(bounds)


def marks(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each mark: its places and the rows that they lie in; a mark does not reach over two texts."""
    found = []
    tag = (data[:-2] == PREFIX[0]) & (data[2:] == PREFIX[2]) if len(data) > 2 else np.zeros(0, dtype=bool)
    at = np.flatnonzero(tag)
    rows = np.searchsorted(offsets, at, side="right") - 1
    inside = at + MARK <= offsets[rows + 1]
    for mark in (PREFIX, SUFFIX, MIDDLE):
        mine = inside & (data[at + 1] == mark[1])
        found.append((at[mine], rows[mine]))
    return found


def scatter(data: np.ndarray, offsets: np.ndarray, cut1: np.ndarray, cut2: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outputs (bytes, offsets) of texts cut at cut1 <= cut2; form is 0 plain, 1 prefix first, 2 suffix first."""
    begin, end = offsets[:-1], offsets[1:]
    out_offsets = np.concatenate([[0], np.cumsum(end - begin + np.where(form > 0, 3 * MARK, 0))])
    base, head, tail = out_offsets[:-1], cut1 - begin, end - cut2
    prefix_at = np.select([form == 1, form == 2], [base + MARK, base + 2 * MARK + tail], base)
    suffix_at = np.select([form == 1, form == 2], [base + 2 * MARK + head, base + MARK], base + cut2 - begin)
    middle_at = np.where(form > 0, base + 3 * MARK + head + tail, base + head)
    places = np.stack([begin, cut1, cut2], axis=1).ravel()
    moves = np.stack([prefix_at - begin, middle_at - cut1, suffix_at - cut2], axis=1).ravel()
    out = np.empty(out_offsets[-1], dtype=np.uint8)
    for low, high, moved in displacements(places, moves, len(data)):
        out[np.arange(low, high) + moved] = data[low:high]
    moved = form > 0
    for mark, at in ((PREFIX, prefix_at), (SUFFIX, suffix_at), (MIDDLE, middle_at)):
        for i, byte in enumerate(mark):
            out[at[moved] - MARK + i] = byte
    return out, out_offsets


def gather(data: np.ndarray, offsets: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts (bytes, offsets) of outputs, and which rows have the marks that their form asks for; others are empty."""
    rows = len(offsets) - 1
    begin, end = offsets[:-1], offsets[1:]
    places, counts = [], []
    for at, row in marks(data, offsets):
        counts.append(np.bincount(row, minlength=rows))
        place = begin.copy()
        place[row] = at
        places.append(place)
    p, s, m = places
    once = (counts[0] == 1) & (counts[1] == 1) & (counts[2] == 1)
    in_order = np.where(form == 1, (p == begin) & (p < s) & (s < m), (s == begin) & (s < p) & (p < m))
    plain, good = form == 0, (form == 0) | (once & in_order)
    # The pieces' places and lengths in the output.
    head_at, tail_at, mid_at = np.where(plain, begin, p + MARK), s + MARK, m + MARK
    head = np.where(plain, end - begin, np.where(form == 1, s, m) - head_at)
    tail = np.where(plain, 0, np.where(form == 1, m, p) - tail_at)
    mid = np.where(plain, 0, end - mid_at)
    head, tail, mid = (np.where(good, x, 0) for x in (head, tail, mid))
    text_offsets = np.concatenate([[0], np.cumsum(head + mid + tail)])
    base = text_offsets[:-1]
    places = np.stack([base, base + head, base + head + mid], axis=1).ravel()
    sources = np.stack([head_at, mid_at, tail_at], axis=1).ravel()
    text = np.empty(text_offsets[-1], dtype=np.uint8)
    for low, high, moved in displacements(places, sources - places, len(text)):
        text[low:high] = data[np.arange(low, high) + moved]
    return text, text_offsets, good


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def chars(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Code points between the places begin and end."""
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    return before[end] - before[begin]


FORMS = np.array(["plain", "psm", "spm"])


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """One row a row of docs: doc_id, n (tokens), form, prefix_chars, middle_chars, output.

    Cuts and form come from the SHA-256 of seed and doc_id alone, so a lost task builds the same rows again: of a
    hundred texts `rate` are transformed, and of those `suffix_first` begin with the suffix.  Null texts count as
    empty; empty texts and texts that hold a mark stay plain.  A null id is hashed as no digits; repeated rows give
    equal outputs.  Other columns are left out, whatever their names.  An empty table gives an empty result.
    """
    common.bound_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    ready = docs.select("doc_id", *hashes, common.text_or_empty().alias("text"))

    def run(batches):
        for batch in batches:
            hashed = [batch.column(k).to_numpy() for k in range(1, 5)]
            for rows, data, offsets in buffers(batch):
                h1, h2, h3, h4 = (h[rows] for h in hashed)
                ends, first, n = token_ends(data, offsets)
                cuts = []
                for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
                    cut = offsets[:-1].copy()
                    cut[k > 0] = ends[(first + k - 1)[k > 0]]
                    cuts.append(cut)
                plain = (n == 0) | (h3 % 100 >= rate)
                for _, held in marks(data, offsets):
                    plain[held] = True
                form = np.where(plain, 0, np.where(h4 % 100 < suffix_first, 2, 1))
                out, out_offsets = scatter(data, offsets, *cuts, form)
                counts = [pa.array(chars(data, a, b), mask=plain) for a, b in ((offsets[:-1], cuts[0]), cuts)]
                ids = batch.column(0).slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(FORMS[form]), *counts, strings(out, out_offsets)], names=NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ready.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


NAMES = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def restore(outputs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and `text`, rebuilt from the columns form and output of each row alone.

    text is null where output or form is null or unknown, or the marks that the form asks for are not there once and
    in order.  An empty table gives an empty result.
    """
    common.bound_batches(outputs.sparkSession)
    (form_name,) = common.free_names(keep, "_form")
    number = F.coalesce(*[F.when(F.col("form") == name, k) for k, name in enumerate(FORMS.tolist())], F.lit(3))
    ready = outputs.select(*keep, F.when(F.col("output").isNull(), 3).otherwise(number).cast("int").alias(form_name), F.coalesce("output", F.lit("")).alias("output"))

    def run(batches):
        for batch in batches:
            forms = batch.column(len(keep)).to_numpy()
            for rows, data, offsets in buffers(batch):
                form = forms[rows]
                text, text_offsets, good = gather(data, offsets, form)
                found = strings(text, text_offsets)
                if not good.all() or (form == 3).any():
                    found = pa.array([x if ok else None for x, ok in zip(found.to_pylist(), good & (form < 3))], pa.string())
                kept = [batch.column(k).slice(rows.start, rows.stop - rows.start) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, found], names=[*keep, "text"])

    fields = [outputs.schema[c] for c in keep]
    return ready.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["text string"]))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(common.table(spark, sf_dir, "documents"))
    hashed = made.withColumn("output_sha256", F.sha2("output", 256))
    back = restore(hashed, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"])
    return back.withColumn("restored_sha256", F.sha2("text", 256)).drop("text")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens
  FROM documents
), c AS (
  SELECT doc_id, text, tokens, CAST(len(tokens) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(tokens) + 1) AS a,
         CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(tokens) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(tokens[1:least(a, b)], '') AS prefix,
         array_to_string(tokens[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(tokens[greatest(a, b) + 1:n], '') AS suffix
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
