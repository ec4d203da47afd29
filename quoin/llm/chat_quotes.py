"""Chat formatting by quotation linking, in DataFrame operations only.

A line that starts with one or more `>` (spaces and tabs may stand between) is quoted; the number of `>` is its
level.  A passage is a line's content with runs of white space made one space and the ends stripped; its SHA-256
links it.  A quoted passage comes from the first message of its conversation, before the quoting one, whose own
lines (level 0) hold that passage.  A message replies to the source of most of its shallowest linked level (ties:
the later turn), otherwise to the turn whose number is one less, if there is one.

Messages and the messages they reply to are trees.  A conversation is told in the order of its replies: every message
is followed by its first reply with all that follows from it, then by the next reply; replies to one message, and
messages that reply to none, go by turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm import common

QUOTE = r"^[ \t]*(?:>[ \t]*)+"
#: Places in a block when positions are counted.
BLOCK = 4096


def _lines(messages: DataFrame) -> DataFrame:
    """One row per line: conv_id, turn, level, passage digest (null for blank lines)."""
    prefix = F.regexp_extract("line", QUOTE, 0)
    passage = F.btrim(F.regexp_replace(F.regexp_replace("line", QUOTE, ""), common.WHITE_RUN, " "), F.lit(" "))
    return (
        messages.select("conv_id", "turn", F.explode(F.split(common.text_or_empty(), "\n")).alias("line"))
        .select("conv_id", "turn", (F.length(prefix) - F.length(F.replace(prefix, F.lit(">")))).alias("level"), passage.alias("p"))
        .where("p <> ''")
        .select("conv_id", "turn", "level", F.unhex(F.sha2("p", 256)).alias("passage"))
    )


def reply_order(replies: DataFrame) -> DataFrame:
    """(conv_id, turn, place, depth) of messages (conv_id, turn, reply_to), one row a turn, that reply to earlier turns.

    place counts from 0 through the conversation in the order of its replies; depth is 0 for a message that replies to
    none.  A walk around the trees enters and leaves every message once.  Each step of it knows the next one, and in
    every round learns the sums up to twice as far ahead, so a conversation takes part in as many rounds as its walk has
    binary digits, and no task ever holds a conversation.  A reply_to without a message counts as none.
    """
    replies = common.settle(replies, "replies")
    turns = replies.select("conv_id", "turn")
    parents = turns.select("conv_id", F.col("turn").alias("reply_to"), F.lit(True).alias("there"))
    known = common.lookup(replies, parents, ["conv_id", "reply_to"], ["turn"]).select(
        "conv_id", "turn", F.col("there").isNull().alias("top"), F.when(F.col("there"), F.col("reply_to")).otherwise(0).alias("parent")
    )
    siblings = common.settle(common.ranked(common.settle(known, "known"), ["conv_id", "top", "parent"], F.floor(F.col("turn") / BLOCK), ["turn"], "nth"), "siblings")
    child = siblings.where("nth = 0 and not top").select("conv_id", F.col("parent").alias("turn"), F.col("turn").alias("first_reply"))
    later = siblings.select("conv_id", "top", "parent", (F.col("nth") - 1).alias("nth"), F.col("turn").alias("sibling"))
    sizes = common.settle(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages")), "sizes")
    around = common.lookup(siblings, sizes, ["conv_id"], ["turn"]).join(child, ["conv_id", "turn"], "left").join(later, ["conv_id", "top", "parent", "nth"], "left")

    def step(turn, enters):
        return F.struct(turn.alias("turn"), F.lit(enters).alias("enters"))

    entering = F.struct(
        step(F.col("turn"), True).alias("step"),
        F.when(F.col("first_reply").isNotNull(), step(F.col("first_reply"), True)).otherwise(step(F.col("turn"), False)).alias("next"),
        F.lit(1).cast("long").alias("ahead"),
        F.lit(1).cast("long").alias("level"),
    )
    leaving = F.struct(
        step(F.col("turn"), False).alias("step"),
        F.when(F.col("sibling").isNotNull(), step(F.col("sibling"), True)).when(~F.col("top"), step(F.col("parent"), False)).alias("next"),
        F.lit(0).cast("long").alias("ahead"),
        F.lit(-1).cast("long").alias("level"),
    )
    walk = common.settle(around.select("conv_id", "messages", F.explode(F.array(entering, leaving)).alias("s")).select("conv_id", "messages", "s.*"), "walk")
    known, longest = 1, 2 * (sizes.agg(F.max("messages")).first()[0] or 0)
    walked = []
    while known < longest:
        # A walk of two steps a message is known to its end once that many are; only the longer ones go on.
        walked.append(walk.where(F.col("messages") * 2 <= known))
        walk = walk.where(F.col("messages") * 2 > known)
        # Sums are those of the steps from here up to the next known one, without it.
        onward = walk.select("conv_id", F.col("step").alias("next"), F.col("next").alias("next2"), F.col("ahead").alias("ahead2"), F.col("level").alias("level2"))
        walk = common.settle(
            walk.join(onward, ["conv_id", "next"], "left").select(
                "conv_id", "messages", "step", F.col("next2").alias("next"),
                (F.col("ahead") + F.coalesce("ahead2", F.lit(0))).alias("ahead"), (F.col("level") + F.coalesce("level2", F.lit(0))).alias("level"),
            ),
            "walk",
        )
        known *= 2
    for part in walked:
        walk = walk.unionByName(part)
    return walk.where("step.enters").select("conv_id", "step.turn", (F.col("messages") - F.col("ahead")).alias("place"), (-F.col("level")).alias("depth"))


def link_quotes(messages: DataFrame) -> DataFrame:
    """Messages without their quotes, in reply order.

    Takes conv_id, turn, role, text; one row out per row in: conv_id, turn, role, position (gapless from 0 in the
    conversation, in reply order), depth (replies above the message), reply_to (a turn or null), linked (whether a quote, not the
    order, decided it), n_quoted, n_linked, quote_level (deepest), text (own lines).  Null text is empty; a message
    of quotes alone keeps an empty text.  Rows that repeat (conv_id, turn) share reply_to and counts and
    stand together; rows with a null conv_id or turn get no links, depth 0, and go by turn, null turns first.  Other columns are ignored; an empty table gives an empty result.
    """
    base = messages.select("conv_id", "turn", "role", "text")
    lines = common.settle(_lines(base), "lines")
    own = lines.where("level = 0").groupBy("conv_id", "passage").agg(F.min("turn").alias("source"))
    quoted = common.settle(
        lines.where("level > 0").groupBy("conv_id", "turn", "passage").agg(F.min("level").alias("level"), F.count(F.lit(1)).alias("n")),
        "quoted",
    )
    found = common.lookup(quoted, own, ["conv_id", "passage"], ["turn"]).withColumn(
        "source", F.when(F.col("source") < F.col("turn"), F.col("source"))
    )
    votes = found.groupBy("conv_id", "turn", "source").agg(F.sum("n").alias("n"), F.min("level").alias("level"))
    replies = (
        votes.groupBy("conv_id", "turn")
        .agg(
            F.sum("n").alias("n_quoted"),
            F.coalesce(F.sum(F.when(F.col("source").isNotNull(), F.col("n"))), F.lit(0)).alias("n_linked"),
            F.max_by(
                "source",
                F.when(
                    F.col("source").isNotNull(),
                    F.struct((-F.col("level")).alias("a"), F.col("n").alias("b"), F.col("source").alias("c")),
                ),
            ).alias("quoted_turn"),
        )
    )
    deepest = quoted_levels(lines)
    before = base.where("conv_id is not null and turn is not null").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("turn_before")).distinct()
    clean = F.array_join(F.filter(F.split(common.text_or_empty(), "\n"), lambda x: ~x.rlike(QUOTE)), "\n")
    joined = (
        base.withColumn("text", clean)
        .join(replies, ["conv_id", "turn"], "left")
        .join(deepest, ["conv_id", "turn"], "left")
        .join(before, ["conv_id", "turn"], "left")
    )
    out = joined.select(
        "conv_id",
        "turn",
        "role",
        F.coalesce("quoted_turn", "turn_before").alias("reply_to"),
        F.col("quoted_turn").isNotNull().alias("linked"),
        F.coalesce("n_quoted", F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce("quote_level", F.lit(0)).cast("int").alias("quote_level"),
        "text",
    )
    out = common.settle(out, "messages")
    placed = reply_order(out.where("conv_id is not null and turn is not null").select("conv_id", "turn", "reply_to").distinct())
    told = common.settle(out.join(placed, ["conv_id", "turn"], "left"), "told")
    order = [F.col("place").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "text", "n_quoted"]
    block = F.coalesce(F.floor(F.col("place") / BLOCK), F.floor(F.col("turn") / BLOCK), F.lit(-(2**40)))
    numbered = common.ranked(told, ["conv_id"], block, order, "position").drop("place")
    return numbered.withColumn("depth", F.coalesce("depth", F.lit(0)).cast("long"))


def quoted_levels(lines: DataFrame) -> DataFrame:
    return lines.where("level > 0").groupBy("conv_id", "turn").agg(F.max("level").alias("quote_level"))


def op2_chat_quotes(spark, sf_dir: str) -> DataFrame:
    return link_quotes(common.table(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations
), parsed AS (
  SELECT conv_id, turn, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS p
  FROM lines
), own AS (
  SELECT conv_id, p, min(turn) AS source FROM parsed WHERE level = 0 AND p <> '' GROUP BY ALL
), quoted AS (
  SELECT conv_id, turn, p, min(level) AS level, count(*) AS n FROM parsed WHERE level > 0 AND p <> '' GROUP BY ALL
), found AS (
  SELECT q.*, CASE WHEN o.source < q.turn THEN o.source END AS source FROM quoted q LEFT JOIN own o USING (conv_id, p)
), votes AS (
  SELECT conv_id, turn, source, sum(n) AS n, min(level) AS level FROM found GROUP BY ALL
), best AS (
  SELECT conv_id, turn, source FROM votes WHERE source IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, source DESC) = 1
), sums AS (
  SELECT conv_id, turn, sum(n) AS n_quoted, sum(CASE WHEN source IS NOT NULL THEN n ELSE 0 END) AS n_linked
  FROM votes GROUP BY ALL
), deep AS (
  SELECT conv_id, turn, max(level) AS quote_level FROM parsed WHERE level > 0 AND p <> '' GROUP BY ALL
), before AS (SELECT DISTINCT conv_id, turn + 1 AS turn, turn AS turn_before FROM conversations), j AS (
  SELECT c.conv_id, c.turn, c.role, coalesce(b.source, x.turn_before) AS reply_to, b.source IS NOT NULL AS linked,
         CAST(coalesce(s.n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(s.n_linked, 0) AS BIGINT) AS n_linked,
         CAST(coalesce(d.quote_level, 0) AS INTEGER) AS quote_level,
         array_to_string(list_filter(string_split(coalesce(c.text, ''), chr(10)),
           lambda l: NOT regexp_matches(l, '^[ \t]*(?:>[ \t]*)+')), chr(10)) AS text
  FROM conversations c LEFT JOIN best b USING (conv_id, turn) LEFT JOIN sums s USING (conv_id, turn)
  LEFT JOIN deep d USING (conv_id, turn) LEFT JOIN before x USING (conv_id, turn)
), nodes AS (SELECT DISTINCT conv_id, turn, reply_to FROM j WHERE conv_id IS NOT NULL AND turn IS NOT NULL), tree AS (
  SELECT conv_id, turn, [turn] AS path FROM nodes WHERE reply_to IS NULL
  UNION ALL SELECT n.conv_id, n.turn, list_append(t.path, n.turn) FROM tree t JOIN nodes n ON n.conv_id = t.conv_id AND n.reply_to = t.turn
)
SELECT j.*, coalesce(len(path) - 1, 0) AS depth,
  row_number() OVER (PARTITION BY conv_id ORDER BY path NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text, n_quoted) - 1 AS position
FROM j LEFT JOIN tree USING (conv_id, turn)
"""
