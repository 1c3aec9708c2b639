"""Chat formatting by perspective rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import table, written

#: Fixed: the marks of the chat markup.
START, END = "<|im_start|>", "<|im_end|>\n"
#: What both marks begin with, and how it is written where a text or a name holds it.
MARK, BROKEN = "<|im_", "<\\|im_"
#: Turns rendered into one string; a longer dialogue gives several rows, numbered by ``part``.
PART_TURNS = 512
SYSTEM = "system"


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``: the number, from 0, of each turn in its conversation's order.

    Rows are sorted over all partitions at once, so a conversation of any length is spread over many; its places
    are counted within a partition, and the rows that it has in earlier partitions are added.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_last(), F.col("who"), F.col("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = written(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("cut", F.spark_partition_id()))
    pieces = stored.groupBy("conv", "cut").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col("conv").alias("of"), F.col("cut").alias("in_cut"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    placed = stored.join(pieces, F.col("conv").eqNullSafe(F.col("of")) & (F.col("cut") == F.col("in_cut")))
    return placed.select("conv", "turn", "who", "text", (F.col("at") + F.col("shift")).alias("place"))


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(BROKEN))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """For every participant of every conversation: ``conv, speaker, part, n_turns, rendered, spans``.

    The speaker's own turns are rendered as ``assistant``, those of the others as ``user name=<who>``, system
    turns as ``system``.  ``spans`` lists ``begin, end`` code-point ranges of ``rendered`` that the speaker
    wrote, end mark included: the loss mask is 1 there and 0 elsewhere.  Turns run by number, those without one
    last, then speaker and text; repeated turns stay.  Null texts are empty, a null speaker is the participant
    ``unknown``; conversations with only system turns have no participant and give no row; a null conversation is
    one conversation.  Marks of the markup inside texts and names are broken by a backslash, so that no text can
    end its own turn.  An empty table gives an empty result.  Ids keep their type; other columns are not read.

    Turns ``part_turns * k`` to ``part_turns * (k + 1) - 1`` of a conversation's order are part k, so that no more
    than ``part_turns`` of them are ever held together, however long a dialogue or however often one turn number
    is repeated; parts meet their participants by conversation and part, so one long dialogue is many keys.
    """
    who = F.coalesce(F.col(speaker_col), F.lit("unknown"))
    rows = _placed(turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), _plain(who).alias("who"), _plain(F.coalesce(F.col(text_col), F.lit(""))).alias("text")))
    rows = rows.withColumn("part", F.floor(F.col("place") / part_turns))
    speakers = rows.where(F.col("who") != SYSTEM).select(F.col("conv").alias("of"), F.col("who").alias("speaker")).distinct()
    parts = rows.select("conv", "part").distinct()
    views = parts.join(speakers, F.col("conv").eqNullSafe(F.col("of"))).select("of", F.col("part").alias("of_part"), "speaker")
    own = F.col("who") == F.col("speaker")
    head = F.when(own, F.lit("assistant")).when(F.col("who") == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), F.col("who")))
    lead = F.concat(F.lit(START), head, F.lit("\n"))
    seen = rows.join(views, F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    seen = seen.select("conv", "speaker", "part", F.struct("place", "text", lead.alias("lead"), own.alias("own")).alias("said"))
    parts = seen.groupBy("conv", "speaker", "part").agg(F.sort_array(F.collect_list("said")).alias("said"))
    size = lambda x: F.char_length(x["lead"]) + F.char_length(x["text"]) + len(END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(state, x):
        begin, end = state["at"] + F.char_length(x["lead"]), state["at"] + size(x)
        mine = F.when(x["own"], F.array(F.struct(begin.alias("begin"), end.alias("end")))).otherwise(F.array().cast("array<struct<begin:int,end:int>>"))
        return F.struct(end.alias("at"), F.concat(state["spans"], mine).alias("spans"))

    rendered = F.array_join(F.transform("said", lambda x: F.concat(x["lead"], x["text"], F.lit(END))), "")
    return parts.select("conv", "speaker", "part", F.size("said").alias("n_turns"), rendered.alias("rendered"), F.aggregate("said", start, step)["spans"].alias("spans"))


def op4_chat_format(spark, sf_dir):
    views = rotate(table(spark, sf_dir, "conversations"))
    masked = F.aggregate("spans", F.lit(0), lambda n, x: n + x["end"] - x["begin"])
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["begin"].cast("string"), x["end"].cast("string"))), ",")
    return views.select(F.col("conv").alias("conv_id"), "speaker", "part", "n_turns", F.char_length("rendered").alias("n_chars"), masked.alias("n_masked"), "rendered", spans.alias("spans"))


QUERIES = {"op4_chat_format": op4_chat_format}

ORACLES = {
    "op4_chat_format": r"""
WITH n AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|im_', '<\|im_') AS who, replace(coalesce(text, ''), '<|im_', '<\|im_') AS text FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, who, text) - 1 AS place, place // 512 AS part FROM n),
p AS (SELECT DISTINCT conv_id AS c, who AS speaker FROM t WHERE who <> 'system'),
r AS (SELECT conv_id, speaker, part, place, who, text, who = speaker AS own,
             '<|im_start|>' || CASE WHEN who = speaker THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user name=' || who END || chr(10) AS lead
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.c),
w AS (SELECT *, lead || text || '<|im_end|>' || chr(10) AS body, row_number() OVER (PARTITION BY conv_id, speaker, part ORDER BY place) AS k FROM r),
o AS (SELECT *, sum(length(body)) OVER (PARTITION BY conv_id, speaker, part ORDER BY k) AS stop FROM w),
g AS (SELECT conv_id, speaker, part, count(*)::INTEGER AS n_turns, string_agg(body, '' ORDER BY k) AS rendered,
             coalesce(sum(length(body) - length(lead)) FILTER (own), 0) AS n_masked,
             coalesce(string_agg((stop - length(body) + length(lead))::BIGINT::VARCHAR || '-' || stop::BIGINT::VARCHAR, ',' ORDER BY k) FILTER (own), '') AS spans
      FROM o GROUP BY 1, 2, 3)
SELECT conv_id, speaker, part, n_turns, length(rendered)::INTEGER AS n_chars, n_masked::INTEGER AS n_masked, rendered, spans FROM g"""
}
