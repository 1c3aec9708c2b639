"""Exact copies by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import SPACE_CLASS, named, numbered, table, written

PREFIX_CHARS = 64


def _sized(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """``id, chars, norm, len, prefix``: the text's code points, the text without white space, its length and prefix hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", F.char_length("text").alias("chars"), F.regexp_replace("text", SPACE_CLASS + "+", "").alias("norm"))
    return rows.select("id", "chars", "norm", F.char_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"))


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that several rows have, counted with map-side combine and stored, so that Spark knows their size."""
    return written(rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per row of ``docs``: ``id, keep_id, group_size, kept, digest``.

    Texts are equal when identical without ``[\\x20\\x09-\\x0D]``; null counts as empty, so null, empty and
    blank texts are one group.  Of equal texts the row with the most code points stays, then the smallest id,
    missing ids last.  Rows that share their length with another row are looked at by prefix hash; of those, rows
    that share that too are grouped by SHA-256 of the whole text, and only those are read a second time.
    ``digest_all`` is for callers that want the digest of every row: it is then taken in the first reading, there
    is no second one, and groups are still sought among the same survivors only.  Without it, ``digest`` is null
    where no full hash was needed.  Repeated rows of one id and text are equal texts: they count in
    ``group_size`` and get the same decision.  An empty table gives an empty result.  Ids keep their type;
    columns of ``docs`` other than the two named are not read, whatever their names.

    Every grouping is a count with map-side combine.  Rows meet the stored counts in a join that Spark makes a
    broadcast where they are small, so no row moves, and whose hot keys the adaptive skew join splits where not;
    a group that holds a third of the rows is not gathered in one task.
    """
    sized = _sized(docs, id_col, text_col, prefix_chars)
    facts = ["id", "chars", "len", "prefix"]
    digest = F.sha2("norm", 256).alias("digest")
    rows = written(sized.select(*facts, digest) if digest_all else sized.select(*facts))
    lengths = _shared(rows, ["len"])
    prefixes = _shared(rows.join(lengths, "len", "left_semi"), ["len", "prefix"])
    if digest_all:
        survivors = rows.join(prefixes, ["len", "prefix"], "left_semi")
    else:  # the second reading: full content of survivors, found by the keys that the scan computes again
        survivors = written(sized.join(prefixes, ["len", "prefix"], "left_semi").select(*facts, digest))
    keys = ["len", "prefix", "digest"]
    order = F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("nameless"), F.col("id"))
    groups = written(survivors.groupBy(*keys).agg(F.count("*").alias("group_size"), F.min(order).alias("best")).where("group_size > 1"))
    one = F.lit(1).cast("long")
    judged = (rows if digest_all else survivors).join(groups, keys, "left")
    found = judged.select("id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("group_size", one).alias("group_size"), "digest")
    if not digest_all:
        alone = rows.join(prefixes, ["len", "prefix"], "left_anti")
        found = found.unionByName(alone.select("id", F.col("id").alias("keep_id"), one.alias("group_size"), F.lit(None).cast("string").alias("digest")))
    return found.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stored: bool = False) -> DataFrame:
    """``docs`` with one row of each text, all columns; which one as in ``exact_groups``.

    Of rows equal in that too, one is taken by its place in the stored table (``stored`` as in ``numbered``), so a repeated or missing id neither
    saves a copy nor takes rows of other texts along.  The list of rows that go is stored first: where it is small
    it is sent to the texts, which then do not move.
    """
    rows, row = numbered(docs, stored)
    found = exact_groups(rows.select(named(id_col, row).alias("name"), F.col(text_col).alias("text")), "name", "text")
    gone = written(found.where(~F.col("kept")).select(F.col("id.row").alias(row)))
    return rows.join(gone, row, "left_anti").select(*[rows[c] for c in docs.columns])


def op8_exact_dedup(spark, sf_dir):
    found = exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}

ORACLES = {
    "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, length(t) AS chars, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS h FROM d),
r AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY h) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM r"""
}
