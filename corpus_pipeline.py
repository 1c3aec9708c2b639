"""A corpus pipeline: from raw documents to a mixed, deduplicated and encoded corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.exact_dedup import drop_copies
from tallyforge.llm.mixing import apply_mix
from tallyforge.llm.ngram_join import keep_one
from tallyforge.llm.pieces import encode
from tallyforge.llm.quality import keep_good
from tallyforge.llm.shared import ready, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on all of them, does not reject.

    Null, empty and wordless texts have no features: the scorer's bias decides on them, which keeps them unless most texts
    are junk. Texts are read whole, however long; repeated rows are judged alike. Columns stay as they are. An empty table stays empty.
    """
    ready(spark)
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: the longest as it stands, then the smallest id.

    Null texts are equal to empty ones, and one of them stays. Of rows that repeat an id and a text one stays. Rows without
    an id take part and lose ties. Columns stay as they are. An empty table stays empty.
    """
    return drop_copies(docs, stored=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similar shingle sets form: the smallest id's, missing ids last.

    Texts without words are no group and stay. Rows that repeat an id take part each; of repeated texts one stays. Texts
    are read whole. Columns stay as they are. An empty table stays empty.
    """
    ready(spark)
    return keep_one(docs, stored=True)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them: their taken words over their size, rounded.

    A null source is a source, the last in order; documents without words are not taken; rows that repeat an id take part
    each. Columns stay as they are. An empty table stays empty.
    """
    return apply_mix(docs, stored=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation of each document, what the next best change in it, and the scores of all.

    A null text is encoded as an empty one: no pieces. Rows that repeat an id are encoded each, long texts stretch by
    stretch. An empty table gives an empty result.
    """
    import public_tokenizers

    ready(spark)
    found = encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select(F.col("id").alias("doc_id"), "n_pieces", "scores", "ids", "edits", "exact")


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: SQL can't express the fitted classifier, the schedule or the lattice search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's documents are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
