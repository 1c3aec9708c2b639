"""Token counts: pieces counted once per distinct pre-token and joined to per-document frequencies."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.llm.pretokens import batch_pretokens, text_of
from tallyforge.llm.shared import table, with_id, written
from tallyforge.llm.shingles import slices

#: Pre-tokens whose counts are sent to every task: 2**17 of 12 bytes at most. All others are joined by a shuffle.
MOST_FREQUENT = 1 << 17
CHUNK_BYTES = 4 << 20
OVER = 512


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def _specials(path: str) -> tuple[str, ...]:
    return tuple(t.content for t in _tokenizer(path).get_added_tokens_decoder().values())


def _parts(texts: list[str | None], specials: tuple[str, ...]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts cut at special strings: the parts, the text of each, and how many special strings each text has."""
    found = np.zeros(len(texts), dtype=np.int64)
    if not any(s in t for t in texts if t for s in specials):
        return [t or "" for t in texts], np.arange(len(texts)), found
    parts, of = [], []
    for i, text in enumerate(texts):
        cut = [text or ""]
        for s in specials:
            found[i] += sum(t.count(s) for t in cut)
            cut = [x for t in cut for x in t.split(s)]
        parts += cut
        of += [i] * len(cut)
    return parts, np.array(of, dtype=np.int64), found


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def pretoken_counts(docs: DataFrame, text_col: str, path: str) -> DataFrame:
    """``number, piece, freq``: the distinct pre-tokens of all texts, summed map-side first."""

    def count(batches):
        specials = _specials(path)
        for batch in batches:
            for a, b in slices(batch.column(0), CHUNK_BYTES):
                parts, *_ = _parts(batch.column(0).slice(a, b - a).to_pylist(), specials)
                numbers, _, starts, ends, codes = batch_pretokens(parts)
                if not len(numbers):
                    continue
                which, kinds = pd.factorize(numbers)
                first = np.zeros(len(kinds), dtype=np.int64)
                first[which[::-1]] = np.arange(len(which))[::-1]
                pieces = [text_of(codes, s, e) for s, e in zip(starts[first].tolist(), ends[first].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(_signed(kinds)), pa.array(pieces, pa.string()), pa.array(np.bincount(which))], ["number", "piece", "freq"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "number long, piece string, freq long")
    return found.groupBy("number", "piece").agg(F.sum("freq").alias("freq"))


def piece_counts(pretokens: DataFrame, path: str) -> DataFrame:
    """``number, n, freq``: how many tokens the library gives each distinct pre-token."""

    def encode(batches):
        tokenizer = _tokenizer(path)
        for batch in batches:
            sizes = [len(e) for a in range(0, batch.num_rows, 2048) for e in tokenizer.encode_batch(batch.column(1).slice(a, 2048).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), batch.column(2)], ["number", "n", "freq"])

    return pretokens.select("number", "piece", "freq").mapInArrow(encode, "number long, n int, freq long")


def frequent(dictionary: DataFrame, most: int) -> pd.DataFrame:
    """At most ``most`` of the most frequent entries: those above the first power of two of frequency that fits."""
    steps = dictionary.groupBy(F.floor(F.log2(F.col("freq").cast("double")) * 8).alias("step")).count().orderBy(F.col("step").desc()).collect()
    held, lowest = 0, None
    for row in steps:  # some hundred rows: eighths of powers of two
        held += row["count"]
        if held > most:
            break
        lowest = row["step"]
    if lowest is None:
        return pd.DataFrame({"number": np.zeros(0, np.int64), "n": np.zeros(0, np.int32)})
    kept = dictionary.where(F.floor(F.log2(F.col("freq").cast("double")) * 8) >= lowest)
    return kept.select("number", "n").orderBy("number").limit(most).toPandas()


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most_frequent: int = MOST_FREQUENT) -> DataFrame:
    """One row per row of ``docs``: ``id, n_bytes, n_tokens``, as the tokenizer file at ``path`` gives them.

    Null counts as empty: 0 bytes, 0 tokens.  Special strings in a text are one token each.  Repeated rows are
    counted each.  Ids keep their type; other columns are not read.  An empty table gives an empty result.

    Every distinct pre-token is encoded once.  The counts of at most ``most_frequent`` of them are sent to all
    tasks, which add up what they cover per document; the remaining (document, pre-token, frequency) rows are
    joined to the dictionary by a shuffle.  A pre-token is known by a 64-bit number.
    """
    spark = docs.sparkSession
    dictionary = written(piece_counts(pretoken_counts(docs, text_col, path), path))
    common = frequent(dictionary, most_frequent)
    sent = spark.sparkContext.broadcast((common["number"].to_numpy(np.int64), common["n"].to_numpy(np.int32)))

    def cover(batches):
        known, sizes = sent.value
        specials = _specials(path)
        base = 0
        for batch in batches:
            for a, b in slices(batch.column(1), CHUNK_BYTES):
                texts = batch.column(1).slice(a, b - a)
                parts, of, n = _parts(texts.to_pylist(), specials)
                numbers, doc, *_ = batch_pretokens(parts)
                doc = of[doc]
                which, kinds = pd.factorize(_signed(numbers))
                at = np.searchsorted(known, kinds)
                held = np.zeros(len(kinds), dtype=bool)
                inner = at < len(known)
                held[inner] = known[at[inner]] == kinds[inner]
                value = np.zeros(len(kinds), dtype=np.int64)
                value[held] = sizes[at[held]]
                n = n + np.bincount(doc, weights=value[which], minlength=b - a).astype(np.int64)
                # one row for the document itself, without a pre-token; then a row for each rare pre-token of it
                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                rare = ~held[which]
                pair, freq = np.unique(doc[rare] * np.int64(max(1, len(kinds))) + which[rare], return_counts=True)
                rows, kind = pair // max(1, len(kinds)), pair % max(1, len(kinds))
                docs_at = pa.array(np.arange(a, b) + base), pa.array(rows + a + base)
                names = ["row", "id", "n_bytes", "covered", "number", "freq"]
                yield pa.RecordBatch.from_arrays([docs_at[0], batch.column(0).slice(a, b - a), size, pa.array(n), pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.int64())], names)
                if len(rows):
                    yield pa.RecordBatch.from_arrays([docs_at[1], pa.nulls(len(rows), batch.column(0).type), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.array(kinds[kind]), pa.array(freq.astype(np.int64))], names)
            base += batch.num_rows

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    columns = with_id(docs, id_col, "row long, n_bytes long, covered long, number long, freq long")
    seen = rows.mapInArrow(cover, StructType([columns["row"], columns["id"], *columns[2:]]))
    seen = written(seen.withColumn("row", F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("row")))
    rare = seen.where("number IS NOT NULL").join(dictionary.select("number", "n"), "number")
    rest = rare.groupBy("row").agg(F.sum(F.col("freq") * F.col("n")).alias("rest"))
    whole = seen.where("number IS NULL").select("row", "id", "n_bytes", "covered").join(rest, "row", "left")
    return whole.select("id", "n_bytes", (F.col("covered") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))


def op6_token_counts(spark, sf_dir):
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > OVER).alias("over_limit"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
