"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import WORD_CLASS, free_name, numbered, table, written

BLOCK_WORDS = 64
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: Parts into which one source's shuffled line and the schedule are cut, so that no source is one task.
LINE_PARTS = 1024
SLOTS_A_CHUNK = 1 << 14
#: Cells of [0, 1) by which schedule points find their source.
CELLS = 4096
#: The fractional part of the golden ratio, and of 2**20 times it, so that points of late slots stay sharp.
GOLDEN = (5**0.5 - 1) / 2
GOLDEN_20 = ((math.isqrt(5 << 120) - (1 << 60)) // 2 * (1 << 20) % (1 << 60)) / (1 << 60)


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_CLASS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows.

    Sources in the order of their code points, null last, weigh ``weights`` in turn and share the sum of all
    sizes; no target is above ``most_repeats`` times its source's size, and what that leaves is shared anew by
    weight.  The fixed point of that sharing is the water level L with ``target = min(L * weight, cap)``: with
    sources ordered by cap / weight, the first whose cap lies above the level of the sources not yet full.
    The windows here run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    per = per.withColumn("pos", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("pos") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", (most_repeats * F.col("source_size")).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    all_rows = Window.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(all_rows).cast("double")).withColumn("heavy", F.sum("weight").over(all_rows))
    full, light = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), F.coalesce(F.sum("weight").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("level", (F.col("total") - full) / (F.col("heavy") - light))
    reached = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "pos", "level"))
    per = per.withColumn("level", F.min(reached).over(all_rows)["level"])
    return per.select("source", "source_size", "pos", F.coalesce(F.least(F.col("level") * F.col("weight"), "cap"), "cap").alias("target"))


def _running(df: DataFrame, keys: list[str], part: Column, order: list[Column], size: Column) -> DataFrame:
    """``df`` with ``before``: the sum of ``size`` over earlier rows of the same keys, summed by parts first."""
    parted = df.withColumn("__part", part).withColumn("__size", size)
    sums = parted.groupBy(*keys, "__part").agg(F.sum("__size").alias("__sum"))
    ahead = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__ahead", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parted = parted.withColumn("__inside", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    return parted.join(sums, [*keys, "__part"]).withColumn("before", F.col("__ahead") + F.col("__inside")).drop("__part", "__size", "__ahead", "__inside")


def schedule(targets: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``slot, pos, rank, block, epoch, words``: which block of which source each slot of the mix takes.

    Slot i lies at the fraction of i times the golden ratio; the cumulative shares of the sources' block needs
    tell its source.  The slots of a source are ranked in order and take its blocks in turn; the last may take
    only the words that the target still wants.  A source that the points gave fewer slots than its target needs
    gets the missing ones at the schedule's end, and slots beyond its need are left out, so the words of each
    source's slots sum to its target, cut to whole words.
    """
    spark = targets.sparkSession
    blocks = F.ceil(F.col("source_size") / block_words)
    need = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * blocks).otherwise(0.0)
    goal = F.floor(F.col("target") + 1e-6)
    slots_needed = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size")) * blocks + F.ceil(goal % F.col("source_size") / block_words)).otherwise(0)
    wants = targets.withColumn("blocks", blocks).withColumn("need", need).withColumn("slots", slots_needed.cast("long"))
    ordered = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    wants = wants.withColumn("all", F.sum("need").over(Window.partitionBy())).withColumn("up_to", F.sum("need").over(ordered))
    wants = wants.where("need > 0").withColumn("lo", (F.col("up_to") - F.col("need")) / F.col("all")).withColumn("hi", F.when(F.col("up_to") >= F.col("all"), F.lit(2.0)).otherwise(F.col("up_to") / F.col("all")))
    points = int(wants.agg(F.ceil(F.max("all")).alias("n")).first()["n"] or 0)
    cells = wants.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))))
    high, low = F.shiftright("slot", 20), F.col("slot").bitwiseAND((1 << 20) - 1)
    slots = spark.range(points).withColumnRenamed("id", "slot").withColumn("point", (high * F.lit(GOLDEN_20) % 1 + low * F.lit(GOLDEN)) % 1)
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS))
    chosen = written(slots.join(cells, "cell").where("point >= lo AND point < hi").select("slot", "pos"))
    ranked = _running(chosen, ["pos"], F.floor(F.col("slot") / SLOTS_A_CHUNK), [F.col("slot")], F.lit(1)).select("slot", "pos", F.col("before").alias("rank"))
    # One row per source from here to the explode, whose length is the discrepancy of the points: some few slots a source.
    short = wants.join(chosen.groupBy("pos").agg(F.count("*").alias("given")), "pos", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    short = short.withColumn("missing", F.greatest(F.col("slots") - F.col("given"), F.lit(0)))
    short = short.withColumn("ahead", F.sum("missing").over(ordered) - F.col("missing")).where("missing > 0")
    added = short.select("pos", "given", "ahead", F.explode(F.sequence("given", F.col("slots") - 1)).alias("rank"))
    added = added.select((points + F.col("ahead") + F.col("rank") - F.col("given")).alias("slot"), "pos", "rank")
    ranked = ranked.unionByName(added).join(wants.select("pos", "source_size", "target", "blocks"), "pos")
    ranked = ranked.withColumn("block", F.col("rank") % F.col("blocks")).withColumn("epoch", F.floor(F.col("rank") / F.col("blocks")))
    start = F.col("epoch") * F.col("source_size") + F.col("block") * block_words
    words = F.least(F.lit(block_words), F.col("source_size") - F.col("block") * block_words, F.floor(F.col("target") + 1e-6) - start)
    return ranked.withColumn("words", words.cast("long")).where("words > 0").select("slot", "pos", "rank", "block", "epoch", "words")


def _mixed(docs: DataFrame, key: Column, source: Column, text: Column, drawn: Column, weights: tuple[float, ...], block_words: int) -> DataFrame:
    """``mix`` for columns instead of names; ``drawn`` is the hash by which rows are shuffled."""
    sizes = written(docs.select(key.alias("id"), source.alias("source"), word_count(text).alias("size"), drawn.alias("shuffled")))
    targets = written(source_targets(sizes, weights))
    slots = schedule(targets, block_words)
    known = sizes.join(targets.select(F.col("source").alias("its_source"), "pos", "source_size", "target"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    line = _running(known, ["pos"], F.pmod("shuffled", F.lit(LINE_PARTS)), [F.col("shuffled"), F.col("id"), F.col("size")], F.col("size"))
    line = written(line.withColumn("row", F.monotonically_increasing_id()))
    first, last = F.floor(F.col("before") / block_words), F.floor((F.col("before") + F.col("size") - 1) / block_words)
    pieces = line.where("size > 0").select("row", "pos", "before", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.col("before") - F.col("block") * block_words, F.lit(0))
    end = F.least(F.col("before") + F.col("size") - F.col("block") * block_words, F.lit(block_words))
    pieces = pieces.select("row", "pos", "block", begin.alias("begin"), end.alias("end"))
    got = pieces.join(slots, ["pos", "block"]).select("row", F.greatest(F.least("end", "words") - F.col("begin"), F.lit(0)).alias("got"))
    taken = got.groupBy("row").agg(F.sum("got").alias("taken"))
    return line.join(taken, "row", "left").select("id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _drawn(id_col: str, text_col: str, place: Column) -> Column:
    """The shuffle's hash of a row: of its id and text, and of its place where it has no id, so that no crowd shares one."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.when(F.col(id_col).isNull(), place), F.lit("mix"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``id, source, size, source_size, target, taken``.

    ``taken`` counts the words that the schedule takes from the row, repeats counted; over a source they sum to
    its target, cut to whole words.  A source's documents are shuffled by a hash of their id and text (of their
    place too, where they have no id) and laid on one line of words that is cut into equal blocks; a block's slots
    take its words, and a document gets the words of its part of the block.  Null and empty texts have size 0 and
    give nothing; a source of such texts has target 0; null is a source of its own; repeated rows lie on the line
    one by one.  An empty table gives an empty result.  Ids keep their type; other columns are not read.
    """
    return _mixed(docs, F.col(id_col), F.col(source_col), F.col(text_col), _drawn(id_col, text_col, F.monotonically_increasing_id()), weights, block_words)


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", stored: bool = False) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as its words are taken, rounded to whole documents.

    Rows that the mix leaves out go, rows of a source to repeat come back twice or three times; all columns stay.
    Rows are told apart by a number of their own (``stored`` as in ``numbered``), so those that share an id or have
    none are decided each.
    """
    rows, row = numbered(docs, stored)
    found = _mixed(rows, F.col(row), F.col(source_col), F.col(text_col), _drawn(id_col, text_col, F.col(row)), WEIGHTS, BLOCK_WORDS)
    times = free_name(rows, "__times")
    often = found.where("size > 0").select(F.col("id").alias(row), F.round(F.col("taken") / F.col("size")).cast("int").alias(times)).where(F.col(times) > 0)
    joined = rows.join(often, row).withColumn(times, F.explode(F.sequence(F.lit(1), times)))
    return joined.select(*[F.col(c) for c in docs.columns])


def op5_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


QUERIES = {"op5_mixing": op5_mixing}
ORACLES: dict[str, str] = {}
