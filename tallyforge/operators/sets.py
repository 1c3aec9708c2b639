"""Candidates, judgements and training sets."""

from __future__ import annotations

import random
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.expressions import all_of, upper_median
from tallyforge.operators.boxes import BOX, MARGIN, corrected, outside_kept

MIN_HEIGHT = 4
#: The longer side that frames are scaled to, how often the largest object has to fit into the reach, and
#: how many places are tried for a background box.
LONG_SIDE, REACH_MARGIN, TRIES = 768, 1.5, 40


class SetError(ValueError):
    """A promotion or set that would mix what must not be mixed."""


SKIP_REASONS = (("recording", "no recording"), ("frame", "no frame"), ("left", "no box"), ("top", "no box"), ("width", "no box"), ("height", "no box"))


def skip_reason(columns: list[str]) -> Column:
    """Why a training row can't be used, the first reason that holds, or null."""
    reason = F.lit(None).cast("string")
    checks = [(F.col(c).isNull(), why) for c, why in SKIP_REASONS if c in columns]
    checks += [((F.col("width") <= 0) | (F.col("height") <= 0), "no area"), (F.col("label").isNull() & ~F.coalesce(F.col("negative"), F.lit(False)), "no label")]
    for test, why in reversed(checks):
        reason = F.when(test, why).otherwise(reason)
    return reason


def skipped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason", skip_reason(rows.columns)).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def pending(candidates: DataFrame, decisions: DataFrame, hide_done: bool = False) -> DataFrame:
    """Candidates not yet reviewed, or with ``hide_done`` not decided either."""
    d = decisions.select("dataset", "idx", "keep", "discard", "reviewed")
    both = candidates.join(d, ["dataset", "idx"], "left")
    open_ = ~F.coalesce("reviewed", F.lit(False))
    if hide_done:
        open_ = open_ & ~F.coalesce("keep", F.lit(False)) & ~F.coalesce("discard", F.lit(False))
    return both.where(open_).drop("keep", "discard", "reviewed")


def centres(candidates: DataFrame, decisions: DataFrame, margin: int = MARGIN) -> DataFrame:
    """Candidates with decisions and the object's ``x, y``, after the drag and the height correction."""
    both = candidates.join(decisions, ["dataset", "idx"], "left")
    left, top = corrected(F.col("left"), F.col("top"), F.col("rect.left"), F.col("rect.top"), margin)
    width = F.coalesce(F.col("rect.width").cast("int"), F.col("width"))
    height = F.greatest(F.coalesce(F.col("rect.height").cast("int"), F.col("height")) + F.coalesce("height_delta", F.lit(0)), F.lit(MIN_HEIGHT))
    return both.withColumns({"x": left + F.floor(width / 2), "y": top + F.floor(height / 2), "left": left, "top": top, "width": width, "height": height})


def fitted_box(rows: DataFrame, by: list[str]) -> DataFrame:
    """The size that fits a set: the upper medians, and the truncated medians that tiles are cut with."""
    return rows.groupBy(*by).agg(upper_median("width").cast("int").alias("width"), upper_median("height").cast("int").alias("height"), F.median("width").cast("int").alias("tile_width"), F.median("height").cast("int").alias("tile_height"))


def sized(rows: DataFrame, by: list[str], native: bool = False) -> DataFrame:
    """Drawn boxes brought to their set's fitted size around their centres, unless sizes are native."""
    if native:
        return rows.withColumn("size_mode", F.lit("native"))
    fit = rows.groupBy(*by).agg(upper_median("width").cast("int").alias("__w"), upper_median("height").cast("int").alias("__h"))
    both = rows.join(fit, by)
    return both.withColumns({"left": F.col("left") + F.floor((F.col("width") - F.col("__w")) / 2).cast("int"), "top": F.col("top") + F.floor((F.col("height") - F.col("__h")) / 2).cast("int"), "width": F.col("__w"), "height": F.col("__h"), "size_mode": F.lit("fitted")}).drop("__w", "__h")


def exhaustive_negatives(candidates: DataFrame, decisions: DataFrame, modes: DataFrame) -> DataFrame:
    """Centres on frames marked exhaustive that were not kept and lie in no kept box: they become negatives."""
    judged = centres(candidates, decisions).join(modes.where("exhaustive").select("frame").distinct(), "frame", "left_semi")
    kept = judged.where("keep")
    return outside_kept(judged.where(~F.coalesce("keep", F.lit(False))), kept, ["frame"])


def promoted(pool: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Training rows from a judged pool: labelled tiles, and excluded ones as negatives; unjudged tiles are left out.

    A pool judged under two definitions is refused.
    """
    judged = pool.where("label IS NOT NULL OR excluded")
    if (several := judged.where("classdef IS NOT NULL").agg(F.collect_set("classdef").alias("d")).first()["d"]) and len(several) > 1:
        raise SetError(f"judged under several definitions: {', '.join(sorted(several))}")
    boxes = centres(candidates, decisions).withColumnRenamed("dataset", "tag")
    both = judged.select("tag", "idx", "label", F.coalesce("excluded", F.lit(False)).alias("excluded")).join(boxes.select("tag", "idx", "frame", *BOX), ["tag", "idx"])
    return both.select(F.col("tag").alias("recording"), "frame", *BOX, F.when(~F.col("excluded"), F.col("label")).alias("label"), F.col("excluded").alias("negative"), F.col("tag").alias("source"))


def merge_sets(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Existing rows stay unless their source (a missing one is like any other) or their very box is stated anew;
    synthetic rows are never carried."""
    old = existing.where("source IS NULL OR source <> 'synthetic'")
    sources = fresh.select(F.col("source").alias("__s")).distinct()
    old = old.join(sources, F.col("source").eqNullSafe(F.col("__s")), "left_anti")
    key = ["recording", "frame", *BOX]
    boxes = fresh.select(*[F.col(c).alias("__" + c) for c in key]).distinct()
    return old.join(boxes, all_of(F.col(c).eqNullSafe(F.col("__" + c)) for c in key), "left_anti").unionByName(fresh)


def examples(rows: DataFrame) -> DataFrame:
    """One row per frame with its objects and its negatives as arrays."""
    box = F.struct(*[F.col(c) for c in BOX], "label")
    negative = F.coalesce("negative", F.lit(False))
    return rows.groupBy("recording", "frame").agg(F.sort_array(F.collect_list(F.when(~negative, box))).alias("objects"), F.sort_array(F.collect_list(F.when(negative, F.struct(*[F.col(c) for c in BOX])))).alias("negatives"))


def class_channels(rows: DataFrame) -> DataFrame:
    """``label, channel`` of the labels present, sorted; one row per class."""
    labels = rows.where("NOT coalesce(negative, false) AND label IS NOT NULL").select("label").distinct()
    return labels.withColumn("channel", F.row_number().over(Window.orderBy("label")) - 1)


def summarise(rows: DataFrame) -> DataFrame:
    """One row: frames, objects, negatives, most objects in a frame, and the class with the fewest rows."""
    negative = F.coalesce("negative", F.lit(False))
    frames = rows.groupBy("recording", "frame").agg(F.count_if(~negative).alias("objects"), F.count_if(negative).alias("negatives"))
    head = frames.agg(F.count("*").alias("frames"), F.sum("objects").alias("objects"), F.sum("negatives").alias("negatives"), F.max("objects").alias("most_in_a_frame"))
    thin = rows.where(~negative).groupBy("label").agg(F.count("*").alias("n")).agg(F.min(F.struct("n", "label")).alias("t"))
    return head.join(F.broadcast(thin)).select("*", F.col("t.label").alias("thinnest"), F.col("t.n").alias("thinnest_rows")).drop("t")


def set_meta(rows: DataFrame) -> DataFrame:
    """One row per source: rows and how many of each label, negatives as such."""
    label = F.when(F.coalesce("negative", F.lit(False)), "(negative)").otherwise(F.col("label"))
    counts = rows.groupBy("source", label.alias("label")).agg(F.count("*").alias("n"))
    return counts.groupBy("source").agg(F.sum("n").alias("rows"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n")))).alias("labels"))


def refuse_mixed(frames: DataFrame) -> None:
    """Raises where a recording's frames have several widths."""
    mixed = frames.groupBy("recording").agg(F.collect_set("frame_width").alias("w")).where(F.size("w") > 1).orderBy("recording").limit(3).collect()
    if mixed:
        raise SetError("; ".join(f"{r['recording']} has frame widths {sorted(r['w'])}" for r in mixed))


def fold_judgements(events: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """``tile, label, excluded``: each tile's state after its latest event.

    A class un-excludes, an exclusion clears the class, a clearing event removes the record. Earlier records count
    as events before all others.
    """
    rows = events.select("tile", "at", "action", "label")
    if records is not None:
        rows = rows.unionByName(records.select("tile", F.lit(-1).cast("long").alias("at"), F.when(F.col("excluded"), "exclude").otherwise("label").alias("action"), "label"))
    last = rows.groupBy("tile").agg(F.max(F.struct("at", "action", "label")).alias("e")).where("e.action <> 'clear'")
    return last.select("tile", F.when(F.col("e.action") == "label", F.col("e.label")).alias("label"), (F.col("e.action") == "exclude").alias("excluded"))


def fold_reviews(events: DataFrame) -> DataFrame:
    """``dataset, idx, height_delta, reviewed``: summed drags of the height and whether it was looked at."""
    return events.groupBy("dataset", "idx").agg(F.sum("delta").alias("height_delta"), F.bool_or("reviewed").alias("reviewed"))


def fold_modes(events: DataFrame) -> DataFrame:
    """Frames whose latest mode is exhaustive."""
    return events.groupBy("recording", "frame").agg(F.max_by("exhaustive", "at").alias("exhaustive")).where("exhaustive")


def pool_overview(pool: DataFrame) -> DataFrame:
    """One row per source: tiles, labelled, excluded, open."""
    excluded = F.coalesce("excluded", F.lit(False))
    return pool.groupBy(F.coalesce("tag", F.lit("untagged")).alias("tag")).agg(F.count("*").alias("tiles"), F.count_if(F.col("label").isNotNull() & ~excluded).alias("labelled"), F.count_if(excluded).alias("excluded"), F.count_if(F.col("label").isNull() & ~excluded).alias("open"))


def first_pool(tiles: DataFrame) -> DataFrame:
    """One row per tile, from the pool of the lowest rank."""
    order = Window.partitionBy("tile").orderBy("pool_rank")
    return tiles.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def ordinals(candidates: DataFrame) -> DataFrame:
    """Candidates with ``ordinal``, their place among the non-negative boxes of the dataset."""
    order = Window.partitionBy("dataset").orderBy("idx")
    return candidates.where("NOT coalesce(negative, false)").withColumn("ordinal", F.row_number().over(order) - 1)


def synthetic_negatives(rows: DataFrame, width: int, height: int, tries: int = TRIES) -> DataFrame:
    """Background boxes: one for each positive of a frame, of its size, overlapping no positive and no box placed before.

    The draws are seeded by the frame's name, so reruns agree; a frame too full for a box yields fewer.
    """
    import numpy as np
    import pandas as pd

    def run(frame):
        frame = frame.sort_values(list(BOX))
        rng = random.Random(zlib.crc32(str(frame["frame"].iloc[0]).encode()) & 0xFFFF)
        sizes, n = frame[["width", "height"]].to_numpy(), len(frame)
        placed, found = np.concatenate([frame[list(BOX)].to_numpy(), np.zeros((n, len(BOX)), dtype=np.int64)]), n
        for w, h in sizes.tolist():
            for _ in range(tries):
                x, y = rng.randrange(max(1, width - w)), rng.randrange(max(1, height - h))
                left, top, across, down = placed[:found].T
                if not ((x < left + across) & (left < x + w) & (y < top + down) & (top < y + h)).any():
                    placed[found] = x, y, w, h
                    found += 1
                    break
        out = pd.DataFrame(placed[n:found], columns=list(BOX))
        return out.assign(recording=frame["recording"].iloc[0], frame=frame["frame"].iloc[0], label=None, negative=True, source="synthetic")[["recording", "frame", *BOX, "label", "negative", "source"]]

    kind = dict(rows.dtypes)["frame"]
    return rows.where(~F.coalesce("negative", F.lit(False))).groupBy("recording", "frame").applyInPandas(run, f"recording string, frame {kind}, left int, top int, width int, height int, label string, negative boolean, source string")


def labels_of(definition: DataFrame) -> DataFrame:
    """``definition, label``: one member of each of up to three dimensions, in order, joined by slashes."""
    parts = definition.groupBy("definition", "position").agg(F.sort_array(F.collect_set("member")).alias("members"))
    lists = parts.groupBy("definition").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "members"))), lambda p: p["members"]).alias("d"))
    part = lambda i: F.coalesce(F.get("d", F.lit(i)), F.array(F.lit(None).cast("string")))
    three = lists.withColumn("a", F.explode(part(0))).withColumn("b", F.explode(part(1))).withColumn("c", F.explode(part(2)))
    return three.select("definition", F.concat_ws(" / ", "a", "b", "c").alias("label"))


def label_for(picks: list[Column]) -> Column:
    """A label from picks by position; questions without an answer are n/a."""
    return F.concat_ws(" / ", *[F.coalesce(p, F.lit("n/a")) for p in picks])


def saved_classes(pool: DataFrame) -> DataFrame:
    """``tile, label`` of the tiles with a class."""
    return pool.where("label IS NOT NULL").select("tag", "idx", "label")


def definitions_used(pool: DataFrame) -> DataFrame:
    return pool.where("classdef IS NOT NULL").select("classdef").distinct()


def confirmed_frames(rows: DataFrame) -> DataFrame:
    """Frames with a confirmed object, with how many and how many negatives."""
    negative = F.coalesce("negative", F.lit(False))
    return rows.groupBy("recording", "frame").agg(F.count_if(~negative).alias("objects"), F.count_if(negative).alias("ignored")).where("objects > 0")


def boxes_by_frame(candidates: DataFrame) -> DataFrame:
    """Per frame the candidates' positives and negatives, as arrays in the order of their index."""
    negative, box = F.coalesce("negative", F.lit(False)), F.struct("idx", *BOX)
    return candidates.groupBy("dataset", "frame").agg(F.sort_array(F.collect_list(F.when(~negative, box))).alias("boxes"), F.sort_array(F.collect_list(F.when(negative, box))).alias("negatives"))


def other_width(frames: DataFrame, capture_width: int) -> DataFrame:
    """One row ``width, n, of``: the most common frame width that is not the model's, of equal ones the smallest."""
    counts = frames.groupBy(F.col("frame_width").alias("width")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("of"))  # one row
    best = counts.where(F.col("width") != capture_width).agg(F.max(F.struct("n", (-F.col("width")).alias("w"))).alias("b")).where("b IS NOT NULL")
    return best.join(F.broadcast(total)).select((-F.col("b.w")).alias("width"), F.col("b.n").alias("n"), "of")


def out_of_reach(rows: DataFrame, reach: int, long_side: int = LONG_SIDE) -> DataFrame:
    """Objects longer than a model can size, by recording; any of them is a reason to refuse training.

    Sizes count as the model sees them, in frames whose longer side is scaled to ``long_side``; an object has to
    fit 1.5 times into the reach.
    """
    scale = F.lit(float(long_side)) / F.greatest("frame_width", "frame_height")
    far = F.greatest(F.col("width"), F.col("height")) * scale
    return rows.where(~F.coalesce("negative", F.lit(False)) & (far > reach / REACH_MARGIN)).groupBy("recording").agg(F.count("*").alias("n"), F.max(far).alias("largest"))


def candidate_page(candidates: DataFrame, decisions: DataFrame, number: int, size: int, hide_done: bool = False, guess: Column | None = None) -> DataFrame:
    """One page of the candidates still to review, with what was decided so far; with ``guess``, an expression over
    candidates, also the class that the reviewer is offered first."""
    rows = pending(candidates, decisions, hide_done).join(decisions.select("dataset", "idx", "keep", "discard", "height_delta"), ["dataset", "idx"], "left")
    page = rows.orderBy("dataset", "idx").offset(number * size).limit(size)
    return page if guess is None else page.withColumn("guess", guess)


def opened(candidates: DataFrame) -> DataFrame:
    """Pool tiles of all datasets at once: non-negative boxes with the size their dataset's tiles are cut to."""
    sizes = candidates.where("NOT coalesce(negative, false)").groupBy("dataset").agg(F.median("width").cast("int").alias("tile_width"), F.median("height").cast("int").alias("tile_height"))
    return ordinals(candidates).join(sizes, "dataset").select(F.format_string("%s_k%05d", "dataset", "ordinal").alias("tile"), F.col("dataset").alias("tag"), "idx", "tile_width", "tile_height")


def open_sources(pool: DataFrame, closed: DataFrame) -> DataFrame:
    """Tags in the pool that were not closed."""
    return pool.select(F.coalesce("tag", F.lit("untagged")).alias("tag")).distinct().join(closed.select("tag").distinct(), "tag", "left_anti")


def draw_size(drawn: DataFrame, existing: DataFrame | None, by: list[str]) -> str:
    """Where drawn boxes may go: ``replace`` unless the set there holds more boxes, which is never shrunk."""
    if existing is None:
        return "replace"
    had = existing.groupBy(*by).agg(F.count("*").alias("had"))
    now = drawn.groupBy(*by).agg(F.count("*").alias("now"))
    shrinks = not had.join(now, by, "left").where("coalesce(now, 0) < had").isEmpty()
    return "new" if shrinks else "replace"


def promote_to(fresh: DataFrame, existing: DataFrame | None, mode: str) -> DataFrame:
    """The set after a promotion: ``new`` refuses a set that is there, ``overwrite`` replaces it, ``merge`` restates.

    An empty promotion never replaces a set.
    """
    if mode not in ("new", "overwrite", "merge"):
        raise SetError(f"no mode {mode!r}")
    if fresh.isEmpty():
        raise SetError("nothing was judged, so the set stays as it is")
    if existing is not None and mode == "new":
        raise SetError("a set of that name is there already")
    return fresh if existing is None or mode == "overwrite" else merge_sets(existing, fresh)
