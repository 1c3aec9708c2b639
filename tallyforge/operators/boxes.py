"""Boxes on frames: geometry, matching, scoring, suppression, tracking.

A box has ``left, top, width, height``; boxes are compared only within a frame of a recording, so every join here
has the frame as its key unless it says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.sources.shared import with_places, written

# When boxes are one object, how near is near, the margin of a canvas, the lowest score, cells apart.
MIN_SHARE, MAX_ROWS_APART, NEAR, MARGIN = 0.5, 1.5, 40, 30
FLOOR = 0.05
#: Peaks of box maps, jitter of training windows and cells of the heat map, cells of the screen.
PEAK_FLOOR, PEAK_LIMIT = 0.3, 100
JITTER, STRIDE = 0.40, 4
CHROME_CELL = 50
SEPARATION = 3
#: Side of the tiles that suppression is dealt by.
TILE = 64
#: Positions that are despiked together.
BLOCK = 1 << 20
#: Boxes of neighbouring ids that are counted together in one task.
ID_BLOCK = 1 << 18
#: Width of the strips in which boxes of a frame meet.
COLUMN = 64
BOX = ("left", "top", "width", "height")


def of(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(prefix + name) for name in BOX)


def overlaps(a, b, min_share: float = MIN_SHARE, max_rows_apart: float = MAX_ROWS_APART) -> Column:
    """The same object: half of the narrower width shared, and rows at most so many heights apart."""
    (al, at, aw, ah), (bl, bt, bw, bh) = a, b
    shared = F.least(al + aw, bl + bw) - F.greatest(al, bl)
    return (shared >= min_share * F.least(aw, bw)) & (F.abs(at - bt) <= max_rows_apart * F.greatest(ah, bh))


def iou(a, b) -> Column:
    """Area shared over area covered; 0 for boxes without area."""
    (al, at, aw, ah), (bl, bt, bw, bh) = a, b
    w = F.greatest(F.least(al + aw, bl + bw) - F.greatest(al, bl), F.lit(0))
    h = F.greatest(F.least(at + ah, bt + bh) - F.greatest(at, bt), F.lit(0))
    union = aw * ah + bw * bh - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def near(a, b, tolerance: int = NEAR) -> Column:
    return (F.abs(a[0] - b[0]) <= tolerance) & (F.abs(a[1] - b[1]) <= tolerance)


def _side(rows: DataFrame, prefix: str, key: list[str]) -> DataFrame:
    return rows.select(*[F.col(k).alias(prefix + k) for k in key], F.col("id").alias(prefix + "id"), *[F.col(c).alias(prefix + c) for c in BOX])


def frame_pairs(a: DataFrame, b: DataFrame, test: Callable[..., Column], key: list[str], column: int = COLUMN) -> DataFrame:
    """``key..., a_id, b_id`` of boxes of one frame that share columns and for which ``test(a, b)`` holds.

    A frame is cut into strips of ``column`` pixels; boxes meet in the strips that both reach into, and a pair
    counts in the first of them, so a frame with many boxes is many keys and only boxes side by side are compared.
    """
    strip = lambda x: F.floor(x / column)

    def side(rows: DataFrame, p: str) -> DataFrame:
        first, last = strip(F.col(p + "left")), strip(F.col(p + "left") + F.greatest(F.col(p + "width"), F.lit(1)) - 1)
        return _side(rows, p, key).withColumns({p + "first": first, p + "strip": F.explode(F.sequence(first, last))})

    on = F.col("a_strip") == F.col("b_strip")
    for k in key:
        on = on & (F.col("a_" + k) == F.col("b_" + k))
    here = F.col("a_strip") == F.greatest("a_first", "b_first")
    return side(a, "a_").join(side(b, "b_"), on & here & test(of("a_"), of("b_"))).select(*[F.col("a_" + k).alias(k) for k in key], "a_id", "b_id")


def near_pairs(rows: DataFrame, tolerance: int = NEAR) -> DataFrame:
    """``a_id, b_id`` (a < b) of boxes anywhere whose corners lie within ``tolerance`` in both axes.

    A band join: corners fall in cells as wide as the tolerance; one side looks in its own and the neighbour cells.
    """
    cell = lambda c: F.floor(F.col(c) / tolerance)
    left = _side(rows, "a_", []).withColumns({"x": cell("a_left"), "y": cell("a_top")})
    right = _side(rows, "b_", []).withColumns({"x": F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cell("b_left") + d))})
    right = right.withColumn("y", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: cell("b_top") + d)))
    return left.join(right, ["x", "y"]).where((F.col("a_id") < F.col("b_id")) & near(of("a_"), of("b_"), tolerance)).select("a_id", "b_id")


def near_counts(rows: DataFrame, tolerance: int, block: int = ID_BLOCK) -> DataFrame:
    """``id, n, ids``: for each box with any, how many boxes of greater id ``near_pairs`` would pair it with, and their ids' sum.

    No pair is made. Ids are cut into blocks of some ``block`` rows by a sketch. Boxes of the blocks above are counted by
    corner, spread to the corners near by, and summed over blocks; within a block, sorted corners and running sums give the
    rest, a search for each box and neighbouring corner. The work grows with rows times neighbouring corners, so this is
    for whole-numbered corners and tolerances of a few pixels.
    """
    kept = rows.select(F.col("id").cast("long").alias("id"), F.col("left").cast("long").alias("x"), F.col("top").cast("long").alias("y")).where("id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    many = kept.count() // block + 1
    edges = kept.agg(F.percentile_approx("id", F.array(*[F.lit(k / many) for k in range(1, many)]), 10 * many)).first()[0] if many > 1 else None
    edges = [-math.inf, *sorted({float(e) for e in edges or [0]}), math.inf]
    kept = Bucketizer(splits=edges, inputCol="of", outputCol="block").transform(kept.withColumn("of", F.col("id").cast("double"))).drop("of")
    spread = F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance)))
    cells = kept.groupBy("block", "x", "y").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    for axis in ("x", "y"):
        cells = cells.withColumn("d", spread).withColumn(axis, F.col(axis) + F.col("d")).groupBy("block", "x", "y").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
    over = Window.partitionBy("x", "y").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    above = cells.select("block", "x", "y", *[F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"{c}_above") for c in ("n", "ids")])

    def within(table: pa.Table) -> pa.Table:
        ids, x, y = (table.column(c).to_numpy() for c in ("id", "x", "y"))
        known, rank = np.unique(ids, return_inverse=True)
        corner_x, corner_y = x - x.min() + tolerance, y - y.min() + tolerance
        height, size = corner_y.max() + tolerance + 1, len(known)
        place = lambda dx, dy: (corner_x + dx) * height + corner_y + dy
        keys = place(0, 0) * size + rank
        order = np.argsort(keys)
        keys, sums = keys[order], np.concatenate([[0], np.cumsum(ids[order])])
        n, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for dx in range(-tolerance, tolerance + 1):
            for dy in range(-tolerance, tolerance + 1):
                at = place(dx, dy)[order]
                a, b = np.searchsorted(keys, at * size + rank[order], side="right"), np.searchsorted(keys, (at + 1) * size)
                n += b - a
                total += sums[b] - sums[a]
        return pa.table({"id": ids[order], "block": table.column("block").to_numpy()[order], "x": x[order], "y": y[order], "n": n, "ids": total})

    own = kept.groupBy("block").applyInArrow(within, "id long, block double, x long, y long, n long, ids long")
    both = own.join(above, ["block", "x", "y"]).select("id", (F.col("n") + F.col("n_above")).alias("n"), (F.col("ids") + F.col("ids_above")).alias("ids"))
    return both.where("n > 0").groupBy("id").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))


def match_frames(predictions: DataFrame, truths: DataFrame, frames: DataFrame, test: Callable[..., Column] = overlaps, key: str = "frame") -> DataFrame:
    """One row per frame: predictions, truths, hits (truths found), spurious predictions; frames without boxes too."""
    pairs = frame_pairs(predictions, truths, test, [key])
    hit = pairs.groupBy(key).agg(F.count_distinct("b_id").alias("hits"), F.count_distinct("a_id").alias("matched"))
    p = predictions.groupBy(key).agg(F.count("*").alias("predictions"))
    t = truths.groupBy(key).agg(F.count("*").alias("truths"))
    rows = frames.select(key).distinct().join(p, key, "left").join(t, key, "left").join(hit, key, "left").na.fill(0, ["predictions", "truths", "hits", "matched"])
    return rows.select(key, "predictions", "truths", "hits", (F.col("truths") - F.col("hits")).alias("misses"), (F.col("predictions") - F.col("matched")).alias("spurious"))


def score(per_frame: DataFrame) -> DataFrame:
    """One row over frames: hits, misses, spurious boxes, empty frames with predictions, recall, frames that are right."""
    empty = F.col("truths") == 0
    return per_frame.agg(
        F.count("*").alias("frames"), F.sum("hits").alias("hits"), F.sum("misses").alias("misses"), F.sum("spurious").alias("spurious"),
        F.count_if(empty & (F.col("predictions") > 0)).alias("false_positive_frames"), (F.sum("hits") / F.nullif(F.sum("truths"), F.lit(0))).alias("recall"),
        F.count_if((F.col("misses") == 0) & (F.col("spurious") == 0)).alias("clean_frames"),
    )


def beats(model: DataFrame, teacher: DataFrame) -> DataFrame:
    """One row from two scores: whether the model finds as much with no more spurious boxes, and more of one kind."""
    t = teacher.select(F.col("recall").alias("t_recall"), F.col("spurious").alias("t_spurious"))  # one row
    no_worse = (F.col("recall") >= F.col("t_recall")) & (F.col("spurious") <= F.col("t_spurious"))
    better = (F.col("recall") > F.col("t_recall")) | (F.col("spurious") < F.col("t_spurious"))
    return model.join(F.broadcast(t)).select("recall", "t_recall", "spurious", "t_spurious", (no_worse & better).alias("beats"))


def outside_kept(points: DataFrame, kept: DataFrame, key: list[str], column: int = COLUMN) -> DataFrame:
    """Points (``x, y``) that lie in no kept box (``left, top, width, height``) of their frame: the negatives.

    A point meets the boxes that reach into its strip of ``column`` pixels only.
    """
    boxes = kept.where("width > 0 AND height > 0").select(*[F.col(k).alias("k_" + k) for k in key], *[F.col(c).alias("k_" + c) for c in BOX])
    left, top, width, height = of("k_")
    boxes = boxes.withColumn("k_strip", F.explode(F.sequence(F.floor(left / column), F.floor((left + width - 1) / column))))
    inside = (F.col("x") >= left) & (F.col("x") < left + width) & (F.col("y") >= top) & (F.col("y") < top + height)
    on = inside & (F.floor(F.col("x") / column) == F.col("k_strip"))
    for k in key:
        on = on & (F.col(k) == F.col("k_" + k))
    return points.join(boxes, on, "left_anti")


def counts_above(candidates: DataFrame) -> DataFrame:
    """``step, n`` for step 0 to 100: candidates with a score of at least step / 100.

    The running total goes over a hundred counts.
    """
    steps = candidates.select(F.floor(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)) * 100 + 1e-9).cast("long").alias("step"))
    counts = steps.groupBy("step").agg(F.count("*").alias("own"))
    every = candidates.sparkSession.range(101).withColumnRenamed("id", "step")
    back = Window.orderBy(F.col("step").desc())
    return every.join(F.broadcast(counts), "step", "left").select("step", F.coalesce(F.sum("own").over(back), F.lit(0)).alias("n"))


def score_histogram(rows: DataFrame, bins: int = 40) -> DataFrame:
    """``on_object, bin, n``; a bin holds its lower edge, the last its upper edge too."""
    at = F.least(F.width_bucket("score", F.lit(0.0), F.lit(1.0), F.lit(bins)), F.lit(bins).cast("long"))
    return rows.where((F.col("score") >= 0) & (F.col("score") <= 1)).groupBy("on_object", at.alias("bin")).agg(F.count("*").alias("n"))


def strongest(candidates: DataFrame, most: int, key: str = "frame") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "id")
    return candidates.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def local_maxima(cells: DataFrame, key: list[str], floor: float = PEAK_FLOOR, limit: int | None = PEAK_LIMIT) -> DataFrame:
    """Cells (``x, y, score``) at least as strong as all of their eight neighbours and as ``floor``; of each group of
    ``key`` the ``limit`` strongest, equal ones by row and column."""
    around = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
    others = cells.select(*key, F.col("score").alias("other"), F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in around])).alias("p")).select(*key, "p.x", "p.y", "other")
    beaten = others.groupBy(*key, "x", "y").agg(F.max("other").alias("strongest"))
    peaks = cells.where(F.col("score") >= floor).join(beaten, [*key, "x", "y"], "left").where(F.col("strongest").isNull() | (F.col("score") >= F.col("strongest"))).drop("strongest")
    if limit is None:
        return peaks
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), "y", "x")
    return peaks.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= limit).drop("__place")


def suppress(cells: DataFrame, key: list[str], separation: int = SEPARATION, limit: int | None = 300, tile: int = TILE) -> DataFrame:
    """Greedy suppression in each group of ``key``: the strongest first, nothing nearer than ``separation`` in both axes;
    of equal scores the larger x, then the larger y. ``x, y`` are whole numbers.

    In each round a task decides the cells of a tile from the strongest on: one that a kept cell is near goes, one is
    kept if all that are stronger and near have gone, and one near a stronger cell that another tile has yet to decide
    waits for the next round. Tiles see their neighbours' cells as far as ``separation`` reaches, so a crowded group is
    many tasks, and rounds are as many as the longest chain of cells that goes from tile to tile. A tile is known by a
    64-bit number.
    """
    reach = separation - 1
    open_, kept, gone = 0, 1, 2

    def decide(group: list, x: list, y: list, state: list, own: list) -> None:
        """Decides cells of whole tiles, the strongest of each first."""
        near: dict = {}  # of each square of the separation's side: its cells that are kept or undecided
        for i, g in enumerate(group):
            a, b, now = x[i], y[i], state[i]
            u, v = a // separation, b // separation
            if now == open_ and own[i]:
                found = 0
                for du in (-1, 0, 1):
                    for dv in (-1, 0, 1):
                        for c, d, what in near.get((g, u + du, v + dv), ()):
                            if abs(a - c) <= reach and abs(b - d) <= reach:
                                found |= what
                now = state[i] = gone if found & 1 else open_ if found else kept
            if now != gone:
                near.setdefault((g, u, v), []).append((a, b, 1 if now == kept else 2))

    def run(batches):
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            group = held.column("__group")
            last = pc.index(group, group[-1]).as_py() if held.num_rows else 0  # the last tile may go on in the next batch
            if last:
                yield from done(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield from done(held)

    def done(table):
        group, x, y, state, own = (table.column(c).to_pylist() for c in ("__group", "x", "y", "__state", "__own"))
        decide(group, x, y, state, own)
        at = table.schema.get_field_index("__state")
        table = table.set_column(at, table.schema.field(at), pa.array(state, pa.int32())).filter(pa.array(own)).select(names)
        yield from table.combine_chunks().to_batches()

    at = lambda c: F.floor(F.col(c) / tile).cast("long")
    reached = lambda c: F.sequence(F.floor((F.col(c) - reach) / tile).cast("long"), F.floor((F.col(c) + reach) / tile).cast("long"))
    now = cells.withColumn("__state", F.lit(open_))
    names = now.columns
    while True:
        spread = now.withColumns({"__i": F.explode(reached("x")), "__home": at("x")}).withColumn("__j", F.explode(reached("y")))
        spread = spread.withColumn("__own", (F.col("__i") == F.col("__home")) & (F.col("__j") == at("y"))).where("__own OR __state <> 2")
        spread = spread.withColumn("__group", F.xxhash64(*key, "__i", "__j")).drop("__home", "__i", "__j")
        strongest = [F.col("score").desc(), F.col("x").desc(), F.col("y").desc()]
        sorted_ = spread.repartition("__group").sortWithinPartitions("__group", *strongest)
        now = written(sorted_.mapInArrow(run, now.schema))
        if now.where(F.col("__state") == open_).isEmpty():
            break
    left = now.where(F.col("__state") == kept).drop("__state")
    if limit is None:
        return left
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col("x").desc(), F.col("y").desc())
    return left.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= limit).drop("__place")


def boxes_from_peaks(peaks: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes of a given size around peak centres (``x, y``), not beyond the frame's upper left."""
    return peaks.withColumns({"left": F.greatest(F.floor(F.col("x") - width // 2), F.lit(0)).cast("int"), "top": F.greatest(F.floor(F.col("y") - height // 2), F.lit(0)).cast("int"), "width": F.lit(width), "height": F.lit(height)})


def rescaled(rows: DataFrame, frames: DataFrame, capture_width: int, key: str = "frame") -> DataFrame:
    """Boxes brought from their frame's width (``frame_width``) to the width at which the model captures."""
    factor = F.lit(capture_width) / F.col("frame_width")
    return rows.join(frames.select(key, "frame_width"), key).withColumns({c: F.bround(F.col(c) * factor).cast("int") for c in BOX}).drop("frame_width")


def corrected(left: Column, top: Column, rect_left: Column, rect_top: Column, margin: int = MARGIN) -> tuple[Column, Column]:
    """A box moved by a drag that was drawn on a canvas with ``margin`` around the box."""
    return F.coalesce(left - margin + rect_left.cast("int"), left), F.coalesce(top - margin + rect_top.cast("int"), top)


def crop_pads(width: Column, height: Column, percent: float | None = None, absolute: int | None = None, square: bool = False) -> tuple[Column, Column]:
    """Padding per side in x and y, by a share of the box or in pixels; never negative, square if asked."""
    w = F.bround(width * (percent or 0) / 100) if absolute is None else F.lit(absolute)
    h = F.bround(height * (percent or 0) / 100) if absolute is None else F.lit(absolute)
    if square:
        side = F.greatest(width + 2 * w, height + 2 * h)
        w, h = F.ceil((side - width) / 2), F.ceil((side - height) / 2)
    return F.greatest(w, F.lit(0)).cast("int"), F.greatest(h, F.lit(0)).cast("int")


def tile_rectangles(rows: DataFrame, frames: DataFrame, pad_x: Column, pad_y: Column, key: str = "frame") -> DataFrame:
    """The padded box where the frame holds it, else the bare one where it does; other boxes give no tile."""
    left, top, width, height = of()
    both = rows.join(frames.select(key, "frame_width", "frame_height"), key)

    def within(x, y, w, h):
        return (x >= 0) & (y >= 0) & (x + w <= F.col("frame_width")) & (y + h <= F.col("frame_height"))

    padded = (left - pad_x, top - pad_y, width + 2 * pad_x, height + 2 * pad_y)
    names = ("tile_left", "tile_top", "tile_width", "tile_height")
    pick = F.when(within(*padded), F.struct(*[p.cast("int").alias(n) for p, n in zip(padded, names)])).when(within(left, top, width, height), F.struct(*[p.cast("int").alias(n) for p, n in zip((left, top, width, height), names)]))
    return both.withColumn("tile", pick).where("tile IS NOT NULL").select(*rows.columns, "tile.*")


def canvas(rows: DataFrame, margin: int = MARGIN) -> DataFrame:
    """Where on a canvas with ``margin`` around each box its part of the frame goes: source and destination."""
    left, top, width, height = of()
    x0, y0 = F.greatest(left - margin, F.lit(0)), F.greatest(top - margin, F.lit(0))
    x1, y1 = F.least(left + width + margin, F.col("frame_width")), F.least(top + height + margin, F.col("frame_height"))
    return rows.withColumns({"src_left": x0, "src_top": y0, "src_width": F.greatest(x1 - x0, F.lit(0)), "src_height": F.greatest(y1 - y0, F.lit(0)), "dst_left": x0 - (left - margin), "dst_top": y0 - (top - margin)})


def minimum_window(width: Column, height: Column, downscale: int = 2, jitter: float = JITTER, stride: int = STRIDE) -> Column:
    """The smallest training window, in pixels of the downscaled frame, that holds a box of this size whole wherever
    jitter puts it, snapped up to whole cells of the heat map."""
    side = F.ceil(F.greatest(width, height) / downscale / (1.0 - 2.0 * jitter))
    return (F.ceil(side / stride) * stride).cast("long")


def window_floor(sizes: DataFrame, capture_width: int | None = None) -> DataFrame:
    """``window`` for fitted box sizes (``width, height``): at the capture width, where one is given, boxes are scaled
    from the ``frame_width`` that they were drawn at."""
    ratio = F.lit(float(capture_width)) / F.col("frame_width") if capture_width else F.lit(1.0)
    scaled = sizes.withColumns({"width": F.bround(F.col("width") * ratio).cast("int"), "height": F.bround(F.col("height") * ratio).cast("int")})
    return scaled.withColumn("window", minimum_window(F.col("width"), F.col("height")))


def spread_sample(frames: DataFrame, count: int, key: str = "frame") -> DataFrame:
    """``count`` frames evenly spread over all, by name."""
    numbered = with_places(frames.select(key).distinct(), [key], "place")
    n = numbered.count()
    take = min(count, n)
    places = frames.sparkSession.range(take).select(F.floor(F.col("id") * n / max(take, 1)).alias("place"))
    return numbered.join(places, "place").select(key)


def angles_apart(rows: DataFrame, by: list[str], angle: str = "degrees") -> DataFrame:
    """Per group: how many angles, and the arc they span, 360 less the widest gap between neighbours on the circle."""
    order = Window.partitionBy(*by).orderBy(angle)
    ring = rows.withColumns({"next": F.lead(angle).over(order), "first": F.first(angle).over(order)})
    gap = F.coalesce("next", F.col("first") + 360) - F.col(angle)
    return ring.withColumn("gap", gap).groupBy(*by).agg(F.count("*").alias("n"), (360 - F.max("gap")).alias("span"))


def chrome_cells(peaks: DataFrame, facings: DataFrame, size: int = CHROME_CELL, spread_degrees: float = 90.0, min_frames: int = 12) -> DataFrame:
    """Screen cells whose detections stay while the heading turns: seen in many frames over a wide arc.

    A detection belongs to the cell that its centre, divided by the cell's size, rounds to (halves to even)."""
    joined = peaks.join(facings, ["recording", "frame"])
    cells = joined.select("recording", *[F.bround((F.col(edge) + F.col(extent) / 2) / size).cast("long").alias(cell) for cell, edge, extent in (("cx", "left", "width"), ("cy", "top", "height"))], F.expr("pmod(degrees(radians), 360.0)").alias("degrees"))
    return angles_apart(cells, ["recording", "cx", "cy"]).where((F.col("n") >= min_frames) & (F.col("span") > spread_degrees))


def despike(track: DataFrame, tolerance: float = 250.0, side: int = 4, least: int = 9, block: int = BLOCK) -> DataFrame:
    """Positions (``recording, frame, x, y``) without those far from the median of their neighbours.

    The neighbours are four places to each side, the place itself left out; short tracks stay as they are.

    Positions are dealt out by their place in the order of all, ``block`` of them together with the ``side`` nearest of
    both neighbour blocks, so a long recording is many tasks.
    """
    counts = track.groupBy(F.col("recording").alias("__of")).agg(F.count("*").alias("__n"))
    placed = with_places(track, ["recording", "frame"], "__place")
    home, at = F.floor(F.col("__place") / block), F.col("__place") % block
    copies = F.array_compact(F.array(home, F.when(at < side, home - 1), F.when(at >= block - side, home + 1)))
    dealt = placed.withColumns({"__home": home, "__block": F.explode(copies)})
    order = Window.partitionBy("__block", "recording").orderBy("__place")

    def middle(c: str) -> Column:
        around = F.array_sort(F.concat(F.collect_list(c).over(order.rowsBetween(-side, -1)), F.collect_list(c).over(order.rowsBetween(1, side))))
        return F.get(around, F.floor(F.size(around) / 2).cast("int"))

    marked = dealt.withColumns({"mx": middle("x"), "my": middle("y")}).where("__block = __home")
    marked = marked.join(counts, F.col("recording").eqNullSafe(F.col("__of")))
    far = F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my")) > tolerance
    return marked.where((F.col("__n") < least) | ~F.coalesce(far, F.lit(False))).select(*track.columns)


class Follower:
    """One position per frame: the strongest to begin with, then the strongest within ``max_step`` of the last; after
    ``lost_after`` frames without one it begins anew. What is carried from frame to frame is a position and a count."""

    def __init__(self, max_step: float, lost_after: int, last: tuple[float, float] | None = None, missed: int = 0):
        self.reach, self.lost_after, self.last, self.missed = max_step**2, lost_after, last, missed

    def step(self, found: list[tuple[float, float, float]]) -> int | None:
        """The place of the one kept among a frame's detections (``x, y, score``, the strongest first), if any is."""
        for k, (x, y, score) in enumerate(found):
            if score is None or math.isnan(score):
                continue
            if self.last is None or (x - self.last[0]) ** 2 + (y - self.last[1]) ** 2 <= self.reach:
                self.last, self.missed = (x, y), 0
                return k
        self.missed += 1
        if self.missed > self.lost_after:
            self.last = None
        return None


def track(detections: DataFrame, max_step: float = 600.0, lost_after: int = 5) -> DataFrame:
    """``recording, frame, x, y, score``: a ``Follower`` along each recording's frames.

    Detections come sorted by recording, frame and strength, and are followed as they stream by: a task holds one batch and
    one frame's detections, however long a recording is.
    """

    def run(batches):
        recording, frame, now, follower = object(), None, [], None

        def close():
            kept = follower.step([d[:3] for d in now]) if now else None
            return [] if kept is None else [(recording, frame, *now[kept][:3])]

        for batch in batches:
            out = []
            for r, f, left, top, width, height, score in zip(*(c.to_pylist() for c in batch.columns)):
                if follower is None or r != recording or f != frame:
                    out += close() if follower else []
                    if follower is None or r != recording:
                        follower = Follower(max_step, lost_after)
                    recording, frame, now = r, f, []
                now.append((left + width / 2, top + height / 2, score))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], names)
        out = close() if follower else []
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)], names)

    shape = T.StructType([detections.schema["recording"], detections.schema["frame"], *(T.StructField(n, T.DoubleType()) for n in ("x", "y", "score"))])
    kinds, names = [f.type for f in to_arrow_schema(shape)], [f.name for f in shape.fields]
    numbers = [F.col(c).cast("double").alias(c) for c in (*BOX, "score")]
    rows = detections.repartition("recording").sortWithinPartitions("recording", "frame", F.col("score").desc_nulls_last(), "id").select("recording", "frame", *numbers)
    return rows.mapInArrow(run, shape)


def sweep(frames: DataFrame, predict: Callable, schema: str = "frame string, x double, y double, score double", floor: float = FLOOR) -> DataFrame:
    """Candidates of any batch predictor over a table of frames; ``predict`` maps a pandas frame to one.

    The predictor is the caller's; Spark deals the frames and keeps scores from ``floor`` up.
    """

    def run(batches):
        for batch in batches:
            yield predict(batch)

    return frames.mapInPandas(run, schema).where(F.col("score") >= floor)
