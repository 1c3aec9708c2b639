"""Candidates, judgements, training sets and assets, derived from orders by arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import assets, sets as ops
from tallyforge.operators.boxes import BOX, frame_pairs, iou
from tallyforge.queries.boxes import B, derived
from tallyforge.queries.common import c, orders, rounded, table
from tallyforge.sources.shared import written

TAG = "concat('rec', frame % 8, '_cnn-20240101-000000')"


def candidates(spark, sf_dir):
    """Candidates by dataset and index, every eleventh a negative."""
    rows = derived(spark, sf_dir).withColumns({"dataset": F.expr(TAG), "idx": c("id"), "negative": c("id") % 11 == 0})
    return rows.select("dataset", "idx", "frame", *[c(n).cast("int").alias(n) for n in ("left", "top", "width", "height")], "score", "label", "negative")


def decisions(spark, sf_dir):
    """A decision on two thirds of the candidates; a fifth of them drags the box."""
    rows = candidates(spark, sf_dir).where("idx % 3 <> 0")
    rect = F.when(c("idx") % 5 == 0, F.struct((30.0 + c("idx") % 7).alias("left"), (28.0 + c("idx") % 4).alias("top"), c("width").cast("double").alias("width"), c("height").cast("double").alias("height")))
    return rows.select("dataset", "idx", (c("idx") % 3 == 1).alias("keep"), (c("idx") % 6 == 2).alias("discard"), (c("idx") % 4 == 0).alias("reviewed"), rect.alias("rect"), (c("idx") % 9 - 8).cast("int").alias("height_delta"))


def pool(spark, sf_dir):
    """Tiles of half the candidates: some labelled, some excluded, some open."""
    rows = candidates(spark, sf_dir).where("idx % 2 = 0")
    return rows.select(c("dataset").alias("tag"), "idx", F.when(c("idx") % 5 < 2, c("label")).alias("label"), (c("idx") % 5 == 2).alias("excluded"), F.when(c("idx") % 5 < 2, F.lit("default")).alias("classdef"))


def set_rows(spark, sf_dir):
    """A training set: recordings, frames, boxes, labels, one row in eleven negative, sources by recording."""
    rows = candidates(spark, sf_dir)
    return rows.select(c("dataset").alias("recording"), "frame", "left", "top", "width", "height", F.when(~c("negative"), c("label")).alias("label"), "negative", F.when(c("idx") % 13 == 0, "synthetic").otherwise(c("dataset")).alias("source"))


def pending_candidates(spark, sf_dir):
    return ops.pending(candidates(spark, sf_dir), decisions(spark, sf_dir), hide_done=True).select("dataset", "idx")


def corrected_centres(spark, sf_dir):
    out = ops.centres(candidates(spark, sf_dir), decisions(spark, sf_dir))
    return out.select("idx", *[c(n).cast("long").alias(n) for n in ("x", "y", "left", "top", "width", "height")])


def exhaustive_negatives(spark, sf_dir):
    modes = derived(spark, sf_dir).select("frame", (c("frame") % 2 == 0).alias("exhaustive"))
    kept = decisions(spark, sf_dir).withColumn("keep", c("idx") % 30 == 1)
    return ops.exhaustive_negatives(candidates(spark, sf_dir), kept, modes).select("frame", "idx", c("x").cast("long").alias("x"), c("y").cast("long").alias("y"))


def skipped_rows(spark, sf_dir):
    rows = set_rows(spark, sf_dir).withColumns({"frame": F.when(c("left") % 17 != 0, c("frame")), "width": F.when(c("top") % 19 == 0, F.lit(0)).otherwise(c("width")), "label": F.when(c("left") % 23 != 0, c("label"))})
    return ops.skipped(rows)


def fitted_box(spark, sf_dir):
    return ops.fitted_box(set_rows(spark, sf_dir), ["recording"])


def sized_boxes(spark, sf_dir):
    rows = candidates(spark, sf_dir)
    return ops.sized(rows, ["dataset"]).select("idx", "left", "top", "width", "height", "size_mode")


def promote_rows(spark, sf_dir):
    out = ops.promoted(pool(spark, sf_dir), candidates(spark, sf_dir), decisions(spark, sf_dir))
    return out.select("recording", "frame", *[c(n).cast("long").alias(n) for n in ("left", "top", "width", "height")], "label", "negative")


def merge_sets(spark, sf_dir):
    """A set merged with a promotion that restates two recordings and some boxes of others."""
    rows = set_rows(spark, sf_dir)
    fresh = rows.where("recording LIKE 'rec1%' AND left % 2 = 0 OR width % 10 = 3").withColumns({"label": F.lit("new"), "source": F.when(c("recording").like("rec1%"), c("recording")).otherwise(F.lit("other"))})
    return ops.merge_sets(rows, fresh).groupBy("recording", "source", "label").agg(F.count("*").alias("n"))


def frame_examples(spark, sf_dir):
    out = ops.examples(set_rows(spark, sf_dir))
    return out.select("recording", "frame", F.size("objects").alias("objects"), F.size("negatives").alias("negatives"), F.aggregate("objects", F.lit(0).cast("long"), lambda a, x: a + x["left"] * x["width"]).alias("digest"))


def class_channel_map(spark, sf_dir):
    return ops.class_channels(set_rows(spark, sf_dir))


def set_summary(spark, sf_dir):
    return ops.summarise(set_rows(spark, sf_dir))


def set_meta(spark, sf_dir):
    return ops.set_meta(set_rows(spark, sf_dir)).select("source", "rows", F.explode("labels").alias("label", "n"))


def fold_judgements(spark, sf_dir):
    """Each customer as a tile: its orders are judgements in time."""
    action = F.when(c("o_orderkey") % 5 == 0, "exclude").when(c("o_orderkey") % 7 == 0, "clear").otherwise("label")
    events = orders(spark, sf_dir).select(F.concat(F.lit("t"), "o_custkey").alias("tile"), c("o_orderkey").alias("at"), action.alias("action"), c("o_orderpriority").alias("label"))
    records = table(spark, sf_dir, "customer").select(F.concat(F.lit("t"), "c_custkey").alias("tile"), F.lit("old").alias("label"), (c("c_custkey") % 2 == 0).alias("excluded"))
    return ops.fold_judgements(events, records)


def fold_reviews(spark, sf_dir):
    events = orders(spark, sf_dir).select(F.lit("d").alias("dataset"), c("o_custkey").alias("idx"), (c("o_orderkey") % 7 - 3).alias("delta"), (c("o_orderkey") % 40 == 0).alias("reviewed"))
    return ops.fold_reviews(events)


def fold_modes(spark, sf_dir):
    events = orders(spark, sf_dir).select(c("o_orderpriority").alias("recording"), c("o_custkey").alias("frame"), c("o_orderkey").alias("at"), (c("o_orderkey") % 3 == 0).alias("exhaustive"))
    return ops.fold_modes(events)


def pool_overview(spark, sf_dir):
    return ops.pool_overview(pool(spark, sf_dir).withColumn("tag", F.when(~c("tag").like("rec7%"), c("tag"))))


def first_pool(spark, sf_dir):
    rows = orders(spark, sf_dir).select(F.concat(F.lit("t"), "o_custkey").alias("tile"), c("o_orderkey").alias("pool_rank"), "o_orderpriority")
    return ops.first_pool(rows)


def tile_ordinals(spark, sf_dir):
    return ops.ordinals(candidates(spark, sf_dir)).select("dataset", "idx", c("ordinal").cast("long").alias("ordinal"))


def synthetic_negatives(spark, sf_dir):
    return ops.synthetic_negatives(set_rows(spark, sf_dir), 4000, 2200)


def class_labels(spark, sf_dir):
    """All labels of a definition of two dimensions: priorities and statuses."""
    rows = orders(spark, sf_dir)
    members = rows.select(F.lit("d").alias("definition"), F.lit(1).alias("position"), c("o_orderpriority").alias("member")).unionByName(rows.select(F.lit("d").alias("definition"), F.lit(2).alias("position"), c("o_orderstatus").alias("member")))
    return ops.labels_of(members)


def label_shares(spark, sf_dir):
    """Labels from picks, with questions left open."""
    pick = ops.label_for([c("o_orderstatus"), F.when(c("o_orderkey") % 3 != 0, c("o_orderpriority"))])
    return orders(spark, sf_dir).groupBy(pick.alias("label")).agg(F.count("*").alias("n"))


def tag_parsing(spark, sf_dir):
    """Names composed from orders and taken apart again."""
    tag = F.concat(F.lit("site/rec"), c("o_custkey") % 9, F.lit("_cnn-20240101-0000"), F.lpad((c("o_orderkey") % 60).cast("string"), 2, "0"), F.when(c("o_orderkey") % 2 == 0, "-20240202-111111").otherwise(""))
    rows = orders(spark, sf_dir).select("o_orderkey", assets.flat(tag).alias("tag")).withColumn("tile", assets.tile_name(c("tag"), c("o_orderkey") % 1000))
    return rows.select("o_orderkey", "tile", assets.tile_tag(c("tile")).alias("tile_tag"), assets.tile_index(c("tile")).alias("tile_index"), assets.peeled(c("tag")).alias("peeled"), assets.recording_of(c("tag")).alias("recording"), assets.group_of(assets.unflat(c("tag"))).alias("folder"))


def _set_sources(spark, sf_dir):
    return orders(spark, sf_dir).select(F.concat(F.lit("set"), c("o_custkey") % 200).alias("set"), F.when(c("o_orderkey") % 11 == 0, "synthetic").otherwise(F.concat(F.lit("rec"), c("o_orderkey") % 97)).alias("source")).distinct()


def _live(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey % 97 < 3").select(F.concat(F.lit("rec"), c("c_custkey") % 97).alias("recording")).distinct()


def orphaned_sets(spark, sf_dir):
    return assets.orphaned_sets(_set_sources(spark, sf_dir), _live(spark, sf_dir))


def known_recordings(spark, sf_dir):
    return assets.recordings_of(_live(spark, sf_dir), _set_sources(spark, sf_dir).where("source <> 'synthetic'").select(c("source").alias("recording")))


def assets_for(spark, sf_dir):
    boxes = table(spark, sf_dir, "supplier").select(F.concat(F.lit("rec"), c("s_suppkey") % 97).alias("recording"), F.concat(F.lit("b"), "s_suppkey").alias("file"))
    tiles = table(spark, sf_dir, "part").select(F.concat(F.lit("rec"), c("p_partkey") % 97).alias("recording"), F.concat(F.lit("t"), "p_partkey").alias("file"))
    made = table(spark, sf_dir, "customer").select(F.concat(F.lit("set"), c("c_custkey") % 200).alias("set"), F.concat(F.lit("c"), "c_custkey").alias("file"))
    found = assets.assets_for(_live(spark, sf_dir), boxes, tiles, _set_sources(spark, sf_dir), made)
    return found.groupBy("recording", "kind").agg(F.count("*").alias("n"), F.min("asset").alias("first"))


def openable(spark, sf_dir):
    tables = table(spark, sf_dir, "customer").select(c("c_custkey").alias("tag"), (c("c_custkey") % 4).alias("boxes"))
    return assets.openable(tables, orders(spark, sf_dir).select(c("o_custkey").alias("tag"))).select("tag")


def candidates_file(spark, sf_dir):
    """The orders of each customer as files of three priorities: the best, where it is the only one."""
    files = orders(spark, sf_dir).select(c("o_custkey").alias("tag"), c("o_orderkey").alias("file"), F.substring("o_orderpriority", 1, 1).alias("priority"))
    return assets.candidates_for(table(spark, sf_dir, "customer").select(c("c_custkey").alias("tag")), files)


def index_cleanup(spark, sf_dir):
    """Index entries left when the tiles of every fourth customer are gone, counted per priority."""
    index = orders(spark, sf_dir).select(c("o_custkey").alias("tile"), "o_orderpriority")
    removed = table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select(c("c_custkey").alias("tile"))
    return assets.without_tiles(index, removed).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def pool_classes(spark, sf_dir):
    """Saved classes and the definitions they were judged under, counted."""
    rows = pool(spark, sf_dir)
    n = ops.definitions_used(rows).agg(F.count("*").alias("definitions"))
    return ops.saved_classes(rows).groupBy("tag", "label").agg(F.count("*").alias("n")).join(F.broadcast(n))


def confirmed_frames(spark, sf_dir):
    return ops.confirmed_frames(set_rows(spark, sf_dir))


def boxes_by_frame(spark, sf_dir):
    out = ops.boxes_by_frame(candidates(spark, sf_dir))
    return out.select("dataset", "frame", F.size("boxes").alias("boxes"), F.size("negatives").alias("negatives"), F.get("boxes", F.lit(0))["idx"].alias("first"))


def other_width(spark, sf_dir):
    frames = derived(spark, sf_dir).select("frame", "frame_width").distinct()
    return ops.other_width(frames, 400).select(c("width").cast("long").alias("width"), "n", "of")


def out_of_reach(spark, sf_dir):
    frames = derived(spark, sf_dir).select("frame", "frame_width", "frame_height").distinct()
    return rounded(ops.out_of_reach(set_rows(spark, sf_dir).join(frames, "frame"), 150))


def candidate_page(spark, sf_dir):
    return ops.candidate_page(candidates(spark, sf_dir), decisions(spark, sf_dir), 1, 50).select("dataset", "idx", "keep", "discard", "height_delta")


def candidate_guesses(spark, sf_dir):
    """The first page with a class offered by the box's shape."""
    guess = F.when(c("width") > 2 * c("height"), "wide").otherwise("tall")
    return ops.candidate_page(candidates(spark, sf_dir), decisions(spark, sf_dir), 0, 50, guess=guess).select("dataset", "idx", "guess")


def negatives_checked(spark, sf_dir):
    """Per frame with objects: whether all background boxes lie inside it, meet no object and none other, and are no more than its objects."""
    columns = ["recording", "frame", *BOX, "placed"]
    objects = set_rows(spark, sf_dir).where(~c("negative")).withColumn("placed", F.lit(False)).select(*columns)
    both = objects.unionByName(synthetic_negatives(spark, sf_dir).withColumn("placed", F.lit(True)).select(*columns))
    both = written(both.withColumn("id", F.monotonically_increasing_id()))
    clash = frame_pairs(both.where("placed"), both, lambda a, b: iou(a, b) > 0, ["recording", "frame"]).where("a_id <> b_id")
    clash = clash.groupBy("recording", "frame").agg(F.count("*").alias("clashes"))
    inside = (c("left") >= 0) & (c("top") >= 0) & (c("left") + c("width") <= 4000) & (c("top") + c("height") <= 2200)
    frames = both.groupBy("recording", "frame").agg((F.bool_and(~c("placed") | inside) & (2 * F.count_if("placed") <= F.count("*"))).alias("fits"))
    return frames.join(clash, ["recording", "frame"], "left").select("recording", "frame", (c("fits") & c("clashes").isNull()).alias("sound"))


def opened_tiles(spark, sf_dir):
    return ops.opened(candidates(spark, sf_dir))


def open_sources(spark, sf_dir):
    closed = orders(spark, sf_dir).select(F.concat(F.lit("rec"), c("o_orderkey") % 3, F.lit("_cnn-20240101-000000")).alias("tag"))
    return ops.open_sources(pool(spark, sf_dir), closed)


def promote_to_set(spark, sf_dir):
    """A set after a merged promotion of the judged pool: rows per source and whether negative."""
    fresh = ops.promoted(pool(spark, sf_dir), candidates(spark, sf_dir), decisions(spark, sf_dir)).where("recording < 'rec4'")
    kinds = {n: "int" for n in ("left", "top", "width", "height")}
    fresh = fresh.withColumns({n: c(n).cast(k) for n, k in kinds.items()})
    merged = ops.promote_to(fresh.select(set_rows(spark, sf_dir).columns), set_rows(spark, sf_dir), "merge")
    return merged.groupBy("source", "negative").agg(F.count("*").alias("n"))


NAMES = (
    "pool_classes", "confirmed_frames", "boxes_by_frame", "other_width", "out_of_reach", "candidate_page", "candidate_guesses", "negatives_checked", "opened_tiles", "open_sources", "promote_to_set",
    "pending_candidates", "corrected_centres", "exhaustive_negatives", "skipped_rows", "fitted_box", "sized_boxes", "promote_rows", "merge_sets", "frame_examples", "class_channel_map",
    "set_summary", "set_meta", "fold_judgements", "fold_reviews", "fold_modes", "pool_overview", "first_pool", "tile_ordinals", "synthetic_negatives", "class_labels", "label_shares",
    "tag_parsing", "orphaned_sets", "known_recordings", "assets_for", "openable", "candidates_file", "index_cleanup",
)
QUERIES = {name: globals()[name] for name in NAMES}

_C = f"""{B}, cand AS (SELECT 'rec' || (frame % 8) || '_cnn-20240101-000000' AS dataset, id AS idx, frame, "left", top, width, height, score, label, id % 11 = 0 AS negative FROM b),
dec AS (SELECT idx, idx % 3 = 1 AS keep, idx % 6 = 2 AS discard, idx % 4 = 0 AS reviewed, CASE WHEN idx % 5 = 0 THEN idx % 7 ELSE 0 END AS dx, CASE WHEN idx % 5 = 0 THEN idx % 4 - 2 ELSE 0 END AS dy, idx % 9 - 8 AS dh FROM cand WHERE idx % 3 <> 0),
ctr AS (SELECT c.*, c."left" + coalesce(dx, 0) AS l2, c.top + coalesce(dy, 0) AS t2, greatest(c.height + coalesce(dh, 0), 4) AS h2, d.keep FROM cand c LEFT JOIN dec d USING (idx))"""
_S = f"""{B}, st AS (SELECT 'rec' || (frame % 8) || '_cnn-20240101-000000' AS recording, frame, "left", top, width, height, CASE WHEN id % 11 <> 0 THEN label END AS label, id % 11 = 0 AS negative,
CASE WHEN id % 13 = 0 THEN 'synthetic' ELSE 'rec' || (frame % 8) || '_cnn-20240101-000000' END AS source FROM b)"""
_SRC = "src AS (SELECT DISTINCT 'set' || (o_custkey % 200) AS s, CASE WHEN o_orderkey % 11 = 0 THEN 'synthetic' ELSE 'rec' || (o_orderkey % 97) END AS source FROM orders), live AS (SELECT DISTINCT 'rec' || (c_custkey % 97) AS recording FROM customer WHERE c_custkey % 97 < 3)"

ORACLES = {
    "pool_classes": f"WITH {_C} SELECT dataset AS tag, label, count(*) AS n, 1::BIGINT AS definitions FROM cand WHERE idx % 2 = 0 AND idx % 5 < 2 GROUP BY 1, 2",
    "confirmed_frames": f"WITH {_S} SELECT recording, frame, count(*) FILTER (NOT negative) AS objects, count(*) FILTER (negative) AS ignored FROM st GROUP BY 1, 2 HAVING count(*) FILTER (NOT negative) > 0",
    "boxes_by_frame": f"WITH {_C} SELECT dataset, frame, (count(*) FILTER (NOT negative))::INTEGER AS boxes, (count(*) FILTER (negative))::INTEGER AS negatives, min(idx) FILTER (NOT negative) AS first FROM cand GROUP BY 1, 2",
    "other_width": f"WITH {B}, f AS (SELECT DISTINCT frame, frame_width FROM b) SELECT frame_width::BIGINT AS width, count(*) AS n, (SELECT count(*) FROM f) AS of FROM f WHERE frame_width <> 400 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "out_of_reach": f"""WITH {_S}, q AS (SELECT recording, negative, greatest(width, height) * (768 / greatest(400 + 100 * (frame % 3), 90)::DOUBLE) AS px FROM st)
SELECT recording, count(*) AS n, round(max(px), 6) AS largest FROM q WHERE NOT negative AND px > 150 / 1.5::DOUBLE GROUP BY 1""",
    "candidate_page": f"WITH {_C} SELECT dataset, idx, keep, discard, dh::INTEGER AS height_delta FROM cand LEFT JOIN dec USING (idx) WHERE NOT coalesce(reviewed, FALSE) ORDER BY dataset, idx LIMIT 50 OFFSET 50",
    "candidate_guesses": f"WITH {_C} SELECT dataset, idx, CASE WHEN width > 2 * height THEN 'wide' ELSE 'tall' END AS guess FROM cand LEFT JOIN dec USING (idx) WHERE NOT coalesce(reviewed, FALSE) ORDER BY dataset, idx LIMIT 50",
    "negatives_checked": f"WITH {_S} SELECT DISTINCT recording, frame, TRUE AS sound FROM st WHERE NOT negative",
    "opened_tiles": f"""WITH {_C}, p AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY idx) - 1 AS k FROM cand WHERE NOT negative)
SELECT dataset || '_k' || lpad(k::VARCHAR, greatest(5, length(k::VARCHAR))::INTEGER, '0') AS tile, dataset AS tag, idx, trunc(median(width) OVER (PARTITION BY dataset))::INTEGER AS tile_width, trunc(median(height) OVER (PARTITION BY dataset))::INTEGER AS tile_height FROM p""",
    "open_sources": f"WITH {_C} SELECT DISTINCT dataset AS tag FROM cand WHERE idx % 2 = 0 AND dataset NOT IN ('rec0_cnn-20240101-000000', 'rec1_cnn-20240101-000000', 'rec2_cnn-20240101-000000')",
    "promote_to_set": f"""WITH {_C}, {_S[_S.index("st AS"):]}, fr AS (SELECT dataset AS recording, frame, l2 AS "left", t2 AS top, width, h2 AS height, dataset AS source, idx % 5 = 2 AS negative FROM ctr WHERE idx % 2 = 0 AND idx % 5 <= 2 AND dataset < 'rec4'),
k AS (SELECT source, negative FROM st WHERE source <> 'synthetic' AND source NOT IN (SELECT source FROM fr) AND NOT EXISTS (SELECT 1 FROM fr WHERE fr.recording = st.recording AND fr.frame = st.frame AND fr."left" = st."left" AND fr.top = st.top AND fr.width = st.width AND fr.height = st.height))
SELECT source, negative, count(*) AS n FROM (SELECT * FROM k UNION ALL SELECT source, negative FROM fr) GROUP BY ALL""",
    "pending_candidates": f"WITH {_C} SELECT dataset, idx FROM cand LEFT JOIN dec USING (idx) WHERE NOT coalesce(reviewed, FALSE) AND NOT coalesce(keep, FALSE) AND NOT coalesce(discard, FALSE)",
    "corrected_centres": f'WITH {_C} SELECT idx, l2 + width // 2 AS x, t2 + h2 // 2 AS y, l2 AS "left", t2 AS top, width::BIGINT AS width, h2 AS height FROM ctr',
    "exhaustive_negatives": f"""WITH {_C}, e AS (SELECT *, idx % 3 <> 0 AND idx % 30 = 1 AS k FROM ctr WHERE frame % 2 = 0), q AS (SELECT frame, idx, l2 + width // 2 AS x, t2 + h2 // 2 AS y FROM e WHERE NOT k)
SELECT * FROM q WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.k AND e.frame = q.frame AND q.x >= l2 AND q.x < l2 + width AND q.y >= t2 AND q.y < t2 + h2)""",
    "skipped_rows": f"""WITH {_S}, r AS (SELECT CASE WHEN "left" % 17 = 0 THEN 'no frame' WHEN top % 19 = 0 THEN 'no area' WHEN NOT negative AND (label IS NULL OR "left" % 23 = 0) THEN 'no label' END AS reason FROM st)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "fitted_box": f"""WITH {_S} SELECT recording, (list_sort(list(width)))[count(*) // 2 + 1]::INTEGER AS width, (list_sort(list(height)))[count(*) // 2 + 1]::INTEGER AS height, trunc(median(width))::INTEGER AS tile_width, trunc(median(height))::INTEGER AS tile_height FROM st GROUP BY 1""",
    "sized_boxes": f"""WITH {_C}, f AS (SELECT dataset, (list_sort(list(width)))[count(*) // 2 + 1] AS w, (list_sort(list(height)))[count(*) // 2 + 1] AS h FROM cand GROUP BY 1)
SELECT idx, ("left" + floor((width - w) / 2))::INTEGER AS "left", (top + floor((height - h) / 2))::INTEGER AS top, w::INTEGER AS width, h::INTEGER AS height, 'fitted' AS size_mode FROM cand JOIN f USING (dataset)""",
    "promote_rows": f'WITH {_C} SELECT dataset AS recording, frame, l2 AS "left", t2 AS top, width::BIGINT AS width, h2 AS height, CASE WHEN idx % 5 < 2 THEN label END AS label, idx % 5 = 2 AS negative FROM ctr WHERE idx % 2 = 0 AND idx % 5 <= 2',
    "merge_sets": f"""WITH {_S}, fr AS (SELECT recording, frame, "left", top, width, height, 'new' AS label, CASE WHEN recording LIKE 'rec1%' THEN recording ELSE 'other' END AS source FROM st WHERE recording LIKE 'rec1%' AND "left" % 2 = 0 OR width % 10 = 3),
k AS (SELECT recording, source, label FROM st WHERE source <> 'synthetic' AND source NOT IN (SELECT source FROM fr) AND NOT EXISTS (SELECT 1 FROM fr WHERE fr.recording = st.recording AND fr.frame = st.frame AND fr."left" = st."left" AND fr.top = st.top AND fr.width = st.width AND fr.height = st.height))
SELECT recording, source, label, count(*) AS n FROM (SELECT * FROM k UNION ALL SELECT recording, source, label FROM fr) GROUP BY ALL""",
    "frame_examples": f'WITH {_S} SELECT recording, frame, (count(*) FILTER (NOT negative))::INTEGER AS objects, (count(*) FILTER (negative))::INTEGER AS negatives, coalesce(sum("left" * width) FILTER (NOT negative), 0)::BIGINT AS digest FROM st GROUP BY 1, 2',
    "class_channel_map": "SELECT o_orderpriority AS label, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS channel FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0)",
    "set_summary": f"""WITH {_S}, f AS (SELECT count(*) FILTER (NOT negative) AS o, count(*) FILTER (negative) AS n FROM st GROUP BY recording, frame), l AS (SELECT label, count(*) AS n FROM st WHERE NOT negative GROUP BY 1 ORDER BY 2, 1 LIMIT 1)
SELECT count(*) AS frames, sum(o)::BIGINT AS objects, sum(f.n)::BIGINT AS negatives, max(o) AS most_in_a_frame, any_value(l.label) AS thinnest, any_value(l.n) AS thinnest_rows FROM f, l""",
    "set_meta": f"WITH {_S} SELECT source, (sum(count(*)) OVER (PARTITION BY source))::BIGINT AS rows, CASE WHEN negative THEN '(negative)' ELSE label END AS label, count(*) AS n FROM st GROUP BY 1, 3",
    "fold_judgements": """WITH e AS (SELECT o_custkey AS k, o_orderkey AS t, CASE WHEN o_orderkey % 5 = 0 THEN 'exclude' WHEN o_orderkey % 7 = 0 THEN 'clear' ELSE 'label' END AS a, o_orderpriority AS l FROM orders
UNION ALL SELECT c_custkey, -1, CASE WHEN c_custkey % 2 = 0 THEN 'exclude' ELSE 'label' END, 'old' FROM customer), x AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY t DESC) = 1)
SELECT 't' || k AS tile, CASE WHEN a = 'label' THEN l END AS label, a = 'exclude' AS excluded FROM x WHERE a <> 'clear'""",
    "fold_reviews": "SELECT 'd' AS dataset, o_custkey AS idx, sum(o_orderkey % 7 - 3)::BIGINT AS height_delta, count(*) FILTER (o_orderkey % 40 = 0) > 0 AS reviewed FROM orders GROUP BY 2",
    "fold_modes": "SELECT o_orderpriority AS recording, o_custkey AS frame, TRUE AS exhaustive FROM orders GROUP BY 1, 2 HAVING max(o_orderkey) % 3 = 0",
    "pool_overview": f"WITH {_C} SELECT CASE WHEN dataset LIKE 'rec7%' THEN 'untagged' ELSE dataset END AS tag, count(*) AS tiles, count(*) FILTER (idx % 5 < 2) AS labelled, count(*) FILTER (idx % 5 = 2) AS excluded, count(*) FILTER (idx % 5 > 2) AS open FROM cand WHERE idx % 2 = 0 GROUP BY 1",
    "first_pool": "SELECT 't' || o_custkey AS tile, min(o_orderkey) AS pool_rank, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey",
    "tile_ordinals": f"WITH {_C} SELECT dataset, idx, row_number() OVER (PARTITION BY dataset ORDER BY idx) - 1 AS ordinal FROM cand WHERE NOT negative",
    "class_labels": "SELECT 'd' AS definition, a.o_orderpriority || ' / ' || b.o_orderstatus AS label FROM (SELECT DISTINCT o_orderpriority FROM orders) a, (SELECT DISTINCT o_orderstatus FROM orders) b",
    "label_shares": "SELECT o_orderstatus || ' / ' || CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority ELSE 'n/a' END AS label, count(*) AS n FROM orders GROUP BY 1",
    "tag_parsing": """WITH n AS (SELECT o_orderkey, 'site__rec' || (o_custkey % 9) AS r, '_cnn' AS k, '-20240101-0000' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || CASE WHEN o_orderkey % 2 = 0 THEN '-20240202-111111' ELSE '' END AS stamp FROM orders)
SELECT o_orderkey, r || k || stamp || '_k' || lpad((o_orderkey % 1000)::VARCHAR, 5, '0') AS tile, r || k || stamp AS tile_tag, o_orderkey % 1000 AS tile_index, r || k AS peeled, r AS recording, 'site' AS folder FROM n""",
    "orphaned_sets": f"WITH {_SRC} SELECT DISTINCT s AS \"set\" FROM src WHERE source <> 'synthetic' AND s NOT IN (SELECT s FROM src JOIN live ON source = recording)",
    "known_recordings": f"WITH {_SRC} SELECT recording, TRUE AS live FROM live UNION ALL SELECT DISTINCT source, FALSE FROM src WHERE source <> 'synthetic' AND source NOT IN (SELECT recording FROM live)",
    "assets_for": f"""WITH {_SRC}, a AS (SELECT 'rec' || (s_suppkey % 97) AS recording, 'boxes' AS kind, 'b' || s_suppkey AS asset FROM supplier UNION SELECT 'rec' || (p_partkey % 97), 'tiles', 't' || p_partkey FROM part
UNION SELECT source, 'set', s FROM src UNION SELECT source, 'checkpoint', 'c' || c_custkey FROM src JOIN customer ON s = 'set' || (c_custkey % 200))
SELECT recording, kind, count(*) AS n, min(asset) AS first FROM a WHERE recording IN (SELECT recording FROM live) GROUP BY 1, 2""",
    "openable": "SELECT c_custkey AS tag FROM customer WHERE c_custkey % 4 > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "candidates_file": """WITH f AS (SELECT o_custkey AS tag, o_orderkey AS file, substr(o_orderpriority, 1, 1) AS p FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT tag, any_value(file) AS file FROM f WHERE p = (SELECT min(p) FROM f g WHERE g.tag = f.tag) GROUP BY tag HAVING count(*) = 1""",
    "index_cleanup": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0) GROUP BY 1",
}
