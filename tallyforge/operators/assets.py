"""Recordings and what belongs to them: names, listings, owners and orphans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAMP = r"(-[0-9]{8}-[0-9]{6})+$"


def flat(path: Column) -> Column:
    """A path as one name."""
    return F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), "/", "__")


def unflat(tag: Column) -> Column:
    return F.regexp_replace(tag, "__", "/")


def tile_tag(tile: Column) -> Column:
    """The dataset of a tile named ``<tag>_k<number>``."""
    return F.regexp_extract(tile, r"^(.*)_k[0-9]+(\.[a-z]+)?$", 1)


def tile_index(tile: Column) -> Column:
    return F.regexp_extract(tile, r"_k([0-9]+)(\.[a-z]+)?$", 1).try_cast("long")


def tile_name(tag: Column, index: Column) -> Column:
    return F.format_string("%s_k%05d", tag, index)


def peeled(tag: Column) -> Column:
    """A tag without the stamps of the runs that made it."""
    return F.regexp_replace(tag, STAMP, "")


def recording_of(tag: Column) -> Column:
    return F.regexp_replace(peeled(tag), r"_(cnn|boxes|drawn)$", "")


def group_of(path: Column) -> Column:
    """The folder a path lies in."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def candidates_for(tags: DataFrame, files: DataFrame) -> DataFrame:
    """``tag, file``: each tag's candidates by the files' priority; tags with two files of one priority are left out."""
    best = Window.partitionBy("tag").orderBy("priority")
    same = Window.partitionBy("tag", "priority")
    both = tags.join(files, "tag").withColumns({"r": F.rank().over(best), "n": F.count("*").over(same)})
    return both.where("r = 1 AND n = 1").select("tag", "file")


def assets_for(recordings: DataFrame, boxes: DataFrame, tiles: DataFrame, set_sources: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """``recording, kind, asset``: boxes and tiles by tag, sets by their sources, checkpoints by their set."""
    r = recordings.select("recording").distinct()
    own = boxes.select("recording", F.lit("boxes").alias("kind"), F.col("file").alias("asset")).unionByName(tiles.select("recording", F.lit("tiles").alias("kind"), F.col("file").alias("asset")))
    sets = set_sources.select(F.col("source").alias("recording"), "set").distinct()
    made = checkpoints.join(sets, "set").select("recording", F.lit("checkpoint").alias("kind"), F.col("file").alias("asset"))
    every = own.unionByName(sets.select("recording", F.lit("set").alias("kind"), F.col("set").alias("asset"))).unionByName(made)
    return every.join(r, "recording", "left_semi").distinct()


def orphaned_sets(set_sources: DataFrame, live: DataFrame) -> DataFrame:
    """Sets none of whose sources still exists; synthetic sources don't count."""
    alive = live.select(F.col("recording").alias("source")).distinct().withColumn("alive", F.lit(True))
    return set_sources.where("source <> 'synthetic'").join(alive, "source", "left").groupBy("set").agg(F.bool_or(F.coalesce("alive", F.lit(False))).alias("any")).where("NOT any").select("set")


def recordings_of(existing: DataFrame, referenced: DataFrame) -> DataFrame:
    """``recording, live``: all recordings, and whether each still exists or is only referred to."""
    have = existing.select("recording").distinct().withColumn("live", F.lit(True))
    return have.unionByName(referenced.select("recording").distinct().join(have, "recording", "left_anti").withColumn("live", F.lit(False)))


def openable(tables: DataFrame, pool: DataFrame) -> DataFrame:
    """Tables with boxes that are not in the pool yet."""
    return tables.where("boxes > 0").join(pool.select("tag").distinct(), "tag", "left_anti")


def without_tiles(index: DataFrame, removed: DataFrame) -> DataFrame:
    """Index entries whose tile was not removed."""
    return index.join(removed.select("tile").distinct(), "tile", "left_anti")
