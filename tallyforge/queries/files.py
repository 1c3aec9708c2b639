"""Sources and sinks: the given tables written in each format to the shared folder and read back whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import views
from tallyforge.queries.common import c, orders, table
from tallyforge.sources import files
from tallyforge.sources.shared import new_path

#: What stands in for text that only cp1252 and UTF-16 hold: an umlaut, the euro sign, a quoted line break.
_NOTE = "concat('Köln \u20ac', o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN ';\\nx' ELSE '' END)"


def _orders(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_totalprice", F.expr(_NOTE).alias("note"))


def _read_back(rows):
    return rows.select(c("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority", c("o_totalprice").cast("double").alias("o_totalprice"), "note")


def file_delimited(spark, sf_dir):
    """Half of the orders as UTF-16 with tabs, half as UTF-8 with semicolons, in one folder: each file's kind is found."""
    path = new_path(spark)
    rows = _orders(spark, sf_dir)
    for half, sep, encoding in ((0, "\t", "UTF-16"), (1, ";", "UTF-8")):
        writer = rows.where(c("o_orderkey") % 2 == half).write.mode("append").option("header", True).option("escape", '"')
        writer.option("sep", sep).option("encoding", encoding).csv(path)
    return _read_back(files.read_delimited(spark, path + "/*.csv", schema=rows.schema))


def file_cp1252(spark, sf_dir):
    """Orders as cp1252: written as ISO-8859-1 with the euro sign at its place in cp1252, found and put right on reading."""
    path = new_path(spark)
    rows = _orders(spark, sf_dir)
    raw = rows.withColumn("note", F.translate("note", "\u20ac", "\x80"))
    raw.write.option("header", True).option("sep", ";").option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    return _read_back(files.read_delimited(spark, path + "/*.csv"))


def file_late_sign(spark, sf_dir):
    """Orders by key as cp1252, of which only the very last line holds a sign that tells it from UTF-8."""
    path = new_path(spark)
    rows = orders(spark, sf_dir).select("o_orderkey", "o_orderpriority", "o_totalprice")
    last = rows.agg(F.max("o_orderkey").alias("last"))  # one row
    raw = rows.join(F.broadcast(last)).withColumn("note", F.when(c("o_orderkey") == c("last"), "Köln").otherwise("plain")).drop("last")
    raw.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return _read_back(files.read_delimited(spark, path + "/*.csv"))


def file_frame_sizes(spark, sf_dir):
    """Images of which there is a header only, one for each nation, and a file that is none: sizes by the headers."""
    path = new_path(spark)
    n = F.col("n_nationkey")
    number = lambda x: F.lpad(F.hex(x.cast("int")), 8, "0")
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(100 + n), number(2000 - 3 * n), F.lit("0802000000"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", F.unhex(head).cast("string").alias("value")).unionByName(spark.range(1).select(F.lit(-1).alias("n_nationkey"), F.lit("no image").alias("value")), allowMissingColumns=True)
    rows.repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    sizes = files.frame_sizes(spark, path)
    return sizes.select(F.regexp_extract("path", r"n_nationkey=(-?\d+)", 1).cast("int").alias("nation"), "frame_width", "frame_height")


def file_encodings(spark, sf_dir):
    """What is found out about the files of three encodings: how many kinds of first line each has."""
    path = new_path(spark)
    rows = orders(spark, sf_dir).select("o_orderkey", F.lit("ü").alias("sign"))
    for k, encoding in enumerate(("UTF-16", "UTF-8", "ISO-8859-1")):
        rows.where(c("o_orderkey") % 3 == k).write.mode("append").option("header", True).option("encoding", encoding).csv(path)
    found = files.encodings(spark, path + "/*.csv")
    return found.groupBy("encoding").agg(F.max("line").alias("line"))


def file_json(spark, sf_dir):
    path = new_path(spark)
    rows = _orders(spark, sf_dir)
    files.write_lines(rows, path)
    return _read_back(files.read_json(spark, path, rows.schema))


def file_lines(spark, sf_dir):
    """Candidates as JSON lines, a file for each part of the keys, each line addressed by its file and place."""
    path = new_path(spark)
    rows = orders(spark, sf_dir).select("o_orderkey", (c("o_orderkey").bitwiseAND(0) + F.expr("o_orderkey div 20000")).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "o_orderkey").write.partitionBy("part").json(path)
    found = files.read_lines(spark, path + "/part=*", "o_orderkey long", places=True)
    return found.select("o_orderkey", c("place").cast("long").alias("place"))


def _broken(spark, sf_dir):
    path = new_path(spark)
    line = F.when(c("o_orderkey") % 10 == 0, F.lit('{"k": 1, ')).otherwise(F.to_json(F.struct(c("o_orderkey").alias("k"))))
    orders(spark, sf_dir).select(line.alias("value")).write.text(path)
    return path


def file_lines_skipping(spark, sf_dir):
    return files.read_lines(spark, _broken(spark, sf_dir), "k long", skip_bad=True).select("k")


def file_bad_lines(spark, sf_dir):
    return files.bad_lines(spark, _broken(spark, sf_dir), "k long")


def _keyed(spark, sf_dir, value):
    """Keyed JSON sidecars, one for every 4,000 keys, each one object."""
    path = new_path(spark)
    part = F.expr("o_orderkey div 4000")
    rows = orders(spark, sf_dir).groupBy(part.alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(c("o_orderkey").cast("string"), value)))).alias("value"))
    rows.repartition("part").write.partitionBy("part").option("maxRecordsPerFile", 1).text(path)
    return path + "/part=*"


def file_keyed(spark, sf_dir):
    """Labels by tile."""
    value = F.struct(F.when(c("o_orderkey") % 5 != 0, c("o_orderpriority")).alias("label"), F.when(c("o_orderkey") % 5 == 0, F.lit(True)).alias("excluded"))
    return files.read_keyed(spark, _keyed(spark, sf_dir, value)).select("key", "label", "excluded")


def file_decisions(spark, sf_dir):
    """Judgements by candidate."""
    rect = F.struct(*[(c("o_orderkey") % k).cast("int").alias(n) for n, k in (("left", 90), ("top", 60), ("width", 40), ("height", 20))])
    value = F.struct((c("o_orderkey") % 3 == 0).alias("keep"), F.when(c("o_orderkey") % 4 == 0, F.lit(True)).alias("reviewed"), F.when(c("o_orderkey") % 2 == 0, rect).alias("rect"), (c("o_orderkey") % 9 - 4).cast("int").alias("height_delta"))
    found = files.read_decisions(spark, _keyed(spark, sf_dir, value))
    return found.select("idx", "keep", "discard", "reviewed", c("rect.left").alias("left"), c("rect.height").alias("height"), "height_delta")


def file_modes(spark, sf_dir):
    """Frames' modes."""
    return files.read_modes(spark, _keyed(spark, sf_dir, c("o_orderkey") % 3 == 1)).select("frame", "exhaustive")


def file_provenance(spark, sf_dir):
    """Sets' meta files that name their sources."""
    path = new_path(spark)
    source = F.when(c("o_orderkey") % 11 == 0, "synthetic").otherwise(F.concat(F.lit("rec"), c("o_orderkey") % 97))
    orders(spark, sf_dir).groupBy((c("o_custkey") % 200).alias("k")).agg(F.collect_set(source).alias("sources")).select("k", "sources").write.partitionBy("k").json(path)
    found = files.read_sources(spark, path + "/k=*")
    return found.select(F.regexp_extract("file", "k=([0-9]+)", 1).alias("k"), "source")


def file_listing(spark, sf_dir):
    """A listing of a partitioned table's folders: which parts hold files that are not empty."""
    path = new_path(spark)
    files.write_table(orders(spark, sf_dir).select("o_orderkey", (c("o_custkey") % 50).alias("k")), path, ["k"])
    found = files.listing(spark, path, "*.parquet").where("length > 0")
    return found.select(F.regexp_extract("path", "k=([0-9]+)", 1).alias("k")).distinct()


def file_feature_maps(spark, sf_dir):
    """Maps of features as JSON lines, bare and wrapped."""
    path = new_path(spark)
    bare = F.to_json(F.create_map(F.lit("key"), c("o_orderkey").cast("double"), F.lit("price"), "o_totalprice"))
    wrapped = F.concat(F.lit('{"features":'), bare, F.lit("}"))
    orders(spark, sf_dir).select(F.when(c("o_orderkey") % 2 == 0, bare).otherwise(wrapped).alias("value")).write.text(path)
    return files.read_feature_maps(spark, path).select(F.col("features")["key"].alias("key"), F.col("features")["price"].alias("price"))


def file_run(spark, sf_dir):
    """A run's tables and its summary."""
    path = new_path(spark)
    rows = orders(spark, sf_dir).select("o_orderkey", "o_totalprice")
    files.write_run(path, {"forecast": rows}, rows.agg(F.count("*").alias("rows")))
    summary = spark.read.schema("rows long").json(path + "/result")
    return spark.read.parquet(path + "/forecast").join(F.broadcast(summary))  # one row


def file_export(spark, sf_dir):
    """A CSV export with its verdict on every line."""
    path = new_path(spark)
    files.write_export(views.export(orders(spark, sf_dir).select("o_orderkey", "o_orderpriority"), False), path)
    return spark.read.option("header", True).schema("o_orderkey long, o_orderpriority string, verdict string").csv(path)


def file_prepared(spark, sf_dir):
    """A prepared table that is built once and read the second time; the key names its source's files."""
    folder, key = new_path(spark), files.fingerprint(spark, f"{sf_dir}/orders.parquet")
    first = orders(spark, sf_dir).groupBy("o_custkey").agg(F.count("*").alias("n"))
    files.prepared(spark, lambda: first, folder, key)
    return files.prepared(spark, lambda: first.where("false"), folder, key)


NAMES = ("file_delimited", "file_cp1252", "file_late_sign", "file_frame_sizes", "file_encodings", "file_json", "file_lines", "file_lines_skipping", "file_bad_lines", "file_keyed", "file_decisions", "file_modes", "file_provenance", "file_listing", "file_feature_maps", "file_run", "file_export", "file_prepared")
QUERIES = {name: globals()[name] for name in NAMES}
_ROWS = "SELECT o_orderkey, o_orderpriority, o_totalprice, 'Köln \u20ac' || o_custkey || CASE WHEN o_orderkey % 7 = 0 THEN ';' || chr(10) || 'x' ELSE '' END AS note FROM orders"
ORACLES = {
    "file_delimited": _ROWS,
    "file_cp1252": _ROWS,
    "file_frame_sizes": "SELECT n_nationkey::INTEGER AS nation, (100 + n_nationkey)::INTEGER AS frame_width, (2000 - 3 * n_nationkey)::INTEGER AS frame_height FROM nation",
    "file_late_sign": "SELECT o_orderkey, o_orderpriority, o_totalprice, CASE WHEN o_orderkey = max(o_orderkey) OVER () THEN 'Köln' ELSE 'plain' END AS note FROM orders",
    "file_encodings": "SELECT * FROM (VALUES ('utf-16', 'o_orderkey,sign'), ('utf-8', 'o_orderkey,sign'), ('cp1252', 'o_orderkey,sign')) t(encoding, line)",
    "file_json": _ROWS,
    "file_lines": "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey // 20000 ORDER BY o_orderkey) - 1 AS place FROM orders",
    "file_lines_skipping": "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 10 <> 0",
    "file_bad_lines": "SELECT count(*) FILTER (o_orderkey % 10 = 0) AS bad FROM orders",
    "file_keyed": "SELECT o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS label, o_orderkey % 5 = 0 AS excluded FROM orders",
    "file_decisions": """SELECT o_orderkey AS idx, o_orderkey % 3 = 0 AS keep, FALSE AS discard, o_orderkey % 4 = 0 AS reviewed, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 90)::INTEGER END AS "left",
CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 20)::INTEGER END AS height, (o_orderkey % 9 - 4)::INTEGER AS height_delta FROM orders""",
    "file_modes": "SELECT o_orderkey::VARCHAR AS frame, o_orderkey % 3 = 1 AS exhaustive FROM orders",
    "file_provenance": "SELECT DISTINCT (o_custkey % 200)::VARCHAR AS k, 'rec' || (o_orderkey % 97) AS source FROM orders WHERE o_orderkey % 11 <> 0",
    "file_listing": "SELECT DISTINCT (o_custkey % 50)::VARCHAR AS k FROM orders",
    "file_feature_maps": "SELECT o_orderkey::DOUBLE AS key, o_totalprice AS price FROM orders",
    "file_run": "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders) AS rows FROM orders",
    "file_export": "SELECT o_orderkey, o_orderpriority, 'not trusted' AS verdict FROM orders",
    "file_prepared": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1",
}
