"""Reading and writing: delimited files of unknown encoding and number format, JSON, JSON lines, listings, tables."""

from __future__ import annotations

import codecs
import csv
import hashlib
import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.sources.shared import written

DECIMAL_COMMA, THOUSANDS_COMMA = r"^\s*-?\d{1,3}(\.\d{3})*,\d+\s*$|^\s*-?\d+,\d+\s*$", r"^\s*-?\d{1,3}(,\d{3})+(\.\d+)?\s*$"
PLAIN = r"^\s*-?\d+(\.\d+)?\s*$"
SEPARATORS = ",;\t|"


def resolve_encoding(head: bytes, requested: str | None = None, utf8: bool | None = None) -> str:
    """The requested encoding, else what a byte order mark says, else UTF-8 where it fits, else cp1252.

    ``utf8`` says whether all bytes of the file are UTF-8; without it ``head`` is all there is."""
    if requested and requested != "auto":
        return codecs.lookup(requested).name
    if head.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    if utf8 is None:
        try:
            head.decode("utf-8")
            utf8 = True
        except UnicodeDecodeError:
            utf8 = False
    if not utf8:
        return "cp1252"
    return "utf-8-sig" if head.startswith(codecs.BOM_UTF8) else "utf-8"


def sniff_separator(line: str) -> str:
    return max(SEPARATORS, key=lambda s: (line.count(s), -SEPARATORS.index(s)))


#: Bytes of a first line that are looked at for its separator and its names.
HEAD_BYTES = 1 << 16


def _raw_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, size, block, at, value``: lines as they stand, which end at newlines only; ``block`` is where the split
    that holds a line begins in its file, ``at`` orders the lines of a block. Long files are many splits."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def _blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One stored row for each split of each file: its bytes and lines, where its lines begin, whether they are UTF-8, and
    how many of them have an odd number of quotes; one pass over all bytes in the JVM."""
    begin = F.min(F.when((F.col("block") == 0) & (F.trim("value") != ""), F.col("at"))).alias("head_at")
    sums = F.max("size").alias("size"), F.sum(F.octet_length("value") + 1).alias("bytes"), F.bool_and(F.is_valid_utf8("value")).alias("utf8")
    return written(_raw_lines(spark, path).groupBy("path", "block").agg(*sums, begin, F.min("at").alias("least"), F.sum(_odd_quotes()).alias("odd")))


def _odd_quotes() -> Column:
    """1 for a line whose quotes are odd in number, else 0."""
    return (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))) % 2


def first_lines(spark: SparkSession, path: str, blocks: DataFrame, *facts: Column) -> DataFrame:
    """``path, head`` and aggregates over a file's splits: the first bytes of each file's first line that isn't blank."""
    found = blocks.groupBy("path").agg(F.min("head_at").alias("at"), *facts)
    heads = _raw_lines(spark, path).where("block = 0").select("path", "at", F.substring(F.col("value").cast("binary"), 1, HEAD_BYTES).alias("head"))
    return found.join(heads, ["path", "at"], "left").drop("at")


def encodings(spark: SparkSession, path: str, blocks: DataFrame | None = None) -> DataFrame:
    """``path, encoding, line, odd`` of every file that isn't empty: its encoding, told from all of its bytes, its first
    line, and whether it has a line with an odd number of quotes.

    Lines are checked in the JVM wherever they are split to. Spark's line reader drops the mark of UTF-8 at a file's
    start, so it shows in a file that is longer than its lines.
    """
    bare = F.max("size") - F.sum("bytes")
    found = first_lines(spark, path, _blocks(spark, path) if blocks is None else blocks, F.bool_and("utf8").alias("utf8"), (bare >= 2).alias("marked"), (F.sum("odd") > 0).alias("odd"))

    def tell(batches):
        for batch in batches:
            heads = [b"" if h is None else (codecs.BOM_UTF8 if m else b"") + bytes(h) for h, m in zip(batch["head"], batch["marked"])]
            batch["encoding"] = [resolve_encoding(h, utf8=bool(u)) for h, u in zip(heads, batch["utf8"])]
            batch["line"] = [(h.decode(k, errors="ignore").splitlines() or [""])[0] for h, k in zip(heads, batch["encoding"])]
            yield batch[["path", "encoding", "line", "odd"]]

    return found.mapInPandas(tell, "path string, encoding string, line string, odd boolean")


#: What cp1252 has where ISO-8859-1 has control characters; the five places that it leaves free stay.
_CP1252 = {b: bytes([b]).decode("cp1252", errors="ignore") for b in range(0x80, 0xA0)}
_FROM, _TO = "".join(chr(b) for b, c in _CP1252.items() if c), "".join(_CP1252.values())


def _read_kind(spark: SparkSession, paths: list[str], kind: str, sep: str, schema: T.StructType | None, breaks: bool) -> DataFrame:
    """Files of one encoding and separator by Spark's reader. cp1252, which it does not take, differs from ISO-8859-1,
    which it does, in characters that are put right afterwards."""
    names = {"utf-16": "UTF-16", "cp1252": "ISO-8859-1", "utf-8": "UTF-8", "utf-8-sig": "UTF-8"}
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    reader = reader.option("encoding", names.get(kind, kind)).option("multiLine", breaks)
    rows = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(paths)
    if kind != "cp1252":
        return rows
    mended = [(F.translate(F.col(f"`{f.name}`"), _FROM, _TO) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")).alias(f.name.translate(str.maketrans(_FROM, _TO))) for f in rows.schema.fields]
    return rows.select(*mended)


def records(spark: SparkSession, paths: str | list[str], blocks: DataFrame | None = None) -> DataFrame:
    """``path, first, value``: records of files whose quoted fields may hold line breaks; ``first`` marks a file's first.

    A line with an odd number of quotes opens a record of several lines or ends one, in turn, so the number of such
    lines before a line tells which record it is part of. They are counted per split first, so every split knows how it
    begins; only splits with such a line, or that begin within a record, are sorted, and only lines of records that
    have several are put together. All others are passed on where they are read. ``blocks`` are those of the same paths.
    """
    lines = _raw_lines(spark, paths).withColumn("odd", _odd_quotes())
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = (_blocks(spark, paths) if blocks is None else blocks).withColumn("before", F.coalesce(F.sum("odd").over(earlier), F.lit(0)))
    counts = counts.select(F.col("path").alias("p"), F.col("block").alias("b"), "before", "least", ((F.col("odd") > 0) | (F.col("before") % 2 == 1)).alias("broken"))
    known = lines.join(counts, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b")))
    known = known.withColumn("first", (F.col("block") == 0) & (F.col("at") == F.col("least")))
    inside = Window.partitionBy("path", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    torn = known.where("broken").withColumn("turn", F.col("before") + F.coalesce(F.sum("odd").over(inside), F.lit(0)))
    alone = (F.col("turn") % 2 == 0) & (F.col("odd") == 0)
    several = torn.where(~alone).groupBy("path", F.floor(F.col("turn") / 2).alias("record"))
    joined = several.agg(F.bool_or("first").alias("first"), F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("parts"))
    joined = joined.select("path", "first", F.array_join(F.col("parts.value"), "\n").alias("value"))
    return known.where("NOT broken").select("path", "first", "value").union(torn.where(alone).select("path", "first", "value")).union(joined)


#: Types that a column of text is tried as, in this order, with what its values must look like besides.
TRIED = {"int": ".", "bigint": ".", "double": r"\d", "date": r"^\d{4}-\d{2}-\d{2}$", "timestamp": r"^\d{4}-\d{2}-\d{2}[T ]\d", "boolean": "^(?i)(true|false)$"}


def _inferred(rows: DataFrame) -> T.StructType:
    """The first type of TRIED that all values of each text column have; one pass, one row."""
    fits = [F.coalesce(F.bool_and(F.col(f"`{n}`").isNull() | F.col(f"`{n}`").try_cast(t).isNotNull() & F.col(f"`{n}`").rlike(look)) & F.bool_or(F.col(f"`{n}`").isNotNull()), F.lit(False)) for n in rows.columns for t, look in TRIED.items()]
    found = rows.agg(*[f.alias(f"f{i}") for i, f in enumerate(fits)]).first()
    kind = lambda i: next((t for k, t in enumerate(TRIED) if found[i * len(TRIED) + k]), "string")
    return T.StructType([T.StructField(n, T._parse_datatype_string(kind(i))) for i, n in enumerate(rows.columns)])


def _read_records(spark: SparkSession, paths: str | list[str], kind: str, sep: str, names: list[str], schema: T.StructType | None, blocks: DataFrame | None) -> DataFrame:
    """Files of one encoding, separator and header, parsed record by record; a long file is many tasks."""
    text = F.col("value")
    if kind == "cp1252":
        text = F.translate(F.decode(text.cast("binary"), "ISO-8859-1"), _FROM, _TO)
    names = [n if n.strip() else f"_c{i}" for i, n in enumerate(names)]
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    shape = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    found = records(spark, paths, blocks).where(~F.col("first")).select(F.rtrim(text, F.lit("\r")).alias("value")).where("value <> ''")
    rows = found.select(F.from_csv("value", shape.simpleString()[7:-1].replace(":", " "), options).alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])
    if schema is None:
        rows = written(rows)  # records are put together once, for their types and for the result
        schema = _inferred(rows)
    given = {f.name: f.dataType for f in schema.fields}
    typed = [F.col(f"`{n}`").try_cast(given[n]).alias(n) for n in names if n in given]
    return rows.select(*typed, *[F.lit(None).cast(t).alias(n) for n, t in given.items() if n not in names]).select(*[f"`{n}`" for n in given])


def read_delimited(spark: SparkSession, path: str, encoding: str | None = None, separator: str | None = None, schema: T.StructType | None = None, breaks: bool = True) -> DataFrame:
    """Delimited files with a header. Encoding and separator are found for each file where not given, the encoding from
    all of its bytes; files of several kinds are read by kind and put together by name.

    Quoted fields may hold line breaks; a long file is many tasks all the same, but for UTF-16, which is read as a
    whole. ``breaks=False`` says that none do. Spark's own reader takes the files where none do."""
    told = resolve_encoding(b"", encoding) if encoding and encoding != "auto" else None
    blocks = _blocks(spark, path)
    kinds: dict[tuple[str, str, str], list] = {}
    for row in encodings(spark, path, blocks).orderBy("path").collect():  # one short row per file, as the reader's own listing has
        kinds.setdefault((told or row["encoding"], separator or sniff_separator(row["line"]), row["line"]), []).append(row)
    whole = None
    for (kind, sep, line), rows in kinds.items():
        paths, torn = [r["path"] for r in rows], breaks and any(r["odd"] for r in rows)
        if torn and kind in ("utf-8", "utf-8-sig", "cp1252"):
            # splits and the order of lines are those of one and the same scan; files of one kind among several are another
            scan = (path, blocks) if len(kinds) == 1 else (paths, None)
            part = _read_records(spark, scan[0], kind, sep, next(csv.reader([line], delimiter=sep)), schema, scan[1])
        else:
            part = _read_kind(spark, paths, kind, sep, schema, torn or kind.startswith("utf-16"))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    if whole is None:
        raise ValueError(f"no file at {path}")
    return whole


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON files that each hold one array or one object a line."""
    kinds: dict[bool, list[str]] = {}
    array = F.ltrim(F.col("head").cast("string")).startswith("[")
    for row in first_lines(spark, path, _blocks(spark, path)).select("path", F.coalesce(array, F.lit(False)).alias("array")).orderBy("path").collect():  # one short row per file
        kinds.setdefault(row["array"], []).append(row["path"])
    whole = None
    for array, paths in kinds.items():
        reader = spark.read.schema(schema) if schema else spark.read
        part = reader.option("multiLine", array).json(paths)
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    if whole is None:
        raise ValueError(f"no file at {path}")
    return whole


def number_formats(rows: DataFrame) -> DataFrame:
    """``column, format`` of each text column: decimal_comma or thousands_comma where all of its values fit; one pass."""
    texts = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType)]

    def kind(c: str):
        v = F.when(F.trim(F.col(c)) != "", F.col(c))
        fits = lambda p: F.coalesce(F.bool_and(v.rlike(p)), F.lit(False))
        decimal = F.coalesce(F.bool_and(v.rlike(DECIMAL_COMMA) | v.rlike(PLAIN)), F.lit(False)) & F.coalesce(F.bool_or(v.rlike(DECIMAL_COMMA) & ~v.rlike(THOUSANDS_COMMA)), F.lit(False))
        grouped = F.coalesce(F.bool_and(v.rlike(THOUSANDS_COMMA) | v.rlike(PLAIN)), F.lit(False)) & F.coalesce(F.bool_or(v.rlike(THOUSANDS_COMMA)), F.lit(False))
        return F.struct(F.lit(c).alias("column"), F.when(fits(PLAIN), F.lit(None)).when(decimal, "decimal_comma").when(grouped, "thousands_comma").alias("format"))

    return rows.agg(F.array(*[kind(c) for c in texts]).alias("k")).select(F.inline("k"))


def parsed_number(value, form: str):
    """A locale-formatted number as a double, null where it does not parse."""
    text = F.trim(value)
    text = F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if form == "decimal_comma" else F.replace(text, F.lit(","), F.lit(""))
    return text.try_cast("double")


def typed_numbers(rows: DataFrame) -> DataFrame:
    """``rows`` with locale-formatted text columns as doubles."""
    formats = {r["column"]: r["format"] for r in number_formats(rows).collect() if r["format"]}
    return rows.withColumns({c: parsed_number(F.col(c), f) for c, f in formats.items()}) if formats else rows


#: Samples of a column, and parts in which a column's values are looked through for them.
SAMPLES, SAMPLE_PARTS = 5, 64


def describe(rows: DataFrame, mode: str = "series") -> DataFrame:
    """One row per column: kind, distinct and missing counts, up to five samples and a suggested role.

    Each (column, value) is counted once, however many rows have it; samples are a column's least values as text.
    """
    kinds = {"string": "text", "date": "date", "timestamp": "date", "timestamp_ntz": "date", "boolean": "text"}
    roles = {"text": "dimension", "date": "anchor" if mode == "row" else "time", "number": "measure"}
    fields = [(f.name, kinds.get(f.dataType.typeName(), "number")) for f in rows.schema.fields]
    pairs = rows.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n, _ in fields])))
    counts = pairs.groupBy("column", "value").agg(F.count("*").alias("n"))
    facts = counts.groupBy("column").agg(F.count("value").alias("levels"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"))
    best = lambda *by: F.row_number().over(Window.partitionBy("column", *by).orderBy("value"))
    some = counts.where("value IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("value"), F.lit(SAMPLE_PARTS)))
    some = some.withColumn("k", best("part")).where(F.col("k") <= SAMPLES).withColumn("k", best()).where(F.col("k") <= SAMPLES)
    samples = some.groupBy("column").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    named = rows.sparkSession.createDataFrame([(n, k, roles[k]) for n, k in fields], "column string, kind string, role string")
    out = named.join(facts, "column", "left").join(samples, "column", "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("column", "kind", count("levels"), count("missing"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), "role")


def fingerprint(spark: SparkSession, path: str, name_only: bool = True) -> str:
    """A digest of the files below ``path``, taken from their names, lengths and times without reading them.

    It is a sum of one number per file, so it does not depend on their order and no list of files is gathered.
    """
    facts = listing(spark, path).select(F.xxhash64(F.substring_index("path", "/", -1) if name_only else F.col("path"), "length", "modificationTime").cast("decimal(38,0)").alias("h"))
    row = facts.agg(F.count("*").alias("n"), F.sum("h").alias("sum"), F.sum(F.pmod(F.col("h") * 31, F.lit(1000003))).alias("check")).first()
    return hashlib.sha256(f"{row['n']} {row['sum']} {row['check']}".encode()).hexdigest()


def prepared(spark: SparkSession, build, cache: str, key: str) -> DataFrame:
    """The table under ``cache/key``, built and written unless a finished one is there."""
    path = f"{cache.rstrip('/')}/{key}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_lines(spark: SparkSession, path: str, schema: str, skip_bad: bool = False, places: bool = False) -> DataFrame:
    """JSON lines with the file each came from; unreadable lines fail, or are left out with ``skip_bad``.

    ``places`` adds ``place``: the line's number, from 0, among its file's lines. A file's lines are then numbered in
    one task, so it is for candidate files, which are addressed by place, not for tables.
    """
    if places:
        text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
        lines = text.select("file", F.posexplode(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")).alias("place", "value"))
        rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE" if skip_bad else "FAILFAST"}).alias("r"), "file", "place")
        return (rows.where("r IS NOT NULL") if skip_bad else rows).select("r.*", "file", "place")
    mode = "DROPMALFORMED" if skip_bad else "FAILFAST"
    return spark.read.schema(schema).option("mode", mode).json(path).withColumn("file", F.input_file_name())


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row: how many lines can't be read."""
    rows = spark.read.text(path).select(F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.agg(F.count_if(F.col("r").isNull() | F.col("r._bad").isNotNull()).alias("bad"))


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """``file, key, label, excluded``: keyed JSON objects; a bare string is a label of the old form."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    pairs = text.select("file", F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    record = F.from_json("value", "label string, excluded boolean", {"mode": "PERMISSIVE"})
    old = ~F.trim("value").startswith("{")
    return pairs.select("file", "key", F.when(old, F.col("value")).otherwise(record["label"]).alias("label"), F.when(old, F.lit(False)).otherwise(F.coalesce(record["excluded"], F.lit(False))).alias("excluded"))


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """``file, idx, keep, discard, reviewed, rect, height_delta``: keyed JSON objects of judgements by candidate."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    record = "keep boolean, discard boolean, reviewed boolean, rect struct<left:int,top:int,width:int,height:int>, height_delta int"
    pairs = text.select("file", F.explode(F.from_json("value", f"map<string,struct<{', '.join(p.replace(' ', ':', 1) for p in record.split(', '))}>>")).alias("key", "r"))
    flag = lambda n: F.coalesce(F.col(f"r.{n}"), F.lit(False)).alias(n)
    return pairs.select("file", F.col("key").cast("long").alias("idx"), flag("keep"), flag("discard"), flag("reviewed"), F.col("r.rect").alias("rect"), F.coalesce("r.height_delta", F.lit(0)).alias("height_delta"))


def read_modes(spark: SparkSession, path: str) -> DataFrame:
    """``file, frame, exhaustive``: keyed JSON of frames' modes, a bare truth value or an object with one."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    pairs = text.select("file", F.explode(F.from_json("value", "map<string,string>")).alias("frame", "value"))
    inner = F.from_json("value", "exhaustive boolean")["exhaustive"]
    return pairs.select("file", "frame", F.when(F.trim("value").startswith("{"), F.coalesce(inner, F.lit(False))).otherwise(F.lower(F.trim("value")) == "true").alias("exhaustive"))


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """``file, source``: the sources that each set's meta file names, synthetic ones left out."""
    meta = spark.read.schema("sources array<string>").option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    return meta.select("file", F.explode("sources").alias("source")).where("source <> 'synthetic'").distinct()


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``path, length, modificationTime`` of all files below ``root`` that fit the pattern; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime")


#: Bytes of an image that are looked at for its size.
IMAGE_HEAD = 1 << 18


def image_size(head: bytes) -> tuple[int, int] | None:
    """Width and height by an image's header: PNG, GIF, BMP or JPEG; None for what is none of them."""
    if head.startswith(b"\x89PNG\r\n\x1a\n") and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a") and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head.startswith(b"BM") and len(head) >= 26:
        width, height = struct.unpack("<ii", head[18:26])
        return width, abs(height)
    if not head.startswith(b"\xff\xd8"):
        return None
    at = 2
    while at + 9 <= len(head):
        if head[at] != 0xFF:
            return None
        kind = head[at + 1]
        if kind == 0xFF:  # padding
            at += 1
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):  # the frame's own header
            height, width = struct.unpack(">HH", head[at + 5 : at + 9])
            return width, height
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # markers without a body
            at += 2
        else:
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    return None


def frame_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``path, frame_width, frame_height`` of images, by their headers; files that are no images are left out."""

    def look(batches):
        for batch in batches:
            found = [(p, *size) for p, h in zip(batch["path"], batch["head"]) if (size := image_size(bytes(h)))]
            yield pd.DataFrame(found, columns=["path", "frame_width", "frame_height"])

    heads = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.substring("content", 1, IMAGE_HEAD).alias("head"))
    return heads.mapInPandas(look, "path string, frame_width int, frame_height int")


def read_feature_maps(spark: SparkSession, path: str) -> DataFrame:
    """``features`` maps, bare or wrapped in an object of that name."""
    text = spark.read.text(path)
    wrapped = F.from_json("value", "features map<string,double>")["features"]
    return text.select(F.coalesce(wrapped, F.from_json("value", "map<string,double>")).alias("features"))


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_export(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_run(folder: str, tables: dict[str, DataFrame], result: DataFrame) -> None:
    """A run's tables and its one-row summary."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    result.write.mode("overwrite").json(f"{folder}/result")
