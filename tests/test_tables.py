"""Sources, sets, boxes and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import assets, boxes, sets, views
from tallyforge.sources import files
from tallyforge.streaming import judgements


@pytest.mark.parametrize("data,want", [("a".encode("utf-16"), "utf-16"), (b"\xef\xbb\xbfa", "utf-8-sig"), ("é".encode(), "utf-8"), ("é€".encode("cp1252"), "cp1252"), (b"", "utf-8")])
def test_encodings(data, want):
    assert files.resolve_encoding(data) == want
    assert files.resolve_encoding(data, "latin-1") == "iso8859-1"


@pytest.mark.parametrize("encoding,sep", [("utf-16", "\t"), ("utf-8", ";"), ("cp1252", ";"), ("utf-8-sig", ",")])
def test_delimited_files(spark, tmp_path, encoding, sep):
    path = tmp_path / "x.csv"
    path.write_bytes(f"Region{sep}Quantity\nMünchen{sep}5\nKöln{sep}7\n".encode(encoding))
    rows = files.read_delimited(spark, str(path))
    assert [(r["Region"], int(r["Quantity"])) for r in rows.orderBy("Quantity").collect()] == [("München", 5), ("Köln", 7)]


def test_mixed_folder_and_quoted_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('Stadt;Note;Zahl\n"Köln €";"two\nlines";1\nx;a\x1cb;2\n'.encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("Stadt\tNote\tZahl\nMünchen\tplain\t3\n".encode("utf-16"))
    rows = files.read_delimited(spark, str(tmp_path)).orderBy("Zahl").collect()
    assert [(r["Stadt"], r["Note"], int(r["Zahl"])) for r in rows] == [("Köln €", "two\nlines", 1), ("x", "a\x1cb", 2), ("München", "plain", 3)]


def test_encoding_by_all_bytes(spark, tmp_path):
    """A sign that is no UTF-8 in the last of many splits; a mark before plain text; an empty file."""
    (tmp_path / "late.csv").write_bytes(b"a,b\n" + b"1,plain text\n" * 20_000 + "2,Köln".encode("cp1252"))
    (tmp_path / "marked.csv").write_bytes(b"\xef\xbb\xbfa,b\n1,x\n")
    (tmp_path / "open.csv").write_bytes(b"\xef\xbb\xbfa,b\n1,x")
    (tmp_path / "none.csv").write_bytes(b"")
    (tmp_path / "blank.csv").write_bytes(b"\n\na;b\n1;x\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)
    try:
        found = {r["path"].rsplit("/", 1)[1]: (r["encoding"], r["line"]) for r in files.encodings(spark, str(tmp_path)).collect()}
        assert found == {"late.csv": ("cp1252", "a,b"), "marked.csv": ("utf-8-sig", "a,b"), "open.csv": ("utf-8-sig", "a,b"), "blank.csv": ("utf-8", "a;b")}
        rows = files.read_delimited(spark, str(tmp_path / "late.csv"))
        assert rows.rdd.getNumPartitions() > 3 and rows.where("b = 'Köln'").count() == 1 and rows.count() == 20_001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_across_splits(spark, tmp_path):
    """Quoted breaks anywhere, records of many splits, quotes within quotes, carriage returns: as one reader of the whole file has it."""
    import csv
    import io
    import random

    rng = random.Random(3)
    rows = []
    for i in range(400):
        note = rng.choice(["plain", 'say "hi"', "two\nlines", "\n\n", "a;b", "x" * 3000 if i % 90 == 0 else "y", "line\n" * 300 if i % 130 == 0 else "z", ""])
        rows.append((i, note, rng.choice(["é", "b\nc", "d"])))
    out = io.StringIO()
    writer = csv.writer(out, delimiter=";", lineterminator="\n")
    writer.writerow(["key", "note", "sign"])
    writer.writerows(rows)
    (tmp_path / "x.csv").write_text(out.getvalue())
    (tmp_path / "y.csv").write_text("key;note;sign\r\n1000;one;e\r\n1001;two;f\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1000)
    try:
        found = sorted(tuple(r) for r in files.read_delimited(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == sorted([(k, n or None, s) for k, n, s in rows] + [(1000, "one", "e"), (1001, "two", "f")])


def test_json_of_both_kinds_in_a_folder(spark, tmp_path):
    (tmp_path / "a.json").write_text('\n [{"k": 1},\n {"k": 2}]')
    (tmp_path / "b.json").write_text('{"k": 3}\n{"k": 4}\n')
    assert sorted(r["k"] for r in files.read_json(spark, str(tmp_path)).collect()) == [1, 2, 3, 4]


def test_a_run_takes_its_tables_along(spark):
    import os

    from tallyforge.sources import shared

    with shared.own_tables(spark) as folder:
        rows = shared.written(spark.range(5))
        assert rows.count() == 5 and os.listdir(folder.removeprefix("file://"))
    assert not os.path.exists(folder.removeprefix("file://"))
    with pytest.raises(ValueError), shared.own_tables(spark) as folder:
        shared.written(spark.range(5))
        raise ValueError
    assert not os.path.exists(folder.removeprefix("file://")) and shared.written(spark.range(2)).count() == 2


@pytest.mark.parametrize("head, size", [
    (b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\1\x2c\0\0\0\xc8", (300, 200)), (b"GIF89a\x2c\x01\xc8\0", (300, 200)), (b"BM" + b"\0" * 16 + (300).to_bytes(4, "little") + (-200).to_bytes(4, "little", signed=True), (300, 200)),
    (b"\xff\xd8\xff\xe0\0\x10" + b"J" * 14 + b"\xff\xff\xc2\0\x11\x08\0\xc8\1\x2c\3", (300, 200)), (b"\xff\xd8\xff\xe0\0", None), (b"", None), (b"text", None),
])
def test_image_sizes(head, size):
    assert files.image_size(head) == size


def test_number_formats(spark):
    rows = spark.createDataFrame([("1.234,50", "1,234.50", "12", "x", "1,5"), ("755,96", "2", "3.5", "1", "1,234"), (None, "", None, None, None)], "a string, b string, c string, d string, e string")
    assert {r["column"]: r["format"] for r in files.number_formats(rows).collect()} == {"a": "decimal_comma", "b": "thousands_comma", "c": None, "d": None, "e": "decimal_comma"}
    typed = files.typed_numbers(rows).collect()
    assert [r["a"] for r in typed] == [1234.5, 755.96, None] and typed[0]["b"] == 1234.5


def test_number_formats_look_at_all_rows(spark):
    late = "CASE WHEN id = 2999 THEN {} ELSE '1.234,50' END AS {}"
    rows = spark.range(3000).selectExpr("id", late.format("'n/a'", "remark"), late.format("'7,25'", "price")).coalesce(1)
    assert {r["column"]: r["format"] for r in files.number_formats(rows).collect()} == {"remark": None, "price": "decimal_comma"}
    assert files.typed_numbers(rows).where("remark IS NULL OR price IS NULL").count() == 0


def test_json_and_lines(spark, tmp_path):
    (tmp_path / "array.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "lines.json").write_text('{"a": 1}\n{"a": 2}\n')
    for name in ("array.json", "lines.json"):
        assert files.read_json(spark, str(tmp_path / name)).agg(F.sum("a")).first()[0] == 3
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 3}\n')
    assert files.read_lines(spark, str(tmp_path / "bad.jsonl"), "a int", skip_bad=True).count() == 2
    assert files.bad_lines(spark, str(tmp_path / "bad.jsonl"), "a int").first()["bad"] == 1
    (tmp_path / "pool.json").write_text(json.dumps({"t1": "old", "t2": {"label": "new", "excluded": False}, "t3": {"excluded": True}}, indent=2))
    rows = {r["key"]: (r["label"], r["excluded"]) for r in files.read_keyed(spark, str(tmp_path / "pool.json")).collect()}
    assert rows == {"t1": ("old", False), "t2": ("new", False), "t3": (None, True)}
    (tmp_path / "maps.jsonl").write_text('{"x": 1}\n{"features": {"x": 2, "y": 3}}\n')
    assert [r["features"] for r in files.read_feature_maps(spark, str(tmp_path / "maps.jsonl")).collect()] == [{"x": 1.0}, {"x": 2.0, "y": 3.0}]
    (tmp_path / "meta.json").write_text(json.dumps({"sources": ["a", "synthetic", "b", "a"]}))
    assert {r["source"] for r in files.read_sources(spark, str(tmp_path / "meta.json")).collect()} == {"a", "b"}


def test_prepared_tables_are_used_again(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert files.prepared(spark, build, str(tmp_path / "cache"), "key").count() == 3
    assert len(built) == 1
    rows = spark.createDataFrame([(1, "a", None)], "n long, s string, d date")
    files.write_table(rows, str(tmp_path / "t"), ["s"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    files.write_export(views.export(rows, False), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["verdict"] == "not trusted"
    assert files.listing(spark, str(tmp_path), "*.parquet").count() >= 1
    assert files.fingerprint(spark, str(tmp_path / "t")) == files.fingerprint(spark, str(tmp_path / "t"))


def test_merge_restates_sources_and_boxes(spark):
    kind = "recording string, frame string, left int, top int, width int, height int, label string, negative boolean, source string"
    old = spark.createDataFrame([("r", "f", 1, 1, 5, 5, "a", False, "s1"), ("r", "f", 2, 1, 5, 5, "b", False, "s2"), ("r", "g", 9, 9, 5, 5, "c", False, None), ("r", "g", 8, 8, 5, 5, None, True, "synthetic")], kind)
    fresh = spark.createDataFrame([("r", "f", 3, 1, 5, 5, "x", False, "s1"), ("r", "f", 2, 1, 5, 5, "y", False, "s3")], kind)
    assert sorted(r["label"] for r in sets.merge_sets(old, fresh).collect()) == ["c", "x", "y"]
    nameless = fresh.withColumn("source", F.lit(None).cast("string"))
    assert sorted(r["label"] for r in sets.merge_sets(old, nameless).collect()) == ["a", "x", "y"]
    with pytest.raises(sets.SetError):
        sets.refuse_mixed(spark.createDataFrame([("r", 10), ("r", 20)], "recording string, frame_width int"))


def test_pools_of_two_definitions_are_refused(spark):
    pool = spark.createDataFrame([("t", 1, "a", False, "d1"), ("t", 2, "a", False, "d2")], "tag string, idx int, label string, excluded boolean, classdef string")
    with pytest.raises(sets.SetError):
        sets.promoted(pool, None, None)


def test_synthetic_boxes_touch_nothing(spark):
    kind = "recording string, frame int, left int, top int, width int, height int, negative boolean"
    rows = spark.createDataFrame([("r", f, 10 * i, 5 * i, 30, 10, False) for f in range(4) for i in range(5)], kind)
    made = sets.synthetic_negatives(rows, 200, 120)
    assert sorted(map(str, made.collect())) == sorted(map(str, sets.synthetic_negatives(rows.repartition(3), 200, 120).collect()))
    every = [(r["frame"], r["left"], r["top"]) for r in made.collect()] + [(r["frame"], r["left"], r["top"]) for r in rows.collect()]
    synthetic = len(made.collect())
    for k, (f, x, y) in enumerate(every[:synthetic]):
        assert all(f != g or x + 30 <= a or a + 30 <= x or y + 10 <= b or b + 10 <= y for j, (g, a, b) in enumerate(every) if j != k)


def test_suppression_keeps_the_strongest_apart(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0.9), (0, 2, 2, 0.8), (0, 3, 0, 0.7), (0, 9, 9, 0.6), (1, 0, 0, 0.1), (2, 5, 5, 0.5), (2, 6, 4, 0.5), (2, 6, 5, 0.5)], "frame int, x int, y int, score double")
    kept = {(r["frame"], r["x"], r["y"]) for r in boxes.suppress(cells, ["frame"]).collect()}
    assert kept == {(0, 0, 0), (0, 3, 0), (0, 9, 9), (1, 0, 0), (2, 6, 5)}
    assert boxes.suppress(cells, ["frame"], limit=1).count() == 3
    assert boxes.suppress(cells.where("false"), ["frame"]).count() == 0


@pytest.mark.parametrize("tile, levels", [(4, 5), (7, 1000), (64, 3)])
def test_suppression_in_rounds_is_the_greedy_one(spark, tile, levels):
    """Crowded maps over many small tiles, with ties and a ridge that rises from tile to tile."""
    import random

    rng = random.Random(tile)
    cells = {(f, x, y): rng.randrange(levels) / levels for f in (0, 1) for x in range(-5, 22) for y in range(18) if rng.random() < 0.8}
    cells |= {(2, x, 0): x / 100 for x in range(60)}
    kept = []
    for (f, x, y), _ in sorted(cells.items(), key=lambda p: (p[0][0], p[1], p[0][1], p[0][2]), reverse=True):
        if not any(f == g and abs(x - a) < 3 and abs(y - b) < 3 for g, a, b in kept):
            kept.append((f, x, y))
    frame = spark.createDataFrame([(*k, s) for k, s in cells.items()], "frame int, x int, y int, score double").repartition(3)
    assert sorted((r["frame"], r["x"], r["y"]) for r in boxes.suppress(frame, ["frame"], limit=None, tile=tile).collect()) == sorted(kept)


def test_load_band_against_draws_by_case(spark):
    """The band of counts dealt out at once, against one draw for each case; a null and an infinite residual don't count."""
    import datetime as dt

    import numpy as np

    rng = np.random.default_rng(4)
    day = dt.date(2026, 1, 5)
    rows = [(i, day + dt.timedelta(days=int(rng.integers(0, 40))), float(rng.integers(1, 30)) / 7) for i in range(3000)]
    pool = np.round(rng.normal(0, 0.5, 700).clip(-0.9, 2), 3)
    residuals = spark.createDataFrame([(float(r),) for r in pool] + [(None,), (float("inf"),)], "resid double")
    frame = spark.createDataFrame(rows, "row long, anchor date, prediction double").repartition(3)
    found = {r["week"]: (r["lower"], r["upper"]) for r in views.load_band(frame, residuals, 7.0, seed=3).collect()}
    again = {r["week"]: (r["lower"], r["upper"]) for r in views.load_band(frame.repartition(2), residuals, 7.0, seed=3).collect()}
    assert found == again
    counts = {}
    for draw in range(400):
        for (_, anchor, wait), r in zip(rows, rng.choice(pool, len(rows))):
            end = anchor + dt.timedelta(days=int(np.round(wait * (1 + r) * 7)))
            week = end - dt.timedelta(days=end.weekday())
            counts.setdefault(week, np.zeros(400))[draw] += 1
    for week, own in counts.items():
        for got, want in zip(found.get(week, (0, 0)), np.percentile(own, (10, 90))):
            assert abs(got - want) <= 1 + 0.35 * own.std()
    assert views.load_band(frame.where("false"), residuals, 7.0).count() == views.load_band(frame, residuals.where("false"), 7.0).count() == 0


@pytest.mark.parametrize("block", [4, 7, 1 << 20])
def test_despiking_over_blocks(spark, block):
    """Recordings of every length over blocks that cut them anywhere, against the medians of whole recordings."""
    import random
    import statistics

    rng = random.Random(1)
    rows = [(r, f, 500.0 * (rng.random() < 0.15) + f, float(f % 3)) for r, n in (("a", 60), ("b", 8), ("c", 9), ("d", 1), ("e", 33)) for f in range(n)]
    want = []
    for r in "abcde":
        own = [x for x in rows if x[0] == r]
        for i, (_, f, x, y) in enumerate(own):
            near = own[max(0, i - 4) : i] + own[i + 1 : i + 5]
            middle = [statistics.median_high(p[k] for p in near) if near else None for k in (2, 3)]
            if len(own) < 9 or ((x - middle[0]) ** 2 + (y - middle[1]) ** 2) ** 0.5 <= 250:
                want.append((r, f))
    frame = spark.createDataFrame(rows, "recording string, frame int, x double, y double").repartition(3)
    assert sorted((r["recording"], r["frame"]) for r in boxes.despike(frame, block=block).collect()) == sorted(want)


def test_tracker(spark):
    kind = "recording string, frame int, id long, left int, top int, width int, height int, score double"
    rows = [("r", 0, 1, 0, 0, 10, 10, 0.5), ("r", 0, 2, 900, 0, 10, 10, 0.9), ("r", 1, 3, 0, 0, 10, 10, 0.99), ("r", 1, 4, 890, 0, 10, 10, 0.4)]
    rows += [("r", f, 10 + f, 0, 0, 10, 10, 0.9) for f in range(2, 9)]
    found = {r["frame"]: r["x"] for r in boxes.track(spark.createDataFrame(rows, kind)).collect()}
    assert found == {0: 905.0, 1: 895.0, 8: 5.0}


def test_assets_are_parsed(spark):
    tag = F.lit("a/b__rec_cnn-20240101-000000-20240102-111111")
    row = spark.range(1).select(assets.peeled(tag).alias("p"), assets.recording_of(tag).alias("r"), assets.tile_index(assets.tile_name(F.lit("x"), F.lit(7))).alias("i"), assets.tile_index(F.lit("none")).alias("n")).first()
    assert (row["p"], row["r"], row["i"], row["n"]) == ("a/b__rec_cnn", "a/b__rec", 7, None)


def test_judgement_table_by_buckets(spark, tmp_path):
    """A replayed epoch changes nothing, untouched buckets keep their files, a late event does not undo a later one."""
    kind = "tile string, at long, action string, label string"
    path = str(tmp_path / "judged")
    kept = judgements.JudgementTable(spark, path, 4)
    assert kept.records().count() == 0
    kept.fold(spark.createDataFrame([(f"t{i}", i, "label", "x") for i in range(40)], kind), 0)
    before = {str(p.relative_to(tmp_path)) for p in (tmp_path / "judged").rglob("*.parquet")}
    batch = spark.createDataFrame([("t1", 100, "exclude", None), ("t1", 99, "label", "y"), ("t2", 101, "clear", None), ("t3", 2, "label", "late")], kind)
    for _ in range(2):
        kept.fold(batch, 1)
        found = {r["tile"]: (r["label"], r["excluded"]) for r in kept.records().collect()}
        assert found == {f"t{i}": ("x", False) for i in range(40) if i not in (1, 2)} | {"t1": (None, True)}
    assert before <= {str(p.relative_to(tmp_path)) for p in (tmp_path / "judged").rglob("*.parquet")}
    kept.fold(spark.createDataFrame([("t2", 50, "label", "old")], kind), 2)
    kept.fold(batch.where("false"), 3)
    assert kept.records().count() == 39 and kept.tidy() >= 1
    assert kept.records().count() == 39 and kept.tidy() == 0


def test_judgements_fold_in_batches(spark, tmp_path):
    kind = "tile string, at long, action string, label string"
    path = str(tmp_path / "records")
    spark.createDataFrame([], "tile string, label string, excluded boolean").write.parquet(path + "0")
    state = [0]

    def write(rows):
        rows.write.parquet(f"{path}{state[0] + 1}")
        state[0] += 1

    fold = judgements.fold_into(lambda: spark.read.parquet(f"{path}{state[0]}"), write)
    fold(spark.createDataFrame([("a", 1, "label", "x"), ("b", 1, "exclude", None), ("c", 2, "label", "z")], kind), 0)
    fold(spark.createDataFrame([("b", 3, "label", "y"), ("c", 4, "clear", None)], kind), 1)
    assert {(r["tile"], r["label"], r["excluded"]) for r in spark.read.parquet(f"{path}2").collect()} == {("a", "x", False), ("b", "y", False)}


def test_promotions_never_destroy_a_set(spark):
    kind = "recording string, frame string, left int, top int, width int, height int, label string, negative boolean, source string"
    rows = spark.createDataFrame([("r", "f", 1, 1, 5, 5, "a", False, "s1")], kind)
    none = rows.where("false")
    for bad in ((none, rows, "overwrite"), (rows, rows, "new"), (rows, None, "append")):
        with pytest.raises(sets.SetError):
            sets.promote_to(*bad)
    assert sets.promote_to(rows, None, "new").count() == 1
    assert sets.draw_size(rows, rows.union(rows), ["recording"]) == "new"
    assert sets.draw_size(rows, rows, ["recording"]) == "replace" == sets.draw_size(rows, None, ["recording"])


def test_quantiles_of_crowded_groups_shuffle_no_rows(spark, monkeypatch):
    """Only what lies within the brackets is shuffled; where a bracket misses the place, all distinct values are counted."""
    from tallyforge.operators import evaluate
    from tallyforge.sources.shared import written

    rows = written(spark.range(200_000).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") / 7.0).alias("v"), (F.col("id") % 5).alias("w")))
    wanted = {"a": (F.col("v"), 0.1), "b": (F.col("v"), 0.5), "c": (F.col("v"), 0.9), "d": (F.col("w"), 0.5)}
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    monkeypatch.setattr(evaluate, "SKETCH", 100)
    for bracket in (0.02, -0.01):
        monkeypatch.setattr(evaluate, "BRACKET", bracket)
        for by in ([], ["g"]):
            one = sorted(map(tuple, evaluate.quantiles(rows, by, wanted, False).collect()))
            began = sent()
            assert sorted(map(tuple, evaluate.quantiles(rows, by, wanted, True).collect())) == one
            assert bracket < 0 or sent() - began < 2 << 20


def test_near_counts_are_those_of_all_pairs(spark):
    """Crowded corners, repeated ids, ids below zero; blocks of a few rows each; and no pair is joined."""
    rows = spark.range(3000).select((F.col("id") - 50 - F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(0)).alias("id"), (F.col("id") * 7 % 23).alias("left"), (F.col("id") * 11 % 9 - 4).alias("top"), F.lit(5).alias("width"), F.lit(5).alias("height"))
    want = boxes.near_pairs(rows, 2).groupBy(F.col("a_id").alias("id")).agg(F.count("*").alias("n"), F.sum("b_id").alias("ids"))
    want = sorted(map(tuple, want.collect()))
    for block in (64, 1000, 10_000):
        assert sorted(map(tuple, boxes.near_counts(rows, 2, block).collect())) == want
    assert boxes.near_counts(rows.where("false"), 2).count() == 0


def test_torn_records_are_put_together_once(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('k;note\n1;"a;\nb"\n2;Köln\n'.encode("cp1252"))
    rows = files.read_delimited(spark, f"{tmp_path}/*.csv")
    assert sorted(map(tuple, rows.collect())) == [(1, "a;\nb"), (2, "Köln")]
    assert not any(str(tmp_path) in file for file in rows.inputFiles())


def test_bands_store_only_what_they_read(spark, monkeypatch):
    from tallyforge.operators import evaluate
    from tallyforge.queries.evaluation import band_apply

    kept, own = [], evaluate.stored
    monkeypatch.setattr(evaluate, "stored", lambda rows, *most: kept.append(set(rows.columns)) or own(rows, *most))
    assert band_apply(spark, "/root/testdata/sf0.001").columns == ["o_orderkey", "lower", "upper"]
    assert kept == [{"o_orderkey", "bucket", "actual", "prediction"}]
