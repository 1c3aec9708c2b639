"""Ties, very long texts, ids of other types, repeated rows and clashing column names."""

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import chat_format, exact_dedup, licenses, mixing, ngram_join, pieces, quality, token_counts, url_reputation, vector_search

PATH = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["#", "-", "▁", ".", "^", "ab", "=-", "\n", " "]


def best_sums(table, text, k):
    """The k best sums at every place of the lattice, by dynamic programming."""
    best = [[] for _ in range(len(text) + 1)]
    best[0] = [0.0]
    for j in range(1, len(text) + 1):
        sums = []
        for size in range(1, min(table.longest, j) + 1):
            piece = table.known.get(text[j - size : j])
            if piece or size == 1:
                sums += [s + (piece[1] if piece else table.unknown) for s in best[j - size]]
        best[j] = sorted(sums, reverse=True)[:k]
    return best[-1]


# SentencePiece


@pytest.mark.parametrize("sign", SIGNS)
def test_runs_of_equal_signs(sign):
    """Every length to 60, by both searches, against the dynamic programme; then runs of 350 to 100,000 in bounded time."""
    table = pieces.piece_table(PATH)
    for n in range(1, 61):
        text = (sign * n)[:n]
        want = best_sums(table, text, 3)
        found = pieces.search_one(table, text, 3)
        assert [s for s, _ in found] == pytest.approx(want) and len({tuple(p) for _, p in found}) == len(want)
        scores, ids = pieces._search_together(table, np.array([[ord(c) for c in text]], dtype=np.uint32), 3)
        assert [s for s in scores[0] if s > -np.inf] == pytest.approx(want)
        assert len({tuple(p) for p in ids[0][: len(want)].tolist()}) == len(want)
    for n in (350, 2000, 100_000):
        text = (sign * n)[:n]
        began = time.time()
        ids, scores, _ = next(pieces.encode_texts(pieces.Memory(table, 3), [text]))
        assert time.time() - began < 60
        assert pieces.decode(table, ids.tolist()) == text.replace("▁", " ")
        if n < 3000:
            assert scores == pytest.approx(best_sums(table, "▁" + text.replace(" ", "▁"), 3))


def test_runs_inside_texts():
    """Underlines of compiler messages, heading rules and table padding, among words."""
    table = pieces.piece_table(PATH)
    memory = pieces.Memory(table, 3)
    rng = random.Random(11)
    for _ in range(60):
        text = " ".join(rng.choice(["error here", rng.choice("^-#= .*~") * rng.randint(1, 90)]) for _ in range(rng.randint(1, 3)))
        ids, scores, edits = next(pieces.encode_texts(memory, [text]))
        assert scores == pytest.approx(best_sums(table, "▁" + text.replace(" ", "▁"), 3))
        for path in pieces.segmentations(ids.tolist(), edits):
            assert pieces.decode(table, path) == text


def test_ids_keep_their_type(spark):
    docs = spark.createDataFrame([("x", "reading"), (None, None), ("x", "")], "doc_id string, text string")
    found = pieces.encode(docs, PATH)
    assert found.schema["id"].dataType.simpleString() == "string"
    assert sorted((str(r.id), r.n_pieces) for r in found.collect()) == [("None", 0), ("x", 0), ("x", 3)]


# All operators and stages on odd tables

CLASH = ["__row", "__times", "__taken", "__gone", "__kept", "__name", "__source", "row", "name", "id", "component", "taken", "part", "rank", "digest", "kept", "place", "said", "score", "number", "grams", "floor", "asked"]


def odd_documents(spark, id_type, more=()):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns of clashing names."""
    make = {"long": lambda i: i, "string": lambda i: None if i is None else f"d{i}"}[id_type]
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a  b c d e f"), (2, "another text"), (None, "a b c d e f"), (None, None), (3, None), (4, ""), (5, " \n\t "), (6, "one"), (7, "w " * 20_000), (8, "-" * 30_000), (9, "漢字" * 5000), *more]
    rows = [(make(i), t, None if (i or 0) % 2 else "s", None, None, *["c"] * len(CLASH)) for i, t in texts]
    kind = f"doc_id {id_type}, text string, source string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame(rows, kind).repartition(3)


def outputs(spark, docs):
    """What each operator gives for a table of documents, by name, with whether it gives a row for each row."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("source").alias("role"), "text", *CLASH)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://"), "text").alias("url"), *CLASH)
    return {
        "quality": (docs.select(quality.quality(F.col("text"), quality.fit(docs))), True),
        "pieces": (pieces.encode(docs, PATH), True),
        "urls": (url_reputation.judge_urls(pages, docs.select(F.col("doc_id").alias("id"), F.lit(1).alias("bad"))), True),
        "chat": (chat_format.rotate(turns), False),
        "mixing": (mixing.mix(docs), True),
        "tokens": (token_counts.token_counts(docs, path), True),
        "join": (ngram_join.similar_groups(docs), True),
        "copies": (exact_dedup.exact_groups(docs), True),
        "all copies": (exact_dedup.exact_groups(docs, digest_all=True), True),
        "licences": (licenses.scan(docs, across_lines=True), False),
        "drop_copies": (exact_dedup.drop_copies(docs), False),
        "keep_one": (ngram_join.keep_one(docs), False),
        "apply_mix": (mixing.apply_mix(docs), False),
        "keep_good": (quality.keep_good(docs), False),
    }


@pytest.mark.parametrize("id_type", ["long", "string"])
def test_operators_on_odd_tables(spark, id_type):
    docs = odd_documents(spark, id_type)
    count = docs.count()
    for name, (found, each) in outputs(spark, docs).items():
        rows = found.collect()
        assert len(rows) == count if each else len(rows) <= 3 * count, name
        if name in ("drop_copies", "keep_one", "apply_mix", "keep_good"):
            assert found.columns == docs.columns, name
    left = sorted((r.text or "").replace(" ", "")[:9] for r in exact_dedup.drop_copies(docs).collect())
    assert left == sorted(["abcdef", "anotherte", "\n\t", "one", "w" * 9, "-" * 9, "漢字漢字漢字漢字漢"])
    groups = {(str(r.id), r.n_shingles): str(r.component) for r in ngram_join.similar_groups(docs).collect()}
    first = "1" if id_type == "long" else "d1"
    assert groups[("None", 2)] == first and groups[(first.replace("1", "2"), 2)] == first
    kept = {(str(r.id), r.keep_id) for r in exact_dedup.exact_groups(docs).collect()}
    assert ("None", docs.select(F.max(F.when(F.col("text") == " \n\t ", F.col("doc_id")))).first()[0]) in kept


def test_operators_on_empty_tables(spark):
    none = odd_documents(spark, "long").where("false")
    for name, (found, _) in outputs(spark, none).items():
        assert found.count() == 0, name


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = odd_documents(spark, "long")
    found = stage(spark, docs, "")
    assert found.count() > 0
    if name != "encoding":
        assert found.columns == docs.columns


def test_vectors_on_odd_tables(spark):
    rows = [(i, [1.0, 2.0], "c") for i in (0, 0, 10, None)] + [(20, None, "c"), (30, [None, 1.0], None), (40, [], "c"), (50, [0.5], "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string").withColumns({c: F.lit("c") for c in ("floor", "asked", "shard", "dim", "v", "score", "rank")})
    found = vector_search.top_k(table, F.col("vec_id") % 10 == 0, k=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in found) == [(0, 1, 10), (10, 1, 0), (10, 2, 0)]
    with pytest.raises(ValueError):
        vector_search.top_k(spark.createDataFrame([("a", [1.0])], "vec_id string, embedding array<double>"), F.lit(True))


# Mixing


def test_small_sources_reach_their_targets(spark):
    """One source of 100,000 words and fifty of 10 to 100: each gets its target, cut to whole words."""
    rng = random.Random(2)
    rows = [(i, "w " * 500, "big") for i in range(200)]
    rows += [(1000 * (s + 1) + k, "w " * rng.randint(5, 50), f"s{s:02d}") for s in range(50) for k in range(2)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    taken, target = {}, {}
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert len(target) == 51
    for s, t in target.items():
        assert taken[s] == int(t + 1e-6)


# Quality


def test_label_model_and_scorer_against_brute_force(spark, tmp_path):
    """The query's own scores, from EM over single texts instead of counted patterns and a dense scorer on the sample."""
    rng = random.Random(3)
    words = ["the", "house", "of", "green", "rivers", "and", "old", "stones", "near", "town"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 60))).capitalize() + "." for _ in range(150)]
    texts += [" ".join(rng.choice(["$$$", "BUY", "!!!", "NOW", "###", "now"]) for _ in range(40)) for _ in range(30)] + ["", None, "one"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in quality.op1_quality(spark, str(tmp_path)).collect()}
    votes = np.array([[int(quality.vote(pa.array([t or ""]))[0]) // 3**k % 3 for k in range(len(quality.LABELLERS))] for t in texts])
    n = len(texts)
    start = [(0.50, 0.01, 0.49), (0.33, 0.34, 0.33)]
    prior, table = 0.15, [[list(start[c]) for _ in range(votes.shape[1])] for c in (0, 1)]

    def belief(v):
        chance = [p * np.prod([table[c][k][v[k]] for k in range(len(v))]) for c, p in ((0, 1 - prior), (1, prior))]
        return chance[1] / sum(chance)

    for _ in range(quality.EM_STEPS):
        junk = [belief(v) for v in votes]
        for c in (0, 1):
            for k in range(votes.shape[1]):
                sums = [sum(b if c else 1 - b for b, v in zip(junk, votes) if v[k] == x) + n / 1000 * start[c][x] for x in range(3)]
                table[c][k] = [s / sum(sums) for s in sums]
        prior = min(max(sum(junk) / n, 1e-3), 0.9)
    model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert model.prior == pytest.approx(prior, rel=1e-6)
    assert model.accuracy == pytest.approx(np.array(table), rel=1e-6)
    for i, text in enumerate(texts):  # the scorer, one text and one feature at a time
        doc, dim, value = quality.features(pa.array([text or ""]))
        z = model.bias + sum(model.weights[d] * v for d, v in zip(dim.tolist(), value.tolist()))
        assert found[i].score == pytest.approx(1 / (1 + np.exp(z)), rel=1e-9)
        assert found[i].kept == (found[i].score >= quality.CUT)
    assert all(found[i].kept for i in range(150)) and not any(found[i].kept for i in range(150, 180))
