"""The corpus pipeline's stages against brute force, and what is registered."""

import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from tallyforge.llm import pieces
from tests.llm.test_operators import DOCS, brute_components, brute_copies, documents

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: In the order that the stages have to stand in.
ORDER = ["quality", "exact_dedup", "near_dedup", "mixing", "encoding"]


def test_registered():
    known = __spark_entry__.queries()
    for n in range(1, 11):
        assert len([name for name in known if name.startswith(f"op{n}_")]) == 1
    assert "pipeline" in known
    assert [name for name, _ in corpus_pipeline.STAGES] == ORDER
    assert set(__spark_entry__.oracle_sql()) <= set(known)


def test_stages(spark):
    docs = spark.createDataFrame([r[:5] for r in documents(3, 80)], COLUMNS).repartition(2)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        after = [tuple(r) for r in out.collect()]
        if name == "exact_dedup":
            assert {r[0] for r in after} == {i for i, v in brute_copies(before).items() if v[2]}
        if name == "near_dedup":
            assert {r[0] for r in after} == {i for i, (_, c) in brute_components(before).items() if c == i}
        assert set(after) <= set(before)
        docs = spark.createDataFrame(after, COLUMNS)
    table = pieces.piece_table(public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r[0]: r[1] for r in documents(3, 80)}
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert len(rows) == docs.count()
    assert all(pieces.decode(table, r.ids) == (texts[r.doc_id] or "") for r in rows)


@pytest.mark.parametrize("k", range(5))
def test_empty_tables_and_extra_columns(spark, k):
    _, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, spark.createDataFrame([], DOCS), "").count() == 0
    rows = [r for r in documents(4, 12)]
    assert stage(spark, spark.createDataFrame(rows, DOCS), "").count() > 0


def test_run_on_small_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where("NOT exact").count() == 0


ODD = "doc_id long, text string, lang string, source string, n_chars long"


def test_dedup_with_missing_and_repeated_ids(spark):
    """Copies go and no other text with them, whatever the ids of the rows."""
    near = ["w%d" % i for i in range(60)]
    rows = [(None, "ab", None, "s", 1), (1, "a  b", None, "s", 1), (None, "only here", None, "s", 1), (None, "nor this", None, "s", 1)]
    rows += [(2, "x y", None, "s", 1), (2, "another text", None, "s", 1), (3, "x  y", None, "s", 1)]
    rows += [(4, "same", "a", "s", 1), (4, "same", "b", "s", 1), (None, "twin", "a", "s", 1), (None, "twin", "a", "s", 1)]
    rows += [(None, " ".join(near), None, "s", 1), (5, " ".join(near[:-1] + ["z"]), None, "s", 1), (5, "far off", None, "s", 1), (None, " ".join(["z"] + near[1:]), None, "s", 1)]
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    once = corpus_pipeline.exact_dedup(spark, docs, "")
    assert once.columns == docs.columns
    texts = sorted(r.text for r in once.collect())
    assert texts == sorted({r[1] for r in rows} - {"ab", "x y"})
    left = corpus_pipeline.near_dedup(spark, once, "")
    assert left.columns == docs.columns
    found = sorted((str(r.doc_id), r.text[:9]) for r in left.collect())
    assert found == sorted([("1", "a  b"), ("None", "only here"), ("None", "nor this"), ("2", "another t"), ("3", "x  y"), ("4", "same"), ("None", "twin"), ("5", "w0 w1 w2 "), ("5", "far off")])
