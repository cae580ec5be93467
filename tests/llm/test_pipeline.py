"""The pipeline stage by stage against plain versions, and the registered queries."""

import os
import sys

import pytest
from edge import documents
from pyspark.sql import functions as F
from test_text_operators import contamination, jaccard_components

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))),
                os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

import corpus_pipeline as P  # noqa: E402
from compare import compare, duck  # noqa: E402
from sortdesk.llm import pseudonyms, toxicity  # noqa: E402
from sortdesk.llm.queries import CHECKS, PIECE_MODEL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """[(input, output)] of every stage on the small tables."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in P.STAGES:
        done = stage(spark, docs, SF).cache()
        out.append((docs, done))
        docs = done
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(stages):
    for before, after in stages[:-1]:
        assert set(after.columns) == set(P.COLUMNS)
        assert 0 < after.count() <= before.count()


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    gone = before.join(after, "doc_id", "left_anti").join(labels, "doc_id")
    clean = before.join(labels.where("toxic = 0"), "doc_id")
    assert gone.where("toxic = 0").count() <= 0.01 * clean.count()
    assert gone.where("toxic = 1").count() >= 0.8 * labels.where("toxic = 1").count()
    verdict = toxicity.toxic_documents(before, labels)
    assert rows(after).keys() == rows(verdict.where("not toxicity.rejected")).keys()


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1]
    pairs = [(r.doc_id, r.text) for r in before.collect()]
    want = {i for i, (_, _, kept) in jaccard_components(pairs, 5, 80).items() if kept}
    assert rows(after).keys() == want


def test_no_benchmark_passage_is_left(spark, stages):
    before, after = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet")
             .select("item_id", "text").collect()]
    left = rows(after)
    assert all(hit == 0 for _, hit, _ in contamination([r.text for r in left.values()], items, 10))
    found = rows(before)
    for i, (n, hit, _) in zip(found, contamination([r.text for r in found.values()], items, 10)):
        if not hit:
            assert left[i].text == found[i].text
        assert (i in left) == (hit <= 0.8 * n)
        if i in left:
            assert left[i].n_chars == len(left[i].text)


def test_personal_values_are_replaced(stages):
    before, after = stages[3]
    values = before.select("doc_id", F.explode(F.regexp_extract_all(
        "text", F.lit(f"({pseudonyms.VALUE})"), F.lit(1))).alias("v"))
    checked = values.select("doc_id", "v", pseudonyms.pseudonym(F.col("v"), "k").isNotNull().alias("ok"))
    texts = rows(after)
    found = checked.where("ok").collect()
    assert len(found) > 20
    for r in found:
        assert r.v not in texts[r.doc_id].text
    assert before.count() == after.count()


def test_pieces_of_the_last_stage(stages):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    before, after = stages[4]
    texts = rows(before)
    for i, r in rows(after).items():
        assert r.ids == library.encode(texts[i].text, add_bos=True, add_eos=True)


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    for name, docs in (("awkward", documents(spark)), ("empty", documents(spark, []))):
        sf = str(tmp_path / name)
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int"
                              ).write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, None), (None, "")], "item_id long, text string"
                              ).write.parquet(f"{sf}/benchmark.parquet")
        got = P.run(spark, sf).collect()
        if name == "empty":
            assert got == []
        else:
            # one of the two equal texts goes, whichever rows repeat it
            assert sorted(r.doc_id for r in got if r.doc_id) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11]
            assert sum(r.doc_id is None for r in got) == 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries(spark, name):
    sf = "/root/testdata/sf0.001"
    if name in CHECKS:
        same, _, diff = compare(spark, sf, QUERIES[name], CHECKS[name], duck(sf))
        assert same, diff
    else:
        assert QUERIES[name](spark, sf).count() > 0
