from __future__ import annotations


import corpus_pipeline
import __spark_entry__
import pytest

from punctual.llm import minhash, packing, passages, queries
from tests.llm.test_texts import plain_lines

SMALL = "/root/testdata/sf0.001"
NUMBERS = range(1, 11)


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and result of every stage on the smallest table."""
    docs, found = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SMALL).write.parquet(path)
        out = spark.read.parquet(path)
        found.append((docs, out))
        docs = out
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], found))


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_return_the_columns_of_documents(stages):
    for name, (_, out) in list(stages.items())[:-1]:
        assert out.columns == list(corpus_pipeline.COLUMNS), name
        assert all(r.n_chars == len(r.text) for r in out.collect())


def test_quality_stage_drops_what_is_predicted_bad(spark, stages):
    before, after = (texts(x) for x in stages["quality"])
    scored = queries.op4_quality(spark, SMALL).collect()
    assert set(after) == {r.doc_id for r in scored if r.predicted == 1}
    assert all(after[d] == before[d] for d in after)


def test_line_stage_follows_the_plain_rule(stages):
    before, after = stages["lines"]
    expect = plain_lines([(r.doc_id, r.text, r.source) for r in before.collect()], 10)
    assert texts(after) == {d: t for d, t, _, gone in expect if not gone or t.split()}


def test_near_duplicate_stage_keeps_the_smallest(spark, stages):
    before, after = stages["near_duplicates"]
    kept = {r.doc_id for r in minhash.near_duplicates(before, words=5).collect() if r.kept}
    assert set(texts(after)) == kept


def test_passage_stage_and_packing(spark, stages):
    before, after = stages["passages"]
    expect = {r.doc_id: r.text for r in passages.remove_repeated_passages(before).collect()}
    assert texts(after) == {d: t for d, t in expect.items() if t.split()}
    docs, pieces = stages["packing"]
    again = packing.pack_documents(docs, queries.BYTE_VOCABULARY)
    names = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, pieces.select(*names).collect())) == sorted(map(tuple, again.select(*names).collect()))


def test_stages_work_on_nothing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in NUMBERS] == [1] * 10
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
