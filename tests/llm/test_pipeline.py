"""The pipeline's stages one by one, each on its own input."""
import pytest

import corpus_pipeline
from helpers import documents, edge_rows
from tillroll.llm import decontam, quality, secrets, simhash
from tillroll.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_stages_are_named_and_return_documents(spark, docs):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE encoding and decoding"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString()


def test_quality_stage_drops_what_the_operator_rejects(spark, docs):
    model = quality.train(docs, table(spark, SF, "labels"))
    keep = {r.doc_id for r in quality.classify(docs, model, keep=["doc_id"]).where("score >= 0.3").select("row.doc_id").collect()}
    got = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert rows_of(got) == sorted(repr(r) for r in docs.collect() if r.doc_id in keep)


def test_dedup_stage_keeps_the_least_of_each_group(spark, docs):
    keep = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert rows_of(corpus_pipeline.simhash_dedup(spark, docs, SF)) == sorted(repr(r) for r in docs.collect() if r.doc_id in keep)


def test_decontamination_stage_drops_hit_documents(spark, docs):
    bad = {r.doc_id for r in decontam.decontaminate(docs, table(spark, SF, "benchmark"), keep=["doc_id"]).where("n_hit > 0").select("row.doc_id").collect()}
    assert bad and rows_of(corpus_pipeline.benchmark_decontamination(spark, docs, SF)) == sorted(repr(r) for r in docs.collect() if r.doc_id not in bad)


def test_secret_stage_redacts_and_keeps_every_document(spark, docs):
    spans = {r.doc_id: r.s for r in secrets.scan(docs, keep=["doc_id"]).select("row.doc_id", secrets.listed("spans").alias("s")).collect()}
    before = {r.doc_id: r for r in docs.collect()}
    after = {r.doc_id: r for r in corpus_pipeline.secret_scan(spark, docs, SF).collect()}
    assert set(before) == set(after)
    for d, r in before.items():
        text, at, out = r.text, 0, ""
        for s in filter(None, spans[d].split(",")):
            _, a, b = s.split(":")
            if int(a) >= at:
                out += text[at:int(a)] + "<SECRET>"
            at = max(at, int(b))
        assert after[d].text == out + text[at:] and after[d].n_chars == len(after[d].text)


def test_stages_take_edge_rows(spark):
    docs = documents(spark, edge_rows())
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert set(docs.columns) <= set(out.columns) and out.count() <= docs.count()
        assert stage(spark, documents(spark, []), SF).count() == 0


def test_whole_run(spark, docs):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in out)
    assert len({r.doc_id for r in out}) == len(out) < docs.count()


def test_last_stage_takes_columns_named_like_its_results(spark):
    docs = documents(spark, edge_rows()).selectExpr("*", "7L as n_tokens", "'x' as Token_IDs", "false as round_trip")
    out = corpus_pipeline.byte_bpe(spark, docs, SF)
    assert out.columns == [*docs.columns[:-3], "token_ids", "n_tokens", "round_trip"]
    got = out.collect()
    assert len(got) == docs.count() and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got)
