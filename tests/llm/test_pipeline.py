"""The pipeline's stages, each judged on its own input by brute force."""

import pytest

import brute
import corpus_pipeline
from courtside.llm import pii, registered

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF_DIR).cache()
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order_and_columns(tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "byte_bpe"]
    for name, (before, after) in tables.items():
        if name != "byte_bpe":
            assert after.columns == before.columns and after.dtypes == before.dtypes


def test_toxic_documents_go(spark, tables):
    before, after = map(texts, tables["toxicity"])
    predicted = {r.doc_id for r in registered.op7_toxicity(spark, SF_DIR).collect() if r.predicted}
    assert set(before) - set(after) == predicted and all(before[d] == t for d, t in after.items())


def test_one_of_each_group_stays(tables):
    before, after = map(texts, tables["simhash_near_dedup"])
    ids = sorted(before)
    roots = brute.reachable([brute.simhash(before[d]) for d in ids])
    assert set(after) == {ids[r] for r in roots} and all(before[d] == t for d, t in after.items())


def test_benchmark_passages_are_cut(spark, tables):
    before, after = map(texts, tables["benchmark_decontamination"])
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {d for d, *_, dirty in brute.contamination(before.items(), items) if dirty}
    assert hit and set(before) == set(after)
    assert not any(dirty for *_, dirty in brute.contamination(after.items(), items))
    assert all((before[d] == after[d]) == (d not in hit) for d in before)


def test_personal_data_is_masked(tables):
    before, after = map(texts, tables["pii"])
    assert set(before) == set(after)
    dirty = {d for d, *counts, _ in brute.personal(before.items()) if sum(counts)}
    assert dirty and all(before[d] != after[d] for d in dirty)
    assert not any(sum(counts) for _, *counts, _ in brute.personal(after.items()))
    for d, text in after.items():
        if text == before[d]:
            continue
        rest = before[d]
        for kept in __import__("re").split(r"\[(?:EMAIL|IP|CARD|PHONE|SECRET)\]", text):
            at = rest.find(kept)  # what is left stands in its old order
            assert at >= 0
            rest = rest[at + len(kept) :]


def test_lengths_follow(tables):
    assert all(r.n_chars == len(r.text) for r in tables["pii"][1].collect())


def test_tokens_decode(tables):
    before, after = tables["byte_bpe"]
    got = {r.doc_id: r for r in after.collect()}
    want = {d: n for d, n, *_ in brute.tokens(texts(before).items())}
    assert {d: r.n_tokens for d, r in got.items()} == want and all(r.exact for r in got.values())


def test_spans_of_all_kinds_are_replaced(spark):
    text = 'a@b.org 4111 1111 1111 1111 x 10.1.2.3, +1 (202) 555-0147; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    docs = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id long, text string")
    got = texts(pii.mask(docs))
    assert got[2] is None and got[3] == "plain"
    assert got[1].startswith("[EMAIL] [CARD] x [IP], [PHONE]; ")
