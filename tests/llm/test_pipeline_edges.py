"""All stages on awkward rows: nulls, repeated rows and ids, long texts, names with dots, clashing names."""

from collections import Counter

import corpus_pipeline

SF_DIR = "/root/testdata/sf0.001"
ODD = [
    (1, None), (1, None), (2, ""), (None, ""), (None, "plain words only"), (3, "plain words only"), (3, "plain words only"), (4, "x" * 200_000),
    (5, "word " * 60_000), (6, "mail jane@corp.com now"), (7, "mail jane@corp.com now"), (8, "💬 é nbsp "), (9, "\t\n "), (10, "a"),
]


def odd_docs(spark):
    rows = [(i, t, "en", None, -1, "kept", 1.5, "r", 7) for i, t in ODD]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `a.b c` string, score double, row string, fingerprint long"
    return spark.createDataFrame(rows, schema).withColumnRenamed("row", "row`x")


def test_stages_keep_columns_and_rows(spark):
    docs = odd_docs(spark)
    want = {"toxicity": Counter(ODD), "benchmark_decontamination": None, "pii": None}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF_DIR)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        got = Counter((r["doc_id"], r["text"]) for r in after.collect())
        if want.get(name):
            assert got == want[name]
        if name == "simhash_near_dedup":
            # One row for each text (none and blank are one): the smallest id, a null id last.
            texts = {}
            for i, t in sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0)):
                texts.setdefault(" ".join((t or "").split()) if (t or "").split() else "", i)
            assert Counter(i for i, _ in got.elements()) == Counter(texts.values())
        if name == "pii":
            assert got[(6, "mail [EMAIL] now")] == 1 and all(r["a.b c"] == "kept" for r in after.collect())
        docs = after
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()
    assert len(coded) == docs.count() and all(r.exact for r in coded)


def test_empty_tables(spark):
    docs = odd_docs(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0
