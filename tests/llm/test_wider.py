"""Wider addresses, whatever else the text holds."""

from pyspark.sql import functions as F

from courtside.llm import pii


def test_wider_addresses_do_not_depend_on_far_words(spark):
    forms = {
        "jane(at)corp.com": True, "jane[at]corp.com": True, "jane @ corp.com": True, "jane at corp dot com": True,
        "jane at mail.corp(dot)com": True, "jane(at)corp[dot]com": True, "came from at and. Of": False,
    }
    rows = [(n, f"see {form} ; {far}") for n, form in enumerate(forms) for far in ("end", "a dot or @ sign")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.with_candidates(docs).select("doc_id", F.size(F.filter("spans", lambda s: s["kind"] == 0)).alias("n")).collect()
    want = sorted((n, int(hit)) for n, hit in enumerate(forms.values()) for _ in range(2))
    assert sorted(map(tuple, found)) == want
