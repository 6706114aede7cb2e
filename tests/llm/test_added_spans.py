"""Precision and recall of the spans that the classifier adds, on planted ones."""

import random
from collections import Counter

from courtside.llm import pii

WORDS = "the of market river paper winter report under along music seven table green".split()


def luhn(digits):
    total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def card(rng, right):
    while True:
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(15))
        if luhn(digits) == right:
            return digits


def planted(n=600, seed=3):
    """Texts and what is planted: (doc_id, kind, start, end) of added spans that are personal data or secrets, and lures."""
    rng = random.Random(seed)
    docs, true, lures = [], set(), set()
    for i in range(n):
        before, after = (" ".join(rng.choices(WORDS, k=rng.randint(3, 9))) for _ in range(2))
        hexes = "".join(rng.choices("0123456789abcdef", k=40))
        value, kind, good = [
            (f"jane{i}(at)corp{i % 7}(dot)com", "email", True), (f"jane{i}@mail.example.com", None, True), (card(rng, True), None, True),
            (card(rng, False), "card", False), (f"(843) 555-{rng.randint(1000, 9999)}", "phone", True),
            (f"token = {hexes}", "secret", True), ("password = changeme_changeme", "secret", False),
            ("token = aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "secret", False),
        ][i % 8]
        docs.append((i, f"{before} {value} {after}"))
        if kind:
            (true if good else lures).add((i, kind, len(before) + 1, len(before) + 1 + len(value)))
    return docs, true, lures


def added(spark, docs):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = set()
    for r in pii.find(frame).collect():
        for s in filter(None, r.spans.split(",")):
            kind, start, end = s.split(":")
            out.add((r.doc_id, kind, int(start), int(end)))
    return out


def test_precision_and_recall_of_added_spans(spark):
    docs, true, lures = planted()
    found = added(spark, docs)
    easy = {(i, k, a, b) for i, k, a, b in found if i % 8 in (1, 2)}
    assert Counter(k for _, k, _, _ in easy) == {"email": 75, "card": 75}
    got = found - easy
    assert not got & lures
    precision, recall = len(got & true) / len(got), len(got & true) / len(true)
    assert precision >= 0.95 and recall >= 0.95, (precision, recall, Counter(k for _, k, _, _ in got - true), Counter(k for _, k, _, _ in true - got))


def test_no_added_card_fails_its_check_digit(spark):
    rng = random.Random(8)
    docs = [(i, f"card {card(rng, i % 10 > 0)} paid") for i in range(400)] + [(500, "numbers 12 4111 1111 1111 1111 end")]
    text = dict(docs)
    for i, kind, start, end in added(spark, docs):
        assert kind != "card" or luhn("".join(c for c in text[i][start:end] if c.isdigit()))


def test_labelers_differ_within_kinds(spark):
    values = ["token = 0123456789", "secret = your_key_goes_in_here", "token = 46d6a7e6a8a7bb8c02c2f090c991ec47d826f64d",
              "12:30:45:10:11:12:13:14", "2001:db8:1:2:3:4:5:6", "2a00:1450:4001:81b:0:1:2:200e"]
    frame = spark.createDataFrame([(i, f"see {v} now") for i, v in enumerate(values)], "doc_id long, text string")
    votes = {r.doc_id: [tuple(s.votes) for s in r.spans] for r in pii.with_candidates(frame).select("doc_id", "spans").collect()}
    assert votes == {0: [], 1: [(0, 0, 1)], 2: [(1, 1, 1)], 3: [(0, 1, 1)], 4: [(1, 0, 1)], 5: [(1, 1, 1)]}
