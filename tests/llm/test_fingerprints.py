"""Fingerprints against a plain version: every anchor, every likeness, hot ids and copies."""

import re
import struct
from collections import Counter

import pytest
import xxhash

from courtside.llm import syncmers


def long_hash(values, seed=42):
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v - (1 << 64) if v >= 1 << 63 else v), seed)
    return seed


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def anchors(text):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    k, s = syncmers.K, syncmers.S
    inner = [signed(long_hash(words[i : i + s])) for i in range(len(words) - s + 1)]
    chosen = []
    for at in range(len(words) - k + 1):
        window = inner[at : at + k - s + 1]
        if min(window) in (window[0], window[-1]):
            chosen.append((at, long_hash([window[j] for j in (0, s, k - s)]) >> 32))
    if words and not chosen:
        chosen = [(0, long_hash(words) >> 32)]
    ends = [at for at, _ in chosen[1:]] + [chosen[-1][0] if chosen else 0]
    return [long_hash([h, end - at]) >> 32 for (at, h), end in zip(chosen, ends)]


def likeness(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain(docs):
    """docs: (id, text). Rows by id, then by the signed hash of the text; equal rows follow each other."""
    order = sorted((i, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), t or "") for i, t in docs if i is not None)
    out = []
    for (i, _, text), (_, _, after) in zip(order, order[1:] + order[:1]):
        cut = len(text) // 4
        a, e = anchors(text), anchors(text[: len(text) - cut] + after[:cut])
        out.append((i, "".join(f"{x:08x}" for x in a), "".join(f"{x:08x}" for x in e), likeness(a, e), likeness(a, anchors(after))))
    for i, t in docs:
        if i is None:
            a = "".join(f"{x:08x}" for x in anchors(t))
            out.append((None, a, a, 1.0, 0.0))
    return out


def check(spark, docs):
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, anchors string")
    got = [(r.doc_id, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in syncmers.edited_likeness(frame).collect()]
    rounded = lambda rows: Counter((*r[:3], round(r[3], 12), round(r[4], 12)) for r in rows)
    assert rounded(got) == rounded(plain(docs))


def test_corpus_against_plain_version(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(spark, [tuple(r) for r in rows])
    assert max(len(anchors(t)) for _, t in rows) > 64


@pytest.mark.parametrize("docs", [
    [(1, "one two three four")], [(1, None), (1, None), (2, ""), (None, "plain words only here"), (3, "a " * 400)], [],
    [(5, " ".join(f"w{j % 7}" for j in range(50)))] * 3 + [(6, "é 💬 " * 30)],
])
def test_awkward_rows(spark, docs):
    check(spark, docs)


def test_hot_ids_and_copies(spark):
    docs = [(i, f"text {i} " + " ".join(f"t{i}v{j}" for j in range(20))) for i in range(300)]
    docs += [(77, f"other {n} " + " ".join(f"o{n % 40}v{j}" for j in range(15))) for n in range(150)]
    docs += [(200, "the very same row " + " ".join(f"s{j}" for j in range(30)))] * 220 + [(200, "another")] * 5
    check(spark, docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    ranged, repeated = syncmers._split_hot(frame)
    assert repeated and max(r["count"] for r in ranged.groupBy("range").count().collect()) < 100


def test_copies_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "_COPIES", 16)
    check(spark, [(1, "a b c")] * 100 + [(2, "d e f")] * 33 + [(3, "g")])
