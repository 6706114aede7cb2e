"""The operators' parts: indexes, sketches, links, templates, models."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from courtside.llm import bpe, chat, decontaminate, pii, quality, simhash, substrings, syncmers, toxicity, urls
from courtside.llm.common import WHITE, hash_words, stored
from courtside.llm.registered import vocabulary

# ---- words and indexes --------------------------------------------------------------------


@given(st.binary(max_size=200), st.integers(1, 64))
def test_words_hash_alike_whatever_the_block(data, block):
    whole = hash_words(np.frombuffer(data, np.uint8), ~WHITE)
    cut = hash_words(np.frombuffer(data, np.uint8), ~WHITE, block)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()
    words = data.split()
    assert len(words) == len(whole[0]) and len(set(words)) == len(set(whole[0].tolist()))


RUNS = st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=6)


@given(RUNS, st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=3), min_size=1, max_size=10), st.integers(1, 7))
def test_index_finds_every_occurrence(runs, patterns, rate):
    text = np.array([x for r in runs for x in [*r, 0]], np.int64)
    index = decontaminate.FMIndex(text, 4, rate)
    low, high = index.search(np.array(patterns))
    for pattern, a, b in zip(patterns, low.tolist(), high.tolist()):
        want = [i for i in range(len(text) - 2) if text[i : i + 3].tolist() == pattern]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@given(RUNS)
def test_suffixes_are_in_order(runs):
    text = np.array([x for r in runs for x in [*r, 0]], np.int64)
    ends = np.flatnonzero(text == 0)
    # Each end is a symbol of its own, below all others, by place.
    key = lambda i: [(1, x) for x in text[i : ends[ends >= i][0]]] + [(0, ends[ends >= i][0])]
    assert decontaminate.suffix_order(text).tolist() == sorted(range(len(text)), key=key)


def test_passes_and_shards_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    columns = ["doc_id", "n_words", "hit_words", "hit_items", "spans"]
    want = sorted(decontaminate.find(docs, bench).select(*columns).collect())
    assert any(r.hit_words for r in want)
    assert sorted(decontaminate.find(docs, bench, pass_bytes=4000, shard_bytes=5000).select(*columns).collect()) == want
    assert len(list(decontaminate._passes(bench, "item_id", "text", 10, 4000))) > 2


# ---- sketch -------------------------------------------------------------------------------


@given(st.lists(st.integers(0, 3), max_size=120))
def test_no_window_occurs_more_often_than_its_anchor_is_counted(values):
    text = " ".join(f"w{v}" for v in values).encode()
    w = substrings._Windows([text], 6, 3)
    counted = w.counted().tolist()
    seen = {}
    for at in range(len(values) - 5):
        seen.setdefault(tuple(values[at : at + 6]), []).append(at)
    for places in seen.values():
        assert counted.count(w.lowest[places[0]]) >= len(places)


def test_a_full_sketch_loses_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(substrings.digest(docs).collect())
    assert sum(r.n_removed for r in want)
    assert sorted(substrings.digest(docs, cells=1 << 17).collect()) == want
    assert sorted(substrings.digest(docs.repartition(7), anchor=19).collect()) == want


def test_cleaned_texts_keep_what_the_digest_keeps(spark):
    import brute

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r.doc_id: r for r in substrings.digest(docs).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    after = substrings.clean(docs)
    assert after.columns == docs.columns
    for r in after.collect():
        assert brute.sha(" ".join(r.text.encode().split() and [w.decode() for w in r.text.encode().split()])) == kept[r.doc_id].kept_sha256
        assert (r.text == before[r.doc_id]) == (kept[r.doc_id].n_removed == 0)


# ---- near copies --------------------------------------------------------------------------


@settings(max_examples=20)
@given(st.integers(0, 2**32), st.integers(0, 31), st.integers(2, 300))
def test_large_buckets_link_like_small_ones(seed, wildcard, size):
    rng = np.random.default_rng(seed)
    free = simhash._free_bits(wildcard << 32)
    prints = np.full(size, rng.integers(2**63), np.uint64)
    for _ in range(3):
        prints ^= np.uint64(1) << np.array(free, np.uint64)[rng.integers(0, len(free), size)]
    prints = np.unique(prints)
    pairwise = simhash.links_in_bucket(prints, free, pairwise=10_000)
    assert simhash.links_in_bucket(prints, free, pairwise=0).tolist() == pairwise.tolist()


def test_links_join_what_pairs_would(spark):
    import brute

    rng = np.random.default_rng(3)
    prints = {0, -1, 1 << 63 - 1}
    for center in rng.integers(-(2**63), 2**63, 8):
        for _ in range(120):
            flips = rng.choice(12, 3) * 5
            prints.add(int(np.int64(center) ^ np.bitwise_xor.reduce(np.int64(1) << flips)))
    prints = sorted(prints)
    roots = brute.reachable([p % 2**64 for p in prints])
    table = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fingerprint long")
    got = {r.fingerprint: r.component_id for r in simhash.component_table(table).collect()}
    assert [got[p] for p in prints] == roots and len(set(roots)) < len(prints)


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges.orderBy("b")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}


# ---- tokens -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec(spark):
    return bpe.ByteBPE(*vocabulary(spark))


@pytest.fixture(scope="module")
def coder(spark):
    import base64

    import tiktoken

    ranks, pattern = vocabulary(spark)
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text() | st.text("aa  \n\t.1'sé\u2003\x1c😀", max_size=60))
def test_encodes_like_the_rank_library(codec, coder, text):
    ids = codec.encode([text])[0]
    assert ids == coder.encode_ordinary(text)
    assert codec.decode(ids).decode() == text
    assert codec.from_characters(codec.characters(ids)) == text.encode()
    offsets = codec.offsets(text, ids)
    at = 0
    for number, (start, end) in zip(ids, offsets):
        size = len(codec.token_bytes[number])
        assert codec.token_bytes[number] in text[start:end].encode()
        assert len(text[:start].encode()) <= at and at + size <= len(text[:end].encode())
        at += size


def test_split_characters_come_together(codec):
    ids = codec.encode(["🂡"])[0]
    assert len(ids) > 1 and codec.offsets("🂡", ids) == [(0, 1)] * len(ids)
    assert b"".join(codec.decode([i]) for i in ids).decode() == "🂡"


def test_columns_of_encoding(spark):
    docs = spark.createDataFrame([(1, "a b", 9), (2, None, 9)], "doc_id long, text string, ids long")
    ranks, pattern = vocabulary(spark)
    got = bpe.decode(bpe.encode(docs, ranks, pattern, with_offsets=True), ranks, pattern).orderBy("doc_id").collect()
    assert [tuple(o) for o in got[0].offsets] == [(0, 1), (1, 3)] and bytes(got[0].decoded) == b"a b"
    assert got[1].ids == [] and bytes(got[1].decoded) == b""


# ---- syncmers -----------------------------------------------------------------------------


def test_equal_passages_give_equal_anchors(spark):
    passage = [f"p{i}" for i in range(60)]
    texts = [(1, " ".join([f"a{i}" for i in range(17)] + passage)), (2, " ".join(passage + ["z"] * 30)), (3, "few words"), (4, None), (5, " ")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.syncmers] for r in syncmers.with_syncmers(rows, positions=True).collect()}
    inside = [(at - 17, h) for at, h in got[1] if at >= 17]
    assert inside and inside == [(at, h) for at, h in got[2] if at + syncmers.K <= 60]
    assert len(got[3]) == 1 and got[4] == got[5] == []


def test_likeness_bounds(spark):
    rows = spark.createDataFrame([([1, 2, 3], [1, 2, 3]), ([1], [2]), ([], []), ([], [1]), ([1, 2], [2, 3])], "a array<long>, b array<long>")
    assert [r[0] for r in rows.select(syncmers.likeness("a", "b")).collect()] == [1, 0, 1, 0, pytest.approx(1 / 3)]


# ---- chats --------------------------------------------------------------------------------


def render(source, **scope):
    return "".join(text for text, _ in chat.compile_template(source)(scope))


def test_template_language():
    assert render("{% for m in ms %}{{ loop.index0 + 1 }}{{ m.a | upper }}{% if loop.first %}!{% endif %} {% endfor %}", ms=[{"a": "x"}, {"a": "y"}]) == "1X! 2Y "
    assert render("{% if a == 'x' and not b %}1{% elif a != 'x' or b %}2{% else %}3{% endif %}", a="x", b=True) == "2"
    assert render(" {%- if (true) -%} x {%- endif -%} {{ 'q\\n' }}") == "xq\n"
    assert render("{{ nothing.at.all }}|{{ x.__class__ }}|{{ x.upper }}", x="text") == "||"


@pytest.mark.parametrize("source", ["{{ a() }}", "{{ a[0] }}", "{% import os %}", "{{ x | eval }}", "{% for x in y %}", "{{ 'a' 'b' }}", "{{ (a }}", "{{ }}", "{% if a %}"])
def test_sandbox_refuses(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' + 'c' | upper }}{% if 1 == 1 %}d{% else %}{{ x }}{% endif %}{% if false %}{{ y }}{% endif %}"))
    assert tree == ("block", [("print", ("const", "abCd"))])


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "to>ol"]), st.text("\\<>[]/s INT\n", max_size=12)), max_size=6))
def test_turns_are_read_back(turns):
    reader, loss, got = chat.Reader(), "", []
    for text, marked in chat.compile_template(chat.TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]}):
        loss += chat.unescape(text) if marked else ""
        got += reader.feed(text)
    assert got == turns and not reader.rest and loss == "".join(t for r, t in turns if r == "assistant")


def test_generation_spans(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "[a]")], "conv_id long, turn long, role string, text string")
    row = chat.render(rows).first()
    assert row.formatted == "<s>[INST] hi [/INST]\\[a]</s>" and row.formatted[row.generated[0].start : row.generated[0].end] == "\\[a]"


# ---- models -------------------------------------------------------------------------------


def test_toxicity_learns_words_in_either_order():
    rng = np.random.default_rng(1)
    clean = [" ".join(f"w{i}" for i in rng.integers(0, 300, 60)) for _ in range(300)]
    toxic = [t + " vile brute" if i % 2 else "Vile, x brute! " + t for i, t in enumerate(clean[:80])]
    model = toxicity.Scorer(toxicity.train(clean[80:] + toxic, [0] * 220 + [1] * 80))
    assert np.count_nonzero(model.weight) < 400  # sparse
    scores = model.scores([b"you vile brute", b"w1 w2 w3", b""])
    assert scores[0] >= 0.7 > scores[1] and scores[2] < 0.7
    assert np.allclose(model.scores([b"w1"] * 3), model.scores([b"w1"])[0])


def test_network_gradients_are_right():
    network = quality.Network()
    noise = np.random.default_rng(8)  # no two places alike, so the largest response is one place
    docs, labels = [quality.chunks(noise.bytes(n)) for n in (900, 160)], np.array([1.0, 0.0], np.float32)

    def loss():
        pooled = np.concatenate([network.pooled(d) for d in docs])
        p = network.probability(pooled, np.array([0, len(docs[0])]))
        return -(np.log(p[0]) + np.log(1 - p[1])) / 2

    got = network.gradients(docs, labels)
    rng = np.random.default_rng(2)
    for name in ("filters", "embed", "shift", "bias"):
        value = getattr(network, name)
        for at in rng.choice(value.size, min(5, value.size), replace=False):
            old, step = value.flat[at], 2e-3
            value.flat[at] = old + step
            up = loss()
            value.flat[at] = old - step
            down = loss()
            value.flat[at] = old
            assert got[name].flat[at] == pytest.approx((up - down) / (2 * step), abs=2e-3)


@given(st.binary(max_size=3000))
def test_chunks_cover_every_byte(data):
    pieces = quality.chunks(data)
    step = quality.CHUNK - quality.OVERLAP
    whole = np.concatenate([p[:step] for p in pieces[:-1]] + [pieces[-1]])
    assert whole[: len(data)].astype(np.uint8).tobytes() == data and (whole[len(data) :] == quality.PAD).all()


@pytest.mark.parametrize("model, name, least", [(toxicity, "toxic", 0.93), (quality, "quality", 0.97)])
def test_held_out_accuracy(spark, model, name, least):
    from courtside.llm.linear import is_held_out

    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = labels.where(is_held_out("doc_id")).join(docs, "doc_id")
    rows = model.score(held, model.fit(docs, labels)).collect()
    right = sum((r.score >= model.THRESHOLD) == r[name] for r in rows) / len(rows)
    wrongly = sum(r.score >= model.THRESHOLD for r in rows if not r[name])
    assert right >= least and (name == "quality" or wrongly <= len(rows) / 200)


def test_estimation_finds_the_reliable_labeler():
    rng = np.random.default_rng(4)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.3
        votes = tuple(int(truth if rng.random() < p else not truth) for p in (0.95, 0.9, 0.6))
        counts[votes] = counts.get(votes, 0) + 1
    belief = pii.estimate([(0, v, (0, 0, 0), n) for v, n in counts.items()])
    for votes, found in ((v, b) for (_, v), b in belief.items()):
        odds = 0.3 / 0.7
        for vote, right in zip(votes, (0.95, 0.9, 0.6)):
            odds *= right / (1 - right) if vote else (1 - right) / right
        assert found == pytest.approx(odds / (1 + odds), abs=0.2)


def test_spans_in_crowded_texts(spark):
    """More matches than a block has, and long runs without one."""
    text = "".join(f"é{i}@a.org " for i in range(300)) + "9" * 40_000 + "b" * 40_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.with_base(docs, "text").first()
    mails = [s for s in row.base if s.kind == 0]
    assert len(mails) == 300 and all(text[s.start : s.end] == s.value for s in mails)


def test_reputation_shrinks_to_the_level_above(spark):
    pages = [(i, "bad.x.org") for i in range(50)] + [(50 + i, "new.x.org") for i in range(3)] + [(100 + i, f"h{i % 30}.y.com") for i in range(300)]
    labels = [(i, 1) for i in range(40)] + [(40 + i, 0) for i in range(10)] + [(100 + i, 0) for i in range(290)]
    got = {r.host: r for r in urls.reputations(spark.createDataFrame(pages, "page_id long, host string"), spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert got["new.x.org"].n == 0 and got["h1.y.com"].bad_mean < got["new.x.org"].bad_mean < got["bad.x.org"].bad_mean
    assert got["bad.x.org"].bad_low > urls.MAX_BAD > got["h1.y.com"].bad_low
    assert all(r.bad_low < r.bad_mean for r in got.values())


def test_stored_tables_lie_in_the_named_folder(spark, tmp_path, monkeypatch):
    named = f"file://{tmp_path}/named"
    monkeypatch.setattr(type(spark.conf), "get", lambda self, key, *default: named if key == "spark.checkpoint.dir" else None)
    assert stored(spark.range(3), "x").count() == 3 and list((tmp_path / "named").iterdir())
