"""Spelling variants, nearest neighbours and collocations: parts, awkward tables, brute force."""

import re
import zlib
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import brute
from courtside.llm import collocations, neighbours, spelling

# ---- spelling variants --------------------------------------------------------------------


def brute_words(docs, min_length=5, min_count=3, garbled=97):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(brute._LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % garbled == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs, **options):
    words = brute_words(docs, **options)
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and is_near(v, w)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


LETTERS = st.text("abé", min_size=1, max_size=7)


@given(st.lists(LETTERS, min_size=1, max_size=30, unique=True), st.lists(LETTERS, max_size=30, unique=True))
@settings(deadline=None)
def test_filters_lose_no_edit(words, others):
    for word in words:
        made = {}
        for length, hashes, line, place, letter in spelling.edits(spelling.codes([word])):
            for h, i, c in zip(hashes.tolist(), place.tolist(), letter.tolist()):
                edit = word[:i] + (chr(spelling.LETTERS[c]) if c >= 0 else "") + word[i + 1 :]
                assert len(edit) == length and edit not in made
                made[edit] = h
                if edit:
                    assert spelling.word_hashes(spelling.codes([edit]))[0] == h
        for other in others:  # every near pair comes up from exactly one side
            if is_near(word, other):
                back = [word[:i] + x + word[i + 1 :] for i in range(len(word)) for x in [""]]
                smaller = len(word) == len(other) and word < other
                assert (other in made) == (other in back or smaller)
    hashes = np.concatenate([spelling.word_hashes(spelling.codes([w])) for w in words])
    assert spelling.probe(spelling.build_filter(hashes), hashes).tolist() == list(range(len(words)))


VARIANTS = [
    (1, "Colour colour COLOUR color colors colours coloür"), (2, "colour color color kolor colors colours"), (None, "colour kolor kolor colors aaaaa aaaa"),
    (3, None), (4, ""), (5, "aaaaa aaaaaa " * 3 + "aaaaaa " * 9), (6, "aaaaa÷ aaaaa÷ aaaaa÷ x" + "y" * 70), (6, "x" + "y" * 70), (7, "x" + "y" * 70 + " " + "y" * 70),
    (8, ("y" * 70 + " ") * 5), (9, ("z" * 30_000 + " " + "z" * 29_999 + "à ") * 3 + ("z" * 29_999 + " ") * 8), (10, "abcde " * 40 + "abcd " * 5 + "abcdef abcdef abcdef"),
    (10, "abcde " * 40), (10, "abcde " * 40), (11, "1colour2 colour_kolor"),
]


@pytest.mark.parametrize("options", [{}, {"filter_words": 3, "pass_bytes": 64}])
def test_variants(spark, options):
    docs = spark.createDataFrame([(d, t, "w") for d, t in VARIANTS], "doc_id long, text string, word string").withColumnRenamed("word", "a.n")
    for garbled in (97, 2):
        got = spelling.variants(docs, garbled=garbled, **options)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert sorted(tuple(r) for r in got.collect()) == brute_variants(VARIANTS, garbled=garbled)
    assert spelling.variants(docs.limit(0), **options).count() == 0


# ---- nearest neighbours -------------------------------------------------------------------


@pytest.mark.parametrize("axes, digits", [(2, 3), (3, 2), (4, 2)])
def test_curve_goes_from_neighbour_to_neighbour(axes, digits):
    size = 1 << digits
    cells = np.stack(np.meshgrid(*[np.arange(size)] * axes), axis=-1).reshape(-1, axes)
    place = neighbours.hilbert(cells, digits)
    assert sorted(place.tolist()) == list(range(size**axes))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def brute_nearest(rows, every=20, top=20):
    """Rows (id, vector) that take part; products summed in order."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = []
    for query, q in rows:
        if query % every == 0:
            found = sorted((-reduce(lambda s, p: s + p[0] * p[1], zip(q, v), 0.0), i) for i, v in rows if i != query)[:top]
            out += [(query, rank, i, -low) for rank, (low, i) in enumerate(found, 1)]
    return sorted(out)


def test_small_and_awkward_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    fine = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.standard_normal((150, 6)) * rng.uniform(0.1, 9, (150, 1)))]
    fine += [(i, fine[7][1]) for i in range(200, 260)] + [(40, fine[40][1])]  # copies, and a repeated row
    odd = [(300, None), (320, [0.0] * 6), (340, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (360, [float("nan")] + [1.0] * 5), (380, [float("inf")] + [1.0] * 5), (400, [1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in fine + odd], "vec_id long, embedding array<double>, score string").withColumnRenamed("score", "v.h")
    got = neighbours.nearest(df)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_nearest(fine)
    for few in (0, 1, 3):
        some = spark.createDataFrame(fine[:few], "vec_id long, embedding array<float>")
        assert sorted(tuple(r) for r in neighbours.nearest(some).collect()) == brute_nearest(fine[:few])


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_windows_hold_the_neighbours(spark, monkeypatch, kind):
    """Many buckets, a third of the rows copies of one vector, lengths that differ."""
    monkeypatch.setattr(neighbours, "SMALL", 64)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 12))
    if kind == "clustered":
        x = x * 0.05 + rng.standard_normal((40, 12))[rng.integers(0, 40, 4000)]
    x *= rng.uniform(0.5, 2, (4000, 1))
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = defaultdict(set), defaultdict(list)
    result = [tuple(r) for r in neighbours.nearest(df).collect()]
    for query, rank, i, score in result:
        got[query].add((i, score))
    scores = x[::20] @ x.T
    found = total = 0
    for q, line in zip(range(0, 4000, 20), scores):
        line[q] = -np.inf
        best = sorted(range(4000), key=lambda i: (-round(line[i], 9), i))[:20]
        assert len(got[q]) == 20
        found, total = found + len({i for i, _ in got[q]} & set(best)), total + 20
    assert found / total >= 0.9
    exact = {(q, i): s for q, _, i, s in result}
    assert all(abs(s - float(x[q] @ x[i])) < 1e-9 for (q, i), s in list(exact.items())[:500])


# ---- collocations -------------------------------------------------------------------------


@given(st.integers(1, 60), st.lists(st.tuples(st.integers(0, 2**63), st.integers(0, 2**63), st.integers(1, 10**12)), min_size=1, max_size=60), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_filters_keep_every_entry(bits, entries, prefix):
    mask = np.uint64((1 << bits) - 1)
    left, right = (np.array([e[i] for e in entries], np.uint64) & mask for i in (0, 1))
    count = np.array([e[2] for e in entries])
    want = Counter()
    for a, b, c in zip(left.tolist(), right.tolist(), count.tolist()):
        want[a, b] += c
    high, low, count = collocations.summed(*collocations.aligned(*collocations.permute(left, right, bits), bits), count)
    assert (np.diff(high.astype(object)) >= 0).all()
    prefix = min(prefix, 2 * bits - 1)
    got = Counter()
    for number in np.unique(collocations._leading(high, prefix)).tolist():
        mine = collocations._leading(high, prefix) == number
        back = collocations.unpack(collocations.pack(high[mine], low[mine], count[mine], prefix, bits))
        assert all((x == y[mine]).all() for x, y in zip(back, (high, low, count)))
        a, b = collocations.restore(*collocations.halves(back[0], back[1], bits), bits)
        got.update(dict(zip(zip(a.tolist(), b.tolist()), back[2].tolist())))
    assert got == want


def brute_collocations(docs, min_count, top=2000):
    f, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(brute._LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, 5):
                f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items()):
                continue
            cut = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-cut[0], -a, " ".join(p).encode(), counts[p[: cut[1]]], counts[p[cut[1] :]]))
        out += [(lang, rank, p.decode(), -a, left, right, totals[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out, key=repr)


PHRASES = [
    ("en", "New York is big. In New York, new york!\nnew\tyork new  york"), ("en", None), (None, "a b a b a b"), (None, ""), ("de", "ä ö ä ö Ä ö; ä\x0bö ä\x0cö"),
    ("en", "the quick brown fox " * 9), ("en", "the quick brown fox jumps. " * 5), ("fr", "x x x x x x x x"), ("en", "a.b a.b a b a b \x1c \x1c"),
    ("fr", "x y " * 400_000), ("en", "the quick brown fox jumps. " * 5),
]


@pytest.mark.parametrize("options", [{}, {"dictionary": 3, "held": 16}, {"top": 3}])
def test_collocations(spark, monkeypatch, options):
    monkeypatch.setattr(collocations, "GATHERED", 50)
    monkeypatch.setattr(collocations, "ROUND_BITS", 3)
    docs = spark.createDataFrame([(d, t, 1) for d, t in PHRASES], "lang string, text string, n long").withColumnRenamed("n", "id.a")
    got = collocations.collocations(docs, min_count=3, **options)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_collocations(PHRASES, 3, options.get("top", 2000))
    assert collocations.collocations(docs.limit(0), min_count=3, **options).count() == 0
