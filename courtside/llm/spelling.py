"""Spelling variants: generated edits probe Bloom filters, only positives meet the vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import lower_ascii, mix, stored

MIN_LENGTH, MIN_COUNT = 5, 3
#: Of the occurrences whose hash this divides, one code point is left out.
GARBLED = 97
#: A form occurs at least so many times as often as the word.
RATIO = 2
#: Code points a word can hold, in order: a-z and U+00C0 to U+00FF.
LETTERS = [*range(0x61, 0x7B), *range(0xC0, 0x100)]
#: Words of this length and longer share a shard.
LONG = 64
#: Words of one filter, its bits per word, and bytes of filters sent to all tasks at once.
FILTER_WORDS, BITS, PASS_BYTES = 1 << 19, 16, 32 << 20
#: Edits that a task holds at once.
EDITS = 1 << 21

_CODE = np.zeros(256, np.uint8)
_CODE[LETTERS] = np.arange(len(LETTERS))
_LETTER = mix(np.arange(1, len(LETTERS) + 1, dtype=np.uint64))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALTS = (mix(np.arange(1, 9, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def occurrences(docs: DataFrame, garbled: int = GARBLED) -> DataFrame:
    """``word`` of every run of letters, A-Z lower-cased, one code point left out where the hash
    of document and run says so. A null id counts as empty there."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select("run", h.alias("h")).select(F.when(F.col("h") % garbled == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, garbled: int = GARBLED) -> DataFrame:
    """``word`` and ``n`` of the words long and frequent enough."""
    words = occurrences(docs, garbled).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# ---- hashes of words and of their edits ---------------------------------------------------


def letter_values(length: int) -> np.ndarray:
    """A value for every letter at every place; a word's hash is mixed from their sum, so that
    the hash of an edit follows from sums at hand."""
    return mix(_LETTER[:, None] ^ (np.arange(length, dtype=np.uint64) * _STEP)[None, :])


def codes(words: list[str]) -> np.ndarray:
    """Letter numbers, one line per word; all words are of one length."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return _CODE[points].reshape(len(words), -1)


def word_hashes(lines: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    total = np.zeros(len(lines), np.uint64)
    for start in range(0, lines.shape[1], block):
        part = lines[:, start : start + block]
        places = np.arange(start, start + part.shape[1], dtype=np.uint64) * _STEP
        total += mix(_LETTER[part] ^ places).sum(axis=1, dtype=np.uint64)
    return mix(total)


def edits(lines: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Edits of words of one length, a bounded number at once: their length, hashes, lines,
    places and new letters (-1: left out). Every pair of near words comes up once: from the
    longer one, by leaving out the first letter of a run of equal ones, or from the one with
    the smaller letter, by replacing it with the larger."""
    n, length = lines.shape
    size = len(LETTERS)
    places = np.arange(length, dtype=np.uint64) * _STEP
    here = mix(_LETTER[lines] ^ places)
    total = here.sum(axis=1, dtype=np.uint64)
    if length > 1:
        moved = mix(_LETTER[lines[:, 1:]] ^ places[:-1])  # each later letter one place earlier
        before = np.cumsum(here, axis=1, dtype=np.uint64) - here
        after = np.zeros_like(here)
        after[:, :-1] = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        first = np.ones(lines.shape, bool)
        first[:, 1:] = lines[:, 1:] != lines[:, :-1]
        line, place = np.nonzero(first)
        yield length - 1, mix((before + after)[line, place]), line, place, np.full(len(line), -1)
    width = max(1, EDITS // (size * n))
    larger = np.arange(size)[None, :] > np.arange(size)[:, None]
    for start in range(0, length, width):
        part = lines[:, start : start + width]
        values = mix(_LETTER[None, :] ^ places[start : start + part.shape[1], None])
        line, place, letter = np.nonzero(larger[part])
        without = (total[:, None] - here[:, start : start + width])[line, place]
        yield length, mix(without + values[place, letter]), line, place + start, letter


# ---- filters ------------------------------------------------------------------------------


def shard_of(length: int) -> int:
    return min(length, LONG)


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(parts)).astype(np.int64)


def _block(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _bit(hashes: np.ndarray, i: int) -> np.ndarray:
    return np.uint32(1) << (hashes.astype(np.uint32) * _SALTS[i] >> np.uint32(27))


def build_filter(hashes: np.ndarray) -> np.ndarray:
    """A blocked filter: blocks of 256 bits, in each of whose eight words a key sets one."""
    out = np.zeros((max(1, -(-len(hashes) * BITS // 256)), 8), np.uint32)
    block = _block(hashes, len(out))
    for i in range(8):
        np.bitwise_or.at(out[:, i], block, _bit(hashes, i))
    return out


def probe(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter may hold."""
    at = np.arange(len(hashes))
    block = _block(hashes, len(table))
    for i in range(8):
        hit = table[block, i] & _bit(hashes, i) != 0
        at, block, hashes = at[hit], block[hit], hashes[hit]
    return at


def _by_length(words: list[str], limit: int = EDITS) -> Iterator[list[int]]:
    """Places of words of one length, few enough that their edits stay within the limit."""
    places: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        places.setdefault(len(w), []).append(i)
    for length, mine in places.items():
        step = max(1, limit // (length * len(LETTERS)))
        for start in range(0, len(mine), step):
            yield mine[start : start + step]


def filters(words: DataFrame, parts: dict[int, int]) -> DataFrame:
    """``shard``, ``part`` and ``bits`` (a filter) of all words. ``parts``: filters per shard."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            for mine in _by_length(found, 1 << 24):
                shard = shard_of(len(found[mine[0]]))
                hashes = word_hashes(codes([found[i] for i in mine]))
                columns = [np.full(len(mine), shard, np.int32), part_of(hashes, parts[shard]).astype(np.int32), hashes.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "part", "hash"])

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def out():
            bits = build_filter(np.concatenate(held).view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([bits.tobytes()], pa.binary())],
                                              ["shard", "part", "bits"])

        for batch in batches:
            shard, part, hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            cuts = np.flatnonzero(np.diff(shard.astype(np.int64) << 32 | part, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if key != (shard[a], part[a]) and held:
                    yield out()
                    held = []
                key = int(shard[a]), int(part[a])
                held.append(hashes[a:b])
        if held:
            yield out()

    dealt = words.select("word").mapInArrow(keyed, "shard int, part int, hash long").repartition("shard", "part").sortWithinPartitions("shard", "part")
    return dealt.mapInArrow(built, "shard int, part int, bits binary")


def positives(words: DataFrame, filters_: dict[tuple[int, int], bytes], parts: dict[int, int], min_length: int) -> DataFrame:
    """``word``, ``n`` and ``edit``: the edits that a filter sent here may hold."""
    shared = words.sparkSession.sparkContext.broadcast(filters_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.frombuffer(v, np.uint32).reshape(-1, 8) for k, v in shared.value.items()}
        for batch in batches:
            found, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for mine in _by_length(found):
                hits = []
                for length, hashes, line, place, letter in edits(codes([found[i] for i in mine])):
                    shard = shard_of(length)
                    if length < min_length or shard not in parts:
                        continue
                    part = part_of(hashes, parts[shard]) if parts[shard] > 1 else np.zeros(len(hashes), np.int64)
                    for p in range(parts[shard]):
                        if (shard, p) in tables:
                            these = np.flatnonzero(part == p)
                            at = these[probe(tables[shard, p], hashes[these])]
                            hits += zip(line[at].tolist(), place[at].tolist(), letter[at].tolist())
                out = [], [], []
                for line, place, letter in hits:
                    word = found[mine[line]]
                    out[0].append(word)
                    out[1].append(n[mine[line]])
                    out[2].append(word[:place] + (chr(LETTERS[letter]) if letter >= 0 else "") + word[place + 1 :])
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1], pa.int64()), pa.array(out[2])], ["word", "n", "edit"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, edit string")


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, filter_words: int = FILTER_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``a``, ``a_n``, ``b``, ``b_n``: every pair of words of the vocabulary (word, n; stored) that
    differ by one code point, once. Filters beyond ``pass_bytes`` are sent in several passes."""
    shard = F.least(F.length("word"), F.lit(LONG)).alias("shard")
    sizes = {r.shard: r.n for r in words.groupBy(shard).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per length
    parts = {s: -(-n // filter_words) for s, n in sizes.items()}
    table = filters(words, parts)
    passes, room = [[]], pass_bytes
    for s, n in sorted(sizes.items()):
        for p in range(parts[s]):
            cost = n * BITS // 8 // parts[s] + 32
            if passes[-1] and cost > room:
                passes.append([])
                room = pass_bytes
            passes[-1].append((s, p))
            room -= cost
    table = stored(table, "filters") if len(passes) > 1 else table
    found = None
    for mine in passes:
        rows = table
        if len(passes) > 1:
            keys = F.col("shard") * F.lit(1 << 32).cast("long") + F.col("part")
            rows = table.where(keys.isin([s << 32 | p for s, p in mine]))
        some = positives(words, {(r.shard, r.part): bytes(r.bits) for r in rows.collect()}, parts, min_length)
        some = stored(some, "edits") if len(passes) > 1 else some
        found = some if found is None else found.unionByName(some)
    other = words.select(F.col("word").alias("edit"), F.col("n").alias("b_n"))
    return found.join(other, "edit").select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("edit").alias("b"), "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root`` of words with a form (``word``, ``form``): forms followed to the last.
    Every step of a round goes twice as far as in the round before, and a form occurs at least
    twice as often as its word, so there are few rounds; each is stored."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return now
        now = after.drop("moved")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, garbled: int = GARBLED, ratio: int = RATIO,
             filter_words: int = FILTER_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n`` of every word in ``docs`` (doc_id,
    text; other columns are ignored) that is long and frequent enough.

    A null text has no words; a null id counts as empty in the hash that garbles; repeated rows
    count each; an empty table gives no rows. Ties among near words go by code points. Near
    words are exact: the filters only choose which edits are looked up.
    """
    words = stored(vocabulary(docs, min_length, min_count, garbled), "vocabulary")
    pairs = near_words(words, min_length, filter_words, pass_bytes)
    one = lambda word, other, n: F.struct(F.col(word).alias("word"), (-F.col(n)).alias("low"), F.col(other).alias("form"))
    both = pairs.select(F.inline(F.array(one("a", "b", "b_n"), one("b", "a", "a_n"))))  # the pairs are found once
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("low", "form")).alias("best"))
    has_form = -F.col("best.low") >= ratio * F.col("n")
    table = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has_form, F.col("best.form")).alias("form"), F.when(has_form, -F.col("best.low")).alias("form_n"))
    table = stored(table, "forms")
    last = roots(table.where("form is not null"))
    return table.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
