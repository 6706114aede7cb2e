"""Phrase collocations: n-grams of word ids counted in counting quotient filters."""

from __future__ import annotations

import io
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import cut_batches, mix, stored

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2000
#: A candidate goes if a longer one around it has at least this share of its count, in percent.
ABSORBED = 80
#: Scores are shares in two millionths.
SCALE = 2_000_000
#: Words of one dictionary sent to all tasks. More are looked up in several passes.
DICTIONARY = 1 << 20
#: n-grams that a task gathers before it writes a filter, and about what one range holds when merged.
GATHERED = RANGE = 1 << 21
#: Digits of the quotient that one round of merging splits by, at most; and entries of one filter.
ROUND_BITS, ENTRIES = 12, 512
BLOCK = 1 << 20

# A-Z is lower-cased; what ends a piece becomes a full stop. Space and tab part words.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(0x2E if b in _ENDS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words in order, a full stop between pieces. A long text comes in several lists, cut
    between pieces."""
    folded, at = text.translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b".", at + BLOCK) if len(folded) - at > BLOCK else -1
        end = len(folded) if end < 0 else end + 1
        yield folded[at:end].replace(b".", b" . ").split()
        at = end


# ---- the filter ---------------------------------------------------------------------------

#: Fixed round keys of the permutation: any distinct values serve.
_ROUNDS = [np.uint64(k) for k in (0x1F3D5B79, 0x2E4C6A88, 0x3D5B7997, 0x4C6A88A6)]


def permute(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A bijection of pairs of ``bits``-digit halves that spreads every digit (a Feistel network)."""
    mask = np.uint64((1 << bits) - 1)
    for key in _ROUNDS:
        left, right = right, left ^ (mix(right ^ key) & mask)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of ``permute``."""
    mask = np.uint64((1 << bits) - 1)
    for key in reversed(_ROUNDS):
        left, right = right ^ (mix(left ^ key) & mask), left
    return left, right


def aligned(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves as the highest 64 digits of the key and the digits below them."""
    if 2 * bits <= 64:
        return (left << np.uint64(bits) | right) << np.uint64(64 - 2 * bits), np.zeros(len(left), np.uint64)
    low = 2 * bits - 64
    return left << np.uint64(64 - bits) | right >> np.uint64(low), right & np.uint64((1 << low) - 1)


def halves(high: np.ndarray, low: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The reverse of ``aligned``."""
    mask = np.uint64((1 << bits) - 1)
    if 2 * bits <= 64:
        key = high >> np.uint64(64 - 2 * bits)
        return key >> np.uint64(bits), key & mask
    below = np.uint64(2 * bits - 64)
    return high >> np.uint64(64 - bits), (high << below | low) & mask


def summed(high: np.ndarray, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries in order, equal keys added up."""
    if not len(high):
        return high, low, count
    order = np.argsort(high)
    high, low, count = high[order], low[order], count[order]
    tied = np.flatnonzero(high[1:] == high[:-1])
    if len(tied) and (low[tied] != low[tied + 1]).any():  # rare: only the highest digits agree
        order = np.lexsort((low, high))
        high, low, count = high[order], low[order], count[order]
    new = np.ones(len(high), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    first = np.flatnonzero(new)
    return high[first], low[first], np.add.reduceat(count, first)


def _leading(values: np.ndarray, bits: int) -> np.ndarray:
    """The number that the highest digits make; none make 0."""
    return (values >> np.uint64(64 - bits) if bits else np.zeros(len(values), np.uint64)).astype(np.int64)


def _bytes_of(values: np.ndarray, size: int) -> np.ndarray:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]


def _from_bytes(raw: np.ndarray, size: int) -> np.ndarray:
    wide = np.zeros((len(raw) // size if size else 0, 8), np.uint8)
    wide[:, :size] = raw.reshape(-1, size) if size else 0
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def pack(high: np.ndarray, low: np.ndarray, count: np.ndarray, prefix: int, bits: int) -> bytes:
    """One filter of entries in order that share their first ``prefix`` digits.

    The next digits are the quotient: it is not stored, only how many entries each one has.
    The rest of the key is the remainder, stored in full, so nothing is lost. A counter is
    one byte; those of 255 and more follow at the end.
    """
    n = len(high)
    rest = 64 - prefix
    quotient = max((q for q in range(rest % 8, rest + 1, 8) if q <= math.log2(n) + 1), default=rest % 8)
    size, low_size = (rest - quotient) // 8, max(0, -(-(2 * bits - 64) // 8))
    inside = high << np.uint64(prefix) if prefix < 64 else np.zeros(n, np.uint64)
    runs = np.bincount(_leading(inside, quotient), minlength=1 << quotient)
    wide = runs.max() > 255
    large = np.flatnonzero(count >= 255)
    head = np.array([n, prefix, quotient, size, low_size, int(wide), int(_leading(high[:1], prefix)[0])], "<i8")
    return b"".join([
        head.tobytes(), runs.astype("<u4" if wide else "u1").tobytes(), _bytes_of(high, size).tobytes(), _bytes_of(low, low_size).tobytes(),
        np.minimum(count, 255).astype(np.uint8).tobytes(), count[large].astype("<i8").tobytes()])


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a filter, in order."""
    n, prefix, quotient, size, low_size, wide, first = np.frombuffer(raw, "<i8", 7).tolist()
    at = 56
    runs = np.frombuffer(raw, "<u4" if wide else "u1", 1 << quotient, at)
    at += runs.nbytes
    high = _from_bytes(np.frombuffer(raw, np.uint8, n * size, at), size) if size else np.zeros(n, np.uint64)
    at += n * size
    low = _from_bytes(np.frombuffer(raw, np.uint8, n * low_size, at), low_size) if low_size else np.zeros(n, np.uint64)
    at += n * low_size
    count = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    count[count == 255] = np.frombuffer(raw, "<i8", -1, at + n)
    if quotient:
        high = high | np.repeat(np.arange(1 << quotient, dtype=np.uint64), runs) << np.uint64(64 - prefix - quotient)
    return (high | np.uint64(first) << np.uint64(64 - prefix) if prefix else high), low, count


class Gathered:
    """Entries on their way into filters: summed whenever many have come together."""

    def __init__(self, bits: int, limit: int):
        self.bits, self.limit, self.size, self.parts = bits, limit, 0, []

    def add(self, high: np.ndarray, low: np.ndarray, count: np.ndarray) -> None:
        self.parts.append((high, low, count))
        self.size += len(high)

    def full(self) -> bool:
        return self.size >= self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts, self.parts, self.size = self.parts, [], 0
        return summed(*map(np.concatenate, zip(*parts))) if parts else (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))

    def compact(self) -> None:
        self.add(*self.take())
        self.limit = max(self.limit, 2 * self.size)  # what one range holds is bounded by their number

    def filters(self, prefix: int) -> Iterator[tuple[int, bytes]]:
        """All entries as filters of bounded size, each with the number of its range (the first
        ``prefix`` digits)."""
        high, low, count = self.take()
        if not len(high):
            return
        deep = max(prefix, min(40, int(math.log2(max(1, len(high) / ENTRIES)))))
        group = _leading(high, deep)
        cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(group[a]) >> deep - prefix, pack(high[a:b], low[a:b], count[a:b], deep, self.bits)


def grams(ids: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The n-grams of two to four words as filter entries; id 0 ends a run of words."""
    ids = ids.astype(np.uint64)
    step = np.uint64(bits // 2)
    known = ids > 0
    for size in range(2, MAX_WORDS + 1):
        n = len(ids) - size + 1
        if n <= 0:
            return
        whole = known[:n].copy()
        for j in range(1, size):
            whole &= known[j : j + n]
        at = np.flatnonzero(whole)
        word = lambda j: ids[at + j] if j < size else np.zeros(len(at), np.uint64)
        left, right = permute(word(0) << step | word(1), word(2) << step | word(3), bits)
        high, low = aligned(left, right, bits)
        yield high, low, np.ones(len(at), np.int64)


def _filter_rows(found: Iterable[tuple[int, bytes]], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    ranges, blobs = [], []
    for number, blob in chain(found, [(None, None)]):
        if blob is not None:
            ranges.append(number)
            blobs.append(blob)
        if ranges and (blob is None or len(ranges) == rows):
            yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int64()), pa.array(blobs, pa.binary())], ["range", "filter"])
            ranges, blobs = [], []


def merged(filters: DataFrame, bits: int, prefix: int, following: int | None, min_count: int) -> DataFrame:
    """Merges the filters of each range. With ``following`` digits to come the result are filters
    of finer ranges; else ``ids`` and ``a`` of all n-grams of at least the count."""
    last = following is None
    step = bits // 2

    def entries(high, low, count) -> pa.RecordBatch:
        often = count >= min_count
        left, right = restore(*halves(high[often], low[often], bits), bits)
        mask = np.uint64((1 << step) - 1)
        words = np.stack([left >> np.uint64(step), left & mask, right >> np.uint64(step), right & mask], axis=1).astype(np.int64)
        ends = np.append(0, np.cumsum((words > 0).sum(axis=1)))
        ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words[words > 0]))
        return pa.RecordBatch.from_arrays([ids, pa.array(count[often])], ["ids", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = Gathered(bits, 2 * RANGE), None
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if number != now and now is not None:
                    if last:
                        yield entries(*held.take())
                    elif held.full():
                        yield from _filter_rows(held.filters(following))
                now = number
                held.add(*unpack(raw.as_py()))
                if held.full():
                    if last:
                        held.compact()
                    else:
                        yield from _filter_rows(held.filters(following))
        if last:
            yield entries(*held.take())
        else:
            yield from _filter_rows(held.filters(following))

    dealt = filters.repartition("range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, "ids array<long>, a long" if last else "range long, filter binary")


# ---- words --------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``word`` and ``n`` of every word; a null word has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                found.pop(b".", None)
                words, n = list(found), list(found.values())
                for at in range(0, len(words), 50_000):
                    part = [w.decode() for w in words[at : at + 50_000]], n[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part[0])), pa.array(part[0], pa.string()), pa.array(part[1], pa.int64())],
                                                     ["lang", "word", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.string()), pa.array([sum(n)], pa.int64())],
                                                 ["lang", "word", "n"])
            counts.clear()

        for batch in chain.from_iterable(cut_batches(b, BLOCK) for b in batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                for words in tokens(text):
                    counts[lang].update(words)
            if sum(map(len, counts.values())) > 300_000:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def numbered(words: DataFrame, parts: int) -> DataFrame:
    """Adds ``part`` (of about the dictionary's size, by hash) and ``id``, from 1 on without gaps."""
    words = words.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(parts)).cast("int"))
    sizes = {r.part: r.n for r in words.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = np.cumsum([0] + [sizes.get(p, 0) for p in range(parts)]).tolist()
    place = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    return words.withColumn("id", place + F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("part")))


def _dictionary(raw: bytes) -> dict[str, dict[bytes, int]]:
    table = pa.ipc.open_stream(io.BytesIO(raw)).read_all()
    found: dict[str, dict[bytes, int]] = defaultdict(dict)
    for batch in table.to_batches():
        for lang, word, number in zip(batch["lang"].to_pylist(), batch["word"].cast(pa.binary()).to_pylist(), batch["id"].to_pylist()):
            found[lang][word] = number
    return found


def _sent(words: DataFrame):
    """A part of the dictionary, sent to all tasks: its size is bounded by its number of words."""
    table = words.select("lang", "word", "id").toArrow()
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return words.sparkSession.sparkContext.broadcast(out.getvalue())


def _ids(words: Iterable[bytes], known: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(known.get, words, repeat(0)), np.int64)


def gram_filters(docs: DataFrame, words: DataFrame, parts: int, bits: int, prefix: int) -> DataFrame:
    """``range`` and ``filter``: the n-grams of frequent words in every task's share of the texts."""

    def run_texts(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, held, waiting = _dictionary(shared.value), Gathered(bits, GATHERED), []
            for batch in chain.from_iterable(cut_batches(b, BLOCK) for b in batches):
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                    for found in tokens(text):
                        waiting += [_ids(found, known.get(lang, {})), _GAP]
                if waiting:
                    for entries in grams(np.concatenate(waiting), bits):
                        held.add(*entries)
                waiting = []
                if held.full():
                    yield from _filter_rows(held.filters(prefix))
            yield from _filter_rows(held.filters(prefix))

        return run

    if parts == 1:
        return docs.mapInArrow(run_texts(_sent(words)), "range long, filter binary")
    # More words than one dictionary holds: each pass fills in the ids of its part.
    rows = docs.withColumn("ids", F.lit(None).cast("array<long>"))
    for part in range(parts):
        shared = _sent(words.where(F.col("part") == part))

        def fill(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = _dictionary(shared.value)
            for batch in chain.from_iterable(cut_batches(b, BLOCK) for b in batches):
                langs, texts, out = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist(), []
                for lang, text, earlier in zip(langs.to_pylist(), texts, batch.column(2)):
                    ids = _ids(chain.from_iterable(tokens(text)), known.get(lang, {}))
                    out.append(ids if earlier.values is None else np.maximum(ids, earlier.values.to_numpy()))
                yield pa.RecordBatch.from_arrays([langs, batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["lang", "text", "ids"])

        rows = stored(rows.mapInArrow(fill, "lang string, text string, ids array<long>"), "word_ids")
        shared.destroy()

    def run_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(bits, GATHERED)
        for batch in batches:
            for ids in batch.column(0):
                for entries in grams(ids.values.to_numpy(), bits):
                    held.add(*entries)
                if held.full():
                    yield from _filter_rows(held.filters(prefix))
        yield from _filter_rows(held.filters(prefix))

    return rows.select("ids").mapInArrow(run_ids, "range long, filter binary")


_GAP = np.zeros(1, np.int64)


# ---- phrases ------------------------------------------------------------------------------


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, dictionary: int = DICTIONARY,
                  held: int = RANGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three stored tables: frequent words (lang, word, n, id), frequent phrases of two to four
    words (``ids``, ``a``), and the number of all words by lang (lang, n)."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(word_counts(rows).where((F.col("n") >= min_count) | F.col("word").isNull()), "words")
    totals = counts.where("word is null").select("lang", "n")
    frequent = counts.where("word is not null")
    size = frequent.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).first()
    parts = max(1, -(-size.words * 5 // (4 * dictionary)))
    words = stored(numbered(frequent, parts), "numbered_words")
    bits = 2 * max(1, int(size.words).bit_length())  # of half a key: two ids
    # At most three n-grams start at a word; their digits are spread evenly over the ranges.
    digits = max(0, math.ceil(math.log2(max(1, 3 * (size.n or 0) / held))))
    digits = min(digits, 2 * bits - 1, 48)
    rounds = list(range(ROUND_BITS, digits, ROUND_BITS)) + [digits]
    table = gram_filters(rows, words, parts, bits, rounds[0])
    for prefix, following in zip(rounds, rounds[1:]):
        table = merged(table, bits, prefix, following, min_count)
    return words, stored(merged(table, bits, digits, None, min_count), "phrases"), totals


def scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """``ids``, ``a``, and of the cut with the lowest score (ties: the shortest first part)
    ``score``, ``l`` and ``r``. All parts of a phrase that is frequent are frequent themselves."""
    known = phrases.unionByName(words.select(F.array("id").alias("ids"), F.col("n").alias("a")))
    cut = F.sequence(F.lit(1), F.size("ids") - 1)
    cuts = phrases.select("ids", "a", F.explode(cut).alias("k"))
    cuts = cuts.withColumn("first", F.slice("ids", F.lit(1), F.col("k"))).withColumn("rest", F.slice("ids", F.col("k") + 1, F.size("ids")))
    cuts = cuts.join(known.select(F.col("ids").alias("first"), F.col("a").alias("l")), "first")
    cuts = cuts.join(known.select(F.col("ids").alias("rest"), F.col("a").alias("r")), "rest")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.call_function("div", wide("a") * F.lit(SCALE).cast("decimal(8,0)"), wide("l") + wide("r"))
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    return cuts.groupBy("ids", "a").agg(lowest).select("ids", "a", "low.score", "low.l", "low.r")


def kept(candidates: DataFrame, absorbed: int = ABSORBED) -> DataFrame:
    """Without candidates that lie in a longer one with nearly as many occurrences. A longer one
    holds one of just one word more that occurs at least as often: looking there is enough."""
    inner = F.explode(F.array(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1)))
    around = candidates.where(F.size("ids") > 2).select(inner.alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
    near = candidates.join(around, "ids", "left")
    return near.where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, dictionary: int = DICTIONARY, held: int = RANGE) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score`` of the first ``top``
    collocations of each lang in ``docs`` (lang, text; other columns are ignored).

    A null lang counts as ``und``, a null text as empty; repeated rows count each; an empty
    table gives no rows. Ties in score and count go by phrase, in byte order.

    Words are counted first; those that are frequent get numbers, and only runs of them can
    be frequent phrases. Each task counts its n-grams in quotient filters; filters are shuffled by
    ranges of the permuted key and merged. Only what is among the best by score and count, ties
    included, is spelled out again.
    """
    words, phrases, totals = phrase_counts(docs, min_count, dictionary, held)
    best = stored(kept(scored(words, phrases)), "collocations")
    langs = words.select(F.col("id").alias("head"), "lang")
    best = best.withColumn("head", F.get("ids", F.lit(0))).join(langs, "head").drop("head")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = best.withColumn("_rank", F.rank().over(order)).where(F.col("_rank") <= top).drop("_rank")
    spelled = best.select("ids", F.posexplode("ids").alias("place", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    spelled = spelled.select("ids", F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(spelled, "ids").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
