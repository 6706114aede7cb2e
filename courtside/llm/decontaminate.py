"""Benchmark decontamination: an FM-index per shard of training text, searched backwards."""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.llm.common import carried, cut_batches, lower_ascii, map_batches, put_back, quoted, slices, stored, text_bytes

WINDOW = 10
#: Text that one index covers; a longer document has an index of its own.
SHARD_BYTES = 4 << 20
#: Benchmark text and ids searched per pass. A larger benchmark is searched in several passes.
PASS_BYTES = 4 << 20
#: Words of a benchmark text that go together; a longer one is cut into overlapping parts.
PIECE_WORDS = 50_000
SAMPLE_RATE = 16

# Words are runs of 0-9, a-z and everything beyond ASCII; A-Z is lower-cased first.
_IS_WORD = np.array([0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A or b >= 0x80 for b in range(256)])
_TO_WORDS = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if _IS_WORD[b] else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class WaveletRanks:
    """A wavelet matrix over small integers: one bit vector per binary digit, highest digit
    first, zeros moved before ones after each. Counts stand at every 64th bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.words, self.counts, self.zeros = bits, [], [], []
        for level in range(bits):
            digit = symbols >> (bits - 1 - level) & 1
            packed = np.packbits(digit.astype(np.uint8), bitorder="little")
            words = np.zeros(len(symbols) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.bitwise_count(words).astype(np.int64)
            self.words.append(words)
            self.counts.append(np.cumsum(ones) - ones)
            self.zeros.append(len(symbols) - int(ones.sum()))
            symbols = np.concatenate([symbols[digit == 0], symbols[digit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the place."""
        base = np.zeros_like(at)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            ones, ones_base = self._ones(level, at), self._ones(level, base)
            at = np.where(one, self.zeros[level] + ones, at - ones)
            base = np.where(one, self.zeros[level] + ones_base, base - ones_base)
        return at - base

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at the place, and how often it stands before."""
        symbol, base = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.bits):
            bit = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones, ones_base = self._ones(level, at), self._ones(level, base)
            symbol = symbol << 1 | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
            base = np.where(bit, self.zeros[level] + ones_base, base - ones_base)
        return symbol, at - base


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order. Zeros end runs; each zero is a symbol of its own,
    by place. Prefix doubling, each round only over what is still tied."""
    zero = symbols == 0
    key = symbols.astype(np.int64) + int(zero.sum())
    key[zero] = np.arange(int(zero.sum()))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.flatnonzero(np.diff(sorted_key, prepend=sorted_key[:1] - 1))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.repeat(first, np.diff(first, append=len(key)))
    step = 1
    while True:
        ranks = rank[order]
        tied = np.zeros(len(order), bool)
        same = ranks[1:] == ranks[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        suffix = order[places]
        mine, following = ranks[places], rank[suffix + step]
        by = np.lexsort((following, mine))
        suffix, mine, following = suffix[by], mine[by], following[by]
        order[places] = suffix
        new = np.ones(len(places), bool)
        new[1:] = (mine[1:] != mine[:-1]) | (following[1:] != following[:-1])
        start = np.flatnonzero(new)
        rank[suffix] = np.repeat(places[start], np.diff(start, append=len(places)))
        step *= 2


class FMIndex:
    """Backward search and location over runs of symbols 1.. that end with 0 each."""

    def __init__(self, symbols: np.ndarray, alphabet: int, rate: int = SAMPLE_RATE):
        order = suffix_order(symbols)
        before = symbols[order - 1].astype(np.int64)  # the last run's end stands before the first suffix
        self.ranks = WaveletRanks(before, max(1, int(alphabet).bit_length()))
        counts = np.bincount(symbols, minlength=alphabet + 1)
        self.smaller = np.cumsum(counts) - counts
        self.length = len(symbols)
        # Starts of runs are sampled besides every rate-th place, so no walk leaves a run.
        sampled = (order % rate == 0) | (before == 0)
        self.sampled = WaveletRanks(sampled.astype(np.int64), 1)
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns (one per line, of one length), last symbol first."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.length, np.int64)
        alive = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[alive, column].astype(np.int64)
            low[alive] = self.smaller[symbol] + self.ranks.rank(symbol, low[alive])
            high[alive] = self.smaller[symbol] + self.ranks.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of the rows: steps back to the nearest sample."""
        steps, rows = np.zeros(len(rows), np.int64), rows.copy()
        while True:
            is_sample, number = self.sampled.access(rows)
            walking = np.flatnonzero(is_sample == 0)
            if not len(walking):
                return self.samples[number] + steps
            symbol, occurrence = self.ranks.access(rows[walking])
            rows[walking] = self.smaller[symbol] + occurrence
            steps[walking] += 1


class Phrases:
    """The windows of some benchmark texts: vocabulary, patterns by length (one per line), and
    per pattern the texts it occurs in, as a slice of one flat array. Picklable, compact."""

    def __init__(self, texts: list[bytes], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        by_size: dict[int, list] = defaultdict(list)
        for number, text in enumerate(texts):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            size = min(window, len(ids))
            if size:
                windows = np.lib.stride_tricks.sliding_window_view(ids, size)
                by_size[size].append((windows, np.full(len(windows), number, np.int32)))
        self.groups = []
        for size, parts in sorted(by_size.items()):
            windows, owner = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((owner, *windows.T[::-1]))
            windows, owner = windows[order], owner[order]
            new = np.ones(len(order), bool)
            new[1:] = (windows[1:] != windows[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            self.groups.append((windows[first], np.append(first, len(order)), owner))
        self.shortest = min((g[0].shape[1] for g in self.groups), default=0)


def find_in_shard(texts: list[bytes], phrases: Phrases) -> tuple[list[int], dict[int, np.ndarray], dict[int, set]]:
    """Words per text; for texts with an occurrence their hit words and the numbers of the benchmark texts.

    The index covers the runs of benchmark words that are as long as the shortest phrase:
    no phrase can occur elsewhere.
    """
    counts, runs, where, size = [], [], [], 0
    get = phrases.vocabulary.get
    for number, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        if not phrases.shortest or len(words) < phrases.shortest:
            continue
        ids = np.fromiter(map(get, words, [0] * len(words)), np.int64, len(words))
        edge = np.diff((ids > 0).astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for a, b in zip(starts.tolist(), ends.tolist()):
            if b - a >= phrases.shortest:
                runs += [ids[a:b], _END]
                where.append((size, number, a))
                size += b - a + 1
    hits: dict[int, np.ndarray] = {}
    items: dict[int, set] = defaultdict(set)
    if not runs:
        return counts, hits, items
    index = FMIndex(np.concatenate(runs), len(phrases.vocabulary))
    run_at = np.array([w[0] for w in where])
    run_text = np.array([w[1] for w in where])
    run_word = np.array([w[2] for w in where])
    marks = np.zeros(size + 1, np.int64)
    for patterns, cuts, owners in phrases.groups:
        low, high = index.search(patterns)
        found = np.flatnonzero(high > low)
        sizes = high[found] - low[found]
        if not len(found):
            continue
        rows = np.repeat(low[found] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        places, pattern = index.locate(rows), np.repeat(found, sizes)
        np.add.at(marks, places, 1)
        np.add.at(marks, places + patterns.shape[1], -1)
        text = run_text[np.searchsorted(run_at, places, "right") - 1]
        pairs = np.unique(np.stack([text, pattern]), axis=1)
        for number, p in pairs.T.tolist():
            items[number].update(owners[cuts[p] : cuts[p + 1]].tolist())
    hit = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
    run = np.searchsorted(run_at, hit, "right") - 1
    text, word = run_text[run], run_word[run] + hit - run_at[run]
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    for start, end in zip(starts.tolist(), np.append(starts[1:], len(text)).tolist()):
        hits[int(text[start])] = word[start:end]
    return counts, hits, items


_END = np.zeros(1, np.int64)


def char_spans(text: bytes, words: np.ndarray) -> list[tuple[int, int]]:
    """Code point spans of runs of neighbouring words (given by place, ascending)."""
    data = np.frombuffer(text, np.uint8)
    edge = np.diff(_IS_WORD[data].astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    first = np.flatnonzero(np.diff(words, prepend=-2) != 1)
    last = np.append(first[1:], len(words)) - 1
    return list(zip(points[starts[words[first]]].tolist(), points[ends[words[last]]].tolist()))


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_FIELDS = [T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())),
           T.StructField("hit_items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(_SPAN))]


def _pieces(benchmark: DataFrame, item_id: str, text: str, window: int, limit: int) -> DataFrame:
    """``words`` (A-Z lower-cased, joined by spaces) and ``items`` (ids, as text): each distinct text
    once, a long one in parts that overlap by a window less one word, its ids in lists of
    about the limit's bytes at most. So no row is long, whatever text or id list repeats."""
    lowered = lower_ascii(F.coalesce(F.col(quoted(text)), F.lit("")))
    words = F.regexp_extract_all(lowered, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)
    rows = benchmark.select(F.col(quoted(item_id)).cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)
    heavy = rows.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    lists = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-4 * heavy // limit))))
    once = rows.groupBy("words", lists.alias("list")).agg(F.collect_set("item").alias("items"))
    step = max(1, PIECE_WORDS - window + 1)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window), F.lit(step))
    return once.select("words", "items", F.explode(starts).alias("start")).select(
        F.array_join(F.slice("words", F.col("start") + 1, F.lit(step + window - 1)), " ").alias("words"), "items")


def _passes(benchmark: DataFrame, item_id: str, text: str, window: int, limit: int) -> Iterator[list[Row]]:
    """The pieces in groups of about the limit's bytes, cut by hash; only one group at a time is
    fetched, so the driver holds a bounded part."""
    rows = _pieces(benchmark, item_id, text, window, limit)
    size = F.octet_length("words") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x) + 8)
    total = rows.agg(F.sum(size)).first()[0] or 0
    parts = max(1, -(-total // limit))
    rows = stored(rows, "phrases") if parts > 1 else rows
    for part in range(parts):
        yield (rows.where(F.pmod(F.xxhash64("words", "items"), F.lit(parts)) == part) if parts > 1 else rows).collect()


def _searcher(docs: DataFrame, pieces: list[Row], window: int, shard_bytes: int):
    """The phrases of one pass, sent to all tasks; gives the broadcast and a function that
    opens them in a task and then takes texts to (words, hit words, items) of each."""
    phrases = Phrases([p.words.encode() for p in pieces], window)
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps((phrases, [p["items"] for p in pieces])))

    def work():
        phrases, items = pickle.loads(shared.value)

        def search(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, list[str]]]:
            for start, end in slices(texts, shard_bytes):
                counts, hits, owners = find_in_shard(texts[start:end], phrases)
                for i, count in enumerate(counts):
                    yield count, hits.get(i, _END[:0]), sorted({x for o in owners.get(i, ()) for x in items[o]})

        return search

    return shared, work


def _spans(text: bytes, words: np.ndarray) -> list[dict]:
    return [{"start": a, "end": b} for a, b in char_spans(text, words)] if len(words) else []


_ARROW = {"n_words": pa.int64(), "hit_words": pa.list_(pa.int32()), "hit_items": pa.list_(pa.string()),
          "spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", pass_bytes: int = PASS_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Adds to each document ``n_words`` (long), ``hit_words`` (places of words inside an
    occurrence of a benchmark window, ascending), ``hit_items`` (items with occurring windows,
    as text) and ``spans`` (merged removal spans in code points, end exclusive).

    A null or wordless text has no words and no hits; items without words have no
    windows; an item with a null id marks words but is not listed. Repeated items count
    once. Rows keep their number and their other columns; input columns with the names of
    the new ones are replaced.

    A benchmark within ``pass_bytes`` is sent to all tasks, and one pass over the documents does
    all, without a shuffle. A larger one is cut into parts of that size. Each part is searched
    by a job of its own, which stores only the hits, under numbers given to the rows; the hits
    then meet the rows. So neither a worker nor the driver ever holds more than one part.
    """
    clash = {f.lower() for f in _ARROW} - {text}
    docs = docs.drop(*[quoted(c) for c in docs.columns if c.lower() in clash])
    source = docs.columns.index(text)
    passes = _passes(benchmark, item_id, item_text, window, pass_bytes)
    first, second = next(passes), next(passes, None)
    if second is None:
        _, search = _searcher(docs, first, window, shard_bytes)

        def all_at_once():
            run = search()

            def compute(batch: pa.RecordBatch) -> list[pa.Array]:
                texts = text_bytes(batch.column(source))
                rows = [(n, w.tolist(), o, _spans(t, w)) for t, (n, w, o) in zip(texts, run(texts))]
                return [pa.array(c, k) for c, k in zip(zip(*rows), _ARROW.values())]

            return compute

        return map_batches(docs, all_at_once, _FIELDS, shard_bytes)

    keyed = stored(carried(docs, text).withColumn("number", F.monotonically_increasing_id()), "keyed")
    hits = None
    for pieces in chain([first, second], passes):
        shared, search = _searcher(docs, pieces, window, shard_bytes)

        def only_hits(batches: Iterator[pa.RecordBatch], search=search) -> Iterator[pa.RecordBatch]:
            run = search()
            for batch in chain.from_iterable(cut_batches(b, shard_bytes) for b in batches):
                found = [(k, w.tolist(), o) for k, (_, w, o) in zip(batch.column(0).to_pylist(), run(text_bytes(batch.column(1)))) if len(w)]
                kinds = pa.int64(), _ARROW["hit_words"], _ARROW["hit_items"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else ((),) * 3, kinds)],
                                                 ["number", "hit_words", "hit_items"])

        part = keyed.select("number", "text").mapInArrow(only_hits, "number long, hit_words array<int>, hit_items array<string>")
        part = stored(part, "hits")
        shared.destroy()
        hits = part if hits is None else hits.unionByName(part)
    merged = hits.groupBy("number").agg(*[
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hit_words", "hit_items")])
    rows = keyed.join(merged, "number", "left")
    at = [rows.columns.index(c) for c in ("text", "hit_words", "hit_items")]

    def finish():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = text_bytes(batch.column(at[0]))
            words, items = ([x or [] for x in batch.column(i).to_pylist()] for i in at[1:])
            spans = [_spans(t, np.array(w, np.int64)) for t, w in zip(texts, words)]
            return [pa.array(c, k) for c, k in zip(([len(words_of(t)) for t in texts], words, items, spans), _ARROW.values())]

        return compute

    found = map_batches(rows, finish, _FIELDS)
    new = [F.col(f.name) for f in _FIELDS]
    return found.select(*[F.col("text" if c == text else f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)], *new)


def remove_spans(docs: DataFrame, spans: str = "spans", text: str = "text") -> DataFrame:
    """Cuts the spans (sorted, apart) out of the text, in one native expression. A null text
    stays null."""
    before = F.transform(
        spans, lambda s, i: F.substring(
            F.col(text), F.when(i == 0, 0).otherwise(F.get(F.col(spans), i - 1)["end"]) + 1,
            s["start"] - F.when(i == 0, 0).otherwise(F.get(F.col(spans), i - 1)["end"])))
    tail = F.substring(F.col(text), F.element_at(F.col(spans), -1)["end"] + 1, F.length(text))
    cut = F.concat(F.array_join(before, ""), tail)
    return docs.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(F.col(text)))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without what they share with the benchmark; columns as given."""
    return put_back(remove_spans(find(carried(docs, text), benchmark, text="text", **options)), docs, text)
