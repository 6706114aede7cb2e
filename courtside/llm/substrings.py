"""Substring dedup: a count-min sketch sorts out windows that cannot repeat, the rest is
grouped exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import WHITE, carried, field_of, hash_words, joined, map_batches, mix, put_back, slices, text_bytes

WINDOW = 20
#: Words of the shingle that a window is counted by in the sketch.
ANCHOR = 8
#: Cells of the sketch, in two rows: 16 MB as bits when sent to the tasks. A fixed bound: where
#: windows outgrow it more of them are estimated as repeated and grouped exactly.
CELLS = 1 << 27
_SLICE = 1 << 16
_STEP = np.uint64(0xD6E8FEB86659FD93)
_TASK_ROWS = 1 << 20


class _Windows:
    """The windows of some texts, by their first word."""

    def __init__(self, texts: list[bytes], window: int, anchor: int):
        data, starts = joined(texts)
        self.hash, offset = hash_words(data, ~WHITE)
        self.owner = np.searchsorted(starts, offset, "right") - 1
        self.first = np.searchsorted(self.owner, np.arange(len(texts)))
        n, span = len(self.hash), window - anchor + 1
        count = max(0, n - window + 1)
        self.whole = self.owner[:count] == self.owner[window - 1 :][:count] if count else np.zeros(0, bool)
        # The window's smallest shingle stands for it in the sketch.
        self.shingle = mix(_rolling(self.hash, anchor, _STEP)) if n >= anchor else np.empty(0, np.uint64)
        self.lowest = _sliding(self.shingle, span, np.minimum)
        self.span = span

    def counted(self) -> np.ndarray:
        """Shingles that are some window's smallest, once per place. Every place where a
        window starts has one at the same distance, so a window occurs no more often than
        its shingle is counted."""
        lowest = np.where(self.whole, self.lowest, 0)
        most = _sliding(np.concatenate([np.zeros(self.span - 1, np.uint64), lowest, np.zeros(self.span - 1, np.uint64)]), self.span, np.maximum)
        return self.shingle[(most == self.shingle) & (most > 0)] if len(self.whole) else self.shingle[:0]


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _rolling(values: np.ndarray, size: int, step: np.uint64) -> np.ndarray:
    out = np.zeros(len(values) - size + 1, np.uint64)
    for i in range(size):
        out = out * step + values[i : i + len(out)]
    return out


def _sliding(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """Smallest or largest of each ``size`` neighbours, by doubling."""
    if len(values) < size:
        return values[:0]
    width = 1
    while width * 2 <= size:
        values, width = pick(values[: len(values) - width], values[width:]), width * 2
    return pick(values[: len(values) - (size - width)], values[size - width :]) if size > width else values


def _cells(shingles: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """A cell in each of the sketch's two rows."""
    half = np.uint64(cells // 2)
    return (shingles % half).astype(np.int64), (shingles >> np.uint64(32)).astype(np.int64) % int(half) + int(half)


def _partial_sketches(window: int, anchor: int, cells: int):
    """Texts to (slice, cells seen once, cells seen more often) of a part of a partition."""

    def rows(seen: list[np.ndarray]) -> pa.RecordBatch:
        cell, count = np.unique(np.concatenate(seen), return_counts=True)
        slice_of = cell // _SLICE
        cut = np.flatnonzero(np.diff(slice_of, prepend=-1))
        numbers, once, more = [], [], []
        for a, b in zip(cut.tolist(), np.append(cut[1:], len(cell)).tolist()):
            low, many = (cell[a:b] % _SLICE).astype(np.uint16), count[a:b] > 1
            numbers.append(int(slice_of[a]))
            once.append(low[~many].tobytes())
            more.append(low[many].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], ["slice", "once", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = [], 0
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for a, b in slices(texts):
                seen += _cells(_Windows(texts[a:b], window, anchor).counted(), cells)
                size += len(seen[-1])
                if size >= _TASK_ROWS:
                    yield rows(seen)
                    seen, size = [], 0
        if size:
            yield rows(seen)

    return run


def _merge_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Saturating sums per slice, as bits: counted at least twice."""
    slices_: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, once, more in zip(*(c.to_pylist() for c in batch.columns)):
            counts = slices_.setdefault(number, np.zeros(_SLICE, np.uint8))
            low = np.frombuffer(once, np.uint16)  # distinct within a row
            counts[low] = np.minimum(counts[low] + 1, 2)
            counts[np.frombuffer(more, np.uint16)] = 2
    if slices_:
        bits = [np.packbits(c >= 2, bitorder="little").tobytes() for c in slices_.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(slices_), pa.int32()), pa.array(bits, pa.binary())], ["slice", "bits"])


def repeated_cells(texts: DataFrame, window: int, anchor: int, cells: int) -> bytes:
    """The merged sketch as one bit per cell. At most ``cells / 8`` bytes reach the driver."""
    partial = texts.select("text").mapInArrow(_partial_sketches(window, anchor, cells), "slice int, once binary, more binary")
    merged = partial.repartition("slice").mapInArrow(_merge_sketches, "slice int, bits binary")
    out = bytearray(cells // 8)
    for row in merged.toLocalIterator():
        out[row.slice * _SLICE // 8 : (row.slice + 1) * _SLICE // 8] = row.bits
    return bytes(out)


# Four longs a row, as this is what travels most. ``place`` is the text's tag and the start.
# ``w2`` is not negative, but for runs that are known to repeat: less than zero, their length.
_KEYED = "w1 long, w2 long, doc_id long, place long"


def _estimated_repeated(sketch, window: int, anchor: int, cells: int):
    """Rows (doc_id, tag, text) to windows that the sketch takes for repeated.

    Of each window only the first place within the task goes on to be compared with the
    other tasks: later ones are known to repeat and come as runs of starts. So a
    window that very many documents share gives each task one row.
    """

    def batch_of(w1, w2, doc, tag, start) -> pa.RecordBatch:
        place = tag.astype(np.int64) << 32 | start
        return pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2), doc, pa.array(place)], _names(_KEYED))

    def reduced(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        doc = pa.concat_arrays([h[0] for h in held])
        w1, w2, tag, start, absent = (np.concatenate([h[i] for h in held]) for i in range(1, 6))
        ids = doc.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.lexsort((start, tag, ids, absent, w2, w1))
        w1, w2, tag, start, ids, absent = (x[order] for x in (w1, w2, tag, start, ids, absent))
        doc = doc.take(pa.array(order))
        new_window = np.ones(len(order), bool)
        new_window[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        head = np.maximum.accumulate(np.where(new_window, np.arange(len(order)), 0))
        tie = (ids == ids[head]) & (absent == absent[head]) & (tag == tag[head]) & (start == start[head])
        for at in range(0, len(order), 1 << 18):  # heads (with copies of the very same row)
            pick = np.flatnonzero(tie[at : at + (1 << 18)]) + at
            yield batch_of(w1[pick], w2[pick].astype(np.int64), doc.take(pa.array(pick)), tag[pick], start[pick])
        late = np.flatnonzero(~tie)
        if len(late):
            late = late[np.lexsort((start[late], tag[late], ids[late], absent[late]))]
            same = np.ones(len(late), bool)
            same[1:] = ~((ids[late][1:] == ids[late][:-1]) & (absent[late][1:] == absent[late][:-1])
                         & (tag[late][1:] == tag[late][:-1]) & (start[late][1:] - start[late][:-1] <= 1))
            cut = np.flatnonzero(same)
            last = np.append(cut[1:], len(late)) - 1
            pick = late[cut]
            length = start[late[last]] - start[pick] + 1
            spread = mix(mix(ids[pick].astype(np.uint64)) ^ start[pick].astype(np.uint64))  # anywhere: nothing to compare
            yield batch_of(spread, -length.astype(np.int64), doc.take(pa.array(pick)), tag[pick], start[pick])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(sketch.value, np.uint8)
        hot = lambda cell: bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1
        held, size = [], 0
        for batch in batches:
            texts = text_bytes(batch.column(2))
            tags = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in slices(texts):
                w = _Windows(texts[a:b], window, anchor)
                one, two = _cells(w.lowest, cells)
                start = np.flatnonzero(w.whole & (hot(one) & hot(two)).astype(bool))
                if not len(start):
                    continue
                other = mix(w.hash ^ _STEP)
                w1, w2 = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
                for i in range(window):
                    w1 = w1 * _STEP + w.hash[start + i]
                    w2 = mix(w2 + other[start + i])
                owner = w.owner[start]
                doc = batch.column(0).take(pa.array(owner + a))
                absent = np.asarray(doc.is_null())
                held.append((doc, mix(w1), w2 >> np.uint64(1), tags[owner + a], start - w.first[owner], absent))
                size += len(start)
                if size >= _TASK_ROWS:
                    yield from reduced(held)
                    held, size = [], 0
        if held:
            yield from reduced(held)

    return run


def repeated_starts(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, cells: int = CELLS) -> DataFrame:
    """``doc_id``, ``tag`` and ``runs`` (arrays of start word and number of starts): the windows
    of each document that also start earlier. Input: doc_id, tag, text."""
    sketch = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs, window, anchor, cells))
    found = docs.select("doc_id", "tag", "text").mapInArrow(_estimated_repeated(sketch, window, anchor, cells), _KEYED)
    # The window's exact group is that of its 127-bit key. Rank, not row number: copies of
    # the very same row are not earlier than each other.
    rank = F.rank().over(Window.partitionBy("w1", "w2").orderBy(F.col("doc_id").asc_nulls_last(), "place"))
    late = found.withColumn("rank", rank).where("w2 < 0 or rank > 1")
    tag, start = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(F.lit(2**32 - 1)).cast("int")
    length = F.when(F.col("w2") < 0, -F.col("w2")).otherwise(1).cast("int")
    return late.groupBy("doc_id", tag.alias("tag")).agg(F.collect_list(F.struct(start.alias("start"), length.alias("length"))).alias("runs"))


def _marked(docs: DataFrame, window: int, anchor: int, cells: int) -> DataFrame:
    """Rows with ``row`` and ``runs``."""
    rows = docs.withColumn("tag", F.pmod(F.xxhash64("text"), F.lit(2**31)).cast("int"))
    starts = repeated_starts(rows, window, anchor, cells).withColumnRenamed("doc_id", "key_id").withColumnRenamed("tag", "key_tag")
    return rows.join(starts, F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("tag") == F.col("key_tag")), "left")


def removed_words(n_words: int, runs: list[dict] | None, window: int) -> np.ndarray:
    """A flag per word: covered by a window that starts in one of the runs."""
    marks = np.zeros(n_words + window + 1, np.int32)
    for run in runs or ():
        marks[run["start"]] += 1
        marks[run["start"] + run["length"] + window - 1] -= 1
    return np.cumsum(marks)[:n_words] > 0


def digest(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, cells: int = CELLS) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` (of the kept words, joined by a
    space) per row of ``docs`` (doc_id, text; other columns are ignored).

    Null and short texts have no windows and keep all words. Rows with a null id count as
    the last document. Rows that share an id and a text are the same place, and neither is
    earlier; rows that share only the id are ordered by a hash of the text.
    """
    rows = _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, anchor, cells).select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                words = text.split()
                gone = removed_words(len(words), runs, window)
                kept = [words[i] for i in np.flatnonzero(~gone).tolist()] if runs else words
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string())))],
                                             ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, anchor: int = ANCHOR, cells: int = CELLS) -> DataFrame:
    """The documents with repeated words cut out and the rest joined by single spaces; texts
    without a repeat stay as they are. Columns as given."""
    rows = carried(docs, text).select("row", field_of(docs, doc_id).cast("long").alias("doc_id"), "text")
    rows = _marked(rows, window, anchor, cells)
    rows = rows.select("row", "text", "runs")

    def work():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for value, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if runs:
                    words = value.encode().split()
                    gone = removed_words(len(words), runs, window)
                    value = b" ".join(words[i] for i in np.flatnonzero(~gone).tolist()).decode()
                out.append(value)
            return [pa.array(out, pa.string())]

        return compute

    from pyspark.sql import types as T

    cut = map_batches(rows, work, [T.StructField("text", T.StringType())])
    return put_back(cut, docs, text)
