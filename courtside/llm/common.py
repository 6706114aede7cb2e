"""What the operators share: storage for intermediate tables, Arrow passes, hashed words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a pass inside a task works on at once; one longer document is worked on alone.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_FOLDER: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Unset, as in tests: a
    temporary folder for a local master, else a folder in the warehouse, which is shared."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/_intermediate"
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="courtside-"))
    return _OWN_FOLDER[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back: later stages do not depend on
    any executor that worked on them."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quoted(name: str) -> str:
    """The column of exactly this name, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def carried(docs: DataFrame, text: str) -> DataFrame:
    """``text`` and all other columns as one struct ``row`` with fields named by place: no name
    of the input can clash with a column that is added, and the text is held once."""
    others = [F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text]
    return docs.select(F.struct(F.lit(True).alias("held"), *others).alias("row"), F.col(quoted(text)).alias("text"))


def put_back(rows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from what ``carried`` made of them, in their order."""
    return rows.select(*[F.col("text" if c == text else f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def field_of(docs: DataFrame, column: str) -> Column:
    """A column of ``docs`` inside the struct of ``carried``."""
    return F.col(f"row.c{docs.columns.index(column)}")


def cut_batches(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive pieces of about ``limit`` bytes of its texts."""
    size = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        before = int(total[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def map_batches(df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], list]], fields: list[T.StructField],
                limit: int = SLICE_BYTES) -> DataFrame:
    """Appends columns computed from Arrow batches. ``work()`` is called once per task and
    gives a function from a batch to one Arrow array per field. A column of the input
    that has a new column's name is replaced, whatever its type. Batches are cut to about
    ``limit`` bytes of text first, so a worker never holds a large one with all its output."""
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType(kept + fields)
    at = [i for i, f in enumerate(df.schema.fields) if f.name.lower() not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = work()
        for batch in chain.from_iterable(cut_batches(b, limit) for b in batches):
            arrays = compute(batch)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in at] + arrays, [f.name for f in kept + fields])

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null is empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` bytes together."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64))


def hash_words(data: np.ndarray, is_word: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start offsets of the maximal runs of word bytes.

    A word's hash is the sum over its bytes of a mixed value of (byte, place in the word).
    Works block by block, cut between words, so scratch memory does not follow the text.
    """
    hashes, offsets, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + block)
        inside = is_word[data[at:end]]
        while end < len(data) and is_word[data[end - 1]] and is_word[data[end]]:  # not inside a word
            gaps = np.flatnonzero(~is_word[data[end : end + block]])
            end = min(len(data), end + (int(gaps[0]) if len(gaps) else block))
            inside = is_word[data[at:end]]
        edge = np.diff(inside.astype(np.int8), prepend=0)
        starts = np.flatnonzero(edge == 1)
        if len(starts):
            body = np.flatnonzero(inside)
            ordinal = np.cumsum(edge == 1)[body] - 1
            place = (body - starts[ordinal]).astype(np.uint64)
            values = mix(_BYTE_VALUES[data[at:end][body]] ^ (place * _GOLD))
            hashes.append(np.add.reduceat(values, np.searchsorted(body, starts)))
            offsets.append(starts + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return mix(np.concatenate(hashes)), np.concatenate(offsets)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer with a line feed after each, and where each starts."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), np.cumsum(lengths) - lengths
