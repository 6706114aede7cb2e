"""SimHash near-duplicates: linked by one-wildcard variants of fingerprint halves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from courtside.llm.common import carried, field_of, map_batches, put_back, stored, text_bytes

SEED = 42
#: Fingerprints link when they differ in at most this many bits. Two halves then suffice:
#: one of them differs in at most one bit.
MAX_BITS = 2
WORDS = 3
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64-bit SimHash of the word shingles, A-Z lower-cased, repeats counted; no words: 0."""
    import xxhash

    found = text.translate(_LOWER).split()
    if not found:
        return 0
    # Words joined by one space: a shingle is a slice of the joined text.
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    span = min(words, len(found))
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(found) - span + 1].tolist(), ends[span - 1 :].tolist())],
        np.uint64,
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > len(hashes)).astype(np.uint64)).sum(dtype=np.uint64))


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS) -> DataFrame:
    """Adds ``fingerprint`` (long). Null and wordless texts have 0."""
    at = docs.columns.index(text)

    def work():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            values = np.array([fingerprint(t, words) for t in text_bytes(batch.column(at))], np.uint64)
            return [pa.array(values.view(np.int64))]

        return compute

    return map_batches(docs, work, [T.StructField("fingerprint", T.LongType())])


def _roots(left: np.ndarray, right: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Merges the components of linked places; every place gets its component's smallest."""
    while len(left):
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while not np.array_equal(root, jumped := root[root]):
            root = jumped
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
    return root


def links_in_bucket(prints: np.ndarray, free_bits: list[int], pairwise: int = 1024) -> np.ndarray:
    """For distinct sorted fingerprints that agree outside ``free_bits``: the place of the
    smallest one reachable within the bucket. Small buckets are compared pairwise, in
    memory and in blocks; in large ones each fingerprint looks up its one- and two-bit
    neighbours, so work grows with the bucket, not with its square."""
    root = np.arange(len(prints))
    if len(prints) <= pairwise:
        for at in range(0, len(prints), 256):
            near = np.bitwise_count(prints[at : at + 256, None] ^ prints[None, :]) <= MAX_BITS
            left, right = np.nonzero(near)
            left = left + at
            root = _roots(left[left < right], right[left < right], root)
        return root
    ones = [np.uint64(1 << b) for b in free_bits]
    masks = ones + [a | b for i, a in enumerate(ones) for b in ones[:i]]
    for mask in masks:
        other = prints ^ mask
        place = np.minimum(np.searchsorted(prints, other), len(prints) - 1)
        left = np.flatnonzero((prints[place] == other) & (prints < other))
        root = _roots(left, place[left], root)
    return root


def _free_bits(key: int) -> list[int]:
    """What may differ in a bucket: the wildcard bit of one half, and the other half."""
    half, wildcard = key >> 37 & 1, key >> 32 & 31
    return [32 * half + wildcard, *range(32 * (1 - half), 32 * (1 - half) + 32)]


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, fingerprint) to links. A bucket may reach over batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
        sizes = np.diff(starts, append=len(keys))
        a, b = [], []
        pair = starts[sizes == 2]
        near = pair[np.bitwise_count(prints[pair] ^ prints[pair + 1]) <= MAX_BITS]
        a.append(prints[near])
        b.append(prints[near + 1])
        for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            group = prints[start : start + size]
            root = links_in_bucket(group, _free_bits(int(keys[start])))
            moved = np.flatnonzero(root != np.arange(size))
            a.append(group[root[moved]])
            b.append(group[moved])
        columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    kept_keys, kept_prints = [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        # Spark sorts signed values; the bucket's order is put right below.
        prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        last = np.searchsorted(keys, keys[-1])  # the last bucket may go on
        if last == 0 and kept_keys and kept_keys[0][0] == keys[-1]:
            kept_keys.append(keys)
            kept_prints.append(prints)
            continue
        whole = np.concatenate([*kept_keys, keys[:last]]), np.concatenate([*kept_prints, prints[:last]])
        kept_keys, kept_prints = [keys[last:]], [prints[last:]]
        order = np.lexsort((whole[1], whole[0]))
        if len(order):
            yield links(whole[0][order], whole[1][order])
    if kept_keys:
        keys, prints = np.concatenate(kept_keys), np.sort(np.concatenate(kept_prints))
        yield links(keys, prints)


def near_links(prints: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints, enough to join what is within two
    bits: per bucket at most one row less than it has members.

    A key is a half of the fingerprint with one bit blanked, 64 keys for each
    fingerprint. Two fingerprints within two bits share the half that differs in at most one
    bit, with that bit blanked, so they meet in a bucket (an equality join on the key) and are
    verified there by their differing bits.
    """
    half = lambda i: F.shiftrightunsigned("fingerprint", 32 * i).bitwiseAND(F.lit(0xFFFFFFFF))
    keys = [
        half(i).bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << bit))).bitwiseOR(F.lit(i << 37 | bit << 32).cast("long"))
        for i in (0, 1) for bit in range(32)
    ]
    variants = prints.select(F.explode(F.array(*keys)).alias("key"), "fingerprint")
    dealt = variants.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_bucket_links, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the component's smallest node) of all linked nodes.

    Alternates two star steps until nothing moves: each node's larger neighbours are
    linked to its smallest neighbour, then its smaller ones and itself. Every round
    is stored, so lineage stays short and the links never leave the executors.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").distinct(), "links")
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        edges = after


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """``doc_id``, ``fingerprint`` and ``component_id`` of every row.

    The component is that of fingerprints joined by chains of links; its id is the smallest
    doc_id in it, null where no row of it has one. Rows with a null id take part.
    Repeated rows stay repeated. Other columns are ignored. Copies collapse into one
    fingerprint before any comparison.
    """
    table = with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words)
    table = stored(table.select("doc_id", "fingerprint"), "fingerprints")
    return table.join(component_table(table), "fingerprint").select("doc_id", "fingerprint", "component_id")


def component_table(table: DataFrame) -> DataFrame:
    """``fingerprint``, ``root`` and ``component_id`` for a table of doc_id and fingerprint."""
    prints = stored(table.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "prints")
    linked = components(near_links(prints.select("fingerprint"))).withColumnRenamed("node", "fingerprint")
    rooted = prints.join(linked, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # A shuffle of its own (grouped by more than the key), so that Spark can split a
    # fingerprint that very many rows share when the rows are joined.
    return rooted.join(ids, "root").groupBy("fingerprint", F.pmod("fingerprint", F.lit(2)).alias("part")).agg(
        F.min("root").alias("root"), F.min("component_id").alias("component_id")).drop("part")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """The documents with one row for each component: the one with the smallest id (a null id
    only where there is no other), ties by text; of equal rows one. Columns as given.

    The rows are stored once with their fingerprint and a number of their own; components and
    the choice work on numbers, and the texts move only to meet the chosen ones."""
    marked = with_fingerprints(carried(docs, text), words=words)
    marked = stored(marked.withColumn("number", F.monotonically_increasing_id()), "marked")
    id_ = field_of(docs, doc_id)
    table = marked.select("fingerprint", "number", id_.alias("doc_id"), F.xxhash64("text").alias("tie"))
    parts = component_table(table).select("fingerprint", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "number"))
    chosen = table.join(parts, "fingerprint").groupBy("root").agg(first.alias("first")).select("first.number")
    return put_back(marked.join(chosen, "number", "left_semi"), docs, text)
