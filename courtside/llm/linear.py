"""Labelled samples for the classifiers: bounded, chosen by hash, never through the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_held_out(doc_id) -> F.Column:
    """Rows that no label is learnt from. A null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """``text`` and ``label`` of at most ``per_class`` documents of each label, the first ones
    by hash of the id. Ids are chosen from the small label table, with a bounded top-k; only
    the chosen documents' texts move. Null and contradictory labels do not count; of
    repeated ids one text serves, the first by hash. Repeats are combined before they move."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~is_held_out("doc_id"))
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
        .select("doc_id", "label", F.xxhash64("doc_id").alias("draw"))
    )
    chosen = [known.where(F.col("label") == value).orderBy("draw", "doc_id").limit(per_class) for value in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # At most 2 * per_class ids and hashes: small by construction.
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label", "draw").agg(
        F.min(F.struct(F.xxhash64("text").alias("order"), "text")).alias("first"))
    return found.select("doc_id", "first.text", F.col("label").cast("int").alias("label"), "draw")


def fit_in_task(sample: DataFrame, fit: Callable[[list[str], list[int]], bytes]) -> bytes:
    """Fits on a bounded sample in one task and returns the model's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["draw"], r["doc_id"], r["text"]))  # the same model whatever the order of arrival
        model = fit([r["text"] for r in rows], [r["label"] for r in rows])
        yield pa.RecordBatch.from_pydict({"model": pa.array([model], pa.binary())})

    # Repartitioned, not coalesced: the scan of the documents stays spread over all tasks.
    row = sample.repartition(1).mapInArrow(run, "model binary").first()
    return bytes(row.model) if row else fit([], [])  # an empty table may leave no task at all
