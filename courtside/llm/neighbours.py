"""Nearest neighbours by inner product: windows of several shifted Hilbert orderings, reranked."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.llm.common import mix, stored

TOP, EVERY = 20, 20
#: Orderings; coordinates and digits of each.
CURVES, AXES, DIGITS = 8, 12, 5
#: Rows that cut the curves into buckets, and queries whose exact neighbours set the window:
#: the bounds of the samples, both chosen by hash.
CUTS, TRIALS = 16_384, 256
#: Share of the trial queries' exact neighbours that the windows must hold.
RECALL = 0.97
#: Rows of a bucket: at least, and at most.
SMALL, LARGE = 1024, 1 << 16
#: Candidates that a bucket hands on for a query, and that are reranked.
HANDED = 40


def hilbert(cells: np.ndarray, digits: int) -> np.ndarray:
    """Places on the Hilbert curve (signed 64 bits) of points with whole coordinates below
    2**digits, one line per point: Gray codes turned and mirrored from the highest digit down."""
    x = cells.T.astype(np.int64).copy()
    axes, top = len(x), 1 << digits - 1
    bit = top
    while bit > 1:
        lower = bit - 1
        for i in range(axes):
            set_ = x[i] & bit != 0
            turn = np.where(set_, 0, (x[0] ^ x[i]) & lower)
            x[0] = np.where(set_, x[0] ^ lower, x[0] ^ turn)
            x[i] ^= turn if i else 0
        bit >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    bit = top
    while bit > 1:
        flip ^= np.where(x[-1] & bit != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    place = np.zeros(x.shape[1], np.int64)
    for digit in range(digits - 1, -1, -1):
        for i in range(axes):
            place = place << 1 | x[i] >> digit & 1
    return place


def tie(ids: np.ndarray) -> np.ndarray:
    """An order within one place of the curve, so that no bucket must take a whole crowded cell."""
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(1)).view(np.int64)


@dataclass
class Curves:
    """What every task needs: scale, directions, sample quantiles, bucket cuts. A few MB."""

    norm: float
    directions: np.ndarray  # curve, dimension + 1, axis
    quantiles: np.ndarray  # curve, axis, ascending values
    shifts: np.ndarray  # curve, axis
    cuts: list  # per curve the sorted (place, tie) of the sample
    buckets: int = 1
    reach: int = 0

    @classmethod
    def fit(cls, sample: np.ndarray, ids: np.ndarray, norm: float, seed: int = 11) -> Curves:
        rng, size = np.random.default_rng(seed), sample.shape[1] + 1
        axes = min(AXES, size)
        directions = np.stack([np.linalg.qr(rng.standard_normal((size, size)))[0][:, :axes] for _ in range(CURVES)])
        made = cls(norm, directions, np.empty(0), rng.random((CURVES, axes)), [])
        flat = made.lifted(sample)
        made.quantiles = np.stack([np.quantile(flat @ d, np.linspace(0, 1, 257), axis=0).T for d in directions])
        for curve in range(CURVES):
            place, t = made.places(flat, curve), tie(ids)
            order = np.lexsort((t, place))
            made.cuts.append((place[order], t[order]))
        return made

    def lifted(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """One more coordinate, so that the largest inner product is the smallest distance: rows
        are scaled into the unit ball and lifted onto its surface, queries lie at height zero."""
        if query:
            flat, height = vectors / np.linalg.norm(vectors, axis=1)[:, None], np.zeros(len(vectors))
        else:
            flat = vectors / self.norm
            height = np.sqrt(np.maximum(0.0, 1 - (flat * flat).sum(axis=1)))
        return np.concatenate([flat, height[:, None]], axis=1)

    def places(self, lifted: np.ndarray, curve: int) -> np.ndarray:
        """Coordinates along the curve's own directions, as shares of the sample below them, shifted
        by up to a third of the cube, then the place on the curve."""
        flat = lifted @ self.directions[curve]
        share = np.stack([np.searchsorted(q, c) / (len(q) + 1) for q, c in zip(self.quantiles[curve], flat.T)], axis=1)
        cells = (share + self.shifts[curve] / 2) / 1.5 * (1 << DIGITS)
        return hilbert(np.minimum(cells.astype(np.int64), (1 << DIGITS) - 1), DIGITS)

    def shares(self, place: np.ndarray, ids: np.ndarray, curve: int) -> np.ndarray:
        """How much of the sample lies before each row in the curve's order, from 0 to 1."""
        cut, ties = self.cuts[curve]
        low, high = np.searchsorted(cut, place, "left"), np.searchsorted(cut, place, "right")
        out, mine = low.copy(), tie(ids)
        for a, b in {(a, b) for a, b in zip(low.tolist(), high.tolist()) if b > a}:
            same = np.flatnonzero((low == a) & (high == b))
            out[same] = a + np.searchsorted(ties[a:b], mine[same])
        return out / max(1, len(cut))

    def bucket(self, share: np.ndarray) -> np.ndarray:
        return np.minimum((share * self.buckets).astype(np.int64), self.buckets - 1)


def vectors(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id``, ``v`` (array<double>) and its key (``h``, ``g``) of the rows that take part: id and
    vector not null, vector not zero, all its components finite, of the most frequent length
    (ties: the longer). Rows repeated whole count once."""
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & fine)
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    usual = lengths.agg(F.max(F.struct("n", "size")).alias("m")).first().m
    rows = rows.where(F.size("v") == usual["size"]) if usual else rows
    return rows.select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))


def distinct_vectors(rows: DataFrame, top: int) -> DataFrame:
    """``vid`` (a hash that names the vector), ``ids`` (its first ids, as many as any result can
    show), ``v``, ``h``, ``g``: each vector once, however many rows share it."""
    first = Window.partitionBy("h", "g", "v").orderBy("vec_id")
    few = rows.withColumn("_n", F.dense_rank().over(first)).where(F.col("_n") <= top + 1)
    return few.groupBy("h", "g", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")).select(F.col("h").alias("vid"), "ids", "v", "h", "g")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sampled(table: DataFrame, n: int, salt: int) -> list[Row]:
    return table.select("vid", "v").orderBy(F.xxhash64(F.lit(salt), "vid"), "vid").limit(n).collect()


def _exact(table: DataFrame, queries: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and vectors of the nearest ``top`` of all rows for some queries, and the query of each:
    every task hands on its own nearest ones only."""
    shared = table.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, best = shared.value, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, rows = batch.column(0).to_numpy(), _matrix(batch.column(1))
            found = [(s, i, v) for s, i, v in _top(q @ rows.T, ids, top, rows)]
            best = found if best is None else [_best(a, b, top) for a, b in zip(best, found)]
        for number, (score, ids, rows) in enumerate(best or []):
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(ids), pa.int32()), pa.array(score), pa.array(ids),
                                              pa.array(list(rows), pa.list_(pa.float64()))], ["query", "score", "vid", "v"])

    found = table.select("vid", "v").mapInArrow(run, "query int, score double, vid long, v array<double>")
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "vid")
    got = found.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= top).toArrow()  # top * queries rows
    return got["query"].to_numpy(), got["vid"].to_numpy(), _matrix(got["v"].combine_chunks())


def _top(scores: np.ndarray, ids: np.ndarray, top: int, rows: np.ndarray):
    n = min(top, scores.shape[1])
    at = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    return [(s[a], ids[a], rows[a]) for s, a in zip(scores, at)]


def _best(a, b, top: int):
    joined = [np.concatenate(x) for x in zip(a, b)]
    at = np.argsort(-joined[0], kind="stable")[:top]
    return tuple(x[at] for x in joined)


def fit(table: DataFrame, queries: DataFrame, top: int = TOP, recall: float = RECALL) -> Curves:
    """Directions and cuts from one bounded sample; the window from another one of queries, whose
    exact neighbours among all rows are looked up: the smallest window that holds the wanted
    share of them. So the window follows the data's own difficulty at every size."""
    size = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("norm")).first()
    sample = _sampled(table, CUTS, 1)
    curves = Curves.fit(np.array([r.v for r in sample]), np.array([r.vid for r in sample]), size.norm)
    trials = _sampled(queries, TRIALS, 2)
    if size.n <= 2 * SMALL or not trials:
        return curves
    asked = np.array([r.v for r in trials])
    number, ids, rows = _exact(table, asked, top + 1)
    far = np.ones(len(ids))
    for curve in range(CURVES):
        at = curves.shares(curves.places(curves.lifted(asked, query=True), curve), np.array([r.vid for r in trials]), curve)
        near = curves.shares(curves.places(curves.lifted(rows), curve), ids, curve)
        far = np.minimum(far, np.abs(near - at[number]))
    window = float(np.sort(far)[min(len(far) - 1, int(np.ceil(recall * len(far))))])
    wanted = max(SMALL, min(LARGE, window * size.n), size.n / len(sample) * 2)
    curves.buckets = max(1, int(size.n / wanted))
    curves.reach = int(np.ceil(window * curves.buckets))  # two places a window apart are at most so many buckets apart
    return curves


def _dealt(table: DataFrame, queries: DataFrame, curves: Curves) -> DataFrame:
    """Every row in its bucket of every curve, every query in the buckets of its window. Vectors
    travel as one byte a component and a scale."""
    shared = table.sparkSession.sparkContext.broadcast(curves)

    def coded(rows: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        scale = np.abs(rows).max(axis=1) / 127
        return scale, [x.tobytes() for x in np.rint(rows / scale[:, None]).astype(np.int8)]

    def work(asks: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, rows = batch.column(0).to_numpy(), _matrix(batch.column(1))
                lifted, (scale, code) = c.lifted(rows, asks), coded(rows)
                scale, code = pa.array(scale), pa.array(code, pa.binary())
                for curve in range(CURVES):
                    home = c.bucket(c.shares(c.places(lifted, curve), ids, curve))
                    for step in range(-c.reach, c.reach + 1) if asks else (0,):
                        here = home + step
                        some = np.flatnonzero((here >= 0) & (here < c.buckets))
                        key = pa.array(curve << 40 | here[some])
                        yield pa.RecordBatch.from_arrays([key, pa.array([asks] * len(some)), pa.array(ids[some]), scale.take(pa.array(some)), code.take(pa.array(some))],
                                                         ["bucket", "asks", "vid", "scale", "code"])

        return run

    schema = "bucket long, asks boolean, vid long, scale double, code binary"
    return table.select("vid", "v").mapInArrow(work(False), schema).unionByName(queries.select("vid", "v").mapInArrow(work(True), schema))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket first the rows, then the queries: each query's nearest rows. Holds one bucket
    at a time, and scores of a bounded number of queries."""
    key, held, block = None, [], None
    for batch in batches:
        bucket, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket * 2 + asks, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if bucket[a] != key:
                key, held, block = bucket[a], [], None
            ids, scale = (batch.column(i).slice(a, b - a).to_numpy() for i in (2, 3))
            code = np.frombuffer(b"".join(batch.column(4).slice(a, b - a).to_pylist()), np.int8).reshape(b - a, -1)
            if not asks[a]:
                held.append((ids, scale, code))
                continue
            if held:
                block, held = [np.concatenate(x) for x in zip(*held)], []
            if block is None:
                continue
            rows = block[2].astype(np.float32)
            n, step = min(HANDED, len(rows)), max(1, (1 << 22) // len(rows))
            for start in range(0, len(ids), step):
                # Queries keep their own scale out: it does not change their order.
                score = code[start : start + step].astype(np.float32) @ rows.T * block[1].astype(np.float32)
                at = np.argpartition(-score, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[start : start + step], n)), pa.array(block[0][at].reshape(-1)),
                     pa.array(np.take_along_axis(score, at, axis=1).reshape(-1))], ["query", "vid", "score"])


def candidates(table: DataFrame, queries: DataFrame, curves: Curves) -> DataFrame:
    """``query`` and ``vid``: the rows to rerank, the best by coded vectors over all windows."""
    dealt = _dealt(table, queries, curves).repartition("bucket").sortWithinPartitions("bucket", "asks")
    found = dealt.mapInArrow(_searched, "query long, vid long, score float").repartition("query")
    found = found.groupBy("query", "vid").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vid")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= HANDED).select("query", "vid")


def nearest(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = EVERY, top: int = TOP,
            recall: float = RECALL) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: for every row whose id is divisible by ``every``
    the ``top`` rows found with the largest inner product, the query's own id left out.

    Products are summed in order in double precision on the original vectors; ties go to the
    smaller id; fewer rows are returned only if there are fewer. Which rows take part is said at
    ``vectors``. Equal vectors are searched once: each lists its first ids, and all rows that
    ask with it get the result, without their own id. Tables of up to two small buckets are
    one bucket, so their result is exact.
    """
    rows = stored(vectors(embeddings, vec_id, embedding), "vectors")
    table = stored(distinct_vectors(rows, top), "distinct_vectors")
    asking = rows.where(F.col("vec_id") % every == 0).select("vec_id", "h", "g").distinct()
    keys = table.select("vid", "h", "g")
    asking = stored(asking.join(keys, ["h", "g"]).select(F.col("vec_id").alias("query_id"), F.col("vid").alias("query")), "asking")
    queries = stored(table.join(asking.select(F.col("query").alias("vid")).distinct(), "vid", "left_semi").select("vid", "v"), "queries")
    empty = "query_id long, rank int, vec_id long, score double"
    if queries.isEmpty():
        return embeddings.sparkSession.createDataFrame([], empty)
    pairs = stored(candidates(table, queries, fit(table, queries, top, recall)), "candidates")
    pairs = pairs.join(queries.select(F.col("vid").alias("query"), F.col("v").alias("q")), "query").join(table.select("vid", "ids", "v"), "vid")
    score = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    listed = pairs.select("query", (-score).alias("low"), F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy("low", "vec_id")
    listed = listed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top + 1)
    lists = listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("low", "vec_id"))).alias("found"))
    answers = asking.join(lists, "query").select("query_id", F.expr(f"slice(filter(found, x -> x.vec_id <> query_id), 1, {top})").alias("found"))
    ranked = answers.select("query_id", F.posexplode("found").alias("place", "x"))
    return ranked.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.low")).alias("score"))
