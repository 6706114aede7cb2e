"""Document fingerprints from closed syncmers of words. Native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from courtside.llm.common import stored

#: Words of a k-mer and of its inner substrings.
K, S = 8, 3


def with_syncmers(docs: DataFrame, text: str = "text", name: str = "syncmers", positions: bool = False) -> DataFrame:
    """Adds the array ``name`` of the text's closed syncmers, as hashes of 32 bits, with
    ``positions`` as structs of ``at`` (place of the first word) and ``hash``.

    A k-mer of words is chosen if the smallest of its inner s-word substrings stands at
    its start or end: nothing outside the k-mer matters, so equal passages give equal
    anchors at equal distances. A text with words but no chosen k-mer has one anchor, its
    whole word sequence; null, empty and blank texts have none. The working columns
    ``_h`` and ``_g`` and a column of the given name are replaced.
    """
    span = K - S
    inner = lambda i, j: F.get(F.col("_g"), i + j)
    # Steps of their own: a lambda that held the whole expression would redo it per element.
    hashed = docs.withColumn("_h", F.transform(
        F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    h = lambda i, j: F.get(F.col("_h"), i + j)
    count = F.size("_h")
    hashed = hashed.withColumn("_g", F.when(count >= K, F.transform(
        F.sequence(F.lit(0), count - S), lambda i: F.xxhash64(*[h(i, j) for j in range(S)]))))
    edge = lambda i: F.least(inner(i, 0), inner(i, span))
    between = lambda i: F.least(*[inner(i, j) for j in range(1, span)])
    whole = lambda i: F.shiftrightunsigned(F.xxhash64(*[inner(i, j) for j in (0, S, span)]), 32)
    places = F.filter(F.sequence(F.lit(0), count - K), lambda i: edge(i) <= between(i))
    hashed = hashed.withColumn("_g", F.when(count >= K, F.col("_g"))).withColumn("_p", F.when(count >= K, places))
    all_words = F.shiftrightunsigned(F.xxhash64("_h"), 32)
    one = (lambda i: F.struct(i.alias("at"), whole(i).alias("hash"))) if positions else whole
    lone = F.struct(F.lit(0).alias("at"), all_words.alias("hash")) if positions else all_words
    chosen = F.when(F.size("_p") > 0, F.transform("_p", one)).when(count > 0, F.array(lone)).otherwise(F.array().cast(
        "array<struct<at:int,hash:bigint>>" if positions else "array<bigint>"))
    return hashed.withColumn(name, chosen).drop("_h", "_g", "_p")


def with_anchors(docs: DataFrame, text: str = "text", name: str = "anchors") -> DataFrame:
    """Adds the array ``name``: every closed syncmer of the text in order, each as a hash of 32
    bits of the syncmer and its distance in words to the next one (0 for the last). Two
    anchors match only where the passages agree and go on to the next anchor at
    the same distance, wherever in the two texts they stand."""
    placed = with_syncmers(docs, text, "_s", positions=True)
    step = lambda x, i: F.coalesce(F.get(F.col("_s"), i + 1)["at"] - x["at"], F.lit(0)).cast("long")
    return placed.withColumn(name, F.transform("_s", lambda x, i: F.shiftrightunsigned(
        F.xxhash64(x["hash"], step(x, i)), 32))).drop("_s")


def fingerprint(anchors: Column | str) -> Column:
    """All anchors in the order of the text, 8 hex digits each."""
    return F.lower(F.array_join(F.transform(anchors, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(one: str, other: str) -> Column:
    """Share of common anchors (Jaccard, over all distinct ones of both), 0 to 1. Two texts without
    words are alike (1)."""
    shared = F.size(F.array_intersect(one, other))
    union = F.size(F.array_distinct(one)) + F.size(F.array_distinct(other)) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union).cast("double")


#: Ranges of ids at most, before those that one id is split into: bounds the broadcast table of first keys.
MAX_RANGES = 1 << 16
_SEGMENTS = 64
#: An id, or one id's text, is hot from this share of the rows on (1 / HOT_SHARE), and above this many rows.
HOT_SHARE, HOT_ROWS = 64, 32
#: Copies that one task writes out.
_COPIES = 1 << 14


def _range_of(ids: DataFrame) -> tuple[Column, int]:
    """A range number that rises with doc_id, about 32 rows to a range, and the number of rows. Ids are
    cut at quantiles, then evenly between them, so that ids that crowd together are split too."""
    row = ids.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
                  F.percentile_approx("doc_id", [i / _SEGMENTS for i in range(1, _SEGMENTS)], 10_000).alias("cuts")).first()
    if not row.n:
        return F.lit(0).cast("long"), 0
    lows = sorted({row.low, *row.cuts})
    each = max(1, min(MAX_RANGES, row.n // 32) // len(lows))
    highs = [*lows[1:], row.high + 1]
    widths = [-(-(high - low) // each) for low, high in zip(lows, highs)]
    pick = lambda values, at: F.get(F.array(*[F.lit(v).cast("decimal(20,0)") for v in values]), at)
    at = F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in lows]), lambda low: low <= F.col("doc_id"))) - 1
    inside = F.floor((F.col("doc_id").cast("decimal(20,0)") - pick(lows, at)) / pick(widths, at))
    return (at * each + inside).cast("long"), row.n


def _frequent(counts: DataFrame, total: int) -> list:
    """The rows of ``counts`` that hold a hot share: fewer than ``HOT_SHARE``."""
    return counts.where((F.col("n") > HOT_ROWS) & (F.col("n") > total // HOT_SHARE)).collect()


def _split_hot(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Adds ``range`` (rises with doc_id, then with ``mark``), ``mark`` (a hash of the text for hot ids,
    else 0) and ``copies``. A hot id has ranges of its own, by parts of the mark; if one text
    of it is hot too, its rows become one with their number, and the second value is true."""
    number, total = _range_of(docs.select("doc_id"))
    hot = sorted(_frequent(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), total))
    if not hot:
        return docs.select("*", F.struct(number.alias("number")).alias("range"), F.lit(0).cast("long").alias("mark"),
                           F.lit(1).cast("long").alias("copies")), False
    ids = F.array(*[F.lit(r.doc_id).cast("long") for r in hot])
    is_hot = F.array_contains(ids, F.col("doc_id"))
    docs = docs.withColumn("mark", F.when(is_hot, F.xxhash64("text")).otherwise(F.lit(0).cast("long")))
    counts = docs.where(is_hot).groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n"))
    pairs = _frequent(counts, total)
    once = docs.withColumn("copies", F.lit(1).cast("long"))
    if pairs:
        many = F.lit(False)
        for r in pairs:
            many = many | ((F.col("doc_id") == r.doc_id) & (F.col("mark") == r.mark))
        same = docs.where(many).groupBy("doc_id", "text", "mark").agg(F.count(F.lit(1)).alias("copies"))
        once = once.where(~many).unionByName(same)
    below = F.size(F.filter(ids, lambda x: x < F.col("doc_id")))
    parts = F.array(*[F.lit(-(-r.n // max(32, total // MAX_RANGES))).cast("long") for r in hot])
    share = F.col("mark").cast("double") / 2.0**64 + 0.5
    part = F.when(is_hot, F.least(F.floor(share * F.get(parts, below)), F.get(parts, below) - 1)).otherwise(F.lit(0).cast("long"))
    lane = below * 2 + is_hot.cast("int")
    return once.withColumn("range", F.struct(number.alias("number"), lane.alias("lane"), part.alias("part"))), bool(pairs)


def with_next(docs: DataFrame) -> tuple[DataFrame, bool]:
    """Adds ``anchors``, the next document's ``next_text`` and ``next_anchors``, in the order of doc_id,
    then of a hash of the text; after the last comes the first. Input: doc_id (not null), text.
    Rows stand for ``copies`` equal ones, of which all but the last are followed by an equal one;
    the second value is false if every row stands for itself.

    The documents are dealt once, by ranges of ids, and each row reads its successor within
    its range. The first key of each range goes along to the range before: these are one
    row a range, at most twice ``MAX_RANGES`` and a few, and so small enough to broadcast.
    """
    ranged, repeated = _split_hot(docs)
    firsts = ranged.groupBy("range").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    every = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(every), F.max("range").over(Window.partitionBy(F.lit(0))))
    firsts = firsts.withColumn("before", before).select("first.*", "before")
    shown = F.array(F.struct(F.lit(0).alias("guest"), F.col("range")), F.struct(F.lit(1).alias("guest"), F.col("before").alias("range")))
    seats = ranged.join(F.broadcast(firsts), ["doc_id", "mark"], "left").withColumn(
        "seat", F.explode(F.when(F.col("before").isNull(), F.slice(shown, 1, 1)).otherwise(shown)))
    seats = seats.select("doc_id", "text", "copies", F.col("seat.guest").alias("guest"), F.col("seat.range").alias("range"))
    # Dealt first, hashed then: the anchors need not travel.
    dealt = with_anchors(seats.repartition("range")).withColumn("draw", F.xxhash64("text"))
    order = Window.partitionBy("range").orderBy("guest", "doc_id", "draw")
    found = dealt.withColumns({"next_text": F.lead("text").over(order), "next_anchors": F.lead("anchors").over(order)})
    return found.where("guest = 0").select("doc_id", "text", "copies", "anchors", "next_text", "next_anchors"), repeated


def _copies_out(rows: DataFrame) -> DataFrame:
    """Each row ``copies`` times, those of one row by many tasks."""
    kept = stored(rows, "fingerprints")
    some = kept.where("copies > 1").withColumn("block", F.explode(F.expr(f"sequence(0, (copies - 1) div {_COPIES})")))
    some = some.repartition("block", "doc_id").withColumn("one", F.explode(F.expr(
        f"sequence(1, least({_COPIES}, copies - block * {_COPIES}))")))
    return kept.where("copies = 1").drop("copies").unionByName(some.drop("copies", "block", "one"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, that of its edited text (the last quarter replaced by the
    beginning of the next document) and the likeness of its own to the edited text's and to the
    next document's, over all anchors. Rows with a null id have no next document: nothing is
    replaced and ``near_next`` is 0. Rows that share an id follow each other by a hash of
    their texts; a hot id is spread over tasks by it. Other columns are ignored; repeated rows stay."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    alone = with_anchors(rows.where("doc_id is null")).select(
        "doc_id", "text", F.lit(1).cast("long").alias("copies"), "anchors", F.lit(None).cast("string").alias("next_text"),
        F.lit(None).cast("array<bigint>").alias("next_anchors"))
    followed, repeated = with_next(rows.where("doc_id is not null"))
    if repeated:  # The last of equal rows meets the next document, the others meet an equal one.
        followed = followed.withColumn("equal", F.explode(F.when(F.col("copies") > 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        followed = followed.withColumns({
            "copies": F.when(F.col("equal"), F.col("copies") - 1).otherwise(F.lit(1).cast("long")),
            "next_text": F.when(F.col("equal"), F.col("text")).otherwise(F.col("next_text")),
            "next_anchors": F.when(F.col("equal"), F.col("anchors")).otherwise(F.col("next_anchors"))}).drop("equal")
    both = followed.unionByName(alone).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.when(F.col("next_text").isNull(), F.lit(0)).otherwise(F.floor(F.col("n_chars") / 4)).cast("int")
    both = both.withColumn("cut", cut).withColumn("edited", F.expr(
        "concat(substring(text, 1, cast(n_chars as int) - cut), coalesce(substring(next_text, 1, cut), ''))")).drop("text", "next_text")
    both = with_anchors(both, "edited", "edited_anchors")
    compared = both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("anchors").alias("fingerprint"),
        fingerprint("edited_anchors").alias("edited_fingerprint"), likeness("anchors", "edited_anchors").alias("near_edited"),
        F.when(F.col("next_anchors").isNotNull(), likeness("anchors", "next_anchors")).otherwise(0.0).alias("near_next"), "copies")
    return _copies_out(compared) if repeated else compared.drop("copies")
