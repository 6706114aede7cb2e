"""Landed API responses (JSON files) to typed rows.

A response is ``{"result": ...}``. Lists of objects, the usual form, are parsed straight into
typed rows. A response that does not fit that, and only such a one, is parsed again, to a
variant, and looked at piece by piece; odds are variants throughout, as their keys are data.

Nothing is lost silently. Empty forms of a result (an empty list or object, null, none at
all) give no rows. A result of another shape, or an element that is no object, fails the
load; head-to-head pulls, one response per pair, may instead skip and count such pairs.

A response is one row and is parsed by one task, so large pulls should land as many
lines or files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside import schemas
from courtside.functions.numbers import to_id, to_odds

_LIST, _OBJECT = "array<variant>", "map<string,variant>"


def _as(value: Column, kind: str) -> Column:
    """The variant in that shape, null where it has another."""
    return F.try_variant_get(value, "$", kind)


def read_landed(spark: SparkSession, path: str | list[str], multiline: bool = False, on_bad: str = "fail") -> DataFrame:
    """All responses under a path in one read, one row each: ``result`` and the path's
    partition columns. Text that is no JSON object fails the read, so a bad pull never
    replaces good rows; with ``on_bad="skip"`` it gives a row with ``bad`` set.

    By default a response takes one line, which lets large files be split;
    ``multiline=True`` reads one response per file.
    """
    if on_bad not in ("fail", "skip"):
        raise ValueError(f"on_bad must be 'fail' or 'skip', not {on_bad!r}")
    lines = spark.read.text(path, wholetext=multiline).filter(F.trim("value") != "")
    rest = [c for c in lines.columns if c != "value"]
    landed = lines.select(F.col("value").alias("response"), _response("value", on_bad == "skip").alias("result"), *rest)
    return landed.withColumn("bad", ~_is_whole("response")) if on_bad == "skip" else landed


def _fields(text: str) -> Column:
    """The response as a variant's fields, null where it is no JSON object."""
    return F.try_variant_get(F.try_parse_json(text), "$", "struct<result variant>")


def _is_whole(text: str) -> Column:
    return _fields(text).isNotNull()


def _response(text: str, lenient: bool = False) -> Column:
    """The result of a response. What is no JSON object fails, or is null where lenient."""
    result = _fields(text)["result"]
    return result if lenient else F.when(_is_whole(text), result).otherwise(F.raise_error(F.lit("MALFORMED response: not a JSON object")))


def _is_text(landed: DataFrame) -> bool:
    return dict(landed.dtypes)["result"] == "string"


def _result(landed: DataFrame) -> Column:
    """The result as a variant, from whatever holds it. An expression of its own, so that it can
    stand in a branch that few rows take."""
    if "response" in landed.columns:
        return _response("response", "bad" in landed.columns)
    return F.parse_json("result") if _is_text(landed) else F.col("result")


def _typed(landed: DataFrame, kind: str) -> Column:
    """``a``, the result as ``kind``, and ``z``, which is 1 if the text was one whole JSON value:
    the parser stops after the first value, so the text is put before a field that only a
    parser that has read all of it can see. Null where there is no text."""
    if "response" in landed.columns:
        text, kind = "response", f"struct<result {kind}>"
    else:
        text = "result"
        if not _is_text(landed):
            return F.lit(None).cast(f"struct<a {kind}, z int>")
    return F.from_json(F.concat(F.lit('{"a":'), text, F.lit(',"z":1}')), f"struct<a {kind}, z int>")


def _is_empty(value: Column) -> Column:
    size = F.coalesce(F.size(_as(value, _LIST)), F.size(_as(value, _OBJECT)), F.lit(-1))
    return value.isNull() | F.is_variant_null(value) | (size == 0)


def _fail(what: str, value: Column) -> Column:
    return F.raise_error(F.concat(F.lit(f"unexpected {what}: "), F.substring(F.to_json(value), 1, 200)))


def _elements(value: Column, what: str) -> Column:
    """The objects of a list; whatever is neither a list of objects nor empty fails."""
    items = F.transform(_as(value, _LIST), lambda v: F.when(_is_object(v), v).otherwise(_fail(f"element of {what}", v)))
    return F.when(_as(value, _LIST).isNotNull(), items).when(~_is_empty(value), _fail(what, value))


def _is_object(value: Column) -> Column:
    """Asked without building a map of the fields."""
    return _as(value, "struct<_ variant>").isNotNull()


def _entries(value: Column, what: str) -> Column:
    """The object itself, null for empty forms; whatever else fails."""
    return F.when(_is_object(value), value).when(~_is_empty(value), _fail(what, value))


def _texts(fields: list[str]) -> str:
    return f"array<struct<{', '.join(f'`{f}` string' for f in fields)}>>"


def _fits(landed: DataFrame, *inside: str) -> tuple[Column, Column]:
    """Whether ``parsed`` is a list of objects, and that list."""
    found = F.col("parsed.a.result" if "response" in landed.columns else "parsed.a")
    for name in inside:
        found = found[name]
    return (F.col("parsed.z") == 1) & found.isNotNull() & ~F.exists(found, lambda x: x.isNull()), found


def _rows(rows: DataFrame, items: Column, fields: list[str], ids: list[str], *more: str) -> DataFrame:
    rows = rows.select(F.explode(items).alias("r"), *more)
    return rows.select(*[(to_id(F.col(f"r.{f}")) if f in ids else F.col(f"r.{f}")).alias(f) for f in fields], *more)


def _odd(value: Column, what: str, fields: list[str]) -> Column:
    """The elements' fields as text, of a list that the typed parser did not take."""
    return F.transform(_elements(value, what), lambda v: F.struct(*[F.try_variant_get(v, f"$.{f}", "string").alias(f) for f in fields]))


def _flatten(landed: DataFrame, what: str, fields: list[str], ids: list[str], *more: Column) -> DataFrame:
    """One row per element of the result with its fields as text, ids as numbers."""
    held = [F.col(c) for c in ("response", "result") if c in landed.columns]
    rows = landed.select(_typed(landed, _texts(fields)).alias("parsed"), *held, *more)
    fits, found = _fits(landed)
    items = F.when(fits, found).otherwise(_odd(_result(landed), what, fields))
    return _rows(rows, items, fields, ids, *[c for c in rows.columns if c not in ("parsed", "response", "result")])


def flatten_matches(landed: DataFrame, logos: bool = False) -> DataFrame:
    """Match rows; with both players' logos for the fixtures table."""
    fields = schemas.MATCH_FIELDS + (schemas.LOGO_FIELDS if logos else [])
    return _flatten(landed, "matches", fields, schemas.MATCH_IDS)


def flatten_tournaments(landed: DataFrame) -> DataFrame:
    return _flatten(landed, "tournaments", schemas.TOURNAMENT_FIELDS, schemas.TOURNAMENT_IDS)


def flatten_standings(landed: DataFrame, event_type: Column | None = None) -> DataFrame:
    """Standings of all event types in one frame, each row tagged with the type it was
    asked for: the ``event_type`` partition column of the path, unless given."""
    tag = (F.col("event_type") if event_type is None else event_type).cast("string").alias("event_type")
    return _flatten(landed, "standings", schemas.STANDING_FIELDS, schemas.STANDING_IDS, tag)


def _pair(value: Column) -> Column:
    """A pair's response, null where it is no object."""
    return F.try_variant_get(value, "$", "struct<H2H variant>")


def _is_odd_pair(landed: DataFrame) -> Column:
    """Asked of responses that the typed parser did not take."""
    result = _result(landed)
    meetings = _pair(result)["H2H"]
    listed = _as(meetings, "array<struct<_ variant>>")
    odd = F.coalesce(F.exists(listed, lambda x: x.isNull()), ~_is_empty(meetings))
    odd = F.when(_pair(result).isNull(), ~_is_empty(result)).otherwise(odd)
    return ~_is_whole("response") | odd if "bad" in landed.columns else odd


_PAIR = f"struct<H2H {_texts(schemas.MATCH_FIELDS)}>"


def bad_pair(landed: DataFrame) -> Column:
    """Whether a head-to-head response cannot be used: not readable, not an object, or
    with meetings that are no list of objects."""
    return F.coalesce(_is_odd_pair(landed), F.lit(True))


def flatten_h2h(landed: DataFrame, on_bad: str = "fail") -> DataFrame:
    """Past meetings only: the ``H2H`` list of each response, all pairs at once. With
    ``on_bad="skip"`` the pairs that ``bad_pair`` names are left out, the others load."""
    held = [F.col(c) for c in ("response", "result") if c in landed.columns]
    rows = landed.select(_typed(landed, _PAIR).alias("parsed"), *held)
    fits, found = _fits(landed, "H2H")
    meetings = _pair(_entries(_result(landed), "head-to-head"))["H2H"]
    odd = _odd(meetings, "meetings", schemas.MATCH_FIELDS)
    items = F.when(fits, found)
    items = items.when(~bad_pair(landed), odd) if on_bad == "skip" else items.otherwise(odd)
    return _rows(rows, items, schemas.MATCH_FIELDS, schemas.MATCH_IDS)


def is_truthy(value: Column) -> Column:
    """Whether a JSON value counts as given: not null, false, the number zero, or empty
    text, list or object. The text ``"0"`` counts."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", F.try_variant_get(value, "$", "string") != "")
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))
        .when(kind.rlike("^(ARRAY|OBJECT)"), ~_is_empty(value))
        .when(kind == "VOID", False)
        .otherwise(F.try_variant_get(value, "$", "double") != 0)
    )


def flatten_odds(landed: DataFrame, date_start: Column | None = None) -> DataFrame:
    """One row per event and house with a price on both sides of the Home/Away market.

    ``event_date`` is the first day asked for, the same on every row of a pull: the
    ``date_start`` partition column of the path, unless given.
    """
    day = (F.col("date_start") if date_start is None else date_start).cast("string").alias("event_date")
    explode = landed.sparkSession.tvf.variant_explode
    responses = landed.select(_result(landed).alias("odds"), day).select(_entries(F.col("odds"), "odds").alias("odds"), "event_date")
    events = responses.lateralJoin(explode(F.col("odds").outer())).select(F.col("key").alias("event_key"), "event_date", F.col("value").alias("event"))
    markets = events.select("event_key", "event_date", F.try_variant_get(_entries(F.col("event"), "event"), "$['Home/Away']", "variant").alias("market"))
    sides = F.try_variant_get(_entries(F.col("market"), "market"), "$", "struct<Home variant, Away variant>")
    sides = markets.select("event_key", "event_date", sides.alias("s"))
    side = lambda name: _entries(F.col(f"s.{name}"), f"{name} prices")
    sides = sides.select("event_key", "event_date", side("Home").alias("homes"), _as(side("Away"), _OBJECT).alias("aways"))
    prices = sides.lateralJoin(explode(F.col("homes").outer())).select(
        "event_key", "event_date", F.col("key").alias("betting_house"), F.col("value").alias("home"), F.try_element_at("aways", "key").alias("away"))
    prices = prices.filter(is_truthy(F.col("away")))
    return prices.select(
        to_id(F.col("event_key")).alias("event_key"), "betting_house",
        *[to_odds(F.try_variant_get(s, "$", "string")).alias(f"{s}_odds") for s in ("home", "away")], "event_date",
    )


def with_download_time(rows: DataFrame, at: Column | None = None) -> DataFrame:
    return rows.withColumn("download_time", F.current_timestamp() if at is None else at)
