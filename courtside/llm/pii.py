"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs
them, a span classifier decides. Native."""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.llm.common import carried, put_back, stored

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
THRESHOLD = 0.5

# Fixed patterns. A match of the first three can only begin where its first run of
# characters begins, or right after the match before; saying so keeps long runs linear,
# as does not giving back what is taken.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns for the candidates that labelers vote on.
LOOSE = {
    # The bare word "at" counts only where the address itself spells out a dot: else it is prose.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]| at (?= ?[A-Za-z0-9-]++(?: ?\. ?[A-Za-z0-9-]++)*+ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]))"
             r" ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)|00[1-9][0-9]|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?:token|secret|passwd|password|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{12,}",
}
# What a text must hold before a pattern is tried on it.
_HINTS = {
    "email": lambda t: t.contains("@"), "ip": lambda t: t.contains("."), "card": lambda t: t.rlike("[0-9]"),
    "phone": lambda t: t.contains("+"),
}
_LOOSE_HINTS = {
    "email": lambda t: ((t.contains("@") | t.contains("(at)") | t.contains("[at]")) & t.contains(".")) | (
        (t.contains("@") | t.contains("(at)") | t.contains("[at]") | t.contains(" at ")) & t.contains("dot")),
    "ip": lambda t: t.contains(":"), "card": lambda t: t.rlike("[0-9]"), "phone": lambda t: t.rlike("[0-9]{3}"),
    "secret": lambda t: t.contains("=") | t.contains(":"),
}
# Gazetteers.
MAIL_ENDINGS = "com|org|net|edu|gov|de|fr|es|uk|io|info|example"
DIAL_CODES = "1|7|20|30|31|32|33|34|39|41|43|44|45|46|47|48|49|52|55|61|81|82|86|90|91|351|353|358|420"
CARD_PREFIXES = "4|5[1-5]|2[2-7]|3[47]|36|38|6011|65|62"
NO_SECRETS = r"example|changeme|placeholder|dummy|sample|your|1234|abcd|([A-Za-z0-9])\1{5}"
SECRET_FORMS = r"(?:sk|pk|ghp|gho|xox[abp])[_-].*|AKIA.*|eyJ.*|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}"
# Words that announce a kind shortly before a span.
CUES = {
    "email": "mail|contact|write|reach", "ip": r"\bip\b|server|host|address|login|gateway", "card": "card|visa|master|amex|pay",
    "phone": r"phone|call|\btel|mobile|fax|dial", "secret": "key|auth|cred|login|bearer",
}
CUE_CHARS = 24

_BLOCK = 64


def located(docs: DataFrame, source: str, pattern: str, hint: Column, name: str) -> DataFrame:
    """Adds ``name``: an array of structs start, end (code points) and value, the leftmost
    matches that do not overlap. The lengths of matches and of what lies between them are
    summed in blocks, so that a text full of matches costs no square of their number."""
    empty = F.array().cast("array<string>")
    text = F.col(source)
    docs = docs.withColumn("_m", F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty))
    docs = docs.withColumn("_l", F.when(F.size("_m") > 0, F.zip_with(
        "_m", F.slice(F.split(text, pattern, -1), F.lit(1), F.size("_m")), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")))))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["gap"] + x["size"])
    docs = docs.withColumn("_b", F.when(F.size("_m") > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size("_m") - 1) / _BLOCK).cast("int")),
        lambda b: total(F.slice(F.col("_l"), b * _BLOCK + 1, F.lit(_BLOCK))) + F.size("_l") * 0)))
    docs = docs.withColumn("_b", F.when(F.size("_b") > 0, F.transform(
        F.sequence(F.lit(0), F.size("_b") - 1), lambda b: F.aggregate(F.slice(F.col("_b"), F.lit(1), b), F.lit(0), lambda a, x: a + x))))

    def span(m: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        before = F.get(F.col("_b"), block) + total(F.slice(F.col("_l"), block * _BLOCK + 1, i % _BLOCK))
        start = before + F.get(F.col("_l"), i)["gap"]
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("value"))

    found = F.when(F.size("_l") > 0, F.transform("_m", span)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))
    return docs.withColumn(name, found).drop("_m", "_l", "_b")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def holds(kind: str, value: Column) -> Column:
    """The check that a base match has to pass."""
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike(r"\A(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])\z"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``base``: spans of kind (place in KINDS), start, end, value and is_base."""
    for kind in BASE_KINDS:
        docs = located(docs, text, BASE[kind], _HINTS[kind](F.col(text)), f"_{kind}")
    parts = [_checked(n, kind) for n, kind in enumerate(BASE_KINDS)]
    return docs.withColumn("base", F.concat(*parts)).drop(*[f"_{k}" for k in BASE_KINDS])


def _checked(number: int, kind: str) -> Column:
    return F.transform(F.filter(f"_{kind}", lambda s: holds(kind, s["value"])), lambda s: _span(number, s, True))


def _unchecked(number: int, kind: str) -> Column:
    return F.transform(f"_{kind}", lambda s: _span(number, s, False))


def _span(number: int, s: Column, is_base: bool) -> Column:
    return F.struct(F.lit(number).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(is_base).alias("is_base"))


def apart(spans: Column) -> Column:
    """The spans by start, without those that begin inside an earlier one; both sorted and cut."""
    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    return F.aggregate(plain, none, lambda kept, s: F.when(
        (F.size(kept) == 0) | (F.element_at(kept, F.greatest(F.size(kept), F.lit(1)))["end"] <= s["start"]), F.concat(kept, F.array(s))).otherwise(
        F.when(F.element_at(kept, F.greatest(F.size(kept), F.lit(1)))["end"] >= s["end"], kept).otherwise(
            F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(F.struct(
                F.element_at(kept, F.greatest(F.size(kept), F.lit(1)))["start"].alias("start"), s["end"].alias("end"),
                F.element_at(kept, F.greatest(F.size(kept), F.lit(1)))["kind"].alias("kind")))))))


def replaced(text: str, spans: str, by) -> Column:
    """The text with each of the sorted, separate spans replaced by ``by(span)``."""
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(spans), i - 1)["end"])
    pieces = F.transform(spans, lambda s, i: F.concat(F.substring(F.col(text), begin(i) + 1, s["start"] - begin(i)), by(s)))
    tail = F.substring(F.col(text), F.element_at(F.col(spans), -1)["end"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col(text))


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``spans``: the base spans and wider candidates outside them, each with the three
    labelers' votes (1, 0, null for no opinion) and the classifier's features."""
    docs = with_base(docs, text)
    docs = docs.withColumn("_apart", apart(F.col("base")))
    docs = docs.withColumn("_rest", replaced(text, "_apart", lambda s: F.repeat(F.lit("\u0001"), s["end"] - s["start"])))
    for kind in KINDS:
        docs = located(docs, "_rest", LOOSE[kind], _LOOSE_HINTS[kind](F.col("_rest")), f"_{kind}")
    loose = [_unchecked(n, kind) for n, kind in enumerate(KINDS)]
    docs = docs.withColumn("_all", F.concat("base", *loose))

    def judged(s: Column) -> Column:
        before = F.substring(F.col(text), s["start"], F.lit(1))
        before = F.when(s["start"] == 0, "").otherwise(before)
        after = F.substring(F.col(text), s["end"] + 1, F.lit(1))
        first = F.greatest(s["start"] - CUE_CHARS, F.lit(0))
        lead = F.substring(F.col(text), first + 1, s["start"] - first)
        return s.withField("votes", F.array(_by_pattern(s), _by_gazetteer(s), _by_context(before, after))).withField(
            "features", F.array(_shape(s["value"]), _side(before), _side(after), _cue(s, lead)))

    return docs.withColumn("spans", F.when(F.size("_all") > 0, F.transform("_all", judged)).otherwise(F.array().cast(SPANS))).drop(
        "base", "_apart", "_rest", "_all", *[f"_{k}" for k in KINDS])


SPANS = "array<struct<kind:int,start:int,end:int,value:string,is_base:boolean,votes:array<int>,features:array<int>>>"


def _per_kind(s: Column, branches: dict[str, Column]) -> Column:
    out = F.lit(None).cast("int")
    for kind, vote in branches.items():
        out = F.when(s["kind"] == KINDS.index(kind), vote.cast("int")).otherwise(out)
    return out


def _by_pattern(s: Column) -> Column:
    """The form alone: check digits, number ranges, mixed characters."""
    value = s["value"]
    secret = F.regexp_extract(value, r"[A-Za-z0-9+/_-]+\z", 0)
    return _per_kind(s, {
        "email": value.rlike(r"\A[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\z"),
        # Eight groups of two decimal digits are times or serial numbers.
        "ip": F.when(value.contains(":"), ~value.rlike(r"\A[0-9]{2}(?::[0-9]{2}){7}\z")).otherwise(holds("ip", value)),
        "card": holds("card", value),
        "phone": value.startswith("+") | value.rlike(r"\A\([0-9]{3}\)"),
        "secret": (F.length(secret) >= 20) & secret.rlike("[0-9]") & secret.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(secret, ""))) >= 10),
    })


def _by_gazetteer(s: Column) -> Column:
    """Known endings, dial codes, card issuers, reserved networks, usual forms of secrets and of what
    stands in for one."""
    value = s["value"]
    secret = F.regexp_extract(value, r"[A-Za-z0-9+/_-]+\z", 0)
    return _per_kind(s, {
        "email": value.rlike(rf"(?i)(?:\.|dot[)\]]?) ?(?:{MAIL_ENDINGS})\z"),
        "ip": ~value.rlike(r"(?i)\A(?:0*(?:0|22[4-9]|2[3-9][0-9])\.|fe80:|ff|2001:0?db8:|(?:0+:){7})"),
        "card": value.rlike(rf"\A(?:{CARD_PREFIXES})"),
        "phone": F.when(value.startswith("+"), value.rlike(rf"\A\+(?:{DIAL_CODES})[^0-9]")),
        "secret": F.when(secret.rlike(f"(?i){NO_SECRETS}"), False).when(secret.rlike(rf"\A(?:{SECRET_FORMS})\z"), True),
    })


def _by_context(before: Column, after: Column) -> Column:
    """Whether the span stands by itself. No opinion beside signs that may be noise."""
    inside = before.rlike(r"[\p{L}\p{N}_]") | after.rlike(r"[\p{L}\p{N}_]")
    free = before.rlike(r"\A(?:\s|[(\[\"':=]|\z)") & after.rlike(r"\A(?:\s|[.,;:!?)\]\"']|\z)")
    return F.when(inside, 0).when(free, 1).cast("int")


def _shape(value: Column) -> Column:
    """Length in five steps, times the share of digits in four."""
    length = F.least(F.floor(F.log2(F.length(value))).cast("int"), F.lit(6))
    share = F.floor(F.length(_digits(value)) * 3 / F.length(value)).cast("int")
    return length * 4 + share


def _cue(s: Column, lead: Column) -> Column:
    return F.coalesce(_per_kind(s, {kind: lead.rlike(f"(?i){words}") for kind, words in CUES.items()}), F.lit(0))


def _side(c: Column) -> Column:
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def pattern_counts(candidates: DataFrame) -> DataFrame:
    """How often each (kind, votes, features) occurs, over all documents. The number of rows
    is bounded by what these can be, whatever the input."""
    spans = candidates.select(F.explode("spans").alias("s"))
    return spans.groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.features").alias("features")).agg(
        F.count(F.lit(1)).alias("n"))


def estimate(counts: list[tuple], rounds: int = 100) -> dict[tuple, float]:
    """Expectation-maximisation over vote patterns: each labeler has a hit rate on true and on
    false spans of a kind, each kind a share of true ones. Returns each pattern's
    probability of being personal data. Starts from labelers right four times in five."""
    votes: dict[tuple, float] = defaultdict(float)
    for kind, pattern, _, n in counts:
        votes[kind, pattern] += n
    share = {k: 0.5 for k, _ in votes}
    rate = {(k, j, z): 0.8 if z else 0.2 for k, j, z in product(share, range(3), (0, 1))}
    belief: dict[tuple, float] = {}
    for _ in range(rounds):
        for kind, pattern in votes:
            odds = math.log(share[kind] / (1 - share[kind]))
            for j, vote in enumerate(pattern):
                if vote is not None:
                    hit, miss = rate[kind, j, 1], rate[kind, j, 0]
                    odds += math.log(hit / miss) if vote else math.log((1 - hit) / (1 - miss))
            belief[kind, pattern] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in share:
            mine = [(p, n, belief[k, p]) for (k, p), n in votes.items() if k == kind]
            share[kind] = (1 + sum(n * b for _, n, b in mine)) / (2 + sum(n for _, n, _ in mine))
            for j, z in product(range(3), (0, 1)):
                weight = [(p[j], n * (b if z else 1 - b)) for p, n, b in mine if p[j] is not None]
                # A prior worth ten spans keeps labelers better than chance where data is thin.
                rate[kind, j, z] = (sum(w for v, w in weight if v) + (8 if z else 2)) / (sum(w for _, w in weight) + 10)
    return belief


class SpanClassifier:
    """Naive Bayes over a span's features, learnt from the estimated labels. The votes are not among
    the features: they made the labels. A span's probability is the lower one of what its
    features and what its votes say."""

    def __init__(self, counts: list[tuple]):
        belief = estimate(counts)
        total: dict[tuple, float] = defaultdict(float)
        seen: dict[tuple, set] = defaultdict(set)
        for kind, votes, features, n in counts:
            b = belief[kind, votes]
            for z, weight in ((1, n * b), (0, n * (1 - b))):
                total[kind, z] += weight
                for name, value in enumerate(features):
                    total[kind, name, value, z] += weight
                    seen[kind, name].add(value)
        self.odds: dict[tuple, float] = {}
        for kind, votes, features, n in counts:
            score = math.log((total[kind, 1] + 1) / (total[kind, 0] + 1))
            for name, value in enumerate(features):
                room = len(seen[kind, name])
                score += math.log((total[kind, name, value, 1] + 1) / (total[kind, 1] + room))
                score -= math.log((total[kind, name, value, 0] + 1) / (total[kind, 0] + room))
            b = min(max(belief[kind, votes], 1e-12), 1 - 1e-12)
            self.odds[kind, votes, features] = min(score, math.log(b / (1 - b)))

    def table(self) -> dict[str, float]:
        """Probability by the text key of ``span_key``; bounded like the counts."""
        name = lambda k, v, f: "|".join([str(k), *("-" if x is None else str(x) for x in v), *map(str, f)])
        return {name(*key): 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) for key, odds in self.odds.items()}


def span_key(s: Column) -> Column:
    votes = [F.coalesce(F.get(s["votes"], j).cast("string"), F.lit("-")) for j in range(3)]
    return F.concat_ws("|", s["kind"].cast("string"), *votes, *[F.get(s["features"], j).cast("string") for j in range(4)])


def fit(candidates: DataFrame) -> SpanClassifier:
    """Labeler reliabilities and the classifier from all spans' pattern counts."""
    return SpanClassifier([(r.kind, tuple(r.votes), tuple(r.features), r.n) for r in pattern_counts(candidates).collect()])


def accepted(model: SpanClassifier, threshold: float = THRESHOLD) -> Column:
    """From ``spans``: base spans, and candidates that the classifier takes; of candidates that
    overlap each other all stay. No vote outweighs a card's check digit, which is the pattern's vote."""
    yes = sorted(key for key, p in model.table().items() if p >= threshold)
    table = F.array(*[F.lit(k) for k in yes]) if yes else F.array().cast("array<string>")
    checked = lambda s: (s["kind"] != KINDS.index("card")) | (F.get(s["votes"], F.lit(0)) == 1)
    return F.filter("spans", lambda s: s["is_base"] | (checked(s) & F.array_contains(table, span_key(s))))


def _listed(spans: Column) -> Column:
    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(plain, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts of base spans by kind, ``base_sha256`` and ``spans`` (kind:start:end by kind,
    then start) of every row. A null text is empty. Other columns are ignored; repeated
    rows stay. The candidates, without the texts, are stored once and serve both the fit
    and the result."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = stored(with_candidates(rows).select("doc_id", "spans"), "candidates")
    model = fit(known)
    base = F.filter("spans", lambda s: s["is_base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return known.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(accepted(model, threshold)).alias("spans"))


def mask(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; spans that overlap become
    one, by the first one's kind. A null text stays null. Columns as given. The rows are stored
    once with their candidates: the fit reads the candidates, the masking both."""
    rows = carried(docs, text).select("row", F.col("text").isNull().alias("was_null"), F.coalesce("text", F.lit("")).alias("text"))
    found = stored(with_candidates(rows).select("row", "was_null", "text", "spans"), "candidates")
    model = fit(found)
    found = found.withColumn("_cut", apart(accepted(model, threshold)))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    found = found.withColumn("_new", replaced("text", "_cut", lambda s: F.get(names, s["kind"])))
    return put_back(found.select("row", F.when(~F.col("was_null"), F.col("_new")).alias("text")), docs, text)
