"""Personal data: fixed formats, and further spans by weak supervision. DataFrame functions only.

The fixed formats (e-mail, IP address, payment card, phone with a country code) are found in every whole
text. Looser patterns propose further spans (numbers grouped like phone numbers, spelled-out
e-mail addresses). Labelers of three sorts vote on every span, for, against or not at all: regular
expressions on its shape, gazetteers on its parts, and words in the context before it. Expectation
maximisation over the counted vote patterns (at most 3^5 rows) estimates how reliable each labeler is and
how likely each pattern marks personal data. These likelihoods teach a naive Bayes classifier of spans by
their features, and proposed spans that it accepts are added; the fixed formats always stay.

Texts are read once; the spans found are stored and all else works on them. A match's place is the sum of
the lengths of the matches and gaps before it, added up in chunks. The patterns begin at the start of a run
or where the last match ended, and repeat possessively, so a long run is read once.

Defined results: a NULL or empty text has no spans; repeated or NULL keys keep a row each; an empty table
gives no rows; only the key and the text are read. Equal starts are ordered by kind.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import stored

KINDS = ("email", "ip", "card", "phone", "other")
CHUNK, BEFORE, ROUNDS = 256, 24, 30
LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "grouped": r"(?<![0-9A-Za-z+.-])(?<![0-9)][\x20])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{2,5}(?![0-9A-Za-z-])(?![\x20.][0-9])",
    "spelled": r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+\x20?(?:\[at\]|\(at\)|\x20at\x20)\x20?[A-Z0-9-]{1,63}+\x20?(?:\[dot\]|\(dot\)|\x20dot\x20)\x20?[A-Z]{2,24}(?![A-Z0-9])",
}
GUARDS = {"email": "@", "ip": ".", "phone": "+"}
#: Gazetteers: fixed values. Endings of domains, first digits of payment cards, reserved networks, country codes.
ENDINGS = "com|org|net|edu|gov|info|io|co|de|fr|es|it|uk|us|eu|ch|at|nl|be|pl|ru|br|in|jp|cn|au|ca"
CARD_PREFIX, RESERVED_IP = "^(?:4|5[1-5]|2[2-7]|3[47]|6)", r"^(?:0|127|255)\."
COUNTRY_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
FOR_WORDS = "phone|tel|call|mobile|fax|mail|contact|write|card|visa|ssn|address|ip|host|reach"
AGAINST_WORDS = "version|isbn|page|order|total|price|chapter|figure|table|invoice|section"
Span = Column


def _with_spans(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: (start, end, match, before) of each match of a pattern, in code points."""
    pattern, none = F.lit(PATTERNS[name]), F.array().cast("array<string>")
    guard = F.contains("text", F.lit(GUARDS[name])) if name in GUARDS else F.lit(True)
    rows = rows.withColumn("_m", F.when(guard, F.regexp_extract_all("text", pattern, 0)).otherwise(none))
    some = F.size("_m") > 0
    rows = rows.withColumn("_g", F.when(some, F.split("text", PATTERNS[name], -1)).otherwise(none))
    rows = rows.withColumn(
        "_l",
        F.zip_with("_m", F.slice("_g", F.lit(1), F.size("_m")), lambda m, g: (F.length(m) + F.length(g)).cast("long")),
    )

    def total(lengths: Column) -> Column:
        return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, b: a + b)

    chunks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("_m") - 1) / CHUNK).cast("int")))
    rows = rows.withColumn("_c", F.transform(chunks, lambda c: total(F.slice("_l", c * CHUNK + 1, F.lit(CHUNK)))))

    def span(match: Column, i: Column) -> Column:
        chunk = F.floor(i / CHUNK).cast("int")
        gap = F.get("_g", i)
        start = (
            total(F.slice("_c", F.lit(1), chunk))
            + total(F.slice("_l", chunk * CHUNK + 1, i - chunk * CHUNK))
            + F.length(gap)
        )
        return F.struct(
            start.alias("start"), (start + F.length(match)).alias("end"), match.alias("match"),
            F.right(gap, F.lit(BEFORE)).alias("before"),
        )

    return rows.withColumn(name, F.transform("_m", span)).drop("_m", "_g", "_l", "_c")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether every second digit from the right, doubled, and the others add up to a multiple of 10."""
    values = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        ),
    )
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _passes(name: str, match: Column) -> Column:
    if name == "ip":
        short = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (F.try_to_number(p, F.lit("999")) <= 255))
    if name == "card":
        return _luhn(_digits(match))
    if name == "phone":
        return F.length(_digits(match)).between(9, 15)
    if name == "grouped":
        return F.length(_digits(match)).between(9, 12)
    return F.lit(True)


def _kept(name: str, kind: str) -> Column:
    """The spans of a pattern that pass, as (start, order, end, kind, pattern, match, before)."""
    return F.transform(
        F.filter(name, lambda s: _passes(name, s["match"])),
        lambda s: F.struct(
            s["start"], F.lit(KINDS.index(kind)).alias("order"), s["end"], F.lit(kind).alias("kind"),
            F.lit(name).alias("pattern"), s["match"], s["before"],
        ),
    )


def find_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id``, the fixed formats' spans ``base`` and the other proposed spans ``more``."""
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for name in PATTERNS:
        rows = _with_spans(rows, name)
    rows = rows.select(
        "id",
        F.concat(*[_kept(kind, kind) for kind in KINDS[:4]]).alias("base"),
        F.concat(_kept("grouped", "other"), _kept("spelled", "other")).alias("proposed"),
    )
    free = F.filter(
        "proposed", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    )
    return rows.select("id", F.sort_array("base").alias("base"), F.sort_array(free).alias("more"))


def votes(span: Span) -> list[Column]:
    """The labelers: 1 for personal data, 0 against, 2 for no opinion."""
    match, before, pattern = F.lower(span["match"]), F.lower(span["before"]), span["pattern"]
    digits = _digits(match)

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, 0).otherwise(2)

    return [
        # shape
        vote(
            (pattern == "email") | (pattern == "card") | (pattern == "phone") & match.rlike(r"^\+[0-9]{1,3}[ (.-]")
            | (pattern == "grouped") & match.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"),
            (pattern == "grouped") & match.rlike(r"^[0-9]{2}[ .-][0-9]{2}[ .-][0-9]{4}$"),
        ),
        vote(F.length(digits).between(10, 16), digits.rlike(r"^([0-9])\1+$")),
        # gazetteers
        vote(
            match.rlike(rf"\.(?:{ENDINGS})$") | match.rlike(rf"(?:dot\)?\]?) ?(?:{ENDINGS})$")
            | (pattern == "card") & digits.rlike(CARD_PREFIX) | (pattern == "phone") & match.rlike(COUNTRY_CODE),
            (pattern == "ip") & match.rlike(RESERVED_IP) | (pattern == "email"),
        ),
        # context
        vote(before.rlike(rf"\b(?:{FOR_WORDS})\b"), before.rlike(rf"\b(?:{AGAINST_WORDS})\b")),
        vote(before.rlike(r"[:=] ?$"), before.rlike(r"[#$€£] ?$")),
    ]


def features(span: Span) -> list[Column]:
    match = span["match"]
    return [
        span["pattern"],
        F.least(F.length(_digits(match)), F.lit(20)).cast("string"),
        F.least(F.length(match), F.lit(40)).cast("string"),
        F.regexp_replace(F.regexp_replace(F.left(match, F.lit(3)), "[0-9]", "0"), "[A-Za-z]", "a"),
        F.regexp_replace(F.regexp_replace(F.right(span["before"], F.lit(1)), "[0-9]", "0"), r"[^0\x21-\x2F:-@]", "a"),
    ]


def reliabilities(patterns: list[tuple[tuple[int, ...], int]]) -> dict[tuple[int, ...], float]:
    """Expectation maximisation: the probability of personal data behind each vote pattern.

    Each labeler has a distribution of votes for either class. It starts from the majority of the votes.
    """
    def majority(pattern: tuple[int, ...]) -> float:
        yes, no = pattern.count(1), pattern.count(0)
        return (yes + 0.5) / (yes + no + 1)

    belief = {p: majority(p) for p, _ in patterns}
    for _ in range(ROUNDS):
        mass = [1.0, 1.0]
        seen = [[[1.0] * 3 for _ in patterns[0][0]] for _ in range(2)] if patterns else []
        for pattern, n in patterns:
            for cls, share in ((1, belief[pattern]), (0, 1 - belief[pattern])):
                mass[cls] += n * share
                for labeler, vote in enumerate(pattern):
                    seen[cls][labeler][vote] += n * share
        for pattern, _ in patterns:
            odds = math.log(mass[1] / mass[0])
            for labeler, vote in enumerate(pattern):
                odds += math.log(seen[1][labeler][vote] / sum(seen[1][labeler]))
                odds -= math.log(seen[0][labeler][vote] / sum(seen[0][labeler]))
            belief[pattern] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return belief


def train(found: DataFrame) -> tuple[float, list[dict[str, float]]]:
    """The span classifier: prior log-odds, and for each feature the log-odds of its values."""
    spans = found.select(F.explode(F.concat("base", "more")).alias("s"))
    cast = spans.select(
        F.concat_ws("", *[v.cast("string") for v in votes(F.col("s"))]).alias("votes"),
        F.array(*features(F.col("s"))).alias("values"),
    )
    # a row for each pattern of five votes, at most 3^5
    counted = [
        (tuple(map(int, r["votes"])), r["n"]) for r in cast.groupBy("votes").agg(F.count("*").alias("n")).collect()
    ]
    belief = reliabilities(sorted(counted))
    if not belief:
        return 0.0, []
    share = F.coalesce(
        *[F.when(F.col("votes") == "".join(map(str, p)), F.lit(b)) for p, b in sorted(belief.items())]
    )
    taught = cast.select(share.alias("yes"), F.posexplode("values").alias("feature", "value"))
    # a few hundred values: kinds, lengths up to 40, and shapes over a small alphabet
    table = taught.groupBy("feature", "value").agg(F.sum("yes").alias("yes"), F.count("*").alias("n")).collect()
    prior = sum(n * belief[p] for p, n in counted), sum(n * (1 - belief[p]) for p, n in counted)
    weights: list[dict[str, float]] = [{} for _ in features(F.col("s"))]
    for r in table:
        yes, no = (r["yes"] + 1) / (prior[0] + 2), (r["n"] - r["yes"] + 1) / (prior[1] + 2)
        weights[r["feature"]][r["value"]] = math.log(yes / no)
    return math.log((prior[0] + 1) / (prior[1] + 1)), weights


def classify(span: Span, model: tuple[float, list[dict[str, float]]]) -> Column:
    """Whether the classifier takes the span for personal data."""
    prior, weights = model
    score = F.lit(prior)
    for value, table in zip(features(span), weights, strict=True):
        by_value = F.from_json(F.lit(json.dumps(table)), "map<string,double>")
        score = score + F.coalesce(F.try_element_at(by_value, value), F.lit(0.0))
    return score > 0


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and ``spans``, (start, order, end, kind) by start and then kind."""
    found = stored(find_spans(docs, doc_id, text), "spans")
    model = train(found)
    more = F.filter("more", lambda s: classify(s, model)) if model[1] else F.slice("more", 1, 0)
    plain = F.transform(
        F.concat("base", more), lambda s: F.struct(s["start"], s["order"], s["end"], s["kind"])
    )
    return found.select(F.col("id").alias(doc_id), F.sort_array(plain).alias("spans"))
