"""Personal data: fixed patterns, and identifiers found by the company they keep.

Entities that the fixed patterns find are seeds. The words before a seed are
patterns for what follows them; other identifier-like tokens behind the same
words are candidates. A pattern's score is the mean score of the distinct
instances behind it, an instance's the best score of its patterns, and seeds
have the full score, round after round on the graph of both. What stands behind
a pattern of high score is an identifier too. All of it is Columns and joins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, saved, whole_text

_SPANS = "array<struct<start:int,kind:int,end:int>>"
FOUND = "found"
_CONTEXT = 80


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.reverse(_digits(match))

    def step(total: Column, i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    size = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), step)
    return F.when(size.between(12, 19), total % 10 == 0).otherwise(F.lit(False))


@dataclass(frozen=True)
class Kind:
    """A pattern, what its matches must hold besides, and what every text with one has.

    Patterns are possessive, and start only where an earlier match ended or no
    character of their first part stands before: long runs cost one pass and no
    stack, and the matches are the same.
    """

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    mark: str


KINDS = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda match: F.lit(True),
        "@",
    ),
    Kind(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda match: F.forall(
            F.split(match, r"\."), lambda part: F.coalesce(part.try_cast("bigint") <= 255, F.lit(False))
        ),
        ".",
    ),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _luhn, ""),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda match: F.length(_digits(match)).between(9, 15), "+"),
)
#: Tokens that could be identifiers: two digits at least, read from a token's start.
_TOKEN = r"(?<![^\x20\x09-\x0D])(?:[^\x20\x09-\x0D0-9]*+[0-9]){2}[^\x20\x09-\x0D]*+"
_EDGES = r"^[\"'(<\[{]+|[\"'),.;:!?>\]}]+$"


def spans_of(text: Column, pattern: str, kind: int, valid: Callable[[Column], Column]) -> Column:
    """(start, kind, end) in code points of the valid matches of a pattern.

    The pieces between the matches and the matches add up to the places.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.zip_with(between, found, lambda piece, match: F.struct(piece.alias("piece"), match.alias("match")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        good = x["match"].isNotNull() & valid(x["match"])
        spans = F.when(good, F.concat(done["spans"], F.array(span))).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(both, begin, step, lambda done: done["spans"])


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns by start, then by kind as listed."""
    none = F.array().cast(_SPANS)
    digits = text.rlike("[0-9]")
    every = []
    for number, kind in enumerate(KINDS):
        there = text.contains(kind.mark) & digits if kind.name != "email" else text.contains(kind.mark)
        every.append(F.when(there, spans_of(text, kind.pattern, number, kind.valid)).otherwise(none))
    return F.array_sort(F.concat(*every))


def spans_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k.name) for k in KINDS), F.lit(FOUND))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def _mentions(read: DataFrame) -> DataFrame:
    """Seeds and candidates of each text with the words before them: ``doc_id``,
    ``copy``, ``span``, ``seed``, ``instance`` and ``patterns``."""
    text = F.col("text")
    tokens = F.when(text.rlike("[0-9]"), spans_of(text, _TOKEN, len(KINDS), lambda match: F.lit(True)))

    def core(span: Column) -> Column:
        """A token's span without quotes, brackets and stops around it."""
        token = F.substring(text, span["start"] + 1, span["end"] - span["start"])
        left = F.length(token) - F.length(F.regexp_replace(token, r"^[\"'(<\[{]+", ""))
        size = F.length(F.regexp_replace(token, _EDGES, ""))
        start = span["start"] + left
        return F.struct(start.alias("start"), span["kind"].alias("kind"), (start + size).alias("end"))

    def clear(span: Column) -> Column:
        """Eight characters at least that no base span overlaps."""
        over = F.exists("base", lambda b: (b["start"] < span["end"]) & (b["end"] > span["start"]))
        return (span["end"] - span["start"] >= 8) & ~over

    others = F.filter(F.transform(F.coalesce(tokens, F.array().cast(_SPANS)), core), clear)
    spans = read.select("doc_id", "copy", "text", F.explode(F.concat("base", others)).alias("span"))
    start = F.col("span.start")
    before = F.substring(text, F.greatest(start - _CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(_CONTEXT)))
    words = F.transform(
        F.slice(F.reverse(F.regexp_extract_all(F.lower(before), F.lit(WORD), F.lit(0))), 1, 2),
        lambda word: F.regexp_replace(word, _EDGES, ""),
    )
    one, two = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    return spans.select(
        "doc_id",
        "copy",
        "span",
        (F.col("span.kind") < len(KINDS)).alias("seed"),
        F.xxhash64(F.substring(text, start + 1, F.col("span.end") - start)).alias("instance"),
        F.array_compact(
            F.array(F.when(one.isNotNull(), one), F.when(two.isNotNull(), F.concat_ws(" ", two, one)))
        ).alias("patterns"),
    )


def patterns(mentions: DataFrame, rounds: int = 3, confidence: int = 800, support: int = 5) -> DataFrame:
    """``pattern``, the words before an entity, and ``score`` in thousandths.

    Only patterns of at least ``support`` distinct instances have a score, and
    those of at least ``confidence`` give theirs to what stands behind them.
    Scores are whole numbers, so reruns agree. The graph is written once and
    holds each pair of pattern and instance once; every round sums it up on the
    map side and joins it with one row per pattern and per instance.
    """
    graph = saved(
        mentions.select(F.explode("patterns").alias("pattern"), "instance", "seed")
        .groupBy("pattern", "instance")
        .agg(F.max("seed").alias("seed")),
        "patterns",
    )
    scored = graph.withColumn("score", F.when(F.col("seed"), 1000).otherwise(0))
    for turn in range(rounds):
        trusted = saved(
            scored.groupBy("pattern")
            .agg(F.floor(F.avg("score")).alias("score"), F.count(F.lit(1)).alias("n"))
            .filter((F.col("n") >= support) & (F.col("score") >= confidence))
            .select("pattern", "score"),
            "trusted",
        )
        if turn + 1 < rounds:
            best = graph.join(trusted, "pattern").groupBy("instance").agg(F.max("score").alias("score"))
            given = F.when(F.col("seed"), 1000).otherwise(F.coalesce("score", F.lit(0)))
            scored = graph.join(best, "instance", "left").withColumn("score", given)
    return trusted


def find_personal_data(docs: DataFrame, *keep: str, **levels) -> DataFrame:
    """The columns ``keep`` with ``base`` and ``spans`` (start, kind, end), a row per row.

    ``spans`` are the base spans and those that patterns discovered, by start
    and kind. A missing text is empty. Rows that share id and text share their
    spans. Texts are read twice and not shuffled; what is joined are spans.
    """
    read = docs.withColumn("text", whole_text()).withColumn("copy", F.xxhash64("text"))
    read = read.withColumn("base", base_spans(F.col("text")))
    mentions = saved(_mentions(read), "mentions")
    known = patterns(mentions, **levels)
    found = (
        mentions.filter(~F.col("seed"))
        .select("doc_id", "copy", "span", F.explode("patterns").alias("pattern"))
        .join(known, "pattern")
        .groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"))
        .agg(F.collect_set("span").alias("more"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))
    rows = read.select("doc_id", "copy", "base", *(c for c in keep if c != "doc_id"))
    spans = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPANS))))
    return rows.join(found, same, "left").select(*keep, "base", spans.alias("spans"))


def personal_data(docs: DataFrame, **levels) -> DataFrame:
    """Numbers per kind, the digest of the base spans and all spans, per document."""

    def of_kind(number: int) -> Column:
        # A second parameter of the lambda, also one with a default, would be the span's place.
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    counts = [of_kind(number).alias(f"n_{kind.name}") for number, kind in enumerate(KINDS)]
    return find_personal_data(docs, "doc_id", **levels).select(
        "doc_id",
        *counts,
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of spans
    that overlap the first names them all."""
    names = F.array(*(F.lit(f"<{k.name}>") for k in KINDS), F.lit(f"<{FOUND}>"))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(state: Column, span: Column) -> Column:
        gap = F.concat(
            state["done"],
            F.substring(text, state["at"] + 1, span["start"] - state["at"]),
            F.get(names, span["kind"]),
        )
        done = F.when(span["start"] >= state["at"], gap).otherwise(state["done"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), done.alias("done"))

    rest = lambda state: F.concat(state["done"], F.substring(text, state["at"] + 1, F.length(text)))
    return F.aggregate(spans, begin, step, rest)


def mask_documents(docs: DataFrame, **levels) -> DataFrame:
    """The documents with personal data masked; ``n_chars``, where there is one,
    follows. Other columns keep their values, whatever their names; a missing
    text stays missing."""
    packed = docs.select("doc_id", "text", F.struct("*").alias("doc"))
    found = find_personal_data(packed, "doc", **levels)
    text = F.col("doc.text")
    masked = found.select("doc", F.when(F.size("spans") > 0, mask(text, F.col("spans"))).otherwise(text).alias("text"))
    made = {"text": F.col("text"), "n_chars": F.length(F.coalesce("text", F.lit(""))).cast("long")}
    return masked.select(*(made.get(name, F.col(f"doc.`{name}`")).alias(name) for name in docs.columns))
