"""Quality rules whose cutoffs are certified to reject few good documents.

Every rule is a share in thousandths with a ladder of cutoffs, from lenient to
strict. What is tested is the joint verdict of a set of rules, on one ladder per
set and stratum: at a step each rule of the set has the strictest of its cutoffs
up to there that catches a labelled bad document of the stratum the one before
doesn't, or none. Bad documents alone make the ladders, so good ones are held
out for them: on them the false rejections of a step are a binomial count, and
the step holds if so few would be seen with probability ``delta`` at most were
the true rate above ``alpha`` (the exact one-sided bound of Clopper and
Pearson). ``delta`` is shared out over the strata that have ladders and over
their sets: half to the set of all rules, a quarter to those of one rule, a
quarter to the others, so that all statements hold together. ``alpha`` is for the
rules together. Within a ladder the tests stop at the first that fails, which
needs no further share. With four strata a step without false rejections holds
for all rules from 99 good labels on, for one rule from 151 on, for any set from
206 on; a stratum with fewer has the base rule only, which the column
``certified`` tells.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, saved, whole_text

_SPACE = re.compile(f"[{SPACES}]")
_SYMBOLS = b"#*$%&|<>"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals",
    "n_marks",
)
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Rejects if ``1000 * top > cutoff * bottom``; cutoffs from lenient to strict."""

    name: str
    top: str
    bottom: str
    cutoffs: tuple[int, ...]


def _down(most: int, least: int, step: int) -> tuple[int, ...]:
    return tuple(range(most, least - 1, -step))


RULES = (
    Rule("symbols", "n_symbols", "n_words", _down(1000, 50, 50)),
    Rule("dup_lines", "n_dup_lines", "n_lines", _down(1000, 50, 50)),
    Rule("repeats", "n_repeat_words", "n_words", _down(200, 10, 10)),
    Rule("capitals", "n_capitals", "word_chars", _down(1000, 50, 50)),
    Rule("marks", "n_marks", "n_words", _down(1000, 50, 50)),
    Rule("long_words", "word_chars", "n_words", _down(23000, 4000, 1000)),
    Rule("short_words", "n_words", "word_chars", _down(1000, 240, 40)),
)


def measure(text: str) -> tuple[int, ...]:
    """The counts of a text; words are divided by six ASCII characters."""
    data = text.encode()
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    grams = list(zip(*(words[i:] for i in range(WINDOW))))
    repeated = 0
    if len(set(grams)) < len(grams):
        seen = Counter(grams)
        end = 0
        for i, gram in enumerate(grams):
            if seen[gram] > 1:
                repeated += i + WINDOW - max(i, end)
                end = i + WINDOW
    return (
        len(words),
        len(text) - sum(map(text.count, "\x20\x09\x0a\x0b\x0c\x0d")),
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(data) - len(data.translate(None, _CAPITALS)),
        data.count(b"!") + data.count(b"?"),
    )


def features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` with the counts of each whole text; none for a missing one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(text.as_py()) for text in batch.column(batch.num_columns - 1)]
            counts = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *counts], names=[*batch.schema.names[:-1], *_COUNTS]
            )

    given = docs.select(*keep, whole_text().alias("_text"))
    fields = [*given.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in _COUNTS)]
    return given.mapInArrow(run, T.StructType(fields))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def exceeds(rule: Rule, cutoff: Column | int) -> Column:
    return 1000 * F.col(rule.top) > cutoff * F.col(rule.bottom)


def holds(rejected: int, total: int, alpha: float, delta: float) -> bool:
    """Whether a rate over ``alpha`` would show so few rejections with
    probability ``delta`` at most."""
    if not total:
        return False
    log = [
        math.lgamma(total + 1) - math.lgamma(i + 1) - math.lgamma(total - i + 1)
        + i * math.log(alpha) + (total - i) * math.log1p(-alpha)
        for i in range(rejected + 1)
    ]
    most = max(log)
    return most + math.log(math.fsum(math.exp(x - most) for x in log)) <= math.log(delta)


def certify(
    measured: DataFrame, labels: DataFrame, stratum: str, alpha: float = 0.05, delta: float = 0.05
) -> DataFrame:
    """``_stratum`` and ``_cutoffs``, one per rule or none, of each stratum with a
    certified step, for the documents of ``measured`` by ``labels`` (doc_id, quality).

    All labels count; a document with several is good only if all say so, and
    a label without a quality or a document is none. Documents without a stratum
    are one together. Every stratum with labels of both kinds has its test, and
    all is counted and chosen in tables with a row per stratum. Of the certified
    steps the one of most gain is taken (ties: fewer rules, the more lenient): bad documents
    rejected less good ones, of which each weighs as many as there are good for
    a bad one. Where none has a gain the rules stay off.
    """
    quality = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    # Per rule the first step whose cutoff a document exceeds, behind the last for none.
    firsts = [
        sum(((~exceeds(rule, c)).cast("int") for c in rule.cutoffs), F.lit(0)) for rule in RULES
    ]
    held = saved(
        measured.join(quality, "doc_id")
        .filter(~base_failed())
        .select(F.col(stratum).alias("_stratum"), (F.col("_quality") > 0).alias("good"), F.array(*firsts).alias("firsts")),
        "held",
    )
    steps = [
        F.array_sort(F.collect_set(F.when(F.col("firsts")[i] < len(rule.cutoffs), F.col("firsts")[i]))).alias(f"r{i}")
        for i, rule in enumerate(RULES)
    ]
    ladders = held.filter("NOT good").groupBy("_stratum").agg(*steps)
    ladders = saved(ladders.select("_stratum", F.array(*(f"r{i}" for i in range(len(RULES)))).alias("steps")), "ladders")
    tests = max(1, ladders.count())

    named = ladders.withColumnRenamed("_stratum", "_name")
    there = F.zip_with("steps", "firsts", lambda taken, first: F.array_min(F.filter(taken, lambda step: step >= first)))
    placed = held.join(named, F.col("_stratum").eqNullSafe(F.col("_name"))).select("_stratum", "good", there.alias("at"))
    # A set's number has a bit per rule. What no set rejects is counted too.
    joint = [
        F.struct(F.lit(number).alias("rules"), F.array_min(F.array(*(F.get("at", F.lit(i)) for i in chosen))).alias("step"))
        for number in range(1, 1 << len(RULES))
        if (chosen := _rules_of(number))
    ]
    counted = (
        saved(placed, "first-steps")
        .groupBy("_stratum", "good", "at")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("_stratum", "good", "n", F.explode(F.array(*joint)).alias("joint"))
        .groupBy("_stratum", "good", "joint.rules", "joint.step")
        .agg(F.sum("n").alias("n"))
        .groupBy("_stratum")
        .agg(F.collect_list(F.struct("rules", "good", "step", "n")).alias("counts"))
    )
    kind = measured.schema[stratum].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [_best_step(counts, alpha, delta / tests) for counts in batch.column(1).to_pylist()]
            rules, steps = (pa.array([b and b[k] for b in best], pa.int32()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), rules, steps], names=["_stratum", "rules", "step"])

    best = counted.mapInArrow(run, f"_stratum {kind}, rules int, step int").filter("step IS NOT NULL")
    cutoffs = [
        F.when(
            F.col("rules").bitwiseAND(F.lit(1 << i)) > 0,
            F.get(
                F.array(*map(F.lit, rule.cutoffs)),
                F.array_max(F.filter(F.get("steps", F.lit(i)), lambda taken: taken <= F.col("step"))),
            ),
        )
        for i, rule in enumerate(RULES)
    ]
    return saved(
        best.join(named, F.col("_stratum").eqNullSafe(F.col("_name"))).select("_stratum", F.array(*cutoffs).alias("_cutoffs")),
        "cutoffs",
    )


def _rules_of(number: int) -> list[int]:
    return [i for i in range(len(RULES)) if number >> i & 1]


def _share(rules: int) -> float:
    """The part of ``delta`` that a ladder with so many rules has."""
    if rules == len(RULES):
        return 1 / 2
    return 1 / (4 * len(RULES)) if rules == 1 else 1 / (4 * (2 ** len(RULES) - len(RULES) - 2))


def _best_step(counts: list[dict], alpha: float, delta: float) -> tuple[int, int] | None:
    """The set of rules and the step of most gain among those that hold, from the
    numbers of good and bad documents by the first step that rejects them, if any."""
    rows: dict[tuple[int, bool], Counter] = {}
    for c in counts:
        rows.setdefault((c["rules"], c["good"]), Counter())[c["step"]] += c["n"]
    most, best = 0, None
    for number in sorted({c["rules"] for c in counts}, key=lambda n: (n.bit_count(), n)):
        good, bad = (rows.get((number, kind), Counter()) for kind in (True, False))
        level = delta * _share(number.bit_count())
        lost = caught = 0
        held: dict[int, bool] = {}
        for step in range(max(len(rule.cutoffs) for rule in RULES)):
            lost, caught = lost + good[step], caught + bad[step]
            if lost not in held:
                held[lost] = holds(lost, good.total(), alpha, level)
            if not held[lost]:
                break
            gain = caught * bad.total() - lost * good.total()
            if gain > most:
                most, best = gain, (number, step)
    return best


def _judged(measured: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """The rows with ``base_failed``, ``kept`` and ``certified``, whether their stratum has cutoffs."""
    rejected = F.lit(False)
    for i, rule in enumerate(RULES):
        rejected = rejected | F.coalesce(exceeds(rule, F.get("_cutoffs", F.lit(i))), F.lit(False))
    return (
        measured.join(cutoffs, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~rejected)
        .withColumn("certified", F.col("_cutoffs").isNotNull())
        .drop("_stratum", "_cutoffs")
    )


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **levels) -> DataFrame:
    """``doc_id``, the stratum, the counts, ``base_failed``, ``kept`` and
    ``certified`` (whether the stratum has cutoffs), a row per document.

    A missing text has no words and fails. Texts are read once; the counts are
    written to shared storage between fitting and deciding.
    """
    measured = saved(features(docs, "doc_id", stratum), "quality")
    return _judged(measured, certify(measured, labels, stratum, **levels), stratum)


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **levels) -> DataFrame:
    """The documents that :func:`quality_rules` keeps, with their columns, whose
    values stay whatever their names.

    Texts are read twice and never shuffled while the table of cutoffs can be
    broadcast: once to fit, once to decide.
    """
    cutoffs = certify(features(docs, "doc_id", stratum), labels, stratum, **levels)
    packed = docs.select(F.col(stratum).alias("_of"), F.struct("*").alias("_doc"), "text")
    return _judged(features(packed, "_of", "_doc"), cutoffs, "_of").filter("kept").select("_doc.*")
