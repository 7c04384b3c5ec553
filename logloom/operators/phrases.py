"""Frequent word pairs and triples in messages."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import text as tx
from ..functions.predicates import is_error
from ..plans.workspace import work_folder

#: Phrases are first counted in 2**16 buckets, by a hash: few enough to stay in a core's cache.
SKETCH_BITS = 16
#: So many of the fullest buckets are looked into at first.
PROBED = 1024


def stop_words() -> list[str]:
    """Spark's English stop words."""
    return sorted(fv.ENGLISH_STOP_WORDS)


def words(message: Column, stopped: Iterable[str]) -> Column:
    """Lower-case words of two or more characters, without stop words."""
    every = F.regexp_extract_all(F.lower(message), F.lit(tx.UNICODE + r"\b\w\w+\b"), F.lit(0))
    stopped = list(stopped)
    return F.filter(every, lambda w: ~w.isin(*stopped)) if stopped else every


def _grams(tokenised: DataFrame) -> DataFrame:
    """All runs of two and of three neighbouring words: ``bucket``, ``a``, ``b``
    and ``c``, which is missing in a run of two.

    The words meet their neighbours as three arrays side by side, by generated
    code, where a function per element would be interpreted.
    """
    size = F.size("tokens")
    beside = F.arrays_zip(
        F.col("tokens").alias("a"), F.slice("tokens", 2, size).alias("b"), F.slice("tokens", 3, size).alias("c")
    )
    pair = F.struct(_bucket("a", "b").alias("bucket"), F.lit(None).cast("string").alias("c"))
    triple = F.struct(_bucket("a", "b", "c").alias("bucket"), F.col("c").alias("c"))
    return (
        tokenised.select(F.inline(beside).alias("a", "b", "c"))
        .filter(F.col("b").isNotNull())
        .select("a", "b", F.explode(F.array(pair, F.when(F.col("c").isNotNull(), triple))).alias("run"))
        .filter(F.col("run").isNotNull())
        .select("run.bucket", "a", "b", "run.c")
    )


def _bucket(*run: str) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*run), 64 - SKETCH_BITS).cast("int")


def _counted(tokenised: DataFrame, buckets: DataFrame) -> DataFrame:
    """Exact counts of all phrases that are in ``buckets``."""
    return (
        _grams(tokenised)
        # At most 2**SKETCH_BITS numbers, however many phrases there are.
        .join(F.broadcast(buckets.select("bucket")), "bucket")
        .groupBy(F.concat_ws(" ", "a", "b", "c").alias("ngram"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def top_phrases(
    messages: DataFrame,
    column: str = "message",
    top: int = 10,
    stopped: Iterable[str] | None = None,
    probed: int = PROBED,
) -> DataFrame:
    """The most frequent phrases of a text column: ``ngram``, ``count``, exact.

    Stop words are taken out first, so a phrase may bridge one. Ties go to the
    smaller phrase; texts that are missing or have fewer than two words left
    have no phrase.

    Phrases are first counted in buckets, whose number is fixed, so what is
    shuffled doesn't grow with the number of distinct phrases. No phrase is
    more frequent than its bucket. Phrases of the ``probed`` fullest buckets
    are counted exactly; the ``top``-th count among them is one that no result
    is below, so only buckets that reach it can hold any other, and these are
    counted where the probe has missed some. Words are written once, so the
    texts are read (and logs parsed) a single time; the job runs at the call.
    """
    spark = messages.sparkSession
    stopped = stop_words() if stopped is None else stopped

    def written(df: DataFrame, purpose: str) -> DataFrame:
        path = work_folder(spark, purpose)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    tokenised = written(
        messages.filter(F.col(column) != "").select(words(F.col(column), stopped).alias("tokens")),
        "phrase_words",
    )
    sketch = written(
        _grams(tokenised).groupBy("bucket").agg(F.count(F.lit(1)).alias("held")),
        "phrase_buckets",
    )
    order = (F.desc("count"), F.asc("ngram"))
    fullest = written(sketch.orderBy(F.desc("held"), "bucket").limit(max(probed, 1)), "phrase_probe")
    counted = written(_counted(tokenised, fullest), "phrase_counts")
    best = counted.orderBy(*order).limit(top)
    found, least = best.agg(F.count(F.lit(1)), F.min("count")).first()
    reached = sketch.filter(F.col("held") >= (least if found == top and top else 1))
    missed = reached.join(F.broadcast(fullest.select("bucket")), "bucket", "left_anti")
    if not top or missed.isEmpty():
        return best
    return counted.unionByName(_counted(tokenised, missed)).orderBy(*order).limit(top)


def top_error_phrases(
    logs: DataFrame, top: int = 10, stopped: Iterable[str] | None = None
) -> DataFrame:
    return top_phrases(logs.filter(is_error()), "message", top, stopped)
