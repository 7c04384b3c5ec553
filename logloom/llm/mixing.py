"""Mixing sources to target weights by a low-discrepancy schedule.

Slots of ``block`` words each are dealt to the sources by the golden-ratio
points ``frac(i * phi)``: a slot goes to the source in whose share of [0, 1)
its point lies, so at any length each source has its share up to a few slots.
The slots of a source, ranked, take its words block by block, its documents in
a shuffled order, round and round over its end. Where the first point of a
source lies in its share, there in the shuffled order its first round starts.
What the slots of a source are off its target is settled: its last slots are cut
there, or one more behind all others takes the rest. Blocks and documents are
joined, so what the mix takes of a document is what the slots take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, saved, whole_text

WEIGHTS = (5.0, 2.0, 1.0)
_GOLDEN = 0.6180339887498949
_CELLS = 4096
_SLOTS = 4096
_ROWS = 4096


def word_count() -> Column:
    """Words of a text, none for a missing one."""
    return F.regexp_count(whole_text(), F.lit(WORD)).cast("long")


def sources(sized: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``key``, ``source_size``, ``target`` and ``low``/``high``, its part of [0, 1).

    Weights repeat over the sources by code point, a missing one last. Targets
    share ``share`` of all sizes by weight; one above ``most`` times its size
    stops there and the rest is shared again. That ends where sources, by the
    size per weight, are full up to some place and even behind it, so the first
    source that its even part doesn't overfill gives the level. One row per
    source goes through these windows, summed up before.
    """
    totals = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy((F.col("key") == "").asc(), "key")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(named) - 1) % len(WEIGHTS) + 1))
    weighted = totals.withColumn("weight", weight)
    limit = most * F.col("source_size")
    order = Window.orderBy(limit / F.col("weight"), "key")
    before, behind = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (
        weighted.withColumn("words", F.sum("source_size").over(every) * share)
        .withColumn("full", F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("level", (F.col("words") - F.col("full")) / F.sum("weight").over(behind))
        .withColumn("even", F.col("level") * F.col("weight") <= limit)
        .withColumn("level", F.min_by("level", F.when(F.col("even"), F.struct(limit / F.col("weight"), "key"))).over(every))
        .withColumn("target", F.least(limit, F.col("level") * F.col("weight")))
    )
    running = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(every)
    return level.select(
        "key",
        "source_size",
        "target",
        F.coalesce(F.try_divide(F.sum("target").over(running), total), F.lit(0.0)).alias("high"),
    ).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("key")), F.lit(0.0)))


def goal() -> Column:
    """The words of a source's target."""
    return F.round("target").cast("long")


def schedule(shares: DataFrame, slots: int, block: int) -> DataFrame:
    """``slot``, ``key``, ``start`` and ``end``: which of the words that a source
    gives each slot takes, and ``place`` (0 to 1), where in the source's share its
    first point lies. The slot that settles a source's rest is ``slots``, behind
    all others.

    Points and shares meet by cells of [0, 1). Ranks per source are counted in
    chunks of the slots and added up, so no source is ranked in one task.
    """
    spark = shares.sparkSession
    cells = shares.filter("high > low").withColumn(
        "cell",
        F.explode(
            F.sequence(
                F.floor(F.col("low") * _CELLS), F.least(F.floor(F.col("high") * _CELLS), F.lit(_CELLS - 1))
            )
        ),
    )
    points = spark.range(slots).select("id", ((F.col("id") + 0.5) * _GOLDEN % 1.0).alias("point"))
    place = (F.col("point") - F.col("low")) / (F.col("high") - F.col("low"))
    dealt = (
        points.withColumn("cell", F.floor(F.col("point") * _CELLS))
        .join(cells, "cell")
        .filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
        .select("id", "key", place.alias("place"), goal().alias("goal"), F.floor(F.col("id") / _SLOTS).alias("chunk"))
    )
    dealt = saved(dealt, "slots")
    counted = dealt.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "place")).alias("first"))
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("key", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("key", "chunk").orderBy("id")) - 1)
    start = (F.col("before") + F.col("rank")) * block
    taken = (
        ranked.join(before, ["key", "chunk"])
        .select(F.col("id").alias("slot"), "key", start.alias("start"), F.least(start + block, "goal").alias("end"))
        .filter("start < end")
    )
    firsts = counted.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    held = shares.join(firsts, "key", "left").select(
        "key",
        (F.coalesce("n", F.lit(0)) * block).alias("start"),
        goal().alias("end"),
        F.coalesce("first.place", F.lit(0.0)).alias("place"),
    )
    settled = held.filter("start < end").select(F.lit(slots).cast("long").alias("slot"), "key", "start", "end")
    return taken.unionByName(settled).join(held.select("key", "place"), "key")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id``, ``source``, ``key``, ``size``, ``row`` (a hash of all columns) and ``order``, row by row."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    row = F.xxhash64(whole_text(), *(F.col(f"`{name}`") for name in docs.columns))
    sized = docs.select("doc_id", "source", key.alias("key"), word_count().alias("size"), row.alias("row"))
    return saved(sized.withColumn("order", F.xxhash64("row", F.lit(seed))), "sizes")


def _placed(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """The rows with ``source_size``, ``target`` and ``start``, their place in the
    shuffled order of their source's words. Places are counted in buckets and
    added up, so no source is ordered in one task."""
    buckets = 64 + sized.count() // _ROWS
    sized = sized.withColumn("bucket", F.pmod(F.col("order"), F.lit(buckets)))
    sums = sized.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.select(
        "key", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    ).join(shares.select("key", "source_size", "target"), "key")
    inside = Window.partitionBy("key", "bucket").orderBy("order", "doc_id", "size")
    placed = (
        sized.withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(places, ["key", "bucket"])
        .withColumn("start", F.col("before") + F.col("within"))
    )
    return saved(placed.select("doc_id", "source", "key", "size", "row", "source_size", "target", "start"), "placed")


def _cells(low: Column, high: Column, block: int) -> Column:
    """The blocks of a source's order that the words from ``low`` to ``high`` touch."""
    return F.explode(F.sequence(F.floor(low / block), F.floor((high - 1) / block))).alias("cell")


def _takes(placed: DataFrame, shares: DataFrame, block: int) -> DataFrame:
    """The rows with ``takes``: per round the first ``slot`` that takes words of a
    document, and how many ``words`` the round takes, from the first one on.

    Slots are laid on the order of a source from the start of the document in
    which their first point lies. Slots and documents meet by block, at most a
    few slots for a block's documents.
    """
    words = shares.agg(F.sum(goal())).first()[0] or 0
    slots = saved(schedule(shares, -(-words // block), block), "schedule")
    firsts = slots.select("key", "place").distinct().join(shares.select("key", "source_size"), "key")
    firsts = firsts.select("key", F.floor(F.col("place") * F.col("source_size")).alias("at"))
    offsets = (
        placed.filter("size > 0")
        .join(firsts, "key")
        .filter(F.col("start") <= F.col("at"))
        .groupBy("key")
        .agg(F.max("start").alias("offset"))
        .join(shares.select("key", "source_size"), "key")
    )
    size, low = F.col("source_size"), F.col("start") + F.col("offset")
    high = F.col("end") + F.col("offset")
    laps = F.explode(F.sequence(F.floor(low / size), F.floor((high - 1) / size))).alias("lap")
    begin = F.greatest(F.col("low") - F.col("lap") * size, F.lit(0))
    end = F.least(F.col("high") - F.col("lap") * size, size)
    laid = (
        slots.join(offsets, "key")
        .select("key", "slot", "offset", "source_size", low.alias("low"), high.alias("high"), laps)
        .select("key", "slot", "offset", "lap", begin.alias("low"), end.alias("high"))
        .select("key", "slot", "offset", "lap", "low", "high", _cells(F.col("low"), F.col("high"), block))
    )
    stop = F.col("start") + F.col("size")
    parts = placed.filter("size > 0").select("key", "start", stop.alias("stop"), _cells(F.col("start"), stop, block))
    # A round starts at the offset, so words before it belong to the round that began a lap earlier.
    turn = F.col("lap") - (F.col("start") < F.col("offset")).cast("long")
    cut = F.least("stop", "high", (F.col("cell") + 1) * block) - F.greatest("start", "low", F.col("cell") * block)
    taken = (
        saved(parts, "parts")
        .join(saved(laid, "laid"), ["key", "cell"])
        .select("key", "start", turn.alias("turn"), "slot", cut.alias("words"))
        .filter("words > 0")
        .groupBy("key", "start", "turn")
        .agg(F.min("slot").alias("slot"), F.sum("words").alias("words"))
        .groupBy("key", "start")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "words"))).alias("takes"))
    )
    own = F.when(F.col("size") > 0, F.col("start"))
    taken = taken.select(F.col("key").alias("_key"), F.col("start").alias("_start"), "takes")
    return placed.join(taken, (F.col("key") == F.col("_key")) & (own == F.col("_start")), "left").drop("_key", "_start")


def _mixed(docs: DataFrame, block: int, seed: int) -> DataFrame:
    sized = _sized(docs, seed)
    shares = saved(sources(sized), "shares")
    return _takes(_placed(sized, shares), shares, block)


def mix(docs: DataFrame, block: int = 128, seed: int = 42) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken`` and
    ``slot``, the first that takes of it, a row per row.

    ``taken`` counts the words that the slots take of the document, repeats
    counted; those of a source add up to its target, rounded, at any ``block``.
    No document is taken more than twice. Missing and empty texts have size 0
    and are not taken. The order of the documents within a source hangs on
    their columns and the seed alone, so reruns agree; rows that are equal in all
    columns may change places. A missing source is one of its own. An empty
    table gives no rows.
    """
    taken = F.coalesce(F.aggregate("takes", F.lit(0).cast("long"), lambda done, x: done + x["words"]), F.lit(0))
    return _mixed(docs, block, seed).select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"),
        F.get("takes", F.lit(0))["slot"].alias("slot"),
    )


def mix_documents(docs: DataFrame, block: int = 128, seed: int = 42) -> DataFrame:
    """The documents of the mix, with their columns, whatever their names: each
    as often as rounds of its source take it, in the order of the slots, and
    where a schedule ends up to the word there. ``n_chars``, where there is one,
    follows the text.

    Rows are told apart by all their columns; equal ones are numbered. Texts are
    shuffled once to meet what is taken of them and once into slots' order.
    """
    columns = docs.columns
    mixed = _mixed(docs, block, seed)
    slots = mixed.agg(F.max(F.element_at("takes", -1)["slot"])).first()[0] or 0
    number = Window.partitionBy("row").orderBy("size")
    right = mixed.withColumn("number", F.row_number().over(number)).filter("takes IS NOT NULL")
    row = F.xxhash64(whole_text(), *(F.col(f"`{name}`") for name in columns))
    left = docs.select(F.struct("*").alias("doc"), row.alias("row"), word_count().alias("size"))
    left = left.withColumn("number", F.row_number().over(number))
    both = left.join(
        right.select(F.col("row").alias("_row"), "takes", F.col("number").alias("_number")),
        # The number is no key of the join: both sides are dealt by row already.
        (F.col("row") == F.col("_row")) & (F.col("number") - F.col("_number") == 0),
    )
    each = both.select("doc", "size", F.explode("takes").alias("take"))
    start = F.regexp_extract_all("doc.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    start = F.array_join(F.slice(start, 1, F.col("take.words").cast("int")), "")
    text = F.when(F.col("take.words") < F.col("size"), start).otherwise(F.col("doc.text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("slot") * parts / (slots + 1)).cast("int")
    ordered = each.select("doc", text.alias("text"), F.col("take.slot").alias("slot"))
    ordered = ordered.repartitionById(parts, part).sortWithinPartitions("slot")
    kept = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return ordered.select(*(kept.get(name, F.col(f"doc.`{name}`")).alias(name) for name in columns))
