"""Removal of every byte that a repeated string of ``LENGTH`` bytes covers.

Every window of LENGTH bytes has an anchor: its GRAM-byte string of the least
hash, the leftmost of equals. Equal windows have equal anchors at equal places,
so a window whose anchor is nowhere else is unique, and runs of windows with
one anchor, about a hundred bytes apart, stand for all windows. Runs with a
repeated anchor are sorted by anchor, and the windows of neighbouring anchors
are classed together by bucket-pointer refinement: buckets of 8-byte strings
are refined by the buckets 8, 16, 32 ... bytes on, which the same refinement
made, until windows of LENGTH bytes in one bucket are equal. An anchor of more
runs than a task refines is a bucket that is refined on Spark before: equal runs
become one, and the others go into buckets of the bytes around the anchor that
all windows of a half, a quarter, ... of their places share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, whole_text

LENGTH = 200
GRAM = 32
_RUN = LENGTH - GRAM + 1
_PLACE = 24
_BATCH = 1 << 20
_MIX = 0x9E3779B97F4A7C15
#: A task refines buckets of at most so many runs; larger ones are divided before.
BUCKET = 1024


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place; sums of halves, doubled."""
    hashes = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX)
    width, base = 1, 0x2545F4914F6CDD1D
    while width < GRAM:
        hashes = hashes[:-width] * np.uint64(base) + hashes[width:]
        width, base = 2 * width, base * base % 2**64
    return (hashes ^ (hashes >> np.uint64(29))) * np.uint64(_MIX)


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, anchor, first window, windows) of the runs of texts in one
    buffer, which the places ``starts`` to ``ends`` divide."""
    empty = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return empty, empty, empty, empty
    hashes = _grams(data)
    # The place in the low bits makes the least value the leftmost of equals.
    least = (hashes >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while 2 * width <= _RUN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = _RUN - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    place = (least & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    docs = np.flatnonzero(ends - starts >= LENGTH)
    counts = ends[docs] - starts[docs] - LENGTH + 1
    owner = np.repeat(docs, counts)
    windows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    anchors = place[windows]
    first = np.flatnonzero((np.diff(anchors, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
    sizes = np.diff(first, append=len(windows))
    return owner[first], hashes[anchors[first]].view(np.int64), windows[first] - starts[owner[first]], sizes


def anchors(read: DataFrame) -> DataFrame:
    """The runs of each text, an anchor's runs in one row: ``doc_id``, ``copy``,
    ``anchor`` and ``places`` (first, windows)."""
    schema = "doc_id long, copy long, anchor long, places array<struct<first:long,windows:int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            keys, copies, texts, skips = zip(*rows)
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            owner, anchor, first, windows = runs(np.frombuffer(b"".join(texts), np.uint8), ends - sizes, ends)
            order = np.lexsort((first, anchor, owner))
            owner, anchor, first, windows = owner[order], anchor[order], first[order], windows[order]
            begin = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(anchor, prepend=0) != 0))
            begin = np.union1d(begin, [0] if len(owner) else []).astype(np.int32)
            places = pa.StructArray.from_arrays(
                [pa.array(first + np.array(skips, np.int64)[owner], pa.int64()), pa.array(windows, pa.int32())],
                names=["first", "windows"],
            )
            columns = [
                pa.array(keys, pa.int64()).take(pa.array(owner[begin])),
                pa.array(copies, pa.int64()).take(pa.array(owner[begin])),
                pa.array(anchor[begin], pa.int64()),
                pa.ListArray.from_arrays(pa.array([*begin, len(owner)], pa.int32()), places),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy", "anchor", "places"])

        for batch in batches:
            rows, held = [], 0
            for key, copy, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_buffer().to_pybytes()
                # A long text comes in parts that share the bytes of a window.
                for at in range(0, max(1, len(text) - LENGTH + 1), _BATCH):
                    rows.append((key, copy, text[at : at + _BATCH + LENGTH - 1], at))
                    held += len(rows[-1][2])
                    if held >= _BATCH:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    return read.select("doc_id", "copy", "text").mapInArrow(run, schema)


def repeated_windows(texts: list[bytes]) -> list[np.ndarray]:
    """For each text, which of its windows are in one of the texts again."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(texts) + bytes(LENGTH), np.uint8).astype(np.uint64)
    total = int(ends[-1])
    width, pointers = 1, data
    while width < 8:
        pointers = (pointers[:-width] << np.uint64(8 * width)) | pointers[width:]
        width *= 2
    left = np.repeat(ends, sizes) - np.arange(total)
    alive = np.flatnonzero(left >= width)
    keys = pointers[alive]
    while True:
        _, bucket, count = np.unique(keys, return_inverse=True, return_counts=True)
        shared = count[bucket] > 1
        alive, bucket = alive[shared], bucket[shared]
        if width == LENGTH or not len(alive):
            break
        # A place alone in its bucket, or too near its text's end, points nowhere.
        pointers = np.full(total, -1, np.int64)
        pointers[alive] = bucket
        step = min(width, LENGTH - width)
        kept = left[alive] >= width + step
        alive, bucket = alive[kept], bucket[kept]
        later = pointers[alive + step]
        alive, bucket, later = alive[later >= 0], bucket[later >= 0], later[later >= 0]
        keys = bucket.astype(np.uint64) << np.uint64(32) | later.astype(np.uint64)
        width += step
    again = np.zeros(total, bool)
    again[alive] = True
    return [again[end - size : end - LENGTH + 1] for end, size in zip(ends, sizes)]


def _spans(again: np.ndarray) -> Iterator[tuple[int, int]]:
    """The bytes that runs of repeated windows cover."""
    edges = np.flatnonzero(np.diff(again, prepend=False, append=False))
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        yield start, end + LENGTH - 1


_SPANS = "doc_id long, copy long, spans array<struct<start:long,end:long>>"


def _span_batch(found: dict[tuple, list[tuple[int, int]]]) -> pa.RecordBatch:
    """One row per document of these, with its spans."""
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = (pa.int64(), pa.int64(), pa.list_(pair))
    rows = [(*key, [{"start": a, "end": b} for a, b in spans]) for key, spans in found.items()]
    columns = list(zip(*rows)) or [[]] * 3
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "copy", "spans"]
    )


def _by_refinement(shared: DataFrame) -> DataFrame:
    """Covered spans of the runs (doc_id, copy, anchor, firsts, bytes), whose
    rows are sorted by anchor and read in batches of whole anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows: doc_id, copy, anchor, firsts, bytes
        size = 0

        def close(rows: list[tuple]) -> pa.RecordBatch:
            groups: dict[int, dict[bytes, list[tuple]]] = {}
            for row in rows:
                groups.setdefault(row[2], {}).setdefault(row[4], []).append(row)
            # Runs with equal bytes are all repeated; the others are classed.
            mixed = [text for group in groups.values() if len(group) > 1 for text in group]
            classed = dict(zip(mixed, repeated_windows(mixed))) if mixed else {}
            spans: dict[tuple, list[tuple[int, int]]] = {}
            for group in groups.values():
                for text, same in group.items():
                    if sum(len(r[3]) for r in same) > 1:
                        found = [(0, len(text))]
                    elif len(group) > 1:
                        found = list(_spans(classed[text]))
                    else:
                        found = []
                    for row in (r for r in same if found and r[3]):
                        own = spans.setdefault(row[:2], [])
                        own += ((at + a, at + b) for at in row[3] for a, b in found)
            return _span_batch(spans)

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if size >= _BATCH and row[2] != held[-1][2]:
                    yield close(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held:
            yield close(held)

    rows = shared.select("doc_id", "copy", "anchor", "firsts", "bytes")
    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _SPANS)


def _equal(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the pieces ``rows`` (bucket, at, bytes, doc_id, copy, firsts; without
    ``firsts`` for what stands elsewhere): spans of those that are there again, and one
    row per different piece of a bucket, its ``firsts`` empty if it is there again."""
    place = F.struct("doc_id", "copy", "firsts")
    rows = rows.withColumn("piece", F.unhex(F.md5(F.concat(F.encode(F.concat(F.col("at").cast("string"), F.lit(":")), "utf-8"), "bytes"))))
    times = F.when(F.size("firsts") > 0, F.size("firsts")).otherwise(2)
    # Written first, so that both sides of the join are dealt anew and can be split.
    rows = saved(rows, "pieces")
    classes = saved(rows.groupBy("bucket", "piece").agg(F.sum(times).alias("times"), F.min(place).alias("one")), "classes")
    joined = saved(rows.join(classes, ["bucket", "piece"]), "classed")
    size = F.octet_length("bytes")
    spans = joined.filter("times > 1 AND size(firsts) > 0").select(
        "doc_id", "copy", F.transform("firsts", lambda begin: F.struct(begin.alias("start"), (begin + size).alias("end"))).alias("spans")
    )
    none = F.array().cast("array<long>")
    ones = joined.filter(place.eqNullSafe(F.col("one"))).withColumn("firsts", F.when(F.col("times") > 1, none).otherwise(F.col("firsts")))
    return spans, ones.dropDuplicates(["bucket", "piece"]).drop("piece", "times", "one")


def _halved(pieces: DataFrame) -> DataFrame:
    """The pieces cut by where in a window its anchor stands, from ``low`` to
    ``high`` bytes on, into a piece for either half of these places. All
    windows of a half hold the bytes around the anchor that the half's bucket
    is named by, which are more than those of the bucket before."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(
        F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high"))
    )
    least = F.col("at") - (F.octet_length("bytes") - LENGTH)
    cut = pieces.withColumn("half", F.explode(halves)).withColumns(
        {"first": F.greatest(least, "half.low").cast("int"), "last": F.least("at", "half.high").cast("int")}
    )
    cut = cut.withColumn("skipped", F.col("at") - F.col("last"))
    core = F.substring("bytes", F.col("at") - F.col("half.low") + 1, F.col("half.low") + LENGTH - F.col("half.high"))
    return cut.filter("first <= last").select(
        F.xxhash64("bucket", "half.low", core).alias("bucket"),
        "half.low",
        "half.high",
        F.col("last").alias("at"),
        F.substring("bytes", F.col("skipped") + 1, F.col("last") - F.col("first") + LENGTH).alias("bytes"),
        "doc_id",
        "copy",
        F.transform("firsts", lambda begin: begin + F.col("skipped")).alias("firsts"),
    )


def _by_division(shared: DataFrame, most: int) -> DataFrame:
    """The same for anchors of more runs than a task takes: pieces that are equal
    become one, and buckets of more than ``most`` different ones are refined by
    the bytes on either side of the anchor, half by half, until a task can refine
    the rest. A piece gives two rows at most a step, eight steps at most."""
    rows = shared.select(
        F.col("anchor").alias("bucket"), F.lit(0).alias("low"), F.lit(_RUN - 1).alias("high"), "at", "bytes",
        "doc_id", "copy", "firsts",
    )
    spans, small = [], []
    while True:
        known, ones = _equal(rows)
        spans.append(known)
        ones = saved(ones, "ones")
        sizes = ones.groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.size("firsts") > 0).alias("open")
        )
        # Where nothing is alone, or only one piece is left, all is known.
        sized = saved(ones.join(saved(sizes.filter("n > 1 AND open > 0"), "sizes"), "bucket"), "sized")
        small.append(_by_refinement(sized.filter(F.col("n") <= most).withColumn("anchor", F.col("bucket"))))
        large = sized.filter((F.col("n") > most) & (F.col("low") < F.col("high")))
        if large.isEmpty():
            return reduce(DataFrame.unionAll, spans + small)
        rows = _halved(large.drop("n", "open"))


def covered(read: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Spans of bytes that repeated windows cover, of texts (doc_id, copy, text)."""
    table = saved(anchors(read), "anchors")
    # Written first, so that both sides of the join are dealt anew and can be split.
    repeated = saved(table.groupBy("anchor").agg(F.sum(F.size("places")).alias("rows")).filter("rows > 1"), "repeated")
    wanted = (
        table.join(repeated, "anchor")
        .groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"))
        .agg(F.collect_list(F.struct("anchor", "places", (F.col("rows") > bucket).alias("hot"))).alias("runs"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        names = ["doc_id", "copy", "anchor", "at", "firsts", "bytes"]
        for batch in batches:
            for doc_id, copy, text, found in zip(*(c.to_pylist() for c in batch.columns[:2]), *batch.columns[2:]):
                text = text.as_buffer().to_pybytes()
                rows = []
                for r in found.as_py():
                    equal: dict[bytes, list[int]] = {}
                    for place in r["places"]:
                        at = place["first"]
                        equal.setdefault(text[at : at + place["windows"] + LENGTH - 1], []).append(at)
                    for run, firsts in equal.items():
                        # Where the anchor is, for those that are divided by it.
                        at = int(np.argmax(_grams(np.frombuffer(run, np.uint8)).view(np.int64) == r["anchor"])) if r["hot"] else None
                        rows.append((doc_id, copy, r["anchor"], at, firsts, run))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    fetched = read.join(wanted, same).select("doc_id", "copy", "text", "runs")
    schema = "doc_id long, copy long, anchor long, at int, firsts array<long>, bytes binary"
    shared = saved(fetched.mapInArrow(run, schema), "shared")
    return _by_refinement(shared.filter("at IS NULL")).unionAll(_by_division(shared.filter("at IS NOT NULL"), bucket))


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per document ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``,
    ``kept_sha256`` and, if asked for, ``kept``, the bytes that stay.

    A text counts by its UTF-8 bytes, a missing one as empty. Strings are
    judged on the input, in other documents or the same one, overlaps included.
    Rows that repeat id and text repeat each other's strings too.
    """
    read = docs.select("doc_id", whole_text().alias("text"))
    read = read.select("doc_id", F.xxhash64("text").alias("copy"), F.col("text").cast("binary").alias("text"))
    spans = (
        covered(read)
        .groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"))
        .agg(F.flatten(F.collect_list("spans")).alias("spans"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), *batch.columns[1:]):
                text, at, kept, n = text.as_buffer().to_pybytes(), 0, [], 0
                for start, end in sorted((s["start"], s["end"]) for s in found.as_py() or ()):
                    if start > at or not n:
                        kept.append(text[at:start])
                        n += 1
                    at = max(at, end)
                kept = b"".join([*kept, text[at:]])
                row = (doc_id, len(text), len(text) - len(kept), n, hashlib.sha256(kept).hexdigest())
                rows.append((*row, kept) if keep_text else row)
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    joined = read.join(spans, same, "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, schema + ", kept binary" * keep_text)
