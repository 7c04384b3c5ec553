"""Near duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from .common import saved, whole_text
from .components import components

BITS = 64
_HALF = BITS // 2
_STEP = 1 << 16


def shingles(text: str, width: int) -> list[bytes]:
    """Runs of ``width`` words joined by a space, all words if they are fewer.
    A-Z count as a-z; words are divided by six ASCII characters."""
    words = text.encode().lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    joined = b" ".join(words)
    starts = [0]
    for word in words:
        starts.append(starts[-1] + len(word) + 1)
    return [joined[a : b - 1] for a, b in zip(starts, starts[width:])]


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """Bit by bit what more than half of the shingles' hashes have; 0 without any."""
    grams = shingles(text, width)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(grams), _STEP):
        hashes = b"".join([xxh64_digest(gram, seed) for gram in grams[at : at + _STEP]])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id`` and ``bits`` (a signed long) of each whole text; a missing one is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [fingerprint(text.as_py(), width) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bits, pa.int64())], names=["doc_id", "bits"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, bits long")


def _forest(members: np.ndarray, distance: int) -> Iterator[tuple[np.uint64, np.uint64]]:
    """Links that hold together what is linked among ``members``.

    What a member reaches is taken out at once, so a dense group takes few
    steps, and there are fewer links than members.
    """
    left = members
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            near = np.bitwise_count(left ^ (one := reached.pop())) <= distance
            for other in left[near]:
                yield one, other
                reached.append(other)
            left = left[~near]


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Pairs ``a``, ``b`` of ``bits`` whose paths join all that differ in at most
    ``distance`` bits (4 at most).

    Two fingerprints that differ in 4 bits differ in at most 2 of one half. For
    each half the table holds every fingerprint under all keys of the ball of
    radius 1 around its half, so two such fingerprints meet under a key between
    theirs. What meets is verified by complete distances. A key's fingerprints
    are read one after another from sorted rows, and a link set of fewer links
    than members leaves the task, never all pairs.
    """
    if distance > 4:
        raise ValueError("two halves with balls of radius 1 find distances up to 4")
    flips = F.explode(F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(_HALF))))
    low = F.lit((1 << _HALF) - 1).cast("long")
    halves = F.array(
        F.shiftrightunsigned("bits", _HALF).bitwiseAND(low), F.col("bits").bitwiseAND(low).bitwiseOR(F.lit(1 << _HALF))
    )
    keys = (
        distinct.select("bits", F.explode(halves).alias("half"))
        .select("bits", F.col("half"), flips.alias("flip"))
        .select(F.col("half").bitwiseXOR(F.col("flip")).alias("key"), "bits")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, bits = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def close(end: int) -> pa.RecordBatch:
            """Links among the first ``end`` rows, which hold whole groups."""
            starts = np.flatnonzero(np.diff(keys[:end], prepend=keys[0] - 1))
            sizes = np.diff(starts, append=end)
            found = []
            for start, size in zip(starts[sizes > 1], sizes[sizes > 1]):
                found += _forest(bits[start : start + size].view(np.uint64), distance)
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            bits = np.concatenate([bits, batch.column(1).to_numpy()])
            if len(keys) and (end := int(np.searchsorted(keys, keys[-1]))):
                yield close(end)
                keys, bits = keys[end:], bits[end:]
        if len(keys):
            yield close(len(keys))

    grouped = keys.repartition("key").sortWithinPartitions("key", "bits")
    return grouped.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``,
    the smallest id that links of at most ``distance`` bits lead to; a row per row.

    Equal fingerprints are one node whatever their number. Texts without words
    have fingerprint 0 and are linked like any other. Only ids and fingerprints
    are shuffled.
    """
    marked = saved(fingerprints(docs, width), "fingerprints")
    nodes = saved(marked.groupBy("bits").agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes.select("bits"), distance))
    rooted = nodes.join(roots, nodes["bits"] == roots["node"], "left").select(
        "bits", "first", F.coalesce("root", "bits").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("bits", "component_id")
    return marked.join(named, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


def row_key(docs: DataFrame) -> Column:
    """What tells rows of one id apart: the text and all columns."""
    return F.xxhash64(whole_text(), *(F.col(f"`{name}`") for name in docs.columns))


def one_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each ``group`` of ``groups`` the row of the least ``first`` (last,
    doc_id, row); rows that are equal in all columns are one row. Columns keep
    their values, whatever their names."""
    least = groups.groupBy("group").agg(F.min("first").alias("first"))
    kept = least.select(F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_kept"))
    rows = docs.select(F.struct("*").alias("doc"), row_key(docs).alias("row"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_kept"))
    chosen = rows.join(kept, same, "left_semi").select("doc", "row", F.col("doc.doc_id").alias("id"))
    return chosen.dropDuplicates(["id", "row"]).select("doc.*")


def drop_near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """The documents with one of each group of near duplicates, that of the smallest id.

    Rows without an id, or of one id, are judged by their texts like any other;
    missing ids come last.
    """
    read = docs.select(
        F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", row_key(docs).alias("row")).alias("doc_id"), "text"
    )
    marked = saved(fingerprints(read, width), "fingerprints")
    roots = components(links(marked.select("bits").distinct(), distance))
    rooted = marked.join(roots, marked["bits"] == roots["node"], "left")
    return one_each(docs, rooted.select(F.coalesce("root", "bits").alias("group"), F.col("doc_id").alias("first")))
