"""Packing of tokenised documents into sequences of a fixed size."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import saved, whole_text

SPECIAL = {"<|endoftext|>": 50256}
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Sequences of one task are numbered within a block of so many bits.
_NUMBER_BITS = 40


def encoder(ranks_path: str, pattern: str):
    """Ids of a text, as the JSON form of the same vocabulary gives them: the
    special string inside a text is its one id there."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return lambda text: own.encode(text, allowed_special="all")


def cut(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: only the first is short."""
    first = (total - 1) % size + 1
    return [(0, first), *((start, size) for start in range(first, total, size))]


def pieces(
    docs: DataFrame, ranks_path: str, pattern: str, size: int = 1024, end_id: int = 2
) -> DataFrame:
    """One row per piece of a document's ids, which end with ``end_id``.

    A missing text is an empty one and gives a piece of that one id. Only
    ``doc_id`` and ``text`` are read; repeated rows are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py()), end_id], "<u4")
                rows += (
                    (doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes()))
                    for k, (start, n) in enumerate(cut(len(ids), size))
                )
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, _PIECES)


def best_two_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of positions in ``lengths``, none over ``size``.

    Each bin takes the longest that fits again and again. If room is left, its
    smallest is replaced by the two unpacked ones that fill the room it leaves
    best, provided they fill more. Which lengths are left is one bit each.
    """
    left: list[list[int]] = [[] for _ in range(size + 1)]
    for position, length in enumerate(lengths):
        left[length].append(position)
    mask = sum(1 << n for n, held in enumerate(left) if held)
    bins = []

    def take(length: int) -> int:
        nonlocal mask
        position = left[length].pop()
        if not left[length]:
            mask ^= 1 << length
        return position

    def largest(limit: int) -> int:
        """The longest length left of at most ``limit``; -1 if there is none."""
        return (mask & ((2 << limit) - 1)).bit_length() - 1

    while mask:
        bin_, room, small = [], size, 0
        while (found := largest(room)) > 0:
            bin_.append(take(found))
            room, small = room - found, found
        if room:
            space, best = room + small, (small, 0, 0)
            a = largest(small - 1)
            while a > 0 and 2 * a > best[0] and best[0] < space:
                b = largest(min(a, space - a))
                if b == a and len(left[a]) < 2:
                    b = largest(a - 1)
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                a = largest(a - 1)
            if best[1]:
                again = bin_.pop()
                bin_ += [take(best[1]), take(best[2])]
                left[small].append(again)
                mask |= 1 << small
        bins.append(bin_)
    return bins


def pack(parts: DataFrame, size: int = 1024, task_rows: int = 16384) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, packed by best-two-fit.

    Pieces are dealt evenly, whatever their ids, to tasks of about
    ``task_rows``; each packs its own. A task leaves at most a few sequences
    that more pieces would have filled, out of thousands, so their share
    doesn't grow with the table. ``parts`` is read twice: save it first.
    """
    tasks = max(1, -(-parts.count() // task_rows))
    names = [f.name for f in parts.schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        lengths = rows["length"].tolist()
        first = TaskContext.get().partitionId() << _NUMBER_BITS
        sequence = np.zeros(len(rows), np.int64)
        offset = np.zeros(len(rows), np.int64)
        for number, bin_ in enumerate(best_two_fit(lengths, size)):
            at = 0
            for position in bin_:
                sequence[position], offset[position] = first + number, at
                at += lengths[position]
        yield rows[names].assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields)
    return parts.repartition(tasks).mapInPandas(run, schema + ", sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, ranks_path: str, pattern: str, size: int = 1024, end_id: int = 2
) -> DataFrame:
    """Documents cut into pieces of at most ``size`` ids and packed."""
    return pack(saved(pieces(docs, ranks_path, pattern, size, end_id), "pieces"), size)
