"""Short codes of vectors by dual-tree Lloyd rounds over their parts.

Vectors are dealt into shards of at most 2,048. In a shard the parts of each
position are ordered once so that every half, half of a half, ... divides them
along their widest side: a tree without nodes of its own, saved with the shard.
A round walks that tree and a tree over the codebook's entries together. Bounds
on the squared distances of two boxes, which are whole numbers like all else
here, drop the entries that can be nearest to nothing in a box; a box with one
entry left adds its cached sum and count as a whole, and in a last box that
isn't certain the parts are measured one by one. Sums add up on Spark, so each
round gives exactly what plain Lloyd gives.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
_SHARD = 2048
_LEAF = 32


@lru_cache(maxsize=4096)
def _halves(n: int, leaf: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``low``, ``high`` and the first child (-1 for a leaf; the second is the
    next) of the ranges that halving 0 to ``n`` down to ``leaf`` gives, parents first."""
    low, high, child, at = [0], [n], [], 0
    while at < len(low):
        middle = (low[at] + high[at]) // 2
        child.append(len(low) if high[at] - low[at] > leaf else -1)
        if child[-1] > 0:
            low += [low[at], middle]
            high += [middle, high[at]]
        at += 1
    return np.array(low), np.array(high), np.array(child)


def _ordered(values: np.ndarray, leaf: int) -> np.ndarray:
    """An order of the rows in which every range of :func:`_halves` is divided at
    the median of its widest column."""
    order = np.arange(len(values))
    if values.shape[1]:
        for low, high, child in zip(*_halves(len(values), leaf)):
            if child > 0:
                own = values[order[low:high]]
                side = own[:, int(np.argmax(np.ptp(own, axis=0)))]
                order[low:high] = order[low:high][np.argpartition(side, (high - low) // 2)]
    return order


class _Tree:
    """Ranges of ordered rows with their boxes and sums."""

    def __init__(self, values: np.ndarray, leaf: int):
        self.values = values
        self.low, self.high, self.child = _halves(len(values), leaf)
        shape = (len(self.low), values.shape[1])
        self.least, self.most, self.sums = (np.empty(shape, np.int64) for _ in range(3))
        ends = np.flatnonzero(self.child < 0)
        ends = ends[np.argsort(self.low[ends])]
        for into, how in ((self.least, np.minimum), (self.most, np.maximum), (self.sums, np.add)):
            into[ends] = how.reduceat(values, self.low[ends], axis=0)
            for node in np.flatnonzero(self.child > 0)[::-1].tolist():
                into[node] = how(into[self.child[node]], into[self.child[node] + 1])


class Codebook:
    """The entries of one position, as a tree; of equal entries the first counts."""

    def __init__(self, entries: np.ndarray):
        _, first = np.unique(entries, axis=0, return_index=True)
        first = np.sort(first)
        order = _ordered(entries[first], 1)
        self.entries, self.index = entries, first[order]
        self.tree = _Tree(entries[self.index], 1)


def nearest(points: _Tree, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of ``points`` the index of the nearest entry (ties: the
    least), and per entry the sum and number of its rows."""
    entries = book.tree
    chosen = np.zeros(len(points.values), np.int64)
    sums = np.zeros(book.entries.shape, np.int64)
    counts = np.zeros(len(book.entries), np.int64)
    p, e = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(p):
        over, under = entries.least[e] - points.most[p], points.least[p] - entries.most[e]
        closest = (np.maximum(np.maximum(over, under), 0) ** 2).sum(1)
        farthest = (np.maximum(points.most[p] - entries.least[e], entries.most[e] - points.least[p]) ** 2).sum(1)
        starts = np.flatnonzero(np.diff(p, prepend=-1))
        bound = np.repeat(np.minimum.reduceat(farthest, starts), np.diff(starts, append=len(p)))
        p, e = p[closest <= bound], e[closest <= bound]
        starts = np.flatnonzero(np.diff(p, prepend=-1))
        sizes = np.diff(starts, append=len(p))
        inner = np.add.reduceat(entries.child[e] > 0, starts, dtype=np.int64)
        nodes = p[starts]
        whole = (sizes == 1) & (inner == 0)
        for node, entry in zip(nodes[whole].tolist(), book.index[entries.low[e[starts[whole]]]].tolist()):
            chosen[points.low[node] : points.high[node]] = entry
            sums[entry] += points.sums[node]
            counts[entry] += points.high[node] - points.low[node]
        unsure = ~whole & (inner == 0) & (points.child[nodes] < 0)
        for node, start, size in zip(nodes[unsure].tolist(), starts[unsure].tolist(), sizes[unsure].tolist()):
            own = points.values[points.low[node] : points.high[node]]
            index = np.sort(book.index[entries.low[e[start : start + size]]])
            other = book.entries[index]
            found = index[np.argmin((other**2).sum(1) - 2 * (own @ other.T), axis=1)]
            chosen[points.low[node] : points.high[node]] = found
            np.add.at(sums, found, own)
            np.add.at(counts, found, 1)
        open_ = np.repeat(~whole & ~unsure, sizes)
        p, e = p[open_], e[open_]
        for tree, of_points in ((entries, False), (points, True)):
            child = tree.child[p if of_points else e]
            split = child > 0
            both = np.where(split, child, p if of_points else e)
            again = child[split] + 1
            p, e = (
                (np.concatenate([both, again]), np.concatenate([e, e[split]]))
                if of_points
                else (np.concatenate([p, p[split]]), np.concatenate([both, again]))
            )
        sort = np.argsort(p, kind="stable")
        p, e = p[sort], e[sort]
    return chosen, sums, counts


def _whole(vector: str) -> Column:
    """Whether a vector is there, with finite components only."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & fine


def _integers(vectors: list, width: int) -> np.ndarray:
    """Components in whole steps of 1 / SCALE, filled up with zeros. One that is
    out of the range in which squared distances stay longs counts as its limit."""
    limit = math.isqrt((1 << 62) // max(1, width // PARTS)) // 2
    made = np.zeros((len(vectors), width), np.int64)
    for row, vector in zip(made, vectors):
        with np.errstate(over="ignore"):
            row[: len(vector)] = np.clip(np.floor(SCALE * np.asarray(vector, np.float64)), -limit, limit)
    return made


def _shards(kept: DataFrame, width: int) -> DataFrame:
    """Rows ``ids``, ``labels``, ``vectors`` and ``orders`` (per position)."""
    label = kept.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(rows: pa.Table) -> pa.RecordBatch:
            values = _integers(rows.column(2).to_pylist(), width)
            orders = [_ordered(part, _LEAF) for part in np.split(values, PARTS, axis=1)]
            columns = [
                pa.array([rows.column(0).to_pylist()], pa.list_(pa.int64())),
                pa.array([rows.column(1).to_pylist()], pa.list_(rows.column(1).type)),
                pa.array([values.tobytes()], pa.binary()),
                pa.array([np.array(orders, np.int16).tobytes()], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "labels", "vectors", "orders"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _SHARD:
                table, held = pa.Table.from_batches(held), []
                while table.num_rows >= _SHARD:
                    yield made(table.slice(0, _SHARD))
                    table = table.slice(_SHARD)
                held = table.to_batches()
        if sum(b.num_rows for b in held):
            yield made(pa.Table.from_batches(held))

    schema = f"ids array<long>, labels array<{label}>, vectors binary, orders binary"
    return kept.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def _positions(vectors: bytes, orders: bytes, width: int, n: int) -> Iterator[tuple[np.ndarray, _Tree]]:
    """Order and tree of each position of a shard."""
    values = np.frombuffer(vectors, np.int64).reshape(n, width)
    for order, part in zip(np.frombuffer(orders, np.int16).reshape(PARTS, n), np.split(values, PARTS, axis=1)):
        yield order, _Tree(part[order], _LEAF)


def _moved(shards: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after a round. What reaches the driver is a row per entry
    and component, ``ENTRIES`` times the vectors' width at most."""
    if not width or not len(books[0]):
        return books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Codebook(book) for book in books]
        sums, counts = np.zeros((PARTS, *books[0].shape), np.int64), np.zeros((PARTS, len(books[0])), np.int64)
        for batch in batches:
            for n, vectors, orders in zip(*(c.to_pylist() for c in batch.columns)):
                for part, (_, tree) in enumerate(_positions(vectors, orders, width, n)):
                    _, more, times = nearest(tree, trees[part])
                    sums[part] += more
                    counts[part] += times
        part, entry = np.nonzero(counts)
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64())]
        columns.append(pa.array(list(sums[part, entry]), pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    placed = shards.select(F.size("ids"), "vectors", "orders").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = (
        placed.select("part", "entry", "n", F.posexplode("sums").alias("at", "value"))
        .groupBy("part", "entry", "at")
        .agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    )
    moved = [book.copy() for book in books]
    for row in totals.collect():
        moved[row["part"]][row["entry"], row["at"]] = row["value"] // row["n"]
    return moved


def _coded(shards: DataFrame, books: list[np.ndarray], width: int, label: str) -> DataFrame:
    """``vec_id``, ``label``, ``code`` and ``error`` by these codebooks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Codebook(book) for book in books if len(book)]
        for batch in batches:
            for ids, labels, vectors, orders in zip(batch.column(0), batch.column(1), *(c.to_pylist() for c in batch.columns[2:])):
                n = len(ids)
                codes, error = np.zeros((n, PARTS), np.uint8), np.zeros(n, np.int64)
                for part, (order, tree) in enumerate(_positions(vectors, orders, width, n)):
                    chosen, _, _ = nearest(tree, trees[part])
                    codes[order, part] = chosen
                    error[order] += ((tree.values - books[part][chosen]) ** 2).sum(1)
                columns = [ids.values, labels.values, pa.array([row.tobytes().hex() for row in codes]), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error"])

    schema = f"vec_id long, label {label}, code string, error long"
    return shards.select("ids", "labels", "vectors", "orders").mapInArrow(run, schema)


def compress_vectors(table: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``table`` (vec_id, embedding, label) with a whole vector:
    ``vec_id``, ``code`` (an entry's number per part, two hexadecimal digits each),
    ``error`` (squared distances of the parts to their entries), ``label_error``
    (summed over equal labels, nulls together) and ``codebooks_sha256``.

    Vectors that are missing or hold missing or infinite components take no part.
    Components count as whole steps of 1 / 1024, rounded down. The first entries
    are the parts of the 256 vectors of the smallest ids (ties: the smaller
    vector; missing ids last); with fewer vectors there are fewer. Shorter
    vectors, and a length that four doesn't divide, are filled up with zeros.
    Repeated rows count each. An empty table gives no rows. Other columns are
    not read. The driver holds the codebooks alone.
    """
    kept = table.filter(_whole("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("embedding")
    )
    width = -(-(kept.agg(F.max(F.size("embedding"))).first()[0] or 0) // PARTS) * PARTS
    first = kept.orderBy(F.col("vec_id").isNull(), "vec_id", "embedding").limit(ENTRIES).select("embedding").collect()
    label = kept.schema["label"].dataType.simpleString()
    shards = saved(_shards(kept, width), "shards")
    books = [part.copy() for part in np.split(_integers([r[0] for r in first], width), PARTS, axis=1)]
    for _ in range(rounds):
        books = _moved(shards, books, width)
    listed = ",".join(str(x) for book in books for x in book.ravel().tolist())
    coded = saved(_coded(shards, books, width, label), "codes")
    # Written first, so that a label with very many rows can be split in the join.
    totals = saved(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256")
    )
