"""Near duplicates by exact similarity of shingle sets. Candidates are what SimHash
fingerprints link by multi-index hashing, and what shares a MinHash band."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from .common import saved, whole_text
from .components import components
from .simhash import fingerprint, links, one_each, row_key, shingles

BANDS, ROWS = 24, 5
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 4096
#: Hashes and members of a tile, of which each counts as so many hashes.
_TILE, _MEMBER = 1 << 17, 256


def shingle_set(text: str, width: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted."""
    grams = set(shingles(text, width))
    return np.unique(np.frombuffer(b"".join([xxh64_digest(gram) for gram in grams]), ">u8").astype(np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A key per band, of the least of ``ROWS`` permuted hashes each; none without any."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _STEP):
        np.minimum(least, (hashes[at : at + _STEP, None] * _FACTORS).min(0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return [xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(rows)]


def _marked(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``row``, ``node`` (a digest of the set), ``n``, ``keys`` and ``bits`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sets = [shingle_set(text, width) for text in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:2],
                    pa.array([xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
                    pa.array([fingerprint(text, width) for text in texts], pa.int64()),
                ],
                names=["doc_id", "row", "node", "n", "keys", "bits"],
            )

    read = docs.select("doc_id", row_key(docs).alias("row"), whole_text().alias("text"))
    return read.mapInArrow(run, "doc_id long, row long, node long, n long, keys array<long>, bits long")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``node`` and ``hashes`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), width) for text in batch.column(1)]
            hashes = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), hashes], names=["node", "hashes"])

    return docs.select("node", whole_text().alias("text")).mapInArrow(run, "node long, hashes array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets share ``percent`` of their union at least."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("of_b"))
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return pairs.join(left, "a").join(right, "b").filter(100 * common >= percent * union).select("a", "b")


def _linked(
    nodes: np.ndarray, roots: np.ndarray, second: np.ndarray, sets: list[np.ndarray], percent: int
) -> Iterator[tuple[int, int]]:
    """Links that join the parts (``roots``) of which members are similar: of the
    members of one tile with each other, or of two tiles with one another.

    What members have in common is counted for all of them at once, by products
    of matrices of the hashes that several have, some columns at a time.
    """
    sizes = np.array([len(own) for own in sets], np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1
    order = np.argsort(column[shared], kind="stable")
    row, column = row[shared][order], column[shared][order]
    left, right = (np.flatnonzero(~second), np.flatnonzero(second)) if second.any() else (np.arange(len(sets)),) * 2
    common = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _STEP):
        part = slice(*np.searchsorted(column, (at, at + _STEP)))
        has = np.zeros((len(sets), _STEP), np.float32)
        has[row[part], column[part] - at] = 1
        common += has[left] @ has[right].T
    similar = 100 * common.astype(np.int64) >= percent * (sizes[left][:, None] + sizes[right][None] - common.astype(np.int64))
    similar &= roots[left][:, None] != roots[right][None]
    a, b = (side[found] for side, found in zip((left, right), np.nonzero(similar)))
    parts = np.sort(np.stack([roots[a], roots[b]], axis=1), axis=1)
    _, first = np.unique(parts, axis=0, return_index=True)
    above: dict[int, int] = {}

    def top(root: int) -> int:
        while root in above:
            root = above[root]
        return root

    for i in first.tolist():
        one, other = top(int(parts[i, 0])), top(int(parts[i, 1]))
        if one != other:
            above[other] = one
            yield int(nodes[a[i]]), int(nodes[b[i]])


def _tile_links(placed: DataFrame, percent: int) -> DataFrame:
    """Links within each group (key, one, two) of ``placed``, whose rows are members of its two tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []

        def close() -> pa.RecordBatch:
            nodes, roots, second = (np.array([r[k] for r in held]) for k in range(3))
            links = list(_linked(nodes, roots, second, [r[3] for r in held], percent)) if len(held) > 1 else []
            a, b = zip(*links) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            *keys, node, root, second = (batch.column(i).to_pylist() for i in range(6))
            for at, key in enumerate(zip(*keys)):
                if key != group and held:
                    yield close()
                    held = []
                group = key
                held.append((node[at], root[at], second[at], batch.column(6)[at].values.to_numpy()))
        if held:
            yield close()

    groups = ["key", "one", "two"]
    rows = placed.select(*groups, "node", "root", "second", "hashes")
    rows = rows.repartition(*groups).sortWithinPartitions(*groups)
    return rows.mapInArrow(run, "a long, b long").distinct()


def similar_links(nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a``, ``b`` of ``nodes`` whose paths join all that share a key and
    are similar.

    Every member of a key is held against the key's leader first, which settles
    dense groups with a pair per member. Where a key's members are still in
    several parts, those outside its largest part are held against all members
    of other parts, so that no two members of different parts stay untested.
    They are dealt into tiles of bounded size and compared tile by tile within
    tasks; a row is a member of a pair of tiles, never a pair of members, and
    only links that join parts leave a task. Sizes that can't reach the
    similarity are no pairs.
    """
    placed = saved(nodes.select("node", "n", F.explode("keys").alias("key")), "band-keys")
    mixed = F.xxhash64("key", "node")
    repeated = saved(
        placed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(mixed.alias("at"), "node", "n")).alias("leader"))
        .filter("times > 1")
        .select("key", "leader"),
        "band-leaders",
    )
    members = saved(placed.join(repeated, "key"), "members")

    def able(one: Column | str, other: Column | str) -> Column:
        return 100 * F.least(one, other) >= percent * F.greatest(one, other)

    wanted = members.select("node").distinct()
    first = nodes.join(wanted, "node", "left_semi").select("node", "first.doc_id", "first.row")
    first = first.select("node", F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    read = docs.select("doc_id", row_key(docs).alias("row"), "text")
    chosen = read.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
    sets = saved(_sets(chosen, width).dropDuplicates(["node"]), "sets")

    led = members.filter((F.col("node") != F.col("leader.node")) & able("n", F.col("leader.n")))
    tested = saved(led.select(F.col("node").alias("a"), F.col("leader.node").alias("b")).distinct(), "led")
    links = saved(_similar(tested, sets, percent), "led-links")

    roots = components(links)
    named = members.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    named = saved(named, "parts")
    parts = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("n") + _MEMBER).alias("weight"))
    weight = F.col("most.weight")
    divided = saved(
        parts.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.max(F.struct("size", "root", "weight")).alias("most"),
            F.sum("weight").alias("weight"),
        )
        .filter("parts > 1")
        .select(
            "key",
            F.col("most.root").alias("most"),
            F.ceil((F.col("weight") - weight) / _TILE).alias("outer"),
            F.ceil(weight / _TILE).alias("inner"),
        ),
        "divided",
    )
    mixed = F.xxhash64("node", F.lit(1))
    outside = F.col("root") != F.col("most")
    tile = F.when(outside, F.pmod(mixed, "outer")).otherwise(F.col("outer") + F.pmod(mixed, "inner"))
    # The largest part's tiles are held against the others only.
    last = F.when(outside, F.col("outer") + F.col("inner")).otherwise(F.col("outer")) - 1
    tiles = named.join(divided, "key").select("key", "node", "root", tile.alias("tile"), last.alias("last"))
    tiles = saved(tiles, "tiles").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    both = tiles.select(
        "key",
        F.least("tile", "other").alias("one"),
        F.greatest("tile", "other").alias("two"),
        "node",
        "root",
        (F.col("tile") > F.col("other")).alias("second"),
    )
    return links.unionAll(_tile_links(both.join(sets, "node"), percent))


def _fingerprint_keys(marked: DataFrame) -> DataFrame:
    """``node`` and ``near``, a key that all nodes share whose fingerprints are
    joined by paths of links, as ``op4_simhash`` joins them. A node has the
    fingerprints of all its texts; one without words has none."""
    marks = saved(marked.filter("n > 0").select("node", "bits").distinct(), "marks")
    roots = components(links(marks.select("bits").distinct())).withColumnRenamed("node", "_bits")
    rooted = marks.join(roots, F.col("bits") == F.col("_bits"), "left")
    near = F.collect_set(F.xxhash64(F.coalesce("root", "bits"), F.lit("near")))
    return rooted.groupBy("node").agg(near.alias("near"))


def drop_similar(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group of near duplicates, that of the smallest id.

    Two texts are near duplicates if their sets of ``width``-word shingles share
    ``percent`` of their union at least, and a group is what paths of such pairs
    join. Held against each other are texts that SimHash links join, fingerprints
    of the same shingles that differ in 4 bits at most, and those that share a
    MinHash band, as at 80 % fingerprints mostly differ in more. A pair of exactly
    80 % meets under one of the bands with probability 0.9999; similarity itself
    is exact. A row is known by its id and columns, so
    rows without an id, or of one id, are judged by their texts like any other;
    missing ids come last. Texts aren't shuffled but to drop rows that are equal
    in all columns.
    """
    marked = saved(_marked(docs, width), "marked")
    nodes = saved(
        marked.groupBy("node").agg(
            F.min("n").alias("n"),
            F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"),
            F.first("keys").alias("keys"),
        )
        .join(_fingerprint_keys(marked), "node", "left")
        .withColumn("keys", F.concat("keys", F.coalesce("near", F.array().cast("array<long>"))))
        .drop("near"),
        "nodes",
    )
    roots = components(similar_links(nodes, docs, width, percent))
    rooted = nodes.join(roots, "node", "left").select(F.coalesce("root", "node").alias("group"), "first")
    return one_each(docs, rooted)
