"""Exact search for the largest inner products, by ball trees per shard."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import saved

_EXACT = 2.0**53
_LONG = 2**63 - 1
#: Below every score.
_NONE = -(2**63)


class BallTree:
    """Balls around halves of halves of the rows, down to ``leaf`` rows.

    ``rows`` are integers, ``ids`` and ``numbers`` name them; all are kept in
    the order of the leaves, so that a ball is a slice.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray, numbers: np.ndarray, leaf: int = 64):
        self.most = max(map(abs, (int(rows.max(initial=0)), int(rows.min(initial=0)))))
        points = rows.astype(np.float64)
        order = np.arange(len(rows))
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left, right
        self.centers: list[np.ndarray] = []
        self.radii: list[float] = []
        self._grow(points, order, 0, len(rows), leaf)
        self.centers, self.radii = np.array(self.centers), np.array(self.radii)
        self.norms = np.sqrt((self.centers**2).sum(1))
        self.rows, self.ids, self.numbers = rows[order], ids[order], numbers[order]

    @classmethod
    def stored(cls, state: bytes) -> BallTree:
        """The tree whose ``state()`` was written."""
        tree = cls.__new__(cls)
        vars(tree).update(pickle.loads(state))
        return tree

    def state(self) -> bytes:
        return pickle.dumps(vars(self))

    def _grow(self, points: np.ndarray, order: np.ndarray, start: int, end: int, leaf: int) -> int:
        own = points[order[start:end]]
        center = own.mean(0)
        away = ((own - center) ** 2).sum(1)
        at = len(self.nodes)
        self.nodes.append((start, end, -1, -1))
        self.centers.append(center)
        self.radii.append(float(np.sqrt(away.max())))
        if end - start > leaf and away.max() > 0:
            one = own[away.argmax()]
            other = own[((own - one) ** 2).sum(1).argmax()]
            half = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own @ (other - one), half)]
            left = self._grow(points, order, start, start + half, leaf)
            right = self._grow(points, order, start + half, end, leaf)
            self.nodes[at] = (start, end, left, right)
        return at

    def bounds(self, query: np.ndarray, norm: float, nodes: list[int]) -> np.ndarray:
        """What no inner product in these balls exceeds, rounding allowed for."""
        return upper_bounds(self.centers[nodes], self.norms[nodes], self.radii[nodes], query, norm)

    def products(self, query: np.ndarray, start: int, end: int) -> np.ndarray:
        """Exact inner products of a slice, those beyond a long as its limit."""
        most = float(self.most) * float(np.abs(query.astype(np.float64)).max(initial=0)) * max(1, len(query))
        if most < _EXACT:
            return (self.rows[start:end].astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
        if most < float(2**62):
            return self.rows[start:end] @ query
        wide = self.rows[start:end].astype(object) @ query.astype(object)
        return np.array([min(max(int(p), -_LONG), _LONG) for p in wide], np.int64)


def upper_bounds(centers: np.ndarray, norms: np.ndarray, radii: np.ndarray, query: np.ndarray, norm: float):
    slack = 1e-9 * norm * (norms + radii) + 1e-6
    # Scores end at a long's limit, and so must what bounds them.
    return np.maximum(centers @ query + norm * radii + slack, -(2.0**62))


def search(tree: BallTree, query: np.ndarray, own: int, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best (score, id) of at least ``least``, ties to smaller ids;
    the row whose number is ``own`` is left out.

    The ball of the highest bound is opened next; the search ends below the kth
    score so far, which starts from the ``least`` that other shards know.
    """
    point = query.astype(np.float64)
    norm = float(np.sqrt((point**2).sum()))
    scores, found = np.zeros(0, np.int64), tree.ids[:0]
    heap = [(-float(tree.bounds(point, norm, [0])[0]), 0)]
    while heap and -heap[0][0] >= least:
        start, end, *children = tree.nodes[heapq.heappop(heap)[1]]
        if children[0] >= 0:
            for bound, child in zip(tree.bounds(point, norm, children), children):
                if float(bound) >= least:
                    heapq.heappush(heap, (-float(bound), child))
            continue
        products = tree.products(query, start, end)
        good = (products >= least) & (tree.numbers[start:end] != own)
        if good.any():
            scores = np.concatenate([scores, products[good]])
            found = np.concatenate([found, tree.ids[start:end][good]])
            # ~x falls as x rises, also at the least long, which has no negative.
            best = np.lexsort((found, ~scores))[:k]
            scores, found = scores[best], found[best]
            if len(scores) == k:
                least = max(least, int(scores[-1]))
    return scores, found


def _regions(sample: list[np.ndarray], leaves: int) -> list[tuple]:
    """Halves of halves of a sample: (direction, cut, left, right) per split, or
    (region,) per leaf. Which region a vector is in only decides what is
    searched first, never what is found."""
    nodes: list[tuple] = []
    regions = 0

    def grow(points: np.ndarray, wanted: int) -> int:
        nonlocal regions
        at = len(nodes)
        nodes.append(())
        away = ((points - points.mean(0)) ** 2).sum(1) if len(points) else np.zeros(0)
        if wanted < 2 or len(points) < 2 or not 0 < away.max() < float("inf"):
            nodes[at] = (regions,)
            regions += 1
            return at
        one = points[away.argmax()]
        other = points[((points - one) ** 2).sum(1).argmax()]
        across = points @ (other - one)
        cut = float(np.median(across))
        low = across < cut
        if not low.any():
            cut = float(across.max())
            low = across < cut
        if not low.any():
            nodes[at] = (regions,)
            regions += 1
            return at
        nodes[at] = (other - one, cut, grow(points[low], wanted // 2), grow(points[~low], wanted - wanted // 2))
        return at

    grow(np.stack(sample).astype(np.float64), leaves)
    return nodes


def _region(nodes: list[tuple], point: np.ndarray) -> int:
    at = 0
    while len(nodes[at]) > 1:
        direction, cut, left, right = nodes[at]
        at = left if float(point @ direction) < cut else right
    return nodes[at][0]


def _with_regions(table: DataFrame, leaves: int, sample_rows: int) -> DataFrame:
    """Adds ``size`` (of the vector) and ``region``; ``region`` is 0 for sizes
    that are not in the sample."""
    by_size: dict[int, list[np.ndarray]] = {}
    for row in table.select("vector").orderBy(F.xxhash64("number")).limit(sample_rows).collect():
        by_size.setdefault(len(row["vector"]), []).append(np.array(row["vector"], np.float64))
    trees = {size: _regions(sample, leaves) for size, sample in by_size.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            points = [np.asarray(v, np.float64) for v in batch["vector"]]
            yield batch.assign(
                size=[len(p) for p in points],
                region=[_region(trees[len(p)], p) if len(p) in trees else 0 for p in points],
            )

    return table.mapInPandas(run, table.schema.simpleString()[7:-1] + ",size:long,region:long")


def top_k(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    scale: int = 1024,
    shard_rows: int = 8192,
    block_rows: int = 8192,
    least_shards: int = 8,
    sample_rows: int = 8192,
    first_shards: int = 4,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of each query's ``k`` best.

    Vectors (vec_id, embedding) become integers ``floor(scale * x)``; a vector
    that is missing or holds a missing, infinite or undefined component takes no
    part, nor does one without an id. Queries are the rows whose id is
    divisible by ``every``, each row a query of its own, also where rows share
    an id; every row but the query's own is a candidate, if its vector is as
    long. Scores beyond a long count as its limit.

    Rows near each other share a shard: regions are cut by a sample of
    ``sample_rows`` rows, every row is put in its region, and a region of more
    than ``shard_rows`` is dealt out over several shards. Each shard's tree is
    built once and written. Queries then search in three waves, each knowing
    the kth score of those before: their own shard, the ``first_shards`` of
    the highest bounds, and all others whose root ball reaches the kth score.
    Only those pairs of query and shard are shuffled. A task holds one shard
    and one block of queries.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    table = saved(
        vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .filter(whole)
        .select(F.monotonically_increasing_id().alias("number"), F.col("vec_id").cast("long"), scaled.alias("vector")),
        "vectors",
    )
    wanted = max(least_shards, -(-table.count() // shard_rows))
    regions = saved(_with_regions(table, min(wanted, max(1, sample_rows // 8)), sample_rows), "regions")
    # Full regions are dealt out, rows by hashes of their numbers.
    held = saved(
        regions.groupBy("size", "region").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("deals")), "region_sizes"
    )
    deal = F.pmod(F.xxhash64("number"), F.col("deals"))
    shard = F.concat_ws("-", "size", "region", deal).alias("shard")
    sharded = regions.join(held, ["size", "region"]).select("number", "vec_id", "vector", "size", shard)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(group["vector"].to_list()).astype(np.int64)
        tree = BallTree(rows, group["vec_id"].to_numpy(), group["number"].to_numpy())
        return pd.DataFrame({
            "shard": [group["shard"].iloc[0]], "size": [rows.shape[1]], "center": [tree.centers[0]],
            "radius": [tree.radii[0]], "tree": [tree.state()],
        })

    trees = saved(
        sharded.groupBy("shard").applyInPandas(
            build, "shard string, size long, center array<double>, radius double, tree binary"
        ),
        "trees",
    )
    queries = saved(
        sharded.filter(F.col("vec_id") % every == 0).select(
            F.col("number").alias("query"), F.col("vec_id").alias("query_id"), "vector", "size", "shard"
        ),
        "queries",
    )
    result = "query long, query_id long, vec_id long, score long"

    def look(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype=np.int64)]
        if len(trees) and len(asked):
            tree = BallTree.stored(trees["tree"].iloc[0])
            for own, name, vector, least in zip(asked["query"], asked["query_id"], asked["vector"], asked["least"]):
                scores, found = search(tree, np.asarray(vector, np.int64), own, k, int(least))
                out.append(pd.DataFrame({"query": own, "query_id": name, "vec_id": found, "score": scores}))
        return pd.concat(out[1:] or out)

    def searched(pairs: DataFrame, known: DataFrame | None, purpose: str) -> DataFrame:
        """The best so far, with what the queries find in the shards of ``pairs``."""
        blocks = pairs.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
        asked = saved(pairs.join(blocks, "shard"), purpose)
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")))
        needed = asked.select("shard", F.col("block").alias("of")).distinct()
        needed = needed.join(trees.select("shard", "tree"), "shard").select(F.col("shard").alias("at"), "of", "tree")
        found = needed.groupBy("at", "of").cogroup(asked.groupBy("shard", "block")).applyInPandas(look, result)
        every_row = found if known is None else found.unionByName(known.select(*found.columns))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        best = every_row.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return saved(best, purpose + "_best")

    def with_least(pairs: DataFrame, best: DataFrame) -> DataFrame:
        kth = best.filter(F.col("rank") == k).select("query", F.col("score").alias("least"))
        return pairs.join(kth, "query", "left").withColumn("least", F.coalesce("least", F.lit(_NONE)))

    own = queries.withColumn("least", F.lit(_NONE).cast("long"))
    best = searched(own, None, "wave1")

    # Root balls meet the queries in blocks of bounded size, not one by one.
    roots = trees.select("shard", "size", "center", "radius")
    parts = max(1, -(-roots.count() // 1024))
    roots = roots.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(parts)))
    salts = max(1, -(-queries.count() // block_rows))
    roots = roots.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    spread = with_least(queries, best).withColumn("salt", F.pmod(F.xxhash64("query"), F.lit(salts)))
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def reach(roots: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": np.zeros(0, np.int64), "shard": np.zeros(0, object), "bound": np.zeros(0)})]
        for size, balls in roots.groupby("size"):
            centers = np.stack(balls["center"].to_list())
            norms, radii = np.sqrt((centers**2).sum(1)), balls["radius"].to_numpy()
            names = balls["shard"].to_numpy()
            mine = asked[asked["size"] == size]
            for own, vector, home, least in zip(mine["query"], mine["vector"], mine["shard"], mine["least"]):
                point = np.asarray(vector, np.float64)
                bound = upper_bounds(centers, norms, radii, point, float(np.sqrt((point**2).sum())))
                good = np.array([float(b) >= least for b in bound], bool) & (names != home)
                out.append(pd.DataFrame({"query": own, "shard": names[good], "bound": bound[good]}))
        return pd.concat(out[1:] or out)

    reached = (
        roots.groupBy("part", "salt")
        .cogroup(spread.groupBy("part", "salt"))
        .applyInPandas(reach, "query long, shard string, bound double")
    )
    in_turn = Window.partitionBy("query").orderBy(F.desc("bound"), "shard")
    reached = saved(reached.withColumn("turn", F.row_number().over(in_turn)), "reached")
    asking = queries.drop("shard")
    first = reached.filter(F.col("turn") <= first_shards).join(asking, "query")
    best = searched(with_least(first, best), best, "wave2")
    rest = with_least(reached.filter(F.col("turn") > first_shards), best)
    rest = rest.filter(F.col("bound") >= F.col("least").cast("double")).join(asking, "query")
    best = searched(rest, best, "wave3")
    return best.select("query_id", "rank", "vec_id", "score")


#: The same result in the checking database's SQL, rows told apart by number.
SQL = """
WITH whole AS (
  SELECT row_number() OVER () AS number, vec_id,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS MATERIALIZED (SELECT * FROM whole),
scored AS (
  SELECT q.number, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM kept q JOIN kept c ON q.vec_id % 100 = 0 AND c.number <> q.number)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10"""
