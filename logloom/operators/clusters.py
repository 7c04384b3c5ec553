"""Grouping error messages by the words they use.

All starts of K-means run at once: a round is one pass over the points that
meets the centroids of every start that still moves. Points and centroids are
whole numbers, and so are sums and costs, so labels don't hang on how rows are
dealt to tasks, and SQL can follow a round to the digit.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from ..functions.predicates import is_error
from .phrases import stop_words, words

# Executors need not have this package: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rounds at most.
ROUNDS = 300
#: A start rests when its centroids move by less than this share of the mean variance.
TOLERANCE = 1e-4
#: Distinct messages, by the least hashes, that first centroids are drawn from.
SEED_MESSAGES = 2048
#: A message is a vector of about this length, an IDF weight a multiple of 1 / IDF_UNIT.
LENGTH = 1 << 15
IDF_UNIT = 1 << 10
#: Rows that are made dense at a time: products of a slice stay exact in doubles.
_SLICE = 1024
#: Words that are looked up at a time.
_PIECE = 1 << 18
_LOW_BITS = 20

CLUSTER_SCHEMA = T.StructType(
    [T.StructField("message", T.StringType()), T.StructField("cluster", T.IntegerType())]
)


@dataclass(frozen=True)
class ClusterModel:
    """What labels messages: the words, their weights and a row per cluster."""

    words: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    cost: int
    rounds: int


def _vocabulary(tokenised: DataFrame, size: int) -> list:
    """The most frequent words, and the weight of messages that hold each."""
    in_order = tokenised.select(F.sort_array("tokens").alias("tokens"), "weight")
    marked = F.transform(
        "tokens",
        lambda word, i: F.struct(
            word.alias("word"),
            # In sorted order a word's first place differs from the one before.
            F.coalesce(word != F.get("tokens", i - 1), F.lit(True)).alias("first"),
        ),
    )
    return (
        in_order.select(F.inline(marked), "weight")
        .groupBy("word")
        .agg(
            F.sum("weight").alias("tf"),
            F.sum(F.when(F.col("first"), F.col("weight"))).alias("df"),
        )
        .orderBy(F.desc("tf"), F.asc("word"))
        .limit(size)
        .collect()
    )


def _slices(tokens: pa.ListArray, vocabulary: pa.Array, idf: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The vectors of messages, some rows at a time, each with its first row's place.

    Words are looked up in pieces, wherever messages end: what is held beside a
    batch doesn't grow with the length of its messages.
    """
    size = len(idf)
    for start in range(0, len(tokens), _SLICE):
        part = tokens.slice(start, _SLICE)
        every = part.flatten()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(part).to_numpy(zero_copy_only=False))])
        counts = np.zeros(len(part) * size, np.int64)
        for first in range(0, len(every), _PIECE):
            piece = every.slice(first, _PIECE)
            place = pc.fill_null(pc.index_in(piece, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(part)), np.diff(np.clip(ends, first, first + len(piece))))
            counts += np.bincount((row * size + place)[place >= 0], minlength=len(counts))
        raw = counts.reshape(len(part), size) * idf.astype(float)
        norm = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        raw *= LENGTH
        raw /= np.where(norm > 0, norm, 1)
        yield start, np.floor(raw, out=raw)


def _make_points(distinct: DataFrame, names: list[str], idf: np.ndarray) -> DataFrame:
    """Distinct messages as sparse vectors: ``key``, ``weight``, ``places``, ``values``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(names)
        for batch in batches:
            for start, dense in _slices(batch.column("tokens"), vocabulary, idf):
                row, place = np.nonzero(dense)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(dense)))])
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(start, len(dense)),
                        batch.column("weight").slice(start, len(dense)),
                        pa.ListArray.from_arrays(offsets, pa.array(place, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(dense[row, place].astype(np.int32))),
                    ],
                    names=["key", "weight", "places", "values"],
                )

    schema = "key long, weight long, places array<int>, values array<int>"
    return distinct.select("key", "weight", "tokens").mapInArrow(run, schema)


def _dense(places: pa.ListArray, values: pa.ListArray, size: int) -> np.ndarray:
    dense = np.zeros((len(places), size))
    row = np.repeat(np.arange(len(places)), pc.list_value_length(places).to_numpy(zero_copy_only=False))
    dense[row, places.flatten().to_numpy()] = values.flatten().to_numpy()
    return dense


def _nearest(dense: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels and squared distances (rows x starts) to centroids of (starts, k, words).

    All products are whole numbers that doubles hold exactly, in any order.
    """
    starts, k, size = centroids.shape
    flat = centroids.reshape(-1, size).astype(float)
    beside = (flat * flat).sum(axis=1) - 2 * (dense @ flat.T)
    beside = beside.reshape(len(dense), starts, k)
    label = beside.argmin(axis=2)
    least = np.take_along_axis(beside, label[:, :, None], axis=2)[:, :, 0]
    return label, (least + (dense * dense).sum(axis=1, keepdims=True)).astype(np.int64)


def _pass(points: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Sums (starts, k, words) and weights (starts, k) of what each centroid is
    nearest to, and the cost of each start.

    A task hands on one row per centroid, whatever it has read; the driver gets
    as many rows as there are centroids, with at most ``max_features`` numbers each.
    """
    starts, k, size = centroids.shape
    schema = "slot int, weight long, cost string, sums binary"

    def rows(weights, costs, sums) -> Iterator[pa.RecordBatch]:
        for slot in sums:
            yield pa.RecordBatch.from_pylist(
                [{"slot": slot, "weight": weights[slot], "cost": str(costs[slot]), "sums": sums[slot].tobytes()}],
                pa.schema([("slot", pa.int32()), ("weight", pa.int64()), ("cost", pa.string()), ("sums", pa.binary())]),
            )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((starts * k, size), np.int64)
        weights = np.zeros(starts * k, np.int64)
        costs = [0] * (starts * k)
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                dense = _dense(batch.column("places"), batch.column("values"), size)
                weight = batch.column("weight").to_numpy()
                label, distance = _nearest(dense, centroids)
                at = (label + np.arange(starts) * k).T
                row = np.arange(len(dense))
                # Weights in two parts: neither a slice's sums nor its costs leave the whole numbers.
                for shift, share in ((0, weight & ((1 << _LOW_BITS) - 1)), (_LOW_BITS, weight >> _LOW_BITS)):
                    if not share.any():
                        continue
                    member = np.zeros((starts * k, len(dense)))
                    member[at, row] = share
                    sums += (member @ dense).astype(np.int64) << shift
                    weights += member.sum(axis=1).astype(np.int64) << shift
                    for s in range(starts):
                        costs[s * k] += int(distance[:, s] @ share) << shift
        yield from rows(weights.tolist(), costs, dict(enumerate(sums)))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        weights: dict[int, int] = {}
        costs: dict[int, int] = {}
        for batch in batches:
            slots, shares, parts = (batch.column(n).to_pylist() for n in ("slot", "weight", "cost"))
            for slot, weight, cost, summed in zip(slots, shares, parts, batch.column("sums")):
                # A view of the batch: sums aren't copied before they are added.
                sums[slot] = sums.get(slot, 0) + np.frombuffer(summed.as_buffer(), np.int64)
                weights[slot] = weights.get(slot, 0) + weight
                costs[slot] = costs.get(slot, 0) + int(cost)
        yield from rows(weights, costs, sums)

    done = points.mapInArrow(partial, schema).repartition("slot").mapInArrow(total, schema).collect()
    sums = np.zeros((starts * k, size), np.int64)
    weights = np.zeros(starts * k, np.int64)
    costs = [0] * (starts * k)
    for r in done:
        sums[r["slot"]] = np.frombuffer(r["sums"], np.int64)
        weights[r["slot"]] = r["weight"]
        costs[r["slot"]] = int(r["cost"])
    return sums.reshape(centroids.shape), weights.reshape(starts, k), costs[::k]


def _first_centroids(dense: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` of the rows, or all distinct ones if fewer: each is the best of some
    that are drawn by weight times squared distance to those chosen."""
    draw = np.random.default_rng(seed)
    trials = 2 + int(math.log(k))
    length = (dense * dense).sum(axis=1)

    def away(row: int) -> np.ndarray:
        return length + length[row] - 2 * (dense @ dense[row])

    first = int(np.searchsorted(np.cumsum(weight), draw.random() * weight.sum(), side="right"))
    chosen = [min(first, len(dense) - 1)]
    near = away(chosen[0])
    while len(chosen) < k and near.any():
        odds = np.cumsum(weight * near)
        tried = np.searchsorted(odds, draw.random(trials) * odds[-1], side="right")
        options = [(row, np.minimum(near, away(row))) for row in np.minimum(tried, len(dense) - 1).tolist()]
        row, near = min(options, key=lambda option: float(weight @ option[1]))
        chosen.append(row)
    return dense[chosen].astype(np.int64)


def _still(sums: np.ndarray, weights: np.ndarray, centroids: np.ndarray, cost: int) -> float:
    """The squared shift below which a start rests, of the variance of the points."""
    total = int(weights.sum())
    squares = cost
    for summed, weight, centre in zip(sums, weights.tolist(), centroids):
        centre = centre.astype(object)
        squares += 2 * int(centre @ summed.astype(object)) - weight * int(centre @ centre)
    mean = sums.sum(axis=0).astype(float) / total
    return TOLERANCE * (squares / total - float(mean @ mean)) / len(mean)


def _lloyd(points: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[np.ndarray, list[int], int]:
    """Moves the centroids of all starts; starts that rest take no part in
    further rounds. A centroid that is nearest to nothing stays."""
    centroids, moving, enough = centroids.copy(), list(range(len(centroids))), None
    done = 0
    while moving and done < rounds:
        old = centroids[moving]
        sums, weights, costs = _pass(points, old)
        if enough is None:
            enough = _still(sums[0], weights[0], old[0], costs[0])
        mean = sums // np.maximum(weights, 1)[:, :, None]
        new = np.where(weights[:, :, None] > 0, mean, old)
        shift = ((new - old).astype(float) ** 2).sum(axis=(1, 2))
        centroids[moving] = new
        moving = [s for s, by in zip(moving, shift) if by > 0 and by > enough]
        done += 1
    return centroids, _pass(points, centroids)[2], done


def _errors(logs: DataFrame) -> DataFrame:
    return logs.filter(is_error()).select(F.coalesce("message", F.lit("")).alias("message"))


def fit_clusters(
    logs: DataFrame,
    n_clusters: int = 5,
    seed: int = fv.CLUSTER_SEED,
    restarts: int = fv.CLUSTER_RESTARTS,
    stopped: Iterable[str] | None = None,
    max_features: int = fv.CLUSTER_VOCABULARY,
    rounds: int = ROUNDS,
    initial: Iterable[str] | None = None,
) -> ClusterModel | None:
    """The model of ``cluster_errors``; None if there are fewer than two errors
    or no word is left. Runs a job per round.

    ``initial`` are messages that the only start begins with, instead of
    ``restarts`` starts whose messages are drawn.
    """
    stopped = list(stop_words() if stopped is None else stopped)
    distinct = (
        _errors(logs)
        .groupBy("message")
        .agg(F.count(F.lit(1)).alias("weight"))
        .select(F.xxhash64("message").alias("key"), words(F.col("message"), stopped).alias("tokens"), "weight")
        .persist()
    )
    try:
        errors = distinct.agg(F.sum("weight")).first()[0] or 0
        vocabulary = _vocabulary(distinct, max_features) if errors >= 2 else []
        if not vocabulary:
            return None
        names = [row["word"] for row in vocabulary]
        idf = [math.floor(IDF_UNIT * (math.log((1 + errors) / (1 + row["df"])) + 1)) for row in vocabulary]
        weights = np.array(idf, np.int64)
        size, k = len(names), int(min(n_clusters, errors))
        points = _make_points(distinct, names, weights).persist()
        try:
            if initial is None:
                sample = points.orderBy("key", "places", "values").limit(SEED_MESSAGES).toArrow()
            else:
                chosen = logs.sparkSession.createDataFrame([(m,) for m in initial], "message string").coalesce(1)
                tokens = chosen.select(
                    F.lit(0).cast("long").alias("key"),
                    F.lit(1).cast("long").alias("weight"),
                    words(F.col("message"), stopped).alias("tokens"),
                )
                sample = _make_points(tokens, names, weights).toArrow()
            column = {n: sample.column(n).combine_chunks() for n in sample.column_names}
            dense = _dense(column["places"], column["values"], size)
            if initial is None:
                weight = column["weight"].to_numpy().astype(float)
                starts = [_first_centroids(dense, weight, k, seed + i) for i in range(restarts)]
                # Starts have as many centroids as the sample has distinct vectors, at most k: all the same.
                centroids = np.stack(starts)
            else:
                centroids = dense.astype(np.int64)[None]
            centroids, costs, done = _lloyd(points, centroids, rounds)
        finally:
            points.unpersist()
    finally:
        distinct.unpersist()
    best = min(range(len(costs)), key=lambda s: (costs[s], s))
    return ClusterModel(names, weights, centroids[best], costs[best], done)


def label_errors(
    logs: DataFrame, model: ClusterModel, stopped: Iterable[str] | None = None, messages: bool = True
) -> DataFrame:
    """Every error message with its nearest cluster and the squared distance to
    it, in units of ``1 / LENGTH``: ``message``, ``cluster``, ``distance``. Of
    equal distances the lower cluster counts. Messages are not shuffled, and
    without ``messages`` only their words are handed to Python."""
    stopped = list(stop_words() if stopped is None else stopped)
    names, idf, centroids = model.words, model.idf, model.centroids[None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(names)
        for batch in batches:
            for start, dense in _slices(batch.column("tokens"), vocabulary, idf):
                label, distance = _nearest(dense, centroids)
                own = [batch.column(n).slice(start, len(dense)) for n in kept]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(label[:, 0], pa.int32()), pa.array(distance[:, 0], pa.int64())],
                    names=[*kept, "cluster", "distance"],
                )

    kept = ["message"] if messages else []
    tokenised = _errors(logs).select(*kept, words(F.col("message"), stopped).alias("tokens"))
    return tokenised.mapInArrow(run, "".join(f"{n} string, " for n in kept) + "cluster int, distance long")


def cluster_errors(
    logs: DataFrame,
    n_clusters: int = 5,
    seed: int = fv.CLUSTER_SEED,
    restarts: int = fv.CLUSTER_RESTARTS,
    stopped: Iterable[str] | None = None,
    max_features: int = fv.CLUSTER_VOCABULARY,
    messages: bool = True,
) -> DataFrame:
    """Every error message with a cluster label: ``message``, ``cluster``;
    without ``messages`` a row for each with its label only.

    TF-IDF over the ``max_features`` most frequent words (so many rows reach
    the driver; the others take no part), then K-means, the best of several
    starts. Copies of a message are one weighted point, so training works on
    distinct texts and is not slowed down by a message that makes up much of
    the log. Labels are the same however the log is dealt to partitions. There
    is no row where there are fewer than two errors or no word is left.
    """
    if n_clusters < 1:
        raise ValueError("at least one cluster")
    stopped = list(stop_words() if stopped is None else stopped)
    columns = CLUSTER_SCHEMA.names if messages else ["cluster"]
    model = fit_clusters(logs, n_clusters, seed, restarts, stopped, max_features)
    if model is None:
        return logs.sparkSession.createDataFrame([], CLUSTER_SCHEMA).select(*columns)
    if len(model.centroids) < 2:
        return _errors(logs).withColumn("cluster", F.lit(0)).select(*columns)
    return label_errors(logs, model, stopped, messages).select(*columns)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("messages")).orderBy("cluster")
