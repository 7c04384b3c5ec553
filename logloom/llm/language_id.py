"""Language identification by error-correcting output codes.

Every language has a codeword of bits; for up to six languages the code holds
every way to part them in two, for more it is a seeded code of far more bits
than needed. A bit has a classifier of its own, which tells the languages with
that bit set from the others by hashed n-grams of the letters: log odds of an
n-gram on either side, added up over the text. A text gets the language whose
codeword loses least: each bit's logistic loss counts by how far its two sides
lie apart. Where the second codeword is hardly worse the text is ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

UNKNOWN = "und"
SIZES = (1, 2, 3, 4)
#: N-grams are counted under so many numbers.
CELLS = 1 << 15
#: About so many documents of a language are learned from, chosen by their hashes.
PER_LANGUAGE = 8000
#: A text whose second language loses less than this more is ambiguous.
MARGIN = 1.0
_PARTITIONS = 64
_EXHAUSTIVE = 6
_STEP = 1 << 16
_OTHER = regex.compile(r"\P{L}+")


def letters(text: str) -> bytes:
    """The words of letters, in small letters, with single spaces around; empty without any."""
    kept = _OTHER.sub(" ", text.lower()).strip()
    return f" {kept} ".encode() if kept else b""


def grams(data: bytes) -> Iterator[np.ndarray]:
    """Numbers below ``CELLS`` of all n-grams of the bytes, a bounded piece at a time."""
    for at in range(0, len(data), _STEP):
        piece = np.frombuffer(data, np.uint8)[at : at + _STEP + SIZES[-1] - 1].astype(np.uint64)
        code = np.zeros_like(piece)
        for n in SIZES:
            if len(piece) < n:
                break
            code = code[: len(piece) - n + 1] << np.uint64(8) | piece[n - 1 :]
            mixed = (code + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed[:_STEP] >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def codewords(languages: int, seed: int = 42) -> np.ndarray:
    """A row of bits (1, -1) per language. The seeded code is the best of some
    by the least distance of two codewords."""
    if languages <= _EXHAUSTIVE:
        ways = range(1, 1 << max(0, languages - 1))
        return np.array([[1 - 2 * (way >> row & 1) for way in ways] for row in range(languages)], np.int8)
    rng, bits = np.random.default_rng(seed), 12 * (languages - 1).bit_length()
    best, most = None, -1
    for _ in range(32):
        code = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        code = code[:, np.abs(code.sum(0, dtype=np.int64)) < languages]
        alike = code.astype(np.int32) @ code.T.astype(np.int32) - 2 * bits * np.eye(languages, dtype=np.int32)
        if (least := code.shape[1] - int(alike.max())) > most:
            best, most = code, least
    return best


@dataclass(frozen=True)
class Model:
    """The names, their codewords, log odds per n-gram and bit, and the bits' weights."""

    names: list[str]
    code: np.ndarray
    odds: np.ndarray
    weights: np.ndarray

    def predict(self, text: str) -> tuple[str, float, bool]:
        data = letters(text)
        if not data or not self.names:
            return UNKNOWN, 0.0, False
        total, n = np.zeros(self.code.shape[1]), 0
        for cells in grams(data):
            total += self.odds[cells].sum(0, dtype=np.float64)
            n += len(cells)
        losses = (np.logaddexp(0, -self.code * (total / np.sqrt(n))) * self.weights).sum(1)
        order = np.argsort(losses, kind="stable")
        best = int(order[0])
        score = 1.0 / float(np.exp(np.minimum(0, losses[best] - losses)).sum())
        close = len(order) > 1 and losses[order[1]] - losses[best] < MARGIN
        return self.names[best], score, bool(close)


def held_out() -> Column:
    """Whether a document isn't learned from; one without an id is neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the languages of ``docs`` (doc_id, text, lang).

    Learns from rows with an id, a text and a lang that aren't held out, whole
    texts of about ``per_language`` documents of each at most, so that no more
    than that is shuffled at any size. The driver holds a row per language and
    n-gram number.
    """
    usable = (F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("text").isNotNull() & F.col("lang").isNotNull()
    given = docs.filter(usable).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counted = given.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()
    names = [r["lang"] for r in counted]
    code = codewords(len(names))
    totals = np.zeros((len(names), CELLS))
    if names:
        shares = F.create_map(*(F.lit(x) for r in counted for x in (r["lang"], per_language / r["n"])))
        place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
        sample = given.filter(place < F.get(F.map_values(F.map_filter(shares, lambda k, _: k == F.col("lang"))), F.lit(0)))
        number = {name: i for i, name in enumerate(names)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[int, np.ndarray] = {}
            for batch in batches:
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    own = seen.setdefault(number[lang], np.zeros(CELLS, np.int64))
                    for cells in grams(letters(text.as_py())):
                        own += np.bincount(cells, minlength=CELLS)
            for lang, own in seen.items():
                cells = np.flatnonzero(own)
                columns = [pa.array(np.full(len(cells), lang), pa.int32()), pa.array(cells, pa.int32()), pa.array(own[cells])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "cell", "n"])

        dealt = sample.select("lang", "text").repartition(_PARTITIONS)
        sums = dealt.mapInArrow(run, "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
        found = sums.toArrow()
        totals[found["lang"].to_numpy(), found["cell"].to_numpy()] = found["n"].to_numpy()
    sides = [totals.T @ (code == side) + 0.5 for side in (1, -1)]
    ones, others = (side / side.sum(0) for side in sides)
    odds = np.log(ones) - np.log(others)
    apart = ((ones - others) * odds).sum(0)
    weights = apart / apart.mean() if apart.size and apart.mean() > 0 else np.ones(apart.shape)
    return Model(names, code, odds.astype(np.float32), weights)


def identify_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``held_out``, ``lang_pred``, ``score`` (0 to
    1) and ``ambiguous``, predicted from the whole text alone.

    Without a ``model`` one is fitted on the rows that aren't held out. A text
    that is missing, empty or without a letter is ``und`` with score 0, and so
    is every text where no language was learned. With one language learned all
    others are that one with score 1. Codewords that lose the same go to the
    first name by code point. Repeated rows give their result each time, an
    empty table none. Other columns are not read.
    """
    model = fit(docs) if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.float64(), pa.bool_())
        for batch in batches:
            found = [model.predict(text.as_py()) for text in batch.column(2)]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*found)) or [[]] * 3, kinds)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *columns], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return docs.select("doc_id", held_out().alias("held_out"), whole_text().alias("text")).mapInArrow(run, schema)
