"""Token counts of whole texts: lengths only, no ids leave the workers.

Texts are encoded in batches of about equal bytes. A text of more than
``chunk_bytes`` is cut at safe boundaries first: one space between two ASCII
letters or digits. No token of the supported vocabularies spans such a place,
so the counts of the parts add up to the count of the whole; a text without
such a place is encoded in one piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

_SAFE = re.compile(r"(?<=[0-9A-Za-z]) (?=[0-9A-Za-z])")
_SCHEMA = "n_bytes long, n_tokens long"


def encoder(path: str) -> tuple[Callable[[list[str]], Iterable[int]], bool]:
    """Token counts for a list of texts, and whether a part that follows a cut
    keeps the space it was cut at.

    ``.json`` files are for tokenizers, ``.model`` files for sentencepiece,
    which puts the mark of a space before every text by itself.
    """
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        fast = Tokenizer.from_file(path)
        fast.no_truncation()
        fast.no_padding()
        return (
            lambda texts: [len(e.ids) for e in fast.encode_batch_fast(texts, add_special_tokens=False)]
        ), True
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=path)
        return (
            lambda texts: map(len, pieces.encode(texts, num_threads=1, add_bos=False, add_eos=False))
        ), not pieces.encode("a", out_type=str)[0].startswith("▁")
    raise ValueError("a vocabulary is a .json or a .model file")


def safe_parts(text: str, chunk: int, keep_space: bool) -> Iterator[str]:
    """The text cut at the first safe boundary after every ``chunk`` characters."""
    start = 0
    while len(text) - start > chunk and (cut := _SAFE.search(text, start + chunk)):
        yield text[start : cut.start()]
        start = cut.start() if keep_space else cut.end()
    yield text[start:] if start else text


def count_batches(
    texts: Iterable[str], count: Callable, keep_space: bool, batch_bytes: int, chunk_bytes: int
) -> list[int]:
    """Token counts of texts, encoded in calls of about ``batch_bytes`` each."""
    totals: list[int] = []
    parts: list[str] = []
    owners: list[int] = []
    held = 0

    def encode() -> None:
        for owner, n in zip(owners, count(parts)):
            totals[owner] += n
        parts.clear()
        owners.clear()

    for text in texts:
        totals.append(0)
        for part in safe_parts(text, chunk_bytes, keep_space):
            parts.append(part)
            owners.append(len(totals) - 1)
            held += len(part)
            if held >= batch_bytes:
                encode()
                held = 0
    encode()
    return totals


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    limit: int = 4096,
    batch_bytes: int = 1 << 20,
    chunk_bytes: int = 1 << 16,
) -> DataFrame:
    """The columns ``keep`` with ``n_bytes``, ``n_tokens`` and ``over_limit``.

    One row per input row, repeated rows included. A missing text counts as an
    empty one, with no bytes and no tokens. Other columns are not read.
    ``vocabulary`` is a path that the executors can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, keep_space = encoder(vocabulary)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = pa.compute.binary_length(column)
            totals = count_batches(
                (value.as_py() for value in column), count, keep_space, batch_bytes, chunk_bytes
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], sizes.cast(pa.int64()), pa.array(totals, pa.int64())],
                names=[*batch.schema.names[:-1], "n_bytes", "n_tokens"],
            )

    given = docs.select(*keep, whole_text(text).alias("_text"))
    kept = [f for f in given.schema.fields if f.name != "_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), _SCHEMA])
    return given.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
