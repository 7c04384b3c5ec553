"""Repeated lines, and sentences within lines: the earliest occurrence stays, the others go."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, whole_text

#: Where lines end, and where sentences end within a line.
LINE = re.compile(r"(?<=\n)")
SENTENCE = re.compile(r"(?<=[.!?] )")
_SPANS = "array<struct<start:bigint,end:bigint>>"


def cut(text: str, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(line, start, end, digest) of every line that has a word, and of every
    sentence of ``min_words`` words; ``line`` is where the line of either starts,
    negative for lines themselves.

    Digests are of the words joined by one space, lines and sentences apart;
    offsets are code points of the text as it is, separators behind included.
    """
    at = 0
    for line in LINE.split(text):
        words = line.encode().split()
        if words:
            yield -at - 1, at, at + len(line), hashlib.md5(b" ".join(words)).digest()
            start = at
            for part in SENTENCE.split(line) if len(words) >= min_words else ():
                words = part.encode().split()
                if len(words) >= min_words:
                    yield at, start, start + len(part), hashlib.md5(b"\n" + b" ".join(words)).digest()
                start += len(part)
        at += len(line)


def dedup_units(docs: DataFrame, min_words: int = 5) -> DataFrame:
    """Per document: ``doc_id``, ``n_units``, ``n_removed``, ``n_chars_removed``
    and ``removed``, the spans that go as ``start:end``, comma-joined.

    Lines that are equal up to white space, of any length, are one group over
    all documents; of a group the one of the smallest ``doc_id`` (missing ids
    last) and then the smallest offset stays. Repeated paragraphs go line by
    line. Sentences of at least ``min_words`` words are grouped likewise, for
    passages that begin or end within a line; those within a line that goes are
    not told apart. What stays first as a sentence is never in a line that goes,
    since that line's first occurrence holds it earlier. ``n_units`` counts
    lines with a word. Rows that share id and text are one document, and each
    such row gets its result. A missing text is empty.

    Only digests and offsets are shuffled. A group is counted on the map side,
    and finding its members is a join against one row per repeated digest,
    whose large groups the adaptive planner splits.
    """
    schema = "doc_id long, copy binary, line long, start long, end long, digest binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                copy = hashlib.md5(text.encode()).digest()
                units = list(cut(text, min_words))
                lines = sum(u[0] < 0 for u in units)
                rows += ((doc_id, copy, *u) for u in [(0, -1, lines, None), *units])
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "copy", "line", "start", "end", "digest"],
            )

    # Every row of the documents has one row without a digest, with its number of lines.
    table = saved(docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, schema), "units")
    units = table.filter("start >= 0")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "copy", "start")
    # Written first, so that both sides of the join are dealt anew and can be split.
    repeated = saved(
        units.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("times"), F.min(rank).alias("first"))
        .filter(F.col("times") > 1)
        .select("digest", "first"),
        "repeated",
    )
    gone = (
        units.join(repeated, "digest")
        .filter(rank != F.col("first"))
        .withColumn("whole", F.col("line") < 0)
        .withColumn("span", F.struct("start", "end"))
        # A line that goes takes its sentences along.
        .groupBy("doc_id", "copy", F.when(F.col("whole"), -F.col("line") - 1).otherwise(F.col("line")).alias("line"))
        .agg(
            F.max(F.when(F.col("whole"), F.col("span"))).alias("all"),
            F.collect_set(F.when(~F.col("whole"), F.col("span"))).alias("parts"),
        )
        .select("doc_id", "copy", F.when(F.col("all").isNull(), F.col("parts")).otherwise(F.array("all")).alias("spans"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"))
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    )
    spans = F.coalesce("spans", F.array().cast(_SPANS))
    rows = table.filter("start < 0")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy"))
    return rows.join(gone, same, "left").select(
        "doc_id",
        F.col("end").alias("n_units"),
        F.size(spans).cast("long").alias("n_removed"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_chars_removed"),
        F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("removed"),
    )


def sql(min_words: int = 5) -> str:
    """The same in the checking database's SQL."""

    def cuts(of: str, end: str, source: str, keys: str) -> str:
        return f"""
  SELECT {keys}, part, begin + coalesce(sum(length(part)) OVER (
    PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    regexp_extract_all(part, '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT {keys}, begin, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
    SELECT {keys}, begin, string_split(regexp_replace({of}, '{end}', '\\1' || chr(0), 'g'), chr(0)) AS parts
    FROM {source}))"""

    return f"""
WITH lines AS ({cuts("text", "(" + chr(92) + "n)", "(SELECT doc_id, coalesce(text, '') AS text, 0 AS begin FROM documents)", "doc_id")}),
kept AS (SELECT doc_id, start AS line, part AS text, start AS begin, words FROM lines WHERE len(words) > 0),
sentences AS ({cuts("text", "([.!?]" + chr(92) + "x20)", "kept", "doc_id, line")}),
ranked_lines AS (
  SELECT doc_id, line, line + length(text) AS stop,
    row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, line) AS n FROM kept),
ranked_sentences AS (
  SELECT doc_id, line, start, start + length(part) AS stop,
    row_number() OVER (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, start) AS n
  FROM sentences WHERE len(words) >= {min_words}),
gone AS (
  SELECT doc_id, line AS start, stop FROM ranked_lines WHERE n > 1
  UNION ALL
  SELECT s.doc_id, s.start, s.stop FROM ranked_sentences s JOIN ranked_lines l USING (doc_id, line)
  WHERE s.n > 1 AND l.n = 1),
lost AS (
  SELECT doc_id, count(*) AS n, sum(stop - start) AS chars, string_agg(start || ':' || stop, ',' ORDER BY start) AS spans
  FROM gone GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_units, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(g.chars, 0) AS BIGINT) AS n_chars_removed, coalesce(g.spans, '') AS removed
FROM documents d LEFT JOIN lost g USING (doc_id) LEFT JOIN counted c USING (doc_id)"""
