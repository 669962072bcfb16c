"""Repeated runs of lines by winnowing over line hashes.

Lines are compared without case of A-Z and with spaces and tabs collapsed; blank
lines don't count. A window is the shortest stretch of lines, ahead or back from
each line, that has ``least_words`` words; its fingerprint is the least of its
line hashes. A fingerprint alone may be a frequent short line, whose first place
says nothing about the lines around it. So it joins positions together with its
extension: the lines both ways of it up to the window's ends. Each window meets
its own first place, and the lines of windows with an earlier place are deleted.

That is exact. A line lies in a run of ``least_words`` words or more that stands
earlier if and only if it lies in a window that does: such a run holds the
window ahead or back of each of its lines, or one of both about it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import blocks, follow, giving_back, mix, powers, separated_by, words
from .lineage import cut
from .salted import with_facts

LEAST_WORDS = 10

#: Words of lines: what lies between spaces, tabs, carriage returns and line feeds, A-Z lowered.
_WORDS = separated_by([9, 10, 13, 32])


def row_key(id_col: str, text_col: str) -> Column:
    """Rows with one id and one text are one document."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def line_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's lines that aren't blank: hash, number of words before (and one more at the end), and row."""
    h, s, first = words(data, bounds, _WORDS)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    line = np.cumsum(data == 10)[s]
    start = np.flatnonzero((np.diff(line, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    if not len(start):
        return h, np.zeros(1, np.int64), row
    up, down = powers(len(h))
    return mix(np.add.reduceat(h * up[: len(h)], start) * down[start]), np.append(start, len(h)), row[start]


def windows_of(h: np.ndarray, before: np.ndarray, row: np.ndarray, least_words: int) -> tuple[np.ndarray, ...]:
    """(start, end, fingerprint, extension): line numbers in the block, end excluded, and two hashes."""
    n = len(h)
    start, end = before[:-1], before[1:]
    lines = np.arange(n)
    stop = np.searchsorted(end, start + least_words)
    ahead = stop < n
    ahead[ahead] = row[stop[ahead]] == row[ahead]
    top = np.searchsorted(start, end - least_words, side="right") - 1
    back = top >= 0
    back[back] = row[top[back]] == row[back]
    # a window back from its last line is one ahead too, unless that line isn't needed for the words
    back &= stop[np.maximum(top, 0)] < lines
    a, z = np.concatenate([lines[ahead], top[back]]), np.concatenate([stop[ahead], lines[back]]) + 1
    least = h[a]
    for k in range(1, least_words):  # each line has a word
        at = np.minimum(a + k, n - 1)
        least = np.where(a + k < z, np.minimum(least, h[at]), least)
    up, down = powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x5DEECE66D)) * up[:n], dtype=np.uint64)])
    both = mix((total[z] - total[a]) * down[a])
    return a, z, least, follow(least, both)


def windows(df: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """(id, key, f, x, n, size): each window of each text, n being its first line's number among the lines that aren't blank."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("f", pa.int64()), ("x", pa.int64()), ("n", pa.int32()), ("size", pa.int32())])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, bounds in blocks(batch.column(2)):
                h, before, row = line_hashes(data, bounds)
                if not len(h):
                    continue
                a, z, f, x = windows_of(h, before, row, least_words)
                first = np.searchsorted(row, np.arange(len(bounds)))
                at = pa.array(row[a] + i)
                numbers = pa.array((a - first[row[a]]).astype(np.int32)), pa.array((z - a).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(f.view(np.int64)), pa.array(x.view(np.int64)), *numbers], schema=schema)

    source = df.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    return source.where("text is not null").mapInArrow(run, "id long, key long, f long, x long, n int, size int")


def repeated_lines(df: DataFrame, id_col: str, text_col: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, runs): by document, the array of (n, size) of its windows that stand earlier; n counts lines that aren't blank."""
    found = cut(windows(df, id_col, text_col, least_words))
    first = [F.min(F.struct("id", "key", "n")).alias("first"), F.count("*").alias("times")]
    met = with_facts(found, ["f", "x"], ["key", "n"], first, "times > 1").where("not (key <=> first.key and n = first.n)")
    return met.groupBy("key").agg(F.collect_list(F.struct("n", "size")).alias("runs"))


def remove_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, removed: str | None = None) -> DataFrame:
    """df with the later copies of repeated runs deleted from its texts; ``removed`` names a column for their number of lines.

    The first place, in the order of ids, texts' hashes and lines, stays. Null
    texts stay null; rows with one id and one text are one document and are
    changed alike; lines of rows without id come first; other columns, of any
    name, stay as they are.
    """
    marks = repeated_lines(df, id_col, text_col, least_words)
    key, mark, count = "__line_dedup_key", "__line_dedup_marks", "__line_dedup_count"
    with_key = df.withColumn(key, row_key(id_col, text_col))
    joined = with_key.join(marks.select(F.col("key").alias(key), F.col("runs").alias(mark)), key, "left").drop(key)
    schema = joined.withColumn(count, F.lit(0).cast("long")).drop(mark).schema

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, marked = batch.schema.get_field_index(text_col), batch.column(mark)
            texts, counts = batch.column(at), np.zeros(batch.num_rows, np.int64)
            hit = np.flatnonzero(marked.is_valid().to_numpy(zero_copy_only=False))
            if len(hit):
                texts = texts.to_pylist()
                for i in hit.tolist():
                    texts[i], counts[i] = without(texts[i], {n for r in marked[i].as_py() for n in range(r["n"], r["n"] + r["size"])})
                texts = pa.array(texts, batch.schema.field(at).type)
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name != mark}
            yield pa.RecordBatch.from_pydict(columns | {text_col: texts, count: pa.array(counts)})

    out = joined.mapInArrow(run, schema)
    return out.withColumnRenamed(count, removed) if removed else out.drop(count)


def without(text: str, numbers: set[int]) -> tuple[str, int]:
    """text without the lines of these numbers, counted without blank lines, and how many they were."""
    kept, n = [], 0
    for line in text.split("\n"):
        if line.strip(" \t\r"):
            n += 1
            if n - 1 in numbers:
                continue
        kept.append(line)
    return "\n".join(kept), len(numbers)
