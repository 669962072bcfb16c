"""Repeated passages by content-defined chunks.

A gear hash rolls over each text's bytes; where its low bits are zero a chunk
may end. A candidate too close after another is skipped, by a rule that looks
at the bytes before it only, and a stretch without any is cut at a fixed length
from the last boundary. So boundaries depend on nearby content alone, and an
insertion shifts no chunk but those that it touches. Chunks with one digest are
the same; all but the first place are repeats.

What is looked up is a seed: from each chunk on, as many neighbouring chunks as
make 48 bytes. A sentence that also stands elsewhere, alone and earlier, so
doesn't hide a longer passage: the seeds over its edges have their own first
place.

A passage begins and ends within chunks. So repeats that lie in one document at
one distance from their first places are held against those places byte by
byte, with a margin of the longest chunk, and what is equal there and long
enough is a passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from .blocks import blocks, mix, powers
from .lineage import cut, drop
from .salted import with_facts

#: A boundary every 16 bytes on average, of which those too close after another are left out; its decision sees the last 16 bytes.
MASK = 15
SEEN = 16
LEAST_CHUNK = 16
MOST_CHUNK = 256

#: Bytes of neighbouring chunks that make a seed, and bytes of a passage; ids that may be broadcast once they are counted, 8 bytes each.
LEAST_SEED = 48
LEAST_PASSAGE = 120
BROADCAST_KEYS = 1_000_000

GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def boundaries(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the chunks of a block's texts, as places in the block."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):  # the sum of the last 2, 4, 8, 16 bytes' gears, each shifted by its distance
        h[k:] += h[:-k].copy() << np.uint32(k)
    at = np.flatnonzero((h >> np.uint32(SEEN - 4)) & np.uint32(MASK) == 0) + 1
    row = np.searchsorted(bounds, at, side="right") - 1
    inside = at < bounds[-1]
    inside[inside] = at[inside] - bounds[row[inside]] >= SEEN
    at, row = at[inside], row[inside]
    apart = (np.diff(at, prepend=-LEAST_CHUNK) >= LEAST_CHUNK) | (np.diff(row, prepend=-1) != 0)
    filled = np.flatnonzero(np.diff(bounds) > 0)
    start = np.concatenate([bounds[filled], at[apart]])
    row = np.concatenate([filled, row[apart]])
    order = np.argsort(start, kind="stable")
    start, row = start[order], row[order]
    end = np.append(start[1:], bounds[-1])
    many = (end - start - 1) // MOST_CHUNK + 1
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start, end, row = (np.repeat(x, many) for x in (start, end, row))
    start = start + MOST_CHUNK * nth
    return row, start, np.minimum(start + MOST_CHUNK, end)


def seeds(row: np.ndarray, start: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the shortest runs of chunks of one text, from each chunk on, that have ``least`` bytes."""
    last = np.searchsorted(end, start + least)
    whole = last < len(end)
    whole[whole] = row[last[whole]] == row[whole]
    return row[whole], start[whole], end[last[whole]]


def chunks(df: DataFrame, id_col: str, text_col: str, least: int = LEAST_SEED) -> DataFrame:
    """(id, key, d, start, end): from every chunk of every text on, the chunks that make a seed, with their digest, in bytes of UTF-8."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("d", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, data, bounds in blocks(batch.column(2)):
                if not len(data):
                    continue
                row, start, end = seeds(*boundaries(data, bounds), least)
                up, down = powers(len(data) + 1)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
                d = mix((total[end] - total[start]) * down[start])
                at = pa.array(row + a)
                places = [pa.array((x - bounds[row]).astype(np.int32)) for x in (start, end)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(d.view(np.int64)), *places], schema=schema)

    return _source(df, id_col, text_col).select("id", "key", "text").mapInArrow(run, "id long, key long, d long, start int, end int")


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("text")).where("text is not null")


def _equal_stretches(own: bytes, other: bytes, least: int) -> list[tuple[int, int]]:
    """[start, end) of stretches of ``least`` bytes or more in which two byte strings agree place by place; characters stay whole."""
    n = min(len(own), len(other))
    a, b = np.frombuffer(own, np.uint8, n), np.frombuffer(other, np.uint8, n)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (a == b).view(np.int8), [0]])))
    out = []
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
        while s < e and 128 <= own[s] < 192:
            s += 1
        while s < e < len(own) and 128 <= own[e] < 192:
            e -= 1
        if e - s >= least:
            out.append((s, e))
    return out


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_passage: int = LEAST_PASSAGE) -> DataFrame:
    """(doc_id, start, end, n_chunks, first_doc_id, key): passages of ``least_passage`` bytes or more that an earlier place has.

    Places are ordered by id, text hash and offset; start and end are bytes of
    the document's UTF-8 text; n_chunks counts the repeated seeds that led to
    the passage; first_doc_id is the document with the first place of the
    passage's beginning. Passages that overlap or touch are one. A passage is
    found if a seed of ``LEAST_SEED`` bytes lies in it whose first place is in the
    same earlier passage: of 51 words or more, over 97 %, also where its
    sentences stand alone in still earlier documents. Null and empty texts have no chunks; rows without id come first; rows
    with one id and one text are one document; an empty table gives an empty
    result.
    """
    every = cut(chunks(df, id_col, text_col, min(LEAST_SEED, least_passage)))
    met = cut(with_facts(every, ["d"], ["key", "start"], [F.count("*").alias("times")], "times > 1").drop("times"))
    drop(every)
    later = with_facts(met, ["d"], ["key", "start"], [F.min(F.struct("id", "key", "start")).alias("first")]).where("not (key = first.key and start = first.start)")
    later = later.select("key", "id", "start", "end", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key"), (F.col("start") - F.col("first.start")).alias("shift")).distinct()
    # what one document shares with another at one distance
    lanes = later.groupBy("key", "first_key", "shift").agg(F.min("id").alias("id"), F.min("first_id").alias("first_id"), F.min("start").alias("lo"), F.max("end").alias("hi"), F.count("*").alias("n_chunks"))
    lanes = cut(lanes.withColumn("lo", F.greatest(F.col("lo") - MOST_CHUNK, F.col("shift"), F.lit(0))).withColumn("hi", F.col("hi") + MOST_CHUNK))
    drop(met)

    lane = ["key", "first_key", "shift"]
    own = lanes.select(F.col("key").alias("at"), *lane, F.col("lo").alias("a"), F.col("hi").alias("b"), F.lit(0).alias("side"))
    other = lanes.select(F.col("first_key").alias("at"), *lane, (F.col("lo") - F.col("shift")).alias("a"), (F.col("hi") - F.col("shift")).alias("b"), F.lit(1).alias("side"))
    # texts without lanes aren't shuffled; a document that very many others share a passage with: adaptive execution splits its rows
    both = own.union(other)
    wanted = cut(both.select("at").distinct())
    texts = _source(df, id_col, text_col).select(F.col("key").alias("at"), F.encode("text", "UTF-8").alias("raw"))
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, "at", "left_semi")
    cuts = texts.join(both, "at").select(*lane, "side", F.substring(F.col("raw"), F.col("a") + 1, F.col("b") - F.col("a")).alias("part"))
    pairs = cuts.groupBy(*lane).agg(F.max(F.when(F.col("side") == 0, F.col("part"))).alias("own"), F.max(F.when(F.col("side") == 1, F.col("part"))).alias("other"))
    pairs = pairs.join(lanes, lane).select("id", "key", "first_id", "n_chunks", "lo", "own", "other")
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("first_doc_id", pa.int64()), ("n_chunks", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (lo, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in (4, 5, 6)))):
                rows += [(i, lo + s, lo + e) for s, e in _equal_stretches(x or b"", y or b"", least_passage)]
            at, start, end = (pa.array(c, pa.int64()) for c in (zip(*rows) if rows else ((), (), ())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(4)), start, end], schema=schema)

    found = cut(pairs.mapInArrow(run, "doc_id long, key long, first_doc_id long, n_chunks long, start long, end long"))
    drop(lanes, wanted)
    before = W.partitionBy("key").orderBy("start", "end", "first_doc_id")
    reached = F.max("end").over(before.rowsBetween(W.unboundedPreceding, -1))
    islands = found.withColumn("begins", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("begins").over(before.rowsBetween(W.unboundedPreceding, 0)))
    passages = islands.groupBy("key", "island").agg(F.min("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_chunks").alias("n_chunks"), F.min_by("first_doc_id", F.struct("start", "end", "first_doc_id")).alias("first_doc_id"))
    return passages.select("doc_id", "start", "end", "n_chunks", "first_doc_id", "key")


def remove_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_passage: int = LEAST_PASSAGE) -> DataFrame:
    """df without its repeated passages; null texts stay null, other columns stay as they are."""
    key, cuts = "__substring_key", "__substring_cuts"
    found = repeated_passages(df, id_col, text_col, least_passage).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts)).withColumnRenamed("key", key)
    joined = df.withColumn(key, F.xxhash64(id_col, text_col)).join(found, key, "left").drop(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = []
            for text, spans in zip(batch.column(at).to_pylist(), batch.column(cuts).to_pylist()):
                if spans:
                    raw, out, last = text.encode(), [], 0
                    for s in spans:
                        out.append(raw[last : s["start"]])
                        last = s["end"]
                    text = b"".join([*out, raw[last:]]).decode(errors="ignore")
                texts.append(text)
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name != cuts}
            yield pa.RecordBatch.from_pydict(columns | {text_col: pa.array(texts, batch.schema.field(at).type)})

    return joined.mapInArrow(run, df.schema)
