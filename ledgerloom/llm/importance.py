"""Importance resampling: a draw of documents that follows the word distribution of a target.

Features are words and, if asked for, pairs of neighbouring words; a feature's
bucket is its bytes' crc32. A feature costs little if it is frequent: the head of
the vocabulary is broadcast, words with their exact CRC states and pairs with
their buckets. Whatever isn't in it, the tail, takes its CRC from its bytes, a
pair from the state of its first word on. The head is a table of bounded size
that only saves time: bucket totals are exact with any head, or with none.

A document's weight is the sum of its buckets' gains, its score the weight and a
Gumbel number of its own, so that the highest scores are a draw without return.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from .blocks import ALNUM, blocks
from .lineage import cut

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Words and pairs in the head, at most: some 30 bytes each.
HEAD = 1 << 16
BLOCK = 1 << 20
#: Words of more bytes take their CRC one by one.
LONG = 64


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_TABLE = _crc_table()
#: The bytes of words, A-Z as a-z; 0 for what stands between words.
_LETTERS = np.where(ALNUM == 0, 0, ALNUM - 1).astype(np.uint8)


def extend(states: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of what ``states`` are the CRCs of, followed by the bytes from ``start`` on: all words at once, byte by byte."""
    out = states.astype(np.uint32)
    order = np.argsort(-length, kind="stable")
    n_long = int(np.searchsorted(-length[order], -LONG))
    for k in order[:n_long]:
        out[k] = zlib.crc32(data[start[k] : start[k] + length[k]].tobytes(), int(out[k]))
    order = order[n_long:]
    c, s, size = ~out[order], start[order], length[order]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j))  # words of more than j bytes come first
        c[:n] = _TABLE[(c[:n] ^ data[s[:n] + j]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[order] = ~c
    return out


class Words:
    """The words of a block of texts: the distinct ones, which of them stands at each place, and the row of each place."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        t = _LETTERS[data]
        inside = t != 0
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        at = bounds[:-1][bounds[:-1] < bounds[1:]]
        start[at] = inside[at]
        s = np.flatnonzero(start)
        self.count = np.diff(np.searchsorted(s, bounds))
        self.row = np.repeat(np.arange(len(bounds) - 1), self.count)
        letters = t[inside]
        offsets = np.concatenate([np.cumsum(inside, dtype=np.int32)[s] - 1, [len(letters)]]).astype(np.int64)
        each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(s), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        coded = each.dictionary_encode()
        self.distinct = coded.dictionary
        self.code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the distinct words: all bytes, where each word starts, and its length."""
        bounds = np.frombuffer(self.distinct.buffers()[1], np.int64)[: len(self.distinct) + 1]
        return np.frombuffer(self.distinct.buffers()[2] or b"", np.uint8), bounds[:-1], np.diff(bounds)


class Head:
    """The frequent words with their CRC states, and the buckets of frequent pairs of them."""

    def __init__(self, words: list[bytes] = (), pairs: np.ndarray = (), buckets: int = BUCKETS):
        self.words = pa.array(sorted(words), pa.large_binary())
        self.states = np.array([zlib.crc32(w) for w in self.words.to_pylist()], np.uint32)
        self.pairs = np.sort(np.asarray(pairs, np.int64))
        w = self.words.to_pylist()
        self.pair_buckets = np.array([zlib.crc32(b" " + w[p % len(w)], int(self.states[p // len(w)])) % buckets for p in self.pairs.tolist()], np.int64)

    def places(self, words: Words) -> np.ndarray:
        """The head's number of each distinct word, or -1."""
        found = pc.index_in(words.distinct, value_set=self.words)
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def states_of(self, words: Words, place: np.ndarray) -> np.ndarray:
        """The CRC of each distinct word: the head's, or its bytes'."""
        out = np.zeros(len(place), np.uint32)
        known = place >= 0
        out[known] = self.states[place[known]]
        data, start, length = words.bytes()
        tail = np.flatnonzero(~known)
        out[tail] = extend(np.zeros(len(tail), np.uint32), data, start[tail], length[tail])
        return out

    def pair_buckets_of(self, words: Words, place: np.ndarray, states: np.ndarray, a: np.ndarray, b: np.ndarray, buckets: int) -> np.ndarray:
        """The bucket of each pair of distinct words a and b: the head's, or from a's state on."""
        out, known = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
        if len(self.pairs):
            key = np.where((place[a] >= 0) & (place[b] >= 0), place[a] * len(self.words) + place[b], -1)
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            known = self.pairs[at] == key
            out[known] = self.pair_buckets[at[known]]
        data, start, length = words.bytes()
        t = np.flatnonzero(~known)
        spaced = extend(states[a[t]], np.array([32], np.uint8), np.zeros(len(t), np.int64), np.ones(len(t), np.int64))
        out[t] = extend(spaced, data, start[b[t]], length[b[t]]) % np.uint32(buckets)
        return out


def features(data: np.ndarray, bounds: np.ndarray, head: Head, max_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: the bucket of each feature, the row of each, and the number of words of each row."""
    words = Words(data, bounds)
    place = head.places(words)
    states = head.states_of(words, place)
    found, rows = [(states % np.uint32(buckets)).astype(np.int64)[words.code]], [words.row]
    if max_words < 2:
        return found[0], rows[0], words.count
    near = words.row[1:] == words.row[:-1]
    key, back = np.unique(words.code[:-1][near] * len(states) + words.code[1:][near], return_inverse=True)
    a, b = np.divmod(key, max(len(states), 1))
    found.append(head.pair_buckets_of(words, place, states, a, b, buckets)[back])
    rows.append(words.row[1:][near])
    return np.concatenate(found), np.concatenate(rows), words.count


class Frequent:
    """A mergeable summary: of a stream of keys, all that are more than a ``size``-th of it, in bounded memory."""

    def __init__(self, size: int):
        self.size, self.counts = size, {}

    def add(self, keys: list, counts: list[int]) -> None:
        for k, n in zip(keys, counts):
            self.counts[k] = self.counts.get(k, 0) + n
        if len(self.counts) > 2 * self.size:
            least = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = {k: n - least for k, n in self.counts.items() if n > least}


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    return df.select(F.col(text_col).alias("text"))


def head_of(df: DataFrame, text_col: str = "text", size: int = HEAD, max_words: int = 1, buckets: int = BUCKETS) -> Head:
    """The head of all texts of df: each task sums up what is frequent in it, at most ``size`` keys; the most frequent of the sums are the head."""

    def top(found: DataFrame) -> list:
        return [r[0] for r in found.groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(size).collect()]  # at most size rows

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Frequent(size)
        for batch in batches:
            for _, _, data, bounds in blocks(batch.column(0), BLOCK):
                w = Words(data, bounds)
                n = np.bincount(w.code, minlength=len(w.distinct))
                often = np.flatnonzero(n > 1)  # the tail of a block isn't frequent
                seen.add(w.distinct.take(pa.array(often)).to_pylist(), n[often].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.counts), pa.binary()), pa.array(list(seen.counts.values()), pa.int64())], names=["key", "n"])

    head = Head([bytes(w) for w in top(_texts(df, text_col).mapInArrow(words, "key binary, n long"))], (), buckets)
    if max_words < 2:
        return head
    known = df.sparkSession.sparkContext.broadcast(head)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, h = Frequent(size), known.value
        for batch in batches:
            for _, _, data, bounds in blocks(batch.column(0), BLOCK):
                w = Words(data, bounds)
                place = h.places(w)[w.code]
                near = (w.row[1:] == w.row[:-1]) & (place[1:] >= 0) & (place[:-1] >= 0)
                key, n = np.unique(place[:-1][near] * len(h.words) + place[1:][near], return_counts=True)
                seen.add(key[n > 1].tolist(), n[n > 1].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.counts), pa.int64()), pa.array(list(seen.counts.values()), pa.int64())], names=["key", "n"])

    return Head(head.words.to_pylist(), top(_texts(df, text_col).mapInArrow(pairs, "key long, n long")), buckets)


def bucket_totals(df: DataFrame, head, text_col: str = "text", max_words: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds. A task adds up its own texts first; ``head`` is a broadcast :class:`Head`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, bounds in blocks(batch.column(0), BLOCK):
                n += np.bincount(features(data, bounds, head.value, max_words, buckets)[0], minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in _texts(df, text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most buckets rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket: a thousand times the log ratio of its smoothed shares in target and source, floored."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def gumbel(draw: int) -> int:
    """A Gumbel number in thousandths, of a draw of 32 bits."""
    return math.floor(-1000 * math.log(-math.log((draw + 0.5) / 4294967296)))


def scored(df: DataFrame, gain: np.ndarray, head, id_col: str = "doc_id", text_col: str = "text", max_words: int = 1, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("draw"))
    table = df.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = table.value
        for batch in batches:
            for a, b, data, bounds in blocks(batch.column(1), BLOCK):
                bucket, row, n_words = features(data, bounds, head.value, max_words, len(g))
                weight = np.bincount(row, weights=g[bucket], minlength=b - a).astype(np.int64)
                luck = np.array([gumbel(x) for x in batch.column(2).slice(a, b - a).to_pylist()], np.int64)
                columns = [n_words, np.bincount(row, minlength=b - a), weight, weight + luck]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return source.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows (doc_id, n_words, score and more, a table) with ``rank`` from 1 of the highest scores: ``percent`` percent of the rows with enough words.

    Ties go to the smaller id; a null id comes after all others. Rows are
    ordered in ranges that a row's own number splits too, so that no task has to
    hold equal rows together; a range's first rank is the number of rows in the
    ranges before it.
    """
    spark: SparkSession = rows.sparkSession
    numbered = rows.withColumn("__tie", F.monotonically_increasing_id())
    able = numbered.where(F.col("n_words") >= least_words)
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__tie")]
    placed = cut(able.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part, within = F.shiftright("__place", 33).alias("__part"), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    upto = W.orderBy("__part").rowsBetween(W.unboundedPreceding, W.currentRow)  # over one row for each range
    counts = placed.groupBy(part).count().select("__part", F.sum("count").over(upto).alias("__upto"), "count").collect()
    total = counts[-1]["__upto"] if counts else 0
    first = spark.createDataFrame([(r["__part"], r["__upto"] - r["count"]) for r in counts], "__part long, __first long")
    rank = F.col("__first") + within + 1
    ranked = placed.withColumn("__part", part).join(F.broadcast(first), "__part").select(*rows.columns, F.when(rank <= total * percent // 100, rank).alias("rank"))
    return ranked.unionByName(numbered.where(~F.coalesce(F.col("n_words") >= least_words, F.lit(False))).select(*rows.columns, F.lit(None).cast("long").alias("rank")))


def resample(
    df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_words: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, head: int = HEAD,
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of df; rank is null for rows that aren't drawn.

    ``max_words`` is 1 (words) or 2 (words and pairs). A null text has no words
    and weight 0; a null id's Gumbel number is drawn as for the empty string.
    Rows that repeat score alike and each has a rank of its own. Empty tables
    give no rows, an empty target gains that only tell rare buckets from
    frequent ones. Of other columns none is read. Texts are read three times,
    never shuffled; the driver sees bucket totals and the head.
    """
    if max_words not in (1, 2):
        raise ValueError("features are words or words and pairs: max_words is 1 or 2")
    known = df.sparkSession.sparkContext.broadcast(head_of(df, text_col, head, max_words, buckets))
    source, wanted = (bucket_totals(x, known, text_col, max_words, buckets) for x in (df, target))
    return drawn(cut(scored(df, gains(source, wanted), known, id_col, text_col, max_words, seed)), percent, least_words)
