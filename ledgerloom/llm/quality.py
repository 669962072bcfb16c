"""Document quality by a hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features are hashed 1- and 2-grams of three word streams of a text: its words
of letters and digits, the shapes of its space-separated words (which kinds of
characters they have), and those shapes with whether a word repeats the one
before. Weights are a vector of fixed size, so that it can be broadcast; a
score is a sparse dot product, computed where the text lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from .blocks import ALNUM, SPACED, blocks, follow, give_back, giving_back, mix, words
from .lineage import cut

BITS = 18
SAMPLE_ROWS = 16_000
SAMPLE_BYTES = 96 << 20
SHARDS = 4
EPOCHS = 3
FOLDS = 5
THRESHOLD = 0.3

_KINDS = np.full(256, 128, np.uint8)
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58], _KINDS[128:] = 1, 2, 4, 8
_KINDS[[ord(c) for c in ".,"]], _KINDS[[ord(c) for c in "!?"]], _KINDS[ord("|")] = 16, 32, 64


def features(data: np.ndarray, bounds: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: feature numbers, the row of each, and the number of words of each row."""
    rows = len(bounds) - 1
    h, _, first = words(data, bounds, ALNUM)
    g, s, top = words(data, bounds, SPACED)
    found, where = [], []

    def stream(x: np.ndarray, starts: np.ndarray, salt: int) -> None:
        row = np.repeat(np.arange(rows), np.diff(starts))
        x = mix(x + np.uint64(salt))
        pair = follow(x[:-1], x[1:])[row[:-1] == row[1:]] if len(x) > 1 else x[:0]
        found.extend((x, pair))
        where.extend((row, row[:-1][row[:-1] == row[1:]] if len(x) > 1 else row[:0]))

    stream(h, first, 1)
    if len(s):
        # a row's last word may be followed by the next row's first: kinds are of each word's own bytes
        shape = np.bitwise_or.reduceat(np.where(SPACED[data] != 0, _KINDS[data], 0).astype(np.uint8), s).astype(np.uint64)
        same = np.zeros(len(g), bool)
        same[1:] = g[1:] == g[:-1]
        same[top[:-1][top[:-1] < len(g)]] = False
        stream(shape, top, 2)
        stream(shape * np.uint64(2) + same, top, 3)
    mask = np.uint64((1 << bits) - 1)
    return (np.concatenate(found) & mask).astype(np.int64), np.concatenate(where), np.diff(top)


def values(counts: np.ndarray, n_words: int) -> np.ndarray:
    """Feature values: ten times the counts to a word."""
    return 10 * counts / max(n_words, 1)


class Ftrl:
    """Follow-the-regularised-leader, one learning rate for each weight, as sparse updates."""

    def __init__(self, size: int, alpha: float = 0.15, beta: float = 1.0, l1: float = 0.02, l2: float = 1.0):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def fold(id_col: str = "doc_id", folds: int = FOLDS) -> F.Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out. A row without id is in no fold."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether no label of the row may be learned; false for a row without id, which has no label."""
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def labelled_sample(df: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(id, text, y), a table of at most ``rows`` labelled documents outside the held-out fold and ``most_bytes`` of text: those whose id's hash is smallest.

    The bounds make the sample's ids a table of proven size, so that they are
    broadcast and no text is shuffled but the sample's. Rows without id or
    label don't count; an id with several labels has the greatest, an id with
    several texts the one with the smallest hash.
    """
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null")
    known = known.where(fold("id") != 0).groupBy("id").agg(F.max("y").alias("y"))
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    fits = texts.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes).join(F.broadcast(chosen), "id")
    one = cut(fits.groupBy("id", "y").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text")))
    # at most ``rows`` short rows: one task adds up their sizes
    upto = one.select("id", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(W.orderBy(F.xxhash64("id"), "id").rowsBetween(W.unboundedPreceding, 0)).alias("upto"))
    return cut(one.join(F.broadcast(upto.where(F.col("upto") <= most_bytes).select("id")), "id").select("id", "text", "y"))


def train(df: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, sample_rows: int = SAMPLE_ROWS, shards: int = SHARDS, epochs: int = EPOCHS) -> np.ndarray:
    """The weights: ``shards`` learners take a share each of a sample of at most ``sample_rows`` rows and ``SAMPLE_BYTES`` of text, and their weights are averaged.

    Without labelled rows all weights are 0 and all scores 0.5.
    """

    def shard(group: pd.DataFrame) -> pd.DataFrame:
        model, docs = Ftrl(1 << bits), []
        group = group.sort_values(["id", "text"], na_position="first")
        for text, y in zip(group["text"], group["y"]):
            data = np.frombuffer((text or "").encode(), dtype=np.uint8)
            at, _, n = features(data, np.array([0, len(data)]), bits)
            at, counts = np.unique(at, return_counts=True)
            docs.append((np.append(at, 1 << bits).astype(np.int32), np.append(values(counts, n[0]), 1.0), y))
        rng = np.random.default_rng(0)
        for _ in range(epochs):
            for k in rng.permutation(len(docs)):
                model.learn(*docs[k])
        w = model.weights()
        at = np.flatnonzero(w)
        del docs, model, group
        give_back()
        return pd.DataFrame({"at": at, "w": w[at]})

    sample = labelled_sample(df, labels, label_col, id_col, text_col, sample_rows)
    dealt = sample.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)))
    learned = dealt.groupBy("shard").applyInPandas(shard, "at long, w double")
    out = np.zeros((1 << bits) + 1)
    for r in learned.groupBy("at").agg(F.sum(F.col("w").cast("decimal(30,15)")).alias("w")).toLocalIterator():  # at most 2^bits rows
        out[r["at"]] = float(r["w"]) / shards
    return out


def score(df: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(id, score, kept columns); a null or empty text scores by the intercept alone. Rows that repeat score alike."""
    handle = df.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    bits = len(weights).bit_length() - 1
    source = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *(c for c in keep if c != text_col))  # a kept text goes once
    schema = (source if text_col in keep else source.drop("__text")).withColumn("__score", F.lit(0.0)).schema

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = handle.value
        for batch in batches:
            scores = []
            for _, _, data, bounds in blocks(batch.column(1)):
                at, row, n = features(data, bounds, bits)
                dot = 10 * np.bincount(row, weights=w[at], minlength=len(n)) / np.maximum(n, 1)
                scores.append(1 / (1 + np.exp(-np.clip(dot + float(w[-1]), -30, 30))))
            out = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name in schema.names}
            yield pa.RecordBatch.from_pydict(out | {"__score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})

    scored = source.mapInArrow(run, schema).withColumnsRenamed({"__score": "score", "__id": "id", "__text": text_col})
    return scored.select("id", *keep, "score")
