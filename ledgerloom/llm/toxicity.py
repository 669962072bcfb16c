"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of two lexicons (words that mark toxic training
texts, and a short fixed list), how near they stand to second-person words,
capitals, punctuation, and words written with digits or symbols in place of
letters. Trees and calibration are Spark ML's, fitted on two parts of a bounded
sample of labelled rows; features of all texts are computed where they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from .blocks import SPACED, blocks, mix, powers, words
from .lineage import cut
from .quality import labelled_sample

SAMPLE_ROWS = 20_000
LEXICON_WORDS = 256
LEAST_Z = 4.0
TREES = 20
DEPTH = 4
NEAR = 3
THRESHOLD = 0.5

#: Plain insults, and second-person words of the corpus's languages.
INSULTS = "idiot idiots stupid moron morons loser losers pathetic worthless disgusting trash garbage scum clown dumb fool filthy ugly coward liar vermin".split()
YOU = "you your yours yourself youre u ur tu te ti tus tuyo usted ustedes vosotros vous votre vos toi ton ta tes du dich dir dein deine euch ihr ihre sie".split()

#: Digits and symbols that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}

FEATURES = ["strong", "weak", "fixed", "strong_count", "fixed_count", "weight", "you", "near_you", "capitals", "all_capitals", "exclamation", "punctuation", "mixed", "hidden", "masked", "log_words", "top"]

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])

#: Words without the symbols around and in them; and with symbols read as letters.
_BARE = SPACED.copy()
_BARE[_SYMBOL] = 0
_FOLDED = SPACED.copy()
for _a, _b in LEET.items():
    _FOLDED[ord(_a)] = ord(_b) + 1


def _hash(word: str) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(words(data, np.array([0, len(data)]), SPACED)[0][0])


def bare_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words of letters and digits, where they start, and each row's first."""
    return words(data, bounds, _BARE)


STEMS = (4, 5, 6)


def with_stems(data: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of bare words, then of their first 4, 5 and 6 bytes (0 for shorter words); starts, and each row's first."""
    h, s, first = bare_words(data, bounds)
    t, up = np.concatenate([_BARE[data], np.zeros(max(STEMS), np.uint64)]), powers(max(STEMS) + 1)[0]
    # a word ends before the next separator: its length is known from the bytes that follow
    ends = np.searchsorted(edges := np.flatnonzero(t == 0), s)
    size = np.minimum(edges[ends], bounds[np.repeat(np.arange(len(bounds) - 1), np.diff(first)) + 1]) - s if len(s) else s
    out, total = [h], np.zeros(len(s), np.uint64)
    for k in range(max(STEMS)):
        total = total + t[s + k] * up[k]
        if k + 1 in STEMS:
            out.append(np.where(size > k + 1, mix(total + np.uint64(k + 1)), np.uint64(0)))
    return out, s, first


def folded_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the spaced words with symbols read as letters, for those that have some between letters; and their rows."""
    odd = _SYMBOL[data] | ((data >= 48) & (data <= 57))
    space = SPACED[data] == 0
    h, s, first = words(data, bounds, _FOLDED)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    if not len(s):
        return h, row
    inner = np.zeros(len(data), bool)
    inner[1:-1] = odd[1:-1] & _LETTER[data[:-2]] & (_LETTER[data[2:]] | odd[2:])
    inner &= ~space
    keep = np.logical_or.reduceat(inner, s)
    return h[keep], row[keep]


def lexicon(sample: DataFrame) -> dict[int, float]:
    """Log odds of at most ``LEXICON_WORDS`` words and stems that mark the toxic rows of sample (text, y), by their hashes."""
    schema = pa.schema([("h", pa.int64()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False) > 0
            for a, b, data, bounds in blocks(batch.column(0)):
                forms, _, first = with_stems(data, bounds)
                sets = [np.unique(np.concatenate([f[x:z] for f in forms])) for x, z in zip(first[:-1], first[1:])]
                toxic = [s for s, t in zip(sets, y[a:b]) if t]
                clean = [s for s, t in zip(sets, y[a:b]) if not t]
                both = [np.unique(np.concatenate(x) if x else np.zeros(0, np.uint64), return_counts=True) for x in (toxic, clean)]
                for k, (v, n) in enumerate(both):
                    zero = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(n if k == 0 else zero), pa.array(n if k else zero)], schema=schema)

    total = sample.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    t_all, n_all = total["t"] or 0.0, total["n"]
    if not t_all or t_all == n_all:
        return {}
    n = sample.select("text", "y").mapInArrow(run, "h long, toxic long, clean long").groupBy("h").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where("t >= 2")
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / (F.lit(t_all) - F.col("t") + 0.5)) - F.log(c / (F.lit(n_all - t_all) - F.col("c") + 0.5))
    n = n.select("h", odds.alias("odds"), (odds / F.sqrt(1 / t + 1 / c)).alias("z")).where(F.col("z") >= LEAST_Z)
    return {r["h"]: r["odds"] for r in n.orderBy(F.desc("z"), "h").limit(LEXICON_WORDS).collect()}


class Features:
    """Dense features of a block's rows, in the order of FEATURES."""

    def __init__(self, marks: dict[int, float]):
        odds = sorted((int(np.int64(h).view(np.uint64)), o) for h, o in marks.items())
        keys, weights = np.array([h for h, _ in odds], dtype=np.uint64), np.array([o for _, o in odds])
        fixed = np.array(sorted(_hash(w) for w in INSULTS), dtype=np.uint64)
        you = np.array(sorted(_hash(w) for w in YOU), dtype=np.uint64)
        strong = keys[weights >= math.log(20)]
        self.keys, self.weights, self.strong, self.fixed, self.you = keys, weights, strong, fixed, you

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        keys, weights, strong, fixed, you = self.keys, self.weights, self.strong, self.fixed, self.you
        rows = len(bounds) - 1
        forms, s, first = with_stems(data, bounds)
        h, n = forms[0], np.diff(first)
        row = np.repeat(np.arange(rows), n)
        add = lambda r, w=None: np.bincount(r, weights=w, minlength=rows)[:rows]
        per = lambda x, of: x / np.maximum(of, 1)
        weight = np.zeros(len(h))
        if len(keys):
            for f in forms:
                at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
                weight = np.maximum(weight, np.where(keys[at] == f, weights[at], 0.0))
        # a word is a strong mark if its odds are twenty times those of other words
        is_strong, is_fixed, is_you = weight >= math.log(20), np.isin(h, fixed), np.isin(h, you)
        near = np.zeros(len(h), bool)
        for k in range(1, NEAR + 1):
            same = row[k:] == row[:-k]
            near[k:] |= is_you[:-k] & same
            near[:-k] |= is_you[k:] & same
        size = np.diff(bounds)
        chars = np.repeat(np.arange(rows), size)
        letters, upper, symbol = _LETTER[data], _UPPER[data], _SYMBOL[data]
        bang = (data == 33) | (data == 63)
        caps = np.logical_and.reduceat(upper | ~letters, s) & np.logical_and.reduceat(~((data >= 97) & (data <= 122)), s) & upper[s] if len(s) else np.zeros(0, bool)
        folded, folded_row = folded_words(data, bounds)
        hidden = np.isin(folded, np.concatenate([strong, fixed]))
        star = np.zeros(len(data), bool)
        star[1:-1] = (data[1:-1] == 42) & letters[:-2] & (letters[2:] | (data[2:] == 42))
        marked = is_strong | is_fixed
        top = np.zeros(rows)
        np.maximum.at(top, row, weight)
        return np.stack([
            per(add(row, is_strong.astype(float)), n), per(add(row, (weight > 0).astype(float)), n), per(add(row, is_fixed.astype(float)), n), add(row, is_strong.astype(float)), add(row, is_fixed.astype(float)), per(add(row, weight), n),
            per(add(row, is_you.astype(float)), n), per(add(row, (near & marked).astype(float)), n), per(add(chars, upper.astype(float)), add(chars, letters.astype(float))), per(add(row, caps.astype(float)), n),
            per(add(chars, bang.astype(float)), size), per(add(chars, symbol.astype(float)), size), per(add(folded_row), n), add(folded_row, hidden.astype(float)), add(chars, star.astype(float)), np.log1p(n), top,
        ], axis=1)


def dense(df: DataFrame, marks: dict[int, float], text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """df's kept columns and ``features``, an array in the order of FEATURES; a null or empty text has zeros."""
    features = Features(marks)
    kept = list(keep)
    schema = df.select(*kept, F.lit(None).cast("array<double>").alias("features")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(data, bounds) for _, _, data, bounds in blocks(batch.column(len(kept)))]
            flat = np.concatenate(found) if found else np.zeros((0, len(FEATURES)))
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * len(FEATURES)), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_pydict({c: batch.column(i) for i, c in enumerate(kept)} | {"features": arrays})

    return df.select(*kept, F.col(text_col).alias("__text")).mapInArrow(run, schema)


class Toxicity:
    """A fitted lexicon, trees and calibration."""

    def __init__(self, marks, trees, calibration):
        self.marks, self.trees, self.calibration = marks, trees, calibration

    def score(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score), one row per input row; rows that repeat score alike.

        The calibrated step function has ties; a hundredth of the trees' own
        probability orders them.
        """
        source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        if self.trees is None:
            return source.select("doc_id", F.lit(0.0).alias("score"))
        own = self._own(dense(source, self.marks, keep=["doc_id"]), "doc_id")
        if self.calibration is None:
            return own.select("doc_id", F.col("own").alias("score"))
        out = self.calibration.transform(own)
        return out.select("doc_id", (0.99 * F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)) + 0.01 * F.col("own")).alias("score"))

    def _own(self, features: DataFrame, *keep: str) -> DataFrame:
        out = self.trees.transform(features.select(*keep, array_to_vector("features").alias("features")))
        return out.select(*keep, vector_to_array("probability")[1].alias("own"))


def fit(df: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Toxicity:
    """Fits on at most ``sample_rows`` labelled rows outside the held-out fold: three quarters for lexicon and trees, one for calibration.

    Without labelled rows of both kinds every score is 0.
    """
    sample = labelled_sample(df, labels, label_col, id_col, text_col, sample_rows)
    part = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4))
    learn, check = sample.where(part != 0), sample.where(part == 0)
    marks = lexicon(learn)
    train = cut(dense(learn, marks, keep=["y"]).coalesce(4))  # some 200 bytes a row: the trees' many small jobs read no text again
    kinds = {r["y"] for r in learn.groupBy("y").count().collect()}
    if kinds != {0.0, 1.0}:
        return Toxicity(marks, None, None)
    trees = GBTClassifier(labelCol="y", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=7, maxMemoryInMB=64, cacheNodeIds=False).fit(train.select("y", array_to_vector("features").alias("features")))
    model = Toxicity(marks, trees, None)
    held = cut(model._own(dense(check, marks, keep=["y"]), "y"))
    if {r["y"] for r in check.groupBy("y").count().collect()} == {0.0, 1.0}:
        model.calibration = IsotonicRegression(labelCol="y", featuresCol="own", isotonic=True).fit(held)
    return model
