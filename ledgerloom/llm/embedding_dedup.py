"""Near-duplicate embeddings by spherical-cap filters with structured random product codes.

A filter is a direction: one random codeword for each block of coordinates. A
vector belongs to every filter whose direction it exceeds a height for, found
block by block, without going through all products of codewords. Rows of one
filter and label are sorted next to each other, a large filter in tiles, and are
compared there: as 16-bit copies that travel with them, with a bound on their
error; the few pairs that the bound leaves open are confirmed in double
precision on the vectors themselves. Pairs are not emitted: a pair counts in the
least of the filters that both vectors have, and each task returns counts by
vector and what joins its vectors. Copies of a vector are one member with a count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .components import components
from .lineage import cut, drop
from .salted import looked_up, salt, salts_of, spread, with_facts

COSINE = 0.93
FILTERS = 24
LEAST_FILTERS = 12
BUCKET = 4
TILE = 256

#: Rows of one filter from which on a task compares them as one product of matrices.
LARGE_GROUP = 24

#: Codewords of one block at most; more vectors take one block more, so that a code stays below 20 MB.
MOST_WORDS = 16_384


def vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): v is the vector as doubles in bytes, null if it links with nothing."""
    schema = pa.schema([("id", pa.int64()), ("label", pa.string()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            labelled = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            out = np.full(batch.num_rows, None, dtype=object)
            for d in np.unique(size[labelled & (size > 0)]).tolist():
                at = np.flatnonzero(labelled & (size == d))
                x = pc.list_flatten(column.take(pa.array(at))).to_numpy(zero_copy_only=False).reshape(-1, d) + 0.0  # a null part is NaN here
                ok = np.isfinite(x).all(axis=1) & x.any(axis=1)
                for i, row in zip(at[ok].tolist(), x[ok]):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out.tolist(), pa.binary())], schema=schema)

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    return source.mapInArrow(run, "id long, label string, v binary")


def units(raw: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of vectors in bytes, for each number of dimensions among them."""
    size, out = np.array([len(r) for r in raw]), []
    for d in np.unique(size).tolist():
        at = np.flatnonzero(size == d)
        x = np.frombuffer(b"".join([raw[i] for i in at.tolist()]), dtype=np.float64).reshape(len(at), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the norm
        out.append((at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))))
    return out


class Code:
    """Random product code for one number of dimensions: the same on every executor, as it follows from its seed."""

    def __init__(self, d: int, words: int, blocks: int = 2, filters: int = FILTERS, least: int = LEAST_FILTERS, seed: int = 11):
        rng = np.random.default_rng([seed, d, words, blocks])
        self.blocks = min(blocks, d)
        self.turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        self.parts = np.array_split(np.arange(d), self.blocks)
        self.books = [rng.standard_normal((words, len(p))) / math.sqrt(d) for p in self.parts]
        self.words, self.least = words, least
        share = min(0.5, filters / float(words) ** self.blocks)
        self.height = NormalDist().inv_cdf(1 - share) / math.sqrt(d)

    def scores(self, x: np.ndarray) -> Iterator[list[np.ndarray]]:
        """For each unit vector, its inner products with the codewords of every block."""
        x = x @ self.turn.T
        return zip(*(x[:, p] @ b.T for p, b in zip(self.parts, self.books)))

    def filters(self, tops: list[np.ndarray]) -> np.ndarray:
        """Numbers of the filters that a vector of these scores exceeds, sorted; with a lower height if they are fewer than ``least``."""
        rest = np.cumsum([t.max() for t in tops][::-1])[::-1].tolist() + [0.0]
        low = self.height
        for attempt in range(60):
            found, scores = np.zeros(1, np.int64), np.zeros(1)
            for k, t in enumerate(tops):
                order = np.argsort(-t)
                # of each prefix, the codewords that can still reach the height
                many = np.searchsorted(-t[order], -(low - rest[k + 1] - scores), side="right")
                at = np.repeat(np.arange(len(scores)), many)
                word = order[np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)] if len(at) else np.zeros(0, np.int64)
                found, scores = found[at] * self.words + word, scores[at] + t[word]
            if len(found) >= min(self.least, self.words**self.blocks):
                break
            low -= 0.02 + 0.01 * attempt
        return np.sort(found)


_codes: dict[tuple[int, int, int], Code] = {}


def code_for(d: int, n_words: int, n_blocks: int) -> Code:
    if (d, n_words, n_blocks) not in _codes:
        _codes[d, n_words, n_blocks] = Code(d, n_words, n_blocks)
    return _codes[d, n_words, n_blocks]


def filed(classes: DataFrame, n_words: int, n_blocks: int) -> DataFrame:
    """(f, lab, k, copies, filters, q, scale, off): each class of vectors once for each of its filters.

    lab tells label and dimensions apart, q holds 16-bit parts, ``off`` is how far q * scale is from the unit vector.
    """
    schema = pa.schema([("f", pa.int64()), ("lab", pa.int64()), ("k", pa.int64()), ("copies", pa.int64()), ("filters", pa.list_(pa.int64())), ("q", pa.binary()), ("scale", pa.float64()), ("off", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                for at, x in units(part.column(3).to_pylist()):
                    found = [code_for(x.shape[1], n_words, n_blocks).filters(t) for t in code_for(x.shape[1], n_words, n_blocks).scores(x)]
                    scale = np.abs(x).max(axis=1, keepdims=True) / 32767
                    q = np.rint(x / scale).astype(np.int16)
                    off = np.sqrt(((x - q * scale) ** 2).sum(axis=1))
                    many = np.array([len(f) for f in found])
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(np.concatenate(found)))
                    rows = pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), part.column(2).take(pa.array(at)), lists, pa.array([r.tobytes() for r in q], pa.binary()), pa.array(scale[:, 0]), pa.array(off)], names=["lab", "k", "copies", *schema.names[4:]])
                    out = rows.take(pa.array(np.repeat(np.arange(len(at)), many)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *out.columns], schema=schema)

    source = classes.select(F.xxhash64(F.lit(7), "label", F.length("v")).alias("lab"), F.col("d1").alias("k"), "copies", "v")
    return source.mapInArrow(run, "f long, lab long, k long, copies long, filters array<long>, q binary, scale double, off double")


def compared(rows: DataFrame, cosine: float) -> DataFrame:
    """(kind, a, b, n): what the rows of each (lab, f, i, j) say of their vectors.

    kind 0: vector a has n more links; 1: a and b are joined by links; 2: the
    bound leaves open whether a and b are linked. The rows of one group, two
    tiles at most, come one after another; a group may go on in the next batch.
    """
    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def small_pairs(t: dict[str, np.ndarray], group: np.ndarray, q: np.ndarray, lists: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(x, y, sure) of near pairs within groups of a few rows, for all groups at once."""
        longest = np.diff(np.flatnonzero(np.concatenate([[True], np.diff(group) != 0, [True]]))).max(initial=0)
        for step in range(1, longest):
            x = np.flatnonzero((group[step:] == group[:-step]) & ((t["i"] == t["j"])[:-step] | (t["tile"][step:] != t["tile"][:-step])))
            y = x + step
            dot = np.einsum("ij,ij->i", q[x], q[y])
            off = t["off"][x] + t["off"][y] + t["off"][x] * t["off"][y] + 1e-12
            near = dot + off >= cosine
            x, y, sure = x[near], y[near], (dot - off)[near] >= cosine
            for k in range(0, len(x), 4096):
                a, b = x[k : k + 4096], y[k : k + 4096]
                least = np.where((lists[a][:, :, None] == lists[b][:, None, :]).any(axis=2), lists[a], np.iinfo(np.int64).max).min(axis=1)
                mine = least == t["f"][a]
                yield a[mine], b[mine], sure[k : k + 4096][mine]

    def large_pairs(t: dict[str, np.ndarray], at: np.ndarray, q: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same for one group, as products of matrices."""
        dot = q[at] @ q[at].T
        off = t["off"][at]
        off = off[:, None] + off + off[:, None] * off + 1e-12
        near = np.triu(dot + off >= cosine, 1)
        if t["i"][at[0]] != t["j"][at[0]]:
            near &= t["tile"][at][:, None] != t["tile"][at]
        row, column = np.nonzero((lists[at] >= 0) & (lists[at] < t["f"][at[0]]))
        lower, number = np.unique(lists[at][row, column], return_inverse=True)
        has = np.zeros((len(at), len(lower)), np.float32)
        has[row, number] = 1
        x, y = np.nonzero(near & (has @ has.T == 0))  # no filter of both is less
        return at[x], at[y], (dot - off)[x, y] >= cosine

    def result(t: dict[str, np.ndarray], group: np.ndarray, q: np.ndarray, lists: np.ndarray) -> pa.RecordBatch:
        n, label, open_pairs = np.zeros(len(group), np.int64), np.arange(len(group)), []
        linked: list[tuple[np.ndarray, np.ndarray]] = []
        edge = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0, [True]]))
        size = np.repeat(np.diff(edge), np.diff(edge))
        few = np.flatnonzero(size < LARGE_GROUP)
        found = small_pairs({c: v[few] for c, v in t.items()}, group[few], q[few], lists[few])
        found = chain(((few[x], few[y], sure) for x, y, sure in found), (large_pairs(t, np.arange(a, b), q, lists) for a, b in zip(edge, edge[1:]) if b - a >= LARGE_GROUP))
        for x, y, sure in found:
            open_pairs.append((t["k"][x[~sure]], t["k"][y[~sure]]))
            x, y = x[sure], y[sure]
            n += np.bincount(x, t["copies"][y], len(n)).astype(np.int64) + np.bincount(y, t["copies"][x], len(n)).astype(np.int64)
            linked.append((x, y))
        if linked:
            a, b = (np.concatenate(c) for c in zip(*linked))
            while True:  # the least place that links reach
                before = label.copy()
                low = np.minimum(label[a], label[b])
                np.minimum.at(label, a, low)
                np.minimum.at(label, b, low)
                label = label[label]
                if (label == before).all():
                    break
        some, moved = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(label)))
        left, right = (np.concatenate(c) for c in zip(*open_pairs)) if open_pairs else (np.zeros(0, np.int64),) * 2
        kind = np.repeat(np.arange(3, dtype=np.int32), [len(some), len(moved), len(left)])
        a = np.concatenate([t["k"][some], t["k"][moved], left])
        b = np.concatenate([t["k"][some], t["k"][label[moved]], right])
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b), pa.array(np.concatenate([n[some], np.zeros(len(kind) - len(some), np.int64)]))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in chain(batches_of(batches), [None]):
            table = pa.Table.from_batches([b for b in (kept, batch) if b is not None]).combine_chunks() if kept is not None or batch is not None else None
            if table is None or not table.num_rows:
                continue
            table = table.to_batches()[0]
            t = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("f", "lab", "i", "j", "tile", "k", "copies", "scale", "off")}
            new = np.concatenate([[True], np.any([np.diff(t[c]) != 0 for c in ("f", "lab", "i", "j")], axis=0)])
            stop = len(new) if batch is None else int(np.flatnonzero(new)[-1])
            kept = table.slice(stop)
            if not stop:
                continue
            t, group = {c: v[:stop] for c, v in t.items()}, np.cumsum(new[:stop])
            size = pc.binary_length(table.column("q")).to_numpy(zero_copy_only=False)[:stop]
            lists, many = table.column("filters").slice(0, stop), pc.list_value_length(table.column("filters")).to_numpy(zero_copy_only=False)[:stop]
            wide = np.full((stop, many.max()), -1, np.int64)
            wide[np.arange(many.max()) < many[:, None]] = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            wide[wide < 0] = -1 - np.nonzero(wide < 0)[0]  # fillers are equal to nothing in another row
            raw = table.column("q").to_pylist()
            for d in np.unique(size).tolist():  # a group has vectors of one size
                at = np.flatnonzero(size == d)
                q = np.frombuffer(b"".join([raw[i] for i in at.tolist()]), dtype=np.int16).reshape(len(at), -1) * t["scale"][at, None]
                yield result({c: v[at] for c, v in t.items()}, group[at], q, wide[at])

    def batches_of(batches: Iterator[pa.RecordBatch], most: int = 4000) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, most):
                yield batch.slice(a, most)

    return rows.mapInArrow(run, "kind int, a long, b long, n long")


def tiled(rows: DataFrame) -> DataFrame:
    """rows of (lab, f) once for each pair i <= j of tiles of ``TILE`` that their own tile is part of; filters with one vector go."""
    out = with_facts(rows, ["lab", "f"], ["k"], [F.count("*").alias("size")], "size > 1")
    many = F.ceil(F.col("size") / TILE).cast("int")
    out = out.withColumn("many", many).withColumn("tile", F.pmod(F.xxhash64("k", F.lit(3)), F.col("many")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    return out.withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other")).drop("size", "many", "other")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Null, zero and non-finite vectors, vectors with null parts and vectors
    without label have no links; so do vectors of different lengths with each
    other. Equal vectors are linked. Rows without id count as links, but have
    no component and are kept. An empty table gives an empty result.
    """
    rows = cut(vectors(df, id_col, vector_col, label_col).withColumn("d1", F.xxhash64("label", "v")).withColumn("d2", F.xxhash64(F.lit(5), "v", "label")))
    usable = rows.where("v is not null")
    classes = cut(usable.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.min(F.struct("label", "v")).alias("x"), salts_of(["id"]).alias("mask")).select("d1", "d2", "first", "copies", "x.label", "x.v", "mask"))

    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    n_blocks = 2
    while (n_words := max(2, math.ceil((largest * FILTERS / BUCKET) ** (1 / n_blocks)))) > MOST_WORDS:
        n_blocks += 1
    members = cut(filed(classes, n_words, n_blocks))
    found = cut(compared(tiled(members).repartition("lab", "f", "i", "j").sortWithinPartitions("lab", "f", "i", "j"), cosine))
    drop(members)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            va, vb = units(batch.column(2).to_pylist()), units(batch.column(3).to_pylist())
            for (at, p), (_, q) in zip(va, vb):  # both of one size
                keep[at] = (p * q).sum(axis=1) >= cosine
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    open_pairs = found.where("kind = 2").select("a", "b")
    left = classes.select(F.col("d1").alias("a"), F.col("v").alias("va"), F.col("copies").alias("na"))
    right = classes.select(F.col("d1").alias("b"), F.col("v").alias("vb"), F.col("copies").alias("nb"))
    sure = looked_up(looked_up(open_pairs, "a", ["b"], left), "b", ["a"], right)
    sure = cut(sure.select("a", "b", "va", "vb").mapInArrow(confirm, "a long, b long"))

    ends = sure.union(sure.select("b", "a")).toDF("d1", "other").join(classes.select(F.col("d1").alias("other"), F.col("copies").alias("n")), "other").select("d1", "n")
    linked = found.where("kind = 0").select(F.col("a").alias("d1"), "n").union(ends).groupBy("d1").agg(F.sum("n").alias("n"))
    groups = components(found.where("kind = 1").select("a", "b").union(sure))
    told = classes.select("d1", "d2", "first", "copies", "mask").join(linked, "d1", "left").join(groups.withColumnRenamed("id", "d1"), "d1", "left")
    told = told.withColumn("component_id", F.coalesce("component_id", "d1"))
    told = with_facts(told, ["component_id"], ["d1"], [F.min("first").alias("component")])
    told = spread(told.select("d1", "d2", "mask", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "component"), "mask")

    out = rows.select("id", F.when(F.col("v").isNotNull(), F.col("d1")).alias("d1"), "d2", salt("id").alias("__salt")).join(told, ["d1", "d2", "__salt"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
