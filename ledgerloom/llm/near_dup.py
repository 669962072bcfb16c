"""Near-duplicate documents by a chosen-path set similarity join over word shingles.

A document's set holds its distinct shingles; copies of a set are one member
from the start. Each member has a pool of minwise tokens, and independent trees
branch the members by them: a node is a path of chosen tokens, and its members
agree on all of them. The trees' first nodes are chosen by three tokens. A node
that isn't small branches further, by one or two tokens that its path selects:
1 / threshold on average, so that a pair at the threshold is expected in as many
nodes at each level as at the one before.

Members that found links join are one component, and only what is not joined yet
is compared. A node is small if few of its members lie outside of its largest
component: these are compared with all others. In other nodes, members are held
against a few pivots, new ones at each level, so that a large group of near copies
is joined in a number of comparisons that grows with the group, not with its
square; then the node branches, the first time by set size too.

What is compared first are odd sketches: each element of a set flips one bit of
1024, so the bits in which two sketches differ count the elements that only one
set has. Sets of up to 1024 elements are sketched whole, larger ones by a
sample of their elements, a quarter at each level; a set that may be linked with
one of the next level is sketched at both. Only (node, member) rows move through
the trees; sketches are fetched for members of nodes that hold more than one
component, tokens for members of nodes that branch. Every link is confirmed on
the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .blocks import SPACED, blocks, follow, giving_back, mix, ragged, words
from .components import components
from .lineage import batches_of, cut, drop
from .salted import salt, salts_of, spread

TREES = 16
POOL = 48
ROOT_DEPTH = 3
LAST_DEPTH = 12
SMALL_NODE = 512
PART = 2048
TILE = 256
PIVOTS = 2
THRESHOLD = 0.8
SHINGLE = 2

#: Ids that may be broadcast, 8 bytes each, once they are counted.
BROADCAST_IDS = 1_000_000

#: Rows with texts, or with two, that go to Python at once.
BATCH = 1000

#: Bits of an odd sketch; as many elements of a set are sketched at most.
BITS = 1024

#: The 64-bit parts of a sketch.
PARTS = [f"q{k}" for k in range(BITS // 64)]

#: Standard deviations by which two sketches may differ more than those of a pair at the threshold are expected to: one in 30,000 such pairs does.
SLACK = 4

_ODD = 0x9E3779B97F4A7C15


def shingle_sets(data: np.ndarray, bounds: np.ndarray, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a block; shorter rows have their whole sequence as one."""
    h, _, first = words(data, bounds, SPACED)
    grams = h
    for k in range(1, shingle):
        grams = follow(grams[:-1], h[k:]) if len(grams) > 1 else grams[:0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= shingle:
            yield np.unique(grams[a : b - shingle + 1])
        elif b > a:
            one = h[a : a + 1]
            for k in range(a + 1, b):
                one = follow(one, h[k : k + 1])
            yield mix(one ^ np.uint64(0x5BD1E995))
        else:
            yield np.zeros(0, np.uint64)


def _minima(values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), 0xFFFFFFFF, np.uint64)
    for a in range(0, len(values), 2048):
        np.minimum(out, (((values[a : a + 2048, None] * factors) >> np.uint64(32))).min(axis=0), out=out)
    return out


def _odd_sketches(hashes: np.ndarray, level: int, levels: int) -> np.ndarray:
    """The odd sketches of a set at ``levels`` levels from ``level`` on, as 64-bit parts one after the other."""
    h = mix(hashes ^ np.uint64(0x2545F4914F6CDD1D))
    out = []
    for k in range(level, level + levels):
        drawn = h if k == 0 else h[(h >> np.uint64(64 - 2 * k)) == 0]
        odd = np.bincount((drawn & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
    return np.concatenate(out)


def sketches(df: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float = THRESHOLD, pool: int = POOL) -> DataFrame:
    """(id, n, d1, d2, tokens, lv, q): set size, digest, the pool of minwise tokens, the level of the odd sketch and its parts, followed by those of the next level if links may reach it."""
    factors = mix(np.arange(1, pool + 1, dtype=np.uint64)) | np.uint64(1)
    percent = round(100 * threshold)
    names = {"id": pa.int64(), "n": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "tokens": pa.list_(pa.int32()), "lv": pa.int32(), "q": pa.list_(pa.int64())}
    schema = pa.schema(list(names.items()))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, bounds in blocks(batch.column(1)):
                n, d, tokens, levels, parts = [], [], [], [], []
                for s in shingle_sets(data, bounds, shingle):
                    n.append(len(s))
                    level = 0
                    while len(s) > BITS << 2 * level:
                        level += 1
                    levels.append(level)
                    if len(s):
                        tokens.append(_minima(s, factors).astype(np.uint32).view(np.int32))
                        parts.append(_odd_sketches(s, level, 1 + (100 * len(s) >= percent * (BITS << 2 * level))))
                        d.append((mix(s).sum(dtype=np.uint64), mix(s * np.uint64(_ODD)).sum(dtype=np.uint64)))
                    else:
                        tokens.append(np.zeros(0, np.int32))
                        parts.append(np.zeros(0, np.int64))
                        d.append((np.uint64(0), np.uint64(0)))
                signed = [np.array(x, dtype=np.uint64).view(np.int64) for x in zip(*d)]
                columns = [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(signed[0]), pa.array(signed[1]), ragged(tokens, pa.int32()), pa.array(levels, pa.int32()), ragged(parts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, d1 long, d2 long, tokens array<int>, lv int, q array<long>")


def _levels() -> Column:
    """The one or two levels at which a member is sketched."""
    return F.sequence("lv", F.col("lv") + F.when(F.size("q") > len(PARTS), 1).otherwise(0))


def marks_of(members: DataFrame) -> DataFrame:
    """(id, lv, n, q0, ...): the odd sketches of each member, a row for each level."""
    each = members.select("id", "n", "q", F.posexplode(_levels()).alias("k", "lv"))
    return each.select("id", "lv", "n", *(F.get("q", F.col("k") * len(PARTS) + i).alias(q) for i, q in enumerate(PARTS)))


def first_nodes(members: DataFrame, trees: int, root_depth: int, pool: int) -> DataFrame:
    """(path, id, lv): the first node of each member in each tree and at each of its levels, by ``root_depth`` different tokens of the pool."""
    rng = np.random.default_rng(9)
    chosen = [rng.choice(pool, root_depth, replace=False).tolist() for _ in range(trees)]
    paths = F.array(*(F.xxhash64(F.lit(t), "lv", *(F.element_at("tokens", k + 1) for k in at)) for t, at in enumerate(chosen)))
    return members.select("id", "tokens", F.explode(_levels()).alias("lv")).select(F.explode(paths).alias("path"), "id", "lv")


def by_size(rows: DataFrame, threshold: float) -> DataFrame:
    """rows with their nodes split by set size: linked sets differ in size by the threshold at most, so they share one of two neighbouring bands."""
    band = F.floor(F.log("n") / F.log(F.lit(1.0001 / threshold)))
    return rows.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("path", F.xxhash64("path", "band")).drop("band")


def branches(rows: DataFrame, tokens: DataFrame, depth: int, threshold: float, pool: int) -> DataFrame:
    """The nodes one level below those of rows: each path selects one token, and a second with the probability that makes 1 / threshold on average."""
    draw = lambda k: F.pmod(F.xxhash64("path", F.lit(depth), F.lit(k)), F.lit(pool)).cast("int") + 1
    second = F.pmod(F.xxhash64("path", F.lit(depth), F.lit(-1)), F.lit(1000)) < round(1000 * (1 / threshold - 1))
    at = F.array_distinct(F.when(second, F.array(draw(0), draw(1))).otherwise(F.array(draw(0))))
    below = rows.join(tokens, "id").withColumn("at", F.explode(at))
    return below.select(F.xxhash64("path", "at", F.element_at("tokens", F.col("at"))).alias("path"), "id", "lv")


def _distance(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return reduce(add, (F.bit_count(F.col(f"{a}.{q}").bitwiseXOR(F.col(f"{b}.{q}"))) for q in PARTS))


def _may_link(a: str, b: str, threshold: float) -> Column:
    """Sizes and sketches, of one level, allow a link.

    Sets at the threshold differ in (n1 + n2) (1 - threshold) / (1 + threshold)
    elements. Of sets sketched whole, no pair at the threshold fails for having
    more bits than that; beyond, and for samples, the expected number of bits
    and ``SLACK`` standard deviations decide.
    """
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    percent = round(100 * threshold)
    whole = F.col(f"{a}.lv") == 0
    apart = F.pow(F.lit(0.25), F.col(f"{a}.lv")) * (n1 + n2) * F.lit((100 - percent) / (100 + percent))
    near, twice = F.exp(-apart / (BITS / 2)), F.exp(-apart / (BITS / 4))
    deviation = F.sqrt((1 - twice) * (BITS / 4) - F.when(whole, apart * twice).otherwise(0.0))
    most = (1 - near) * (BITS / 2) + SLACK * deviation + 1
    sizes = 100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)
    return sizes & (_distance(a, b) <= F.when(whole, F.least(most, apart + 1e-6)).otherwise(most))


def _few(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if a count finds them few; joined by a shuffle else, with the same result."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def texts_of(ids: DataFrame, df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the documents with these ids (a column id)."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.join(_few(ids), "id", "left_semi")


def without_ids(df: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """df without the rows that have one of these ids (a column of the same name); rows without id stay."""
    return df.join(_few(cut(ids)), id_col, "left_anti")


def confirmed(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets have a similarity of the threshold or more, as a table; a may be one document of very many pairs."""
    pairs = cut(pairs.distinct())
    if pairs.isEmpty():
        return pairs
    percent = round(100 * threshold)
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                sets = [[s for _, _, data, bounds in blocks(part.column(c)) for s in shingle_sets(data, bounds, shingle)] for c in (2, 3)]
                keep = []
                for x, y in zip(*sets):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(len(x) > 0 and len(y) > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], schema=kind).filter(pa.array(keep, pa.bool_()))

    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = cut(texts_of(ids, df, id_col, text_col))  # of both sides: read once
    right = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    # the texts of a document with very many pairs go to several tasks
    left = spread(pairs.groupBy("a").agg(salts_of(["b"]).alias("mask")), "mask").join(texts.withColumnsRenamed({"id": "a", "text": "text_a"}), "a")
    met = right.withColumn("__salt", salt("b")).join(left, ["a", "__salt"])
    with batches_of(df.sparkSession, BATCH):
        out = cut(met.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct())
    drop(pairs, ids, texts)
    return out


def _placed(rows: DataFrame, labels: DataFrame, at: str, name: str) -> DataFrame:
    """rows with the component of the id in column ``at``; an id without links is its own."""
    return rows.join(labels.select(F.col("id").alias(at), F.col("component_id").alias(name)), at, "left").withColumn(name, F.coalesce(name, at))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links, which move whole components."""
    moved = components(_placed(_placed(links, labels, "a", "ca"), labels, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    to = moved.select(F.col("id").alias("component_id"), F.col("component_id").alias("to"))
    old = labels.join(to, "component_id", "left").select("id", F.coalesce("to", "component_id").alias("component_id"))
    out = cut(old.union(moved.join(labels, "id", "left_anti")))
    drop(moved, labels)
    return out


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends lie in different components."""
    return _placed(_placed(pairs, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb").select("a", "b")


def nearest_of_components(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each component the pair (a, b) with another one whose sketches differ least: no more pairs than components."""
    placed = _placed(_placed(pairs, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb")
    ends = placed.select(F.explode(F.array("ca", "cb")).alias("c"), "far", "a", "b")
    return ends.groupBy("c").agg(F.min(F.struct("far", "a", "b")).alias("x")).select("x.a", "x.b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, root_depth: int = ROOT_DEPTH, last_depth: int = LAST_DEPTH, small_node: int = SMALL_NODE, pool: int = POOL) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    Words lie between ASCII white space, A-Z lowered; a text of fewer words
    than a shingle has its whole sequence as its one shingle. At a threshold of
    0.8 a pair at the threshold shares a first node of one of 16 trees with a
    probability over 0.999, in crowds that stay large it still shares a node
    after two levels more with 0.99, after five with 0.97 and after nine, at
    the last depth, with 0.91 (simulated; a pair at 0.85 with 0.97). What is
    mixed at the last depth is compared exhaustively, whatever its size, in
    blocks. An odd sketch keeps one of 30,000 pairs at the threshold apart.

    Null and empty texts have the empty set and are linked with nothing. Rows
    with one id are one document, linked by any of its texts. Rows without id
    are kept, without component. An empty table gives an empty result.
    """
    with batches_of(df.sparkSession, BATCH):
        sketch = cut(sketches(df, id_col, text_col, shingle, threshold, pool))
    known = sketch.where("n > 0 and id is not null")
    classes = cut(known.groupBy("d1", "d2").agg(F.min("id").alias("rep"), salts_of(["id"]).alias("mask")))
    members = known.join(classes.select("d1", "d2", F.col("rep").alias("id")), ["id", "d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"])
    members = cut(members.select("id", "n", "tokens", "lv", "q"))
    marks = cut(marks_of(members))

    # ids with several texts join the classes of all of them
    several = known.groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("x"), F.max(F.struct("d1", "d2")).alias("y")).where("x <> y").select("id")
    own = known.join(several, "id", "left_semi").select("id", "d1", "d2").join(classes, ["d1", "d2"]).select(F.col("rep").alias("a"), F.col("id").alias("b"))

    # a few pivots of each node that holds two members or more: a member of a loose group is near one of them in some tree
    turn = lambda k: F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("turn"), "id"))["id"]
    first = first_nodes(members, trees, root_depth, pool)
    pivots = F.array_distinct(F.array(*(turn(k) for k in range(PIVOTS)))).alias("pivots")
    nodes = cut(first.groupBy("path").agg(F.count("*").alias("size"), pivots, F.min("lv").alias("lv"), salts_of(["id"]).alias("mask")).where("size > 1"))
    rows = cut(first.withColumn("__salt", salt("id")).join(spread(nodes.select("path", "mask"), "mask"), ["path", "__salt"]))

    # every member against that pivot of its first nodes whose sketch is nearest; the others are tried next, where this leaves them apart
    heads = spread(nodes.select("path", "lv", "mask", F.explode("pivots").alias("id")).join(marks, ["id", "lv"]).drop("lv"), "mask")
    stars = rows.join(marks, ["id", "lv"]).alias("r").join(heads.alias("p"), ["path", "__salt"]).where("r.id <> p.id").where(_may_link("r", "p", threshold))
    stars = cut(stars.groupBy(F.col("p.id").alias("a"), F.col("r.id").alias("b")).agg(F.min(_distance("r", "p")).alias("far")))
    drop(nodes)
    nearest = F.min(F.struct("far", "a"))["a"].alias("a")
    found = confirmed(stars.groupBy("b").agg(nearest).select("a", "b"), df, id_col, text_col, shingle, threshold)
    labels = components(found.union(own))
    drop(found)

    before, rows = rows, rows.drop("__salt")
    for depth in range(root_depth, last_depth + 1):
        # nodes that hold two components or more
        rows = cut(mixed_nodes(_placed(rows, labels, "id", "c"), marks, depth))
        drop(before)
        before = rows
        small = F.col("minor") <= small_node
        pairs = against_minor(rows.where(small), threshold)
        large = rows.where(~small)
        if depth == root_depth:
            pairs = pairs.union(_placed(_placed(stars, labels, "a", "ca"), labels, "b", "cb").where("ca <> cb").select("a", "b", "far"))
        last = depth == last_depth or large.isEmpty()
        if depth == last_depth:
            pairs = pairs.union(in_tiles(large, TILE, threshold))
        elif not last:
            pairs = pairs.union(against_pivots(large, marks, threshold))
        pairs = cut(pairs.groupBy("a", "b").agg(F.min("far").alias("far")))
        # first the nearest candidate of each component, then those that this leaves apart
        for part in (nearest_of_components, apart):
            found = confirmed(part(pairs, labels), df, id_col, text_col, shingle, threshold)
            if found.isEmpty():
                drop(found)
                continue
            labels = joined(labels, found)
            drop(found)
        drop(pairs)
        if last:
            break
        large = by_size(large, threshold) if depth == root_depth else large
        rows = branches(large, members.select("id", "tokens"), depth, threshold, pool)
    drop(stars)
    drop(before, members, marks)

    place = spread(_placed(classes, labels, "rep", "found"), "mask")
    out = sketch.select("id", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("d1")).alias("d1"), "d2", salt("id").alias("__salt"))
    out = out.join(place.select("d1", "d2", "__salt", "found"), ["d1", "d2", "__salt"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("found", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def mixed_nodes(rows: DataFrame, marks: DataFrame, depth: int) -> DataFrame:
    """rows (path, id, lv, c) of nodes with two components or more, with their sketches, the node's ``size``, the component ``main`` with most members, the number of ``minor`` members outside of it, and a pivot ``p`` (its id and component), a new one at each depth."""
    order = F.struct(F.xxhash64("id", F.lit(depth)).alias("turn"), "id", "c")
    by = rows.groupBy("path", "c").agg(F.count("*").alias("many"), F.min(order).alias("p"), salts_of(["id"]).alias("mask"))
    nodes = by.groupBy("path").agg(F.sum("many").alias("size"), F.max(F.struct("many", "c")).alias("most"), F.min("p").alias("p"), F.bit_or("mask").alias("mask"), F.count("*").alias("components")).where("components > 1")
    nodes = nodes.select("path", "size", F.col("most.c").alias("main"), (F.col("size") - F.col("most.many")).alias("minor"), "p", F.col("mask").alias("salts"), "mask")
    mixed = rows.withColumn("__salt", salt("id")).join(spread(nodes, "mask"), ["path", "__salt"])
    return mixed.join(marks, ["id", "lv"])


_SIDE = ["path", "id", "lv", "n", "c", *PARTS]


def _cross(x: DataFrame, y: DataFrame, on: list[str], also: str, threshold: float) -> DataFrame:
    met = x.alias("x").join(y.alias("y"), on).where(f"x.c <> y.c and {also}").where(_may_link("x", "y", threshold))
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"), _distance("x", "y").alias("far"))


def against_minor(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components in nodes with few minor members: each of these with every member of its node. Grows with the node, not with its square.

    A node's members are dealt into parts of some 2048, and its minor members go to every part: at most a quarter of the node's size in copies, and one copy in an ordinary node.
    """
    parts = F.ceil(F.col("size") / PART).cast("int")
    minor = rows.where("c <> main").select(*_SIDE, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return _cross(rows.select(*_SIDE, "main", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part")), minor, ["path", "part"], "(x.c = x.main or x.id > y.id)", threshold)


def against_pivots(rows: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components: every member of a node with the node's pivot."""
    nodes = rows.groupBy("path").agg(F.min("lv").alias("lv"), F.min("p.id").alias("id"), F.min("p.c").alias("c"), F.min("salts").alias("salts"))
    heads = spread(nodes.join(marks, ["id", "lv"]), "salts").select(*_SIDE, "__salt")
    return _cross(rows.select(*_SIDE, "__salt"), heads, ["path", "__salt"], "true", threshold)


def in_tiles(rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """All pairs (a, b) of different components of each node, tile by tile, so that no task holds a node."""
    tiles = F.ceil(F.col("size") / size).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(3)), tiles).cast("int")
    sides = []
    for k in (0, 1):
        other = F.sequence(own, tiles - 1) if k == 0 else F.sequence(F.lit(0), own)
        out = rows.select(*_SIDE, own.alias("own"), F.explode(other).alias("other"))
        i, j = ("own", "other") if k == 0 else ("other", "own")
        sides.append(out.select(*_SIDE, F.col(i).alias("i"), F.col(j).alias("j")))
    return _cross(*sides, ["path", "i", "j"], "(i < j or x.id < y.id)", threshold)
