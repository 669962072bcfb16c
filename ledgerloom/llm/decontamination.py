"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton is built on the driver from blocks of items of bounded size; a
test set of up to a million words is one block. Each block is frozen into
sorted arrays, some 80 bytes a word, and broadcast. Training texts stream
through it where they lie, with no shuffle; with several blocks, the spans found
so far are written between them, so that a task holds one block at a time.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .blocks import ALNUM_BYTES, giving_back
from .lineage import cut, drop

WINDOW = 13
BLOCK_WORDS = 1_000_000


def tokens(text: bytes) -> list[bytes]:
    """Words of letters, digits and what is beyond ASCII, A-Z lowered."""
    return text.translate(ALNUM_BYTES).split()


class _Builder:
    """All substrings of the items' word sequences, while items are added: a state's edges, suffix link and longest string."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def append(self, last: int, c: int) -> int:
        """The state of the item so far with c at its end."""
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        """The shorter strings of q, reached from p, as a state of their own."""
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy


class Automaton:
    """The items' substrings as sorted arrays: edges by state and word, suffix links, lengths, and the items of each window's state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        #: Items without id mark words, but are not named.
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: k for k, name in enumerate(self.names)}
        build, whole, pairs, short = _Builder(), [], set(), []
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            pairs.update(a << 32 | b for a, b in zip(ids, ids[1:]))
            last = 0
            for i in ids:
                last = build.append(last, i)
            if len(ids) >= window:
                whole.append((number.get(name, -1), ids))
            elif ids:
                short.append((name, ids))
        #: Neighbouring words of items; a match of two words or more runs over these only.
        self.pairs = np.array(sorted(pairs), dtype=np.int64)
        self.shortest = min((min(len(w), window) for _, w in items if w), default=window)
        edges = sorted((s << 32 | c, t) for s, by in enumerate(build.next) for c, t in by.items())
        self.edges, self.targets = array("q", [e for e, _ in edges]), array("i", [t for _, t in edges])
        self.link, self.length = array("i", build.link), array("i", build.length)
        # which items a window's state stands for: each item is read through its own automaton, a window at a time
        owned = set()
        for k, ids in whole:
            state = size = 0
            for c in ids:
                state, size = self.trimmed(self.step(state, c), size + 1)
                if size == window:
                    owned.add((state, k))
        self.whole: dict[int, int] = {}  # state of an item shorter than the window: its length
        for name, ids in short:
            state = 0
            for c in ids:
                state = self.step(state, c)
            state = self.up(state, len(ids))
            owned.add((state, number.get(name, -1)))
            self.whole[state] = len(ids)
        owned = sorted((s, k) for s, k in owned if k >= 0)
        self.owned, self.owners = array("i", [s for s, _ in owned]), array("i", [k for _, k in owned])

    def step(self, state: int, c: int) -> int:
        """The state after one word more, or -1."""
        key = state << 32 | c
        at = bisect_left(self.edges, key)
        return self.targets[at] if at < len(self.edges) and self.edges[at] == key else -1

    def up(self, state: int, size: int) -> int:
        """The state of the suffix of that size."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def trimmed(self, state: int, size: int) -> tuple[int, int]:
        """A match that is longer than the window, cut to it. From a match of the window's size one word on, that is one link at most, however often words repeat."""
        return (self.up(state, self.window), self.window) if size > self.window else (state, size)

    def of(self, state: int) -> list[int]:
        """The numbers of the items whose window the state is."""
        return self.owners[bisect_left(self.owned, state) : bisect_right(self.owned, state)].tolist()

    def spans(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) spans of words in windows, and the items whose windows occur."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words], dtype=np.int64)
        hits: list[tuple[int, int]] = []
        states: set[int] = set()
        for a, b in self.runs(ids):
            state, size = 0, 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                after = self.step(state, c)
                while state and after < 0:
                    state = self.link[state]
                    size = self.length[state]
                    after = self.step(state, c)
                if after >= 0:
                    state, size = self.trimmed(after, size + 1)
                matched = 0
                if size == self.window:
                    matched = self.window
                    states.add(state)
                if self.whole:
                    s = state  # at most a window's links up to the root
                    while s > 0:
                        if (n := self.whole.get(s)) and n <= size:
                            matched = max(matched, n)
                            states.add(s)
                        s = self.link[s]
                if matched:
                    start = i + 1 - matched
                    if hits and hits[-1][1] >= start:
                        while hits and hits[-1][1] >= start:
                            start = min(start, hits.pop()[0])
                    hits.append((start, i + 1))
        return hits, {self.names[k] for s in states for k in self.of(s)}

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches that may hold a window: each pair of neighbours is one of some item, and there are enough."""
        if len(ids) < self.shortest or not len(self.pairs) and self.shortest > 1:
            return
        if self.shortest == 1:
            ok = ids > 0
        else:
            codes = ids[:-1] << 32 | ids[1:]
            at = np.searchsorted(self.pairs, codes)
            ok = self.pairs[np.minimum(at, len(self.pairs) - 1)] == codes
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.view(np.int8), [0]])))
        more = 0 if self.shortest == 1 else 1
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + more >= self.shortest:
                yield a, b + more


def automata(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[tuple[int, Broadcast]]:
    """(number of the blocks after it, broadcast automaton) for each block of items; a block has about ``block_words`` words or one item.

    The size of the test set is checked before any of it is fetched: from its
    characters follows the number of blocks, and one block at a time comes to
    the driver.
    """
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    many = max(1, -(-size // (5 * block_words)))
    for k in range(many):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(many)) == k)
        rows = [(r["item"], tokens(r["text"].encode())) for r in block.toLocalIterator()]
        yield many - 1 - k, items.sparkSession.sparkContext.broadcast(Automaton([r for r in rows if r[1]], window))


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] = (), clean: int | None = None) -> DataFrame:
    """Per row: id, text, n_words, spans (array of [start, end) word numbers, merged), items (array, sorted) and the kept columns.

    A span is a maximal stretch of words that lie in windows of ``window``
    consecutive words of some item; an item of fewer words is one window. Null
    and empty texts have no words and no spans; null items have no windows;
    items without id mark words, but are not among ``items``; a repeated row is
    judged like the first; an empty table gives an empty result. With ``clean``
    the text comes without the spans of so many words or more, as from
    :func:`remove_spans`, in the same step: a task has one Python worker then.
    """
    own = ["__id", "__text", "__n_words", "__spans", "__items"]
    spans = "array<struct<start:long,end:long>>"
    out = df.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), F.lit(0).cast("long").alias("__n_words"), F.lit(None).cast(spans).alias("__spans"), F.lit(None).cast("array<string>").alias("__items"), *keep)
    schema = out.schema
    for name in own:
        schema[name].nullable = True

    def step(handle: Broadcast, clean: int | None):
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())

        @giving_back
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = handle.value
            for batch in batches:
                for a in range(0, batch.num_rows, 500):
                    part = batch.slice(a, 500)
                    n, spans, items = [], [], []
                    for text, had, names in zip(pc.fill_null(part.column(1).cast(pa.large_binary()), b"").to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist()):
                        words = tokens(text)
                        found, seen = automaton.spans(words)
                        n.append(len(words))
                        spans.append([{"start": s, "end": e} for s, e in merged([*((x["start"], x["end"]) for x in had or ()), *found])])
                        items.append(sorted({*(names or ()), *seen}))
                    made = {"__n_words": pa.array(n, pa.int64()), "__spans": pa.array(spans, kinds[0]), "__items": pa.array(items, kinds[1])}
                    if clean is not None:
                        made["__text"] = _cleaned(part.column(1), spans, clean)
                    yield pa.RecordBatch.from_pydict({f.name: part.column(i) for i, f in enumerate(part.schema)} | made)

        return run

    before = None
    for left, handle in automata(benchmark, item_col, item_text_col, window, block_words):
        out = out.mapInArrow(step(handle, None if left else clean), schema)
        if left:
            out = cut(out)
            drop(before)
            before = out
    return out.withColumnsRenamed({c: c[2:] for c in own})


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans; those that touch or overlap are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def n_hit() -> F.Column:
    """Words in spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])


def contaminated() -> F.Column:
    """The verdict on a row of :func:`contamination`: 5 % of its words or more are hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    """The counts and the contamination verdict of each row of :func:`contamination`."""
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def remove_spans(found: DataFrame, least_words: int = WINDOW, keep: list[str] = ()) -> DataFrame:
    """(doc_id, text, kept columns) with the words of every span of ``least_words`` or more taken out; the rest keeps its bytes."""
    source = found.select("id", "text", "spans", *keep)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {f.name: batch.column(i) for i, f in enumerate(batch.schema) if f.name != "spans"}
            yield pa.RecordBatch.from_pydict(columns | {"text": _cleaned(batch.column(1), batch.column(2).to_pylist(), least_words)})

    return source.mapInArrow(run, source.drop("spans").schema).withColumnRenamed("id", "doc_id")


def _cleaned(texts: pa.Array, spans: list[list[dict] | None], least_words: int) -> pa.Array:
    """texts without the words of their spans of ``least_words`` or more."""
    out = []
    for text, found in zip(texts.to_pylist(), spans):
        long = [(x["start"], x["end"]) for x in found or () if x["end"] - x["start"] >= least_words]
        out.append(text if text is None or not long else _without(text.encode(), long).decode(errors="ignore"))
    return pa.array(out, texts.type)


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    inside = np.frombuffer(text.translate(ALNUM_BYTES), dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for s, e in spans:
        out.append(text[at : starts[s]])
        at = int(ends[e - 1])
    return b"".join([*out, text[at:]])
