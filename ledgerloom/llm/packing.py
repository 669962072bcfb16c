"""Packing documents into fixed-length token sequences: shortest-pack-first over the length histogram.

Each document is tokenized once, where it lies; only (start, length, checksum)
rows go on. The histogram of piece lengths has at most ``width`` rows, whatever
the corpus, and is all that the driver sees. It places the lengths longest
first, each into the shortest pack that has room, and works with counts of
packing patterns, not with packs. Pieces then find their place by their rank
among the pieces of their length.
"""

from __future__ import annotations

import heapq
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, Window as W

from .blocks import giving_back
from .lineage import cut

WIDTH = 2048
END_ID = 1
#: Words that a worker knows at most, and those that it keeps when they become more and after a task: the first ones, among which the frequent ones are.
CACHE_WORDS = 400_000
KEPT_WORDS = 100_000
SEGMENT = 1 << 20

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 10 else b for b in range(256))

#: ASCII symbols that no letters after an apostrophe make special.
_SYMBOLS = b"!#$%&()*+,-./:;=?@[]^_{|}~"

#: What a text may hold besides points and commas so that no run of symbols needs to be looked for.
_QUIET = bytes(b for b in range(256) if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789 " or 128 <= b < 192 or b == 0xC3)

#: A point or comma that may belong to a longer run of symbols: one after anything but ASCII letters, digits and the letters of Latin-1.
_RUN = re.compile(rb"(?:[^a-z0-9\x80-\xbf ]|(?<!\xc3)[\x80-\xbf]|\xc3[\x97\xb7])[.,] ")


def _has_run(text: bytes) -> bool:
    if text.translate(None, _QUIET).strip(b".,") or b"\xc3\x97" in text or b"\xc3\xb7" in text:
        return _RUN.search(text) is not None
    return b".." in text or b".," in text or b",." in text or b",," in text


def _words(text: bytes) -> list[bytes]:
    """A text's space-separated words, A-Z lowered; points and commas at the ends of words stand alone, as they do for the tokenizer, so that fewer words differ."""
    text = text.translate(_PLAIN) + b" "
    if not _has_run(text):
        text = text.replace(b". ", b" . ").replace(b", ", b" , ")
    return text.split(b" ")


def _is_plain(word: str) -> bool:
    """Letters only, before and after the tokenizer's normalisation."""
    return word.isalpha() and word.lower().isalpha() and unicodedata.is_normalized("NFC", word)


class WordIds:
    """Token ids of space-separated words, as bytes of little-endian 32-bit numbers, kept for words seen before.

    The tokenizer never joins characters across a space or a line feed and
    lowers letters, so a text's ids are those of its words in a row.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[ends] = True
        self.known: dict[bytes, bytes] = {b"": b""}

    def learn(self, new: set[bytes]) -> None:
        """Ids of new words. A word of letters is one piece for the tokenizer, so its last token alone ends a word: such words are encoded together."""
        known, letters, rest, tailed = self.known, [], [], []
        for w in new:
            if w.isalpha() or _is_plain(w.decode()):
                letters.append(w)
            elif (head := w.rstrip(_SYMBOLS)) and head != w and (head.isalpha() or _is_plain(head.decode())):
                tailed.append((w, head, w[len(head) :]))
            else:
                rest.append(w)
        # symbols after letters are a piece of their own
        if tailed:
            letters += {head for _, head, _ in tailed}.difference(known, letters)
            rest += {tail for _, _, tail in tailed}.difference(known, rest)
        if letters:
            ids = np.array(self.tokenizer.encode(b" ".join(letters).decode(), add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(letters) and stops[-1] == len(ids):
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                known.update(zip(letters, map(raw.__getitem__, map(slice, [0, *stops], stops))))
            else:
                rest += letters
        if rest:
            for w, e in zip(rest, self.tokenizer.encode_batch([w.decode() for w in rest], add_special_tokens=False)):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()
        known.update((w, known[head] + known[tail]) for w, head, tail in tailed)

    def forget(self) -> None:
        """All but the first words go."""
        self.known = dict(islice(self.known.items(), KEPT_WORDS))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        words = [_words(t) for t in texts]
        every = set().union(*words)
        new = every.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.forget()
            new = every.difference(self.known)
        if new:
            self.learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]

    def encode_long(self, text: bytes) -> bytes:
        """The ids of one text of any length, taken in segments that end at a space."""
        parts, a = [], 0
        while a < len(text):
            b = text.find(b" ", a + SEGMENT)
            b = len(text) if b < 0 else b
            parts += self.encode([text[a:b]])
            a = b + 1
        return b"".join(parts)


_word_ids: dict[str, WordIds] = {}


def _word_ids_at(path: str) -> WordIds:
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) for each document cut into pieces of at most ``width`` ids.

    A null or empty text has only the closing id. Rows that repeat are
    documents of their own; a null doc_id stays null.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, close = _word_ids_at(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = pc.fill_null(part.column(1).cast(pa.large_binary()), b"").to_pylist()
                short = [t if len(t) <= SEGMENT else b"" for t in texts]
                rows = []
                for key, text, raw in zip(part.column(0).to_pylist(), texts, ids.encode(short)):
                    raw = (raw if len(text) <= SEGMENT else ids.encode_long(text)) + close
                    n = len(raw) // 4
                    rows += [(key, s, min(width, n - s), zlib.crc32(raw[4 * s : 4 * (s + width)]), n) for s in range(0, n, width)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        ids.forget()

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def patterns(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths in a pack) and how many packs have each, by shortest-pack-first."""
    packs: dict[int, Counter] = defaultdict(Counter)  # used length: patterns
    used: list[int] = []  # a heap of the keys of packs

    def put(pattern: tuple[int, ...], n: int) -> None:
        size = sum(pattern)
        if not packs[size]:
            heapq.heappush(used, size)
        packs[size][pattern] += n

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            while used and not packs[used[0]]:
                heapq.heappop(used)
            if used and used[0] + length <= width:
                kinds = packs[used[0]]
                pattern, there = kinds.popitem()
                take = min(n, there)
                if there > take:
                    kinds[pattern] = there - take
                put((*pattern, length), take)
            else:
                take = max(1, n // max(1, width // length)) if 2 * length <= width else n
                put((length,), take)
            n -= take
    return [(p, n) for size in sorted(packs, reverse=True) for p, n in sorted(packs[size].items()) if n]


def places(found: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Rank ranges by length: from rank ``rank`` on, ``many`` pieces to a sequence, the first being ``sequence``."""
    rows, offsets, next_rank, sequence = [], [], Counter(), 0
    for pattern, n in found:
        starts = defaultdict(list)
        at = 0
        for length in pattern:
            starts[length].append(at)
            at += length
        for length, where in starts.items():
            rows.append((length, next_rank[length], len(where), sequence, len(offsets)))
            offsets += where
            next_rank[length] += n * len(where)
        sequence += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "many", "sequence", "offset_at"), table.T)) | {"offsets": np.array(offsets, dtype=np.int64)}


def ranked(df: DataFrame, total: int) -> DataFrame:
    """df with ``rank``: from 0, among the rows of the same length. No task sees all rows of a common length."""
    deal = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (1 << 16)))
    df = df.withColumn("deal", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(deal)))
    before = W.partitionBy("length").orderBy("deal").rowsBetween(W.unboundedPreceding, -1)
    first = df.groupBy("length", "deal").count().select("length", "deal", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(W.partitionBy("length", "deal").orderBy("doc_id", "start", "ids_crc32"))
    return df.withColumn("within", within).join(first, ["length", "deal"]).withColumn("rank", F.col("first") + F.col("within") - 1).drop("deal", "within", "first")


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id lies in one piece, each sequence is gapless from offset 0 and holds
    at most ``width`` ids. An empty table gives an empty result; null and empty
    texts, repeated rows and null ids are as in :func:`pieces`.
    """
    cutted = cut(pieces(df, tokenizer, id_col, text_col, width, end_id))
    histogram = {r["length"]: r["count"] for r in cutted.groupBy("length").count().collect()}  # at most width rows
    table = df.sparkSession.sparkContext.broadcast(places(patterns(histogram, width)))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = pa.schema([(c, pa.int64()) for c in (*names, "sequence_id", "offset")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = t["length"] << 44 | t["rank"]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            step, slot = np.divmod(rank - t["rank"][row], t["many"][row])
            out = [t["sequence"][row] + step, t["offsets"][t["offset_at"][row] + slot]]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(x, pa.int64()) for x in out], schema=schema)

    with_rank = ranked(cutted, sum(histogram.values())).select(*names, "rank")
    return with_rank.mapInArrow(place, ", ".join(f"{c} long" for c in schema.names))
