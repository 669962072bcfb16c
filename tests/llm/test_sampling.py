"""Importance resampling and fill-in-the-middle against brute force written from their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fill_middle, importance
from tests.llm.test_llm import ALNUM, documents, lower, odd_texts, prose


def draw(seed, doc_id, k=0):
    return int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16)


def grams(text, n):
    w = re.findall(ALNUM, lower(text))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def resampled(docs, target, n=1, buckets=10_000, percent=10, least=20):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for text in texts for x in grams(text, n)[0]) for texts in ([d[1] for d in docs], target))
    size = (sum(s.values()), sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (size[0] + buckets) / ((s[b] + 1) * (size[1] + buckets))))
    rows = []
    for doc_id, text in docs:
        found, words = grams(text, n)
        weight = sum(gain(bucket(x)) for x in found)
        rows.append([doc_id, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((draw(2024, doc_id) + 0.5) / 4294967296)))])
    able = sorted((k for k, r in enumerate(rows) if r[1] >= least), key=lambda k: (-rows[k][4], rows[k][0] is None, rows[k][0] or 0))
    rank = {k: i + 1 for i, k in enumerate(able[: percent * len(able) // 100])}
    return sorted(repr([*r, rank.get(k)]) for k, r in enumerate(rows))


@pytest.mark.parametrize(("n", "head", "percent"), [(1, 1 << 16, 10), (2, 30, 37), (2, 1 << 16, 100)])
def test_resample_equals_the_definition(spark, n, head, percent):
    rng = random.Random(n)
    texts = odd_texts(rng) + [prose(rng, rng.randint(0, 60)) for _ in range(120)] + ["Ünï cödé " * 15, "x" * 300 + " y" * 30] + [prose(random.Random(5), 40)] * 20
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, prose(random.Random(5), 40))] * 9 + [(None, prose(rng, 30))] * 2
    target = [None, "w1 w2 w3 w1", "the W7 w8", *[prose(rng, 30, ["w1", "w2", "zz"]) for _ in range(3)]]
    out = importance.resample(documents(spark, rows).repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), max_words=n, head=head, percent=percent)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(repr(list(r)) for r in out.collect()) == resampled(rows, target, n, percent=percent)


def test_resample_of_empty_tables(spark):
    none, some = documents(spark, []), documents(spark, [(1, "a b " * 20), (2, None)])
    assert importance.resample(none, some).count() == 0
    got = {r["doc_id"]: r for r in importance.resample(some, none, percent=100).collect()}
    assert got[1]["rank"] == 1 and got[2]["rank"] is None and got[2]["weight"] == 0
    with pytest.raises(ValueError):
        importance.resample(some, some, max_words=3)


def test_crc_from_states():
    rng = random.Random(3)
    parts = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 3, 9, 64, 65, 500]))) for _ in range(300)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    length = np.array([len(p) for p in parts])
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    before = [bytes([k % 256]) * (k % 5) for k in range(300)]
    got = importance.extend(np.array([zlib.crc32(b) for b in before], np.uint32), data, start, length)
    assert got.tolist() == [zlib.crc32(b + p) for b, p in zip(before, parts)]


def test_frequent_keys_survive():
    rng = random.Random(4)
    seen, true = importance.Frequent(10), Counter()
    for _ in range(400):
        some = Counter({rng.randrange(5000): 1 for _ in range(20)}) + Counter({k: rng.randint(1, 4) for k in range(-5, 0)})
        true += some
        seen.add(list(some), list(some.values()))
        assert len(seen.counts) <= 20
    assert {k for k, n in true.items() if n > sum(true.values()) / 10} <= set(seen.counts)


def middle(doc_id, text, unit="line", rate=100, spm=50, seed=7, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = [draw(seed, doc_id, k) for k in range(4)]
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return (doc_id, len(units), "plain", None, None, text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return (doc_id, len(units), "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m)
    return (doc_id, len(units), "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m)


def lined(rng):
    pieces = ["\n", "\n\n", "a", "é", "漢字", "😀", "<", ">", "P", "S>", "<S", "line one", "\r\n", " "]
    return "".join(rng.choices(pieces, k=rng.randint(0, 40)))


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("character", 100, 50), ("character", 60, 0), ("line", 0, 100)])
def test_fill_in_middle_equals_the_definition(spark, unit, rate, spm):
    rng = random.Random(2)
    texts = odd_texts(rng) + ["<P>", "a\n<M>b", "a<S", "\n", "é\n" * 40_000, "😀" * 30_000] + [lined(rng) for _ in range(300)]
    rows = [*enumerate(texts), (None, "a\nb\nc"), (None, None), (5, "x\ny"), (5, "x\ny")]
    out = fill_middle.fill_in_middle(documents(spark, rows).repartition(3), unit=unit, rate=rate, spm_rate=spm)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("again", fill_middle.restored()).collect()
    assert sorted(repr(tuple(r)[:6]) for r in got) == sorted(repr(middle(k, t, unit, rate, spm)) for k, t in rows)
    assert sorted(repr((r["doc_id"], r["again"])) for r in got) == sorted(repr((k, t or "")) for k, t in rows)


def test_fill_in_middle_of_an_empty_table_and_text_ids(spark):
    assert fill_middle.fill_in_middle(documents(spark, [])).count() == 0
    named = documents(spark, [(1, "a\nb")]).withColumn("name", F.lit("n1"))
    assert fill_middle.fill_in_middle(named, id_col="name").first()["output"] == middle("n1", "a\nb")[5]


def test_code_points_and_bytes():
    rng = random.Random(6)
    texts = [lined(rng) for _ in range(50)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    index = fill_middle.Exceptions(data)
    whole = "".join(texts)
    at = np.array([len(whole[:k].encode()) for k in range(len(whole) + 1)])
    assert index.bytes(np.arange(len(whole) + 1)).tolist() == at.tolist()
    assert index.characters(at).tolist() == list(range(len(whole) + 1))
