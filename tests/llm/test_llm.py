"""The text and vector operators against brute force, on fixtures with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import blocks, components, decontamination, embedding_dedup, license_scan, line_dedup, near_dup, packing, quality, salted, substring_dedup, toxicity, url_filter
from ledgerloom.llm.queries import ORACLE, QUERIES, tokenizer_path

ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"


def lower(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def prose(rng, n, words=None):
    words = words or [f"w{k}" for k in range(400)]
    return " ".join(rng.choices(words, k=n))


def documents(spark, rows):
    """rows of (doc_id, text) with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"id": F.lit("x"), "key": F.lit(1), "n": F.lit(2), "score": F.lit("s"), "start": F.lit(None).cast("int"), "path": F.lit("p"), "label": F.lit("l")})


def odd_texts(rng):
    return [None, "", " ", "\n\n", "one", "One two", "ÀÉ ß ünïcode Straße", "!!! ... ???", "a" * 5000, prose(rng, 30_000), "tab\tand\x1cother\x85spaces", "é" * 300]


def grouped(links, ids):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("table", "pattern"), [(blocks.ALNUM, ALNUM), (blocks.SPACED, SPACED)])
def test_words_of_blocks(table, pattern):
    import pyarrow as pa

    rng = random.Random(1)
    texts = odd_texts(rng) + ["Mixed CASE x", "x mixed case", "x"]
    seen = {}
    for a, b, data, bounds in blocks.blocks(pa.array(texts), 1000):
        h, s, first = blocks.words(data, bounds, table)
        for k in range(a, b):
            want = re.findall(pattern, lower(texts[k]))
            got = h[first[k - a] : first[k - a + 1]].tolist()
            assert len(got) == len(want)
            for w, x in zip(want, got):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(600, 640)] + [(7, 7)]
    want = {i: c for i, c in grouped(links, range(700)).items() if any(i in x and x[0] != x[1] for x in links)}
    got = components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long"))
    assert {r["id"]: r["component_id"] for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_a_long_rising_path(spark):
    rounds = []
    out = components.components(spark.range(1000).selectExpr("id a", "id + 1 b"), rounds=rounds)
    assert out.where("component_id = 0").count() == out.count() == 1001
    assert len(rounds) <= 12 and rounds[0] == 1000


@pytest.mark.parametrize("n", [0, 3])
def test_salted_joins_equal_plain_ones(spark, n):
    rows = spark.range(n * 1000).selectExpr("id", "if(id % 3 = 0, 7, id % 50) k")
    out = salted.with_facts(rows, ["k"], ["id"], [F.count("*").alias("n")], "n > 1")
    assert sorted(map(tuple, out.groupBy("k", "n").count().collect())) == sorted((r["k"], r["n"], r["n"]) for r in rows.groupBy("k").agg(F.count("*").alias("n")).collect())
    table = spark.range(30).selectExpr("id k", "id * 2 v")
    for how in ("inner", "left"):
        got = salted.looked_up(rows, "k", ["id"], table, how)
        assert sorted(map(str, got.select("id", "k", "v").collect())) == sorted(map(str, rows.join(table, "k", how).select("id", "k", "v").collect()))


# 1


def brute_rule(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fits = [r for _, r in url_filter.RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def test_url_rules_and_ratio(spark):
    good = [f"http://site{k % 7}.com/news/{k}" for k in range(120)]
    bad = [f"http://site{k % 7}.net/es/zzq{k}" for k in range(120)]
    urls = [*good, *bad, "http://a.org/news/5", "http://a.org/es/zzq5", "HTTP://WWW.Example.COM/en/x?y", "http://example.com/en/", "http://com", "http://xcom/", "https://u@com/?/", "no scheme", "", None, "http://", "x://h?q/a", "http://com/", "http://a.org/" + "news/" * 20_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "gram": F.lit(2), "q": F.lit(3)})
    out = {r["page_id"]: r for r in url_filter.judge(df.union(df.where("page_id = 3"))).collect()}
    for k, u in enumerate(urls):
        assert (out[k]["host"], out[k]["path"], out[k]["rule"]) == brute_rule(u), u
        assert out[k]["rule"] is None or out[k]["verdict"] == dict((r, v) for v, r in url_filter.RULES)[out[k]["rule"]]
    assert out[240]["verdict"] == "allow" and out[241]["verdict"] == "block"
    assert url_filter.judge(df.where("false")).count() == 0


# 2


def brute_contamination(text, items):
    words = re.findall(ALNUM, lower(text))
    hit, names = set(), set()
    for name, item in items:
        w = re.findall(ALNUM, lower(item))
        size = min(13, len(w))
        windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for p in range(len(words) - size + 1) if size else ():
            if tuple(words[p : p + size]) in windows:
                hit.update(range(p, p + size))
                names.add(str(name))
    names.discard("None")  # items without id mark words, but are not named
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_words", [2_000_000, 10])
def test_decontamination(spark, block_words):
    rng = random.Random(3)
    few = ["a", "b", "c"]
    items = [(k, prose(rng, rng.choice([1, 5, 12, 13, 14, 40]), [f"q{j}" for j in range(9)])) for k in range(12)] + [(20, prose(rng, 30, few)), (21, None), (22, "!"), (23, prose(rng, 30)), (24, "q1 q2 rare"), (None, "q7 q7 q8"), (None, prose(rng, 20, few))]
    rows = [(k, t) for k, t in enumerate(odd_texts(rng))]
    rows += [(100 + k, prose(rng, 20) + " " + prose(rng, 15, [f"q{j}" for j in range(9)]) + " " + rng.choice(items[:12])[1] + ", " + prose(rng, 20)) for k in range(30)]
    rows += [(200 + k, prose(rng, 60, few)) for k in range(10)] + [(300, items[15][1].upper()), (301, " ".join(items[15][1].split()[3:17])), (302, " ".join(items[15][1].split()[3:15])), (300, items[15][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("id", F.lit(1))
    found = decontamination.contamination(documents(spark, rows), bench, block_words=block_words)
    got = sorted(map(tuple, decontamination.digest(found).collect()))
    assert got == sorted((k, *brute_contamination(t, items)) for k, t in rows)
    cut = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(found.where("id = 300 or id = 0 or id = 302")).collect()}
    assert cut[0] is None and cut[300] == "" and cut[302] == rows[-2][1]
    assert decontamination.contamination(documents(spark, []), bench).count() == 0


def test_automaton_size():
    """A block's broadcast is bounded: some 80 bytes a word, and the vocabulary."""
    import pickle

    rng = random.Random(23)
    items = [(str(k), prose(rng, 500, [f"x{j}" for j in range(3000)]).encode().split()) for k in range(60)]
    automaton = decontamination.Automaton(items)
    assert len(pickle.dumps(automaton)) < 110 * sum(len(w) for _, w in items)
    spans, names = automaton.spans([b"no", *items[7][1][100:140], b"x1", b"no"])
    assert spans == [(1, 41)] and "7" in names


# 3


def test_license_scan(spark):
    rng = random.Random(4)
    rows = list(enumerate(odd_texts(rng)))
    rows += [(100, "The MIT License, the mit-license; GNU General Public License"), (101, "mit the license"), (102, prose(rng, 50) + " Licensed under CC BY-NC 4.0. " + prose(rng, 9)), (103, "this program is free software you can also redistribute it and or modify it under the terms of the gnu general license"), (102, None), (None, "apache license")]
    rows += [(104, "Licensed under CC BY-SA 4.0 or licensed under CC BY 4.0"), (105, "licensed under cc-by the 4.0")]
    out = license_scan.scan(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = [t for k, t in rows if k == r["doc_id"] and len(re.findall(ALNUM, lower(t))) == r["n_words"]][0]
        w = re.findall(ALNUM, lower(text))
        at = [(p, label) for phrase, label in license_scan.PHRASES for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at})))
        assert 0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
    by = {(r["doc_id"], r["n_words"] > 0): r for r in out}
    assert by[104, True]["labels"] == "cc-by,cc-by-sa" and by[105, True]["labels"] == "cc-by"
    assert by[102, True]["labels"] == "cc-by-nc" and by[103, True]["labels"] == "gpl" and by[101, True]["labels"] == ""


# 4 and 5


def labelled(spark, column, positive, negative, n=400):
    rng = random.Random(5)
    rows = [(k, positive(rng) if k % 3 == 0 else negative(rng)) for k in range(n)]
    odd = [(n + k, t) for k, t in enumerate(odd_texts(rng))] + [(0, rows[0][1]), (None, "x y")]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(n)] + [(1, 0), (None, 1), (n, None)], f"doc_id long, {column} int")
    return documents(spark, rows + odd), labels, n


def accuracy(rows, n, limit):
    held = [r for r in rows if r[0] is not None and r[0] < n and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    return sum((s >= limit) == (k % 3 == 0) for k, s in held) / len(held)


def test_quality_classifier(spark):
    docs, labels, n = labelled(spark, "quality", lambda r: prose(r, 80) + ".", lambda r: "$$$ ".join(prose(r, 40).split()))
    weights = quality.train(docs, labels)
    rows = [(r["id"], r["score"]) for r in quality.score(docs, weights).collect()]
    assert len(rows) == docs.count() and all(0 <= s <= 1 for _, s in rows)
    assert accuracy(rows, n, quality.THRESHOLD) > 0.98
    assert quality.score(docs.where("false"), weights).count() == 0
    assert not quality.train(docs, labels.where("false")).any()


def test_toxicity(spark):
    docs, labels, n = labelled(spark, "toxic", lambda r: prose(r, 60) + " you " + r.choice(["idiot", "zorgify", "zorgling"]) + " " + prose(r, 20), lambda r: prose(r, 80))
    model = toxicity.fit(docs, labels)
    rows = [(r["doc_id"], r["score"]) for r in model.score(docs).collect()]
    assert len(rows) == docs.count() and all(0 <= s <= 1 for _, s in rows)
    assert accuracy(rows, n, toxicity.THRESHOLD) > 0.97
    assert model.score(docs.where("false")).count() == 0
    assert {r["score"] for r in toxicity.fit(docs, labels.where("false")).score(docs).collect()} == {0.0}


def test_toxicity_features_do_not_cross_rows():
    import pyarrow as pa

    features = toxicity.Features({int(np.uint64(toxicity._hash("idiot")).view(np.int64)): 5.0})
    of = lambda texts: np.concatenate([features(data, bounds) for _, _, data, bounds in blocks.blocks(pa.array(texts))])
    texts = ["You", "idiot", "", "1d1ot st*pid NOW!!", None, "you idiot"]
    np.testing.assert_allclose(of(texts), np.concatenate([of([t]) for t in texts]))
    assert of(texts)[3][toxicity.FEATURES.index("hidden")] == 1 and of(texts)[5][toxicity.FEATURES.index("near_you")] > 0


def test_ftrl_equals_a_slow_version():
    rng = random.Random(20)
    docs = [(sorted(rng.sample(range(40), 6)), [rng.random() * 3 for _ in range(6)], float(rng.random() < 0.4)) for _ in range(200)]
    fast = quality.Ftrl(40, 0.15, 1.0, 0.02, 1.0)
    z, n = {}, {}

    def weight(i):
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= 0.02 else -(zi - (0.02 if zi > 0 else -0.02)) / ((1.0 + ni**0.5) / 0.15 + 1.0)

    for at, x, y in docs:
        fast.learn(np.array(at), np.array(x), y)
        w = [weight(i) for i in at]
        p = 1 / (1 + np.exp(-max(-30, min(30, sum(a * b for a, b in zip(w, x))))))
        for i, xi, wi in zip(at, x, w):
            g = (p - y) * xi
            z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / 0.15 * wi
            n[i] = n.get(i, 0.0) + g * g
    np.testing.assert_allclose(fast.weights()[:40], [weight(i) for i in range(40)], atol=1e-12)


def test_quality_features_by_brute_force():
    import pyarrow as pa

    rng = random.Random(21)
    texts = ["Hello  hello, WORLD 12.5 !? a|b", "", None, "é é x", "one", prose(rng, 40) + "\nsame same"]
    kinds = lambda w: np.bitwise_or.reduce([1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 4 if 48 <= b <= 57 else 8 if b >= 128 else 16 if chr(b) in ".," else 32 if chr(b) in "!?" else 64 if chr(b) == "|" else 128 for b in w.encode()])
    one = lambda x: np.array([x], np.uint64)

    def stream(values, salt):
        x = [blocks.mix(one(v) + np.uint64(salt)) for v in values]
        return [int(v[0]) for v in x] + [int(blocks.follow(a, b)[0]) for a, b in zip(x, x[1:])]

    for a, b, data, bounds in blocks.blocks(pa.array(texts)):
        found, row, n = quality.features(data, bounds)
        for k in range(a, b):
            text = texts[k] or ""
            plain, spaced = re.findall(ALNUM, lower(text)), re.findall(SPACED, text)
            shapes = [int(kinds(w)) for w in spaced]
            same = [int(i > 0 and lower(w) == lower(spaced[i - 1])) for i, w in enumerate(spaced)]
            want = stream([int(blocks.word_hashes(w)[0]) for w in plain], 1) + stream(shapes, 2) + stream([2 * s + t for s, t in zip(shapes, same)], 3)
            assert sorted(found[row == k - a].tolist()) == sorted(x & ((1 << quality.BITS) - 1) for x in want) and n[k - a] == len(spaced)


def test_toxicity_features_by_brute_force():
    import pyarrow as pa

    rng = random.Random(22)
    texts = ["You are an IDIOT!! Really?", "quiet text, no harm", "you! filthy-liar... Ünï x", "", prose(rng, 30) + " your STUPID ugly"]
    for a, b, data, bounds in blocks.blocks(pa.array(texts)):
        rows = toxicity.Features({})(data, bounds)
        for k in range(a, b):
            raw = texts[k].encode()
            bare = re.findall(rb"[^\x09-\x0d !-/:-@\[-`{-~]+", texts[k].encode().lower())
            bare = [w.decode() for w in bare]
            you, fixed = [w in toxicity.YOU for w in bare], [w in toxicity.INSULTS for w in bare]
            near = sum(f and any(you[max(0, i - toxicity.NEAR) : i] + you[i + 1 : i + 1 + toxicity.NEAR]) for i, f in enumerate(fixed))
            letters, upper = sum(65 <= x <= 90 or 97 <= x <= 122 or x >= 128 for x in raw), sum(65 <= x <= 90 for x in raw)
            n = max(len(bare), 1)
            want = {"fixed": sum(fixed) / n, "fixed_count": sum(fixed), "you": sum(you) / n, "near_you": near / n, "capitals": upper / max(letters, 1), "exclamation": sum(x in b"!?" for x in raw) / max(len(raw), 1), "log_words": np.log1p(len(bare))}
            for name, value in want.items():
                assert abs(rows[k - a][toxicity.FEATURES.index(name)] - value) < 1e-12, (texts[k], name)


def area_and_f1(rows, limit):
    """(area under the curve, F1) of (score, label) pairs."""
    scores, y = np.array([s for s, _ in rows]), np.array([t for _, t in rows])
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for v in np.unique(scores):
        ranks[scores == v] = ranks[scores == v].mean()
    one = y.sum()
    said = scores >= limit
    return (ranks[y == 1].sum() - one * (one + 1) / 2) / (one * (len(y) - one)), 2 * (said & (y == 1)).sum() / (said.sum() + one)


@pytest.mark.parametrize(("name", "label", "limit", "least"), [("op4_toxicity", "toxic", 0.5, (0.9, 0.7)), ("op5_quality_classifier", "quality", 0.3, (0.95, 0.9))])
def test_held_out_labels(spark, name, label, limit, least):
    folder = "/root/testdata/sf0.01"
    scores = QUERIES[name](spark, folder).where("held_out")
    rows = scores.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where(f"{label} is not null").select("score", label).collect()
    area, f1 = area_and_f1([tuple(r) for r in rows], limit)
    print(name, len(rows), area, f1)
    assert area >= least[0] and f1 >= least[1]


# 6


def test_substring_dedup(spark):
    rng = random.Random(6)
    passage = prose(rng, 60)
    rows = list(enumerate(odd_texts(rng)[:6])) + [(10, prose(rng, 150)), (11, prose(rng, 50) + " " + passage + " " + prose(rng, 50)), (12, "x" + prose(rng, 33) + " " + passage + " " + prose(rng, 80)), (13, prose(rng, 150)), (14, None), (15, passage), (16, "ab" * 4000)]
    docs = documents(spark, rows)
    found = substring_dedup.repeated_passages(docs).collect()
    assert {12, 15} <= {r["doc_id"] for r in found} <= {12, 15, 16}
    assert all(r["first_doc_id"] in (11, 12, 16) for r in found)
    texts = dict(rows)
    for r in found:
        part = texts[r["doc_id"]].encode()[r["start"] : r["end"]]
        assert len(part) >= substring_dedup.LEAST_PASSAGE and (r["first_doc_id"] == 16 or part in texts[11].encode())
        assert r["doc_id"] == 16 or passage.encode() in part
    cleaned = {r["doc_id"]: r["text"] for r in substring_dedup.remove_passages(docs).collect()}
    assert cleaned[10] == texts[10] and cleaned[14] is None and cleaned[11] == texts[11] and passage not in cleaned[12] and len(cleaned[15]) < 2
    assert substring_dedup.repeated_passages(docs.where("false")).count() == 0


def test_substring_dedup_finds_planted_passages(spark):
    """By brute force: of passages of 51 to 60 words at random places, the later copies are found whole; nothing else is."""
    rng = random.Random(16)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvéñ", k=rng.randrange(2, 10))) for _ in range(4000)]
    docs, planted = [], []
    for k in range(300):
        passage = prose(rng, rng.randrange(51, 61), words)
        for j in range(2):
            planted.append((2 * k + j, passage))
            docs.append((2 * k + j, f"{prose(rng, rng.randrange(1, 90), words)} {passage} {prose(rng, rng.randrange(1, 90), words)}"))
    clean = [(1000 + k, prose(rng, 200, words)) for k in range(100)]
    texts = dict(docs + clean)
    found = {}
    for r in substring_dedup.repeated_passages(documents(spark, docs + clean)).collect():
        part = texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode()
        assert part in texts[r["first_doc_id"]] and r["first_doc_id"] < r["doc_id"]
        found[r["doc_id"]] = part
    later = [(k, p) for k, p in planted if k % 2]
    assert set(found) <= {k for k, _ in later}
    assert sum(p in found.get(k, "") for k, p in later) >= 0.97 * len(later)


def test_substring_dedup_finds_passages_of_known_sentences(spark):
    """Two sentences that stand alone in earlier documents and together in two later ones: the later of these has both, whole."""
    rng = random.Random(26)
    words = ["".join(rng.choices("abcdefghijklmnoprstuv", k=rng.randrange(2, 10))) for _ in range(4000)]
    around = lambda x: f"{prose(rng, rng.randrange(20, 60), words)} {x} {prose(rng, rng.randrange(20, 60), words)}"
    docs, planted = [], {}
    for k in range(150):
        a, b = (prose(rng, 30, words)[:112] for _ in range(2))
        docs += [(4 * k, around(a)), (4 * k + 1, around(b)), (4 * k + 2, around(f"{a} {b}")), (4 * k + 3, around(f"{a} {b}"))]
        planted[4 * k + 3] = f"{a} {b}"
    texts, found = dict(docs), {}
    for r in substring_dedup.repeated_passages(documents(spark, docs)).collect():
        found.setdefault(r["doc_id"], []).append(texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode())
    assert sum(any(p in x for x in found.get(k, [])) for k, p in planted.items()) >= 0.97 * len(planted)
    assert not {k for k in found if k % 4 < 2}


def test_substring_dedup_equals_all_common_substrings(spark):
    """By brute force: what is reported lies in an earlier place, nothing else, and of all bytes in common substrings of 120 bytes or more few are left."""
    rng = random.Random(36)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(300)]
    parts = [prose(rng, rng.randrange(10, 45), words) for _ in range(12)]
    docs = [(k, " ".join(rng.choice(parts) if rng.random() < 0.4 else prose(rng, rng.randrange(5, 30), words) for _ in range(rng.randrange(2, 7)))) for k in range(40)]
    least, seen, want = substring_dedup.LEAST_PASSAGE, set(), {}
    for k, text in docs:
        own = [text[i : i + least] for i in range(len(text) - least + 1)]
        marks = set()
        for i, x in enumerate(own):
            if x in seen or x in own[:i]:
                marks |= set(range(i, i + least))
        want[k] = marks
        seen |= set(own)
    got = {k: set() for k, _ in docs}
    for r in substring_dedup.repeated_passages(documents(spark, docs)).collect():
        got[r["doc_id"]] |= set(range(r["start"], r["end"]))
    assert all(got[k] <= want[k] for k in got)
    assert sum(map(len, got.values())) >= 0.9 * sum(map(len, want.values())) > 0


def test_chunks_resist_shifts():
    rng = random.Random(7)
    a = prose(rng, 3000).encode()
    b = a[:5000] + b"inserted" + a[5000:]
    cuts = lambda *texts: substring_dedup.boundaries(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    parts = [{x[i:j] for _, i, j in zip(*(c.tolist() for c in cuts(x)))} for x in (a, b)]
    assert len(parts[0] - parts[1]) <= 6
    row, start, end = cuts(b, b"", b"short", a, b"x" * 700)
    assert (end > start).all() and (end - start).max() <= substring_dedup.MOST_CHUNK and (start[1:] == end[:-1]).all() and set(row) == {0, 2, 3, 4}
    # a text's chunks are the same in a block as alone
    assert (start[row == 3] - len(b) - 5).tolist() == cuts(a)[1].tolist()


# 2, of texts that repeat themselves


def test_automaton_takes_linear_time_on_repeated_words():
    import time

    start = time.process_time()
    word = decontamination.Automaton([("a", [b"x"] * 20_000), ("b", [b"x", b"y"] * 50), ("c", [b"x"] * 5)])
    built = time.process_time()
    spans, names = word.spans([b"x"] * 200_000 + [b"y"] + [b"x", b"y"] * 10)
    assert built - start < 6 and time.process_time() - built < 6
    assert spans == [(0, 200_021)] and names == {"a", "b", "c"}


# 7


def test_embedding_dedup(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((60, 24))
    x = np.concatenate([base, base + 0.25 * rng.standard_normal(base.shape), base[:20] + 0.2 * rng.standard_normal((20, 24)), np.repeat(base[:1], 30, 0), 3 * base[1:2]]).astype(np.float32)
    rows = [(k, v.tolist(), k % 60 % 3) for k, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 24, 1), (1002, [float("nan")] * 24, 1), (1003, [None, 1.0], 1), (1004, base[0].tolist(), None), (1005, [1.0, 2.0], 1), (1006, [1.0, 2.0], 1), (1007, [], 1), (1008, [1e-30, 2e-30], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "d1": F.lit(2)})
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    usable = [(k, np.array(v, dtype=np.float64), lab) for k, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for (a, p, s), (b, q, t) in combinations(usable, 2) if s == t and len(p) == len(q) and (p / np.abs(p).max()) @ (q / np.abs(q).max()) / np.linalg.norm(p / np.abs(p).max()) / np.linalg.norm(q / np.abs(q).max()) >= 0.93]
    want = grouped(links, [r[0] for r in rows])
    n = {k: sum(k in x for x in links) for k, *_ in rows}
    found = sum(r["n_links"] for r in got.values()) / 2
    assert found >= 0.95 * len(links) and all(got[k]["n_links"] <= n[k] for k in n)
    wrong = [k for k in want if want[k] != got[k]["component_id"]]
    assert len(wrong) <= 0.05 * len(want) and all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert embedding_dedup.near_vectors(df.where("false")).count() == 0


def test_embedding_dedup_of_a_large_group(spark):
    """One label with most rows, all near one direction: more than a tile, counts equal brute force; a row without id joins two others."""
    rng = np.random.default_rng(18)
    base = rng.standard_normal(32)
    x = base + 0.25 * rng.standard_normal((900, 32))
    y = rng.standard_normal((100, 32))
    a, b = np.eye(32)[0], np.eye(32)[1]
    tilt = [np.cos(t) * a + np.sin(t) * b for t in (0.0, 0.3, 0.6)]
    rows = [(k, v.tolist(), 1) for k, v in enumerate([*x, *y])] + [(5000, tilt[0].tolist(), 2), (None, tilt[1].tolist(), 2), (5001, tilt[2].tolist(), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(df).collect()}
    u = np.concatenate([x, y])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    n = np.array([got[k]["n_links"] for k in range(1000)])
    assert want.max() > 2 * embedding_dedup.TILE and (n <= want).all() and n.sum() >= 0.97 * want.sum()
    assert got[5001]["component_id"] == 5000 and got[None]["n_links"] == 2 and got[None]["kept"]


def test_embedding_recall_at_the_threshold():
    rng = np.random.default_rng(19)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((400, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    code = embedding_dedup.Code(64, 600)
    p, q = ([code.filters(t) for t in code.scores(v)] for v in (x, 0.93 * x + np.sqrt(1 - 0.93**2) * z))
    assert np.mean([bool(np.intersect1d(a, b).size) for a, b in zip(p, q)]) >= 0.95


# 8


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = [*odd_texts(rng), "O'Neil's İstanbul ΑΣ ΣΑΣ. e\u0301 <|endoftext|> x<|startoftext|>y 12.5,3 ..., ».", "!!. ,x; a. b, c.d »., é, ×. ÷, 5. '. ...", *(prose(rng, rng.randrange(1, 900), ["The,", "naïve.", "x!!", "foo###", "don't", "99.", "ß"]) for _ in range(60))]
    rows = list(enumerate(texts)) + [(0, None), (500, texts[-1])]
    out = packing.pack(documents(spark, rows), tokenizer_path()).toPandas()
    for k, t in enumerate(texts[1:], 1):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        mine = out[out.doc_id == k].sort_values("start")
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids), t
        assert (mine.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    assert (out.doc_id == 0).sum() == 2
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert packing.pack(documents(spark, []), tokenizer_path()).count() == 0


def test_packing_patterns():
    rng = random.Random(10)
    histogram = {n: rng.randrange(1, 50) for n in rng.sample(range(1, 2049), 300)}
    found = packing.patterns(histogram)
    placed = {}
    for pattern, n in found:
        assert sum(pattern) <= 2048
        for length in pattern:
            placed[length] = placed.get(length, 0) + n
    assert placed == histogram


# 9


def brute_near(rows, shingle, percent):
    sets = []
    for k, t in rows:
        w = re.findall(SPACED, lower(t))
        sets.append((k, frozenset(tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else [])))
    links = [(a, b) for (a, x), (b, y) in combinations(sets, 2) if x and y and 100 * len(x & y) >= percent * len(x | y)]
    links += [(a[0], b[0]) for (a, b) in combinations(rows, 2) if a[0] == b[0]]
    return sets, grouped(links, {k for k, _ in rows})


@pytest.mark.parametrize(("shingle", "small_node"), [(2, 2), (5, near_dup.SMALL_NODE)])
def test_near_duplicates(spark, shingle, small_node):
    rng = random.Random(11)
    rows = list(enumerate(odd_texts(rng)))
    for g in range(12):
        base = prose(rng, rng.choice([8, 40, 120])).split()
        for _ in range(rng.choice([1, 2, 9])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                w[rng.randrange(len(w))] = rng.choice(["new", "Other", "x9"])
            rows.append((100 + len(rows), " ".join(w)))
    base = prose(rng, 100).split()
    for k in range(40):  # a group about the threshold
        w = list(base)
        for _ in range(rng.randrange(14)):
            w[rng.randrange(100)] = f"n{rng.randrange(99)}"
        rows.append((1000 - k, " ".join(w)))
    rows += [(3000, "one"), (3001, "ONE"), (3002, rows[-1][1].upper()), (3003, None), (3000, "one")]
    many = [" ".join(rng.choices([f"z{j}" for j in range(500)], k=30)) for _ in range(4)]  # chains over ids with two texts
    rows += [(4003, many[0]), (4002, many[0]), (4002, many[1]), (4001, many[1]), (4005, many[2]), (4005, many[3]), (4004, many[3]), (4006, many[2])]
    sets, want = brute_near(rows, shingle, 80)
    out = near_dup.near_duplicates(documents(spark, [*rows, (None, "one")]), shingle=shingle, small_node=small_node).collect()
    assert len(out) == len(rows) + 1
    assert sorted((r["doc_id"], r["n_shingles"]) for r in out if r["doc_id"] is not None) == sorted((k, len(s)) for k, s in sets)
    assert {r["doc_id"]: r["component_id"] for r in out if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out if r["doc_id"] is not None)
    assert near_dup.near_duplicates(documents(spark, [])).count() == 0


# 10


def test_line_dedup(spark):
    rng = random.Random(12)
    long = [prose(rng, 14) for _ in range(12)]
    short = [prose(rng, 3) for _ in range(30)]
    runs = [short[k : k + 5] for k in range(0, 30, 5)]
    docs = []
    for k in range(25):
        body = [prose(rng, rng.randrange(3, 20)) for _ in range(4)]
        for x in rng.sample([*([x] for x in long), *runs], 3):
            at = rng.randrange(len(body) + 1)
            body[at:at] = [*x, ""] if rng.random() < 0.3 else x
        docs.append((k, "\n".join(body)))
    docs += [(50, docs[3][1].upper()), (51, ""), (52, "one\ntwo"), (53, "one\ntwo")]
    out = line_dedup.remove_repeated_lines(documents(spark, [*docs, (54, None), (51, "")]), removed="gone").collect()
    assert len(out) == len(docs) + 2 and "path" in out[0].asDict()
    got = {r["doc_id"]: r for r in out}
    for k, gone in every_repeated_line(docs, line_dedup.LEAST_WORDS).items():
        text = dict(docs)[k]
        want = [x for i, x in enumerate(text.split("\n")) if i not in gone]
        assert got[k]["text"].split("\n") == (want or [""]), k
    assert got[54]["text"] is None and got[54]["gone"] == 0
    assert line_dedup.remove_repeated_lines(documents(spark, [])).count() == 0


def every_repeated_line(docs, least):
    """By the definition: each line of any run of ``least`` words or more, of any length, that stands earlier."""
    lines = {k: [(i, " ".join(lower(x).split())) for i, x in enumerate(t.split("\n")) if x.strip(" \t\r")] for k, t in docs}
    seen, gone = set(), {k: set() for k in lines}
    for k in sorted(lines):
        rows = lines[k]
        for i in range(len(rows)):
            for j in range(i + 1, len(rows) + 1):
                run = tuple(x for _, x in rows[i:j])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone[k].update(rows[m][0] for m in range(i, j))
                    seen.add(run)
    return gone


def test_line_dedup_of_lines_that_stand_alone_before(spark):
    rng = random.Random(13)
    docs = []
    for k in range(40):
        run = [prose(rng, 3) + f" r{k}" for _ in range(5)]
        docs += [(100 * k + j, "\n".join([prose(rng, 8), x, prose(rng, 8)])) for j, x in enumerate(run)]
        docs += [(100 * k + 50 + j, "\n".join([prose(rng, 20), *run, prose(rng, 20)])) for j in range(2)]
        # nine words and a line of fourteen, each repeated from another document
        nine, line = [prose(rng, 3) + f" n{k}" for _ in range(2)], prose(rng, 14)
        docs += [(100 * k + 60, "\n".join([prose(rng, 12), *nine, prose(rng, 12)])), (100 * k + 61, line + "\n" + prose(rng, 12)), (100 * k + 62, "\n".join([*nine, line, prose(rng, 12)]))]
    out = {r["doc_id"]: r["gone"] for r in line_dedup.remove_repeated_lines(documents(spark, docs), removed="gone").select("doc_id", "gone").collect()}
    assert all(out[100 * k + 51] == 5 and out[100 * k + 50] == 0 and out[100 * k + 62] == 1 for k in range(40))
    assert sum(out.values()) == 40 * 6


@pytest.mark.parametrize("frequent", range(2))
def test_line_dedup_meets_every_earlier_run(spark, frequent):
    # a frequent short line between headlines: for some of these lines, its hash is the smallest of its windows
    rng = random.Random(frequent)
    heads = [prose(rng, 6) for _ in range(12)]
    docs = []
    for k in range(14):
        body = [x for h in rng.sample(heads, 5) for x in (h, f"read more{frequent}")]
        docs.append((k, "\n".join(body)))
    docs += [(k, "\n".join([*docs[rng.randrange(14)][1].split("\n")[2:8], prose(rng, 2)])) for k in range(20, 30)]
    docs += [(40, docs[20][1] + "\n" + "\n".join(heads)), (41, "\n".join([prose(rng, 12), "a tail"] * 2))]
    out = line_dedup.remove_repeated_lines(documents(spark, docs), removed="gone").collect()
    got = {r["doc_id"]: r["text"] for r in out}
    for k, gone in every_repeated_line(docs, line_dedup.LEAST_WORDS).items():
        want = [x for i, x in enumerate(dict(docs)[k].split("\n")) if i not in gone]
        assert got[k].split("\n") == (want or [""]), k


# all together


#: What the results must hold; there may be more columns.
RESULTS = {
    "op1": "page_id bigint, host string, path string, rule string, verdict string", "op2": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op3": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double", "op4": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5": "doc_id bigint, held_out boolean, score double, predicted int", "op6": "doc_id bigint, start bigint, end bigint", "op7": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint", "op9": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean", "op10": "doc_id bigint",
    "op11": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", "op12": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13": "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, restored_sha256 string",
}
TABLES = {"op1": "pages", "op7": "embeddings", "op6": None, "op8": None}


def holds(op, rows, ids):
    """Invariants of a result."""
    if op in ("op4", "op5"):
        least = 0.5 if op == "op4" else 0.3
        return all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    if op in ("op7", "op9"):
        key = "vec_id" if op == "op7" else "doc_id"
        least = {}
        for r in rows:
            least[r["component_id"]] = min(least.get(r["component_id"], r[key]), r[key])
        return all(r["kept"] == (r[key] == r["component_id"]) and least[r["component_id"]] == r["component_id"] for r in rows)
    if op == "op8":
        docs, packs = {}, {}
        for r in rows:
            docs.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
            packs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        gapless = lambda spans: all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
        whole = all(gapless([x[:2] for x in sorted(p)]) and sum(x[1] for x in p) == p[0][2] for p in docs.values())
        return set(docs) == ids and whole and all(gapless(sorted(p)) and sum(n for _, n in p) <= 2048 for p in packs.values())
    if op == "op6":
        return all(0 <= r["start"] and r["end"] - r["start"] >= substring_dedup.LEAST_PASSAGE and r["doc_id"] in ids for r in rows)
    return True


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries(spark, sf, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    op = name.partition("_")[0]
    kinds = {k: "bigint" if op == "op6" and v == "int" else v for k, v in df.dtypes}
    assert all(kinds.get(k) == v for k, v in (c.split() for c in RESULTS[op].split(", ")))
    table = TABLES.get(op, "documents")
    if table:
        assert len(rows) == spark.read.parquet(f"{sf}/{table}.parquet").count()
    assert holds(op, rows, {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()})
    if name in ORACLE:
        import duckdb

        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
        found = con.execute(ORACLE[name])
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns)
        plain = lambda v: round(v, 9) if isinstance(v, float) else v
        assert sorted(repr([plain(r[c]) for c in sorted(names)]) for r in rows) == sorted(repr([plain(dict(zip(names, r))[c]) for c in sorted(names)]) for r in found.fetchall())
    else:
        assert rows or name.startswith("op6")


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), stage(spark, docs, sf).schema) if name != "packing" else stage(spark, docs, sf)
        after = docs.toPandas()
        if name != "packing":
            assert sorted(after.columns) == sorted(before.columns) and set(after.doc_id) <= set(before.doc_id)
        if name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(after.doc_id) == {k for k, t in zip(before.doc_id, before.text) if not brute_contamination(t, items)[4]}
            whole = [i for i in items if len(re.findall(ALNUM, i[1])) >= 13]
            had = {k: brute_contamination(t, whole)[1] for k, t in zip(before.doc_id, before.text)}
            texts = dict(zip(before.doc_id, before.text))
            for k, t in zip(after.doc_id, after.text):
                # joined ends may make a word of two; nothing else changes
                assert (t == texts[k]) if not had[k] else len(re.findall(ALNUM, lower(t))) <= len(re.findall(ALNUM, lower(texts[k]))) - had[k]
        if name == "line_dedup":
            gone = every_repeated_line(list(zip(before.doc_id, before.text)), line_dedup.LEAST_WORDS)
            want = {k: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in zip(before.doc_id, before.text)}
            assert dict(zip(after.doc_id, after.text)) == {k: t for k, t in want.items() if t.strip() or not dict(zip(before.doc_id, before.text))[k].strip()}
        if name == "quality_classifier":
            quality_scores = quality.score(spark.createDataFrame(before), quality.train(spark.createDataFrame(before), spark.read.parquet(f"{sf}/labels.parquet"))).toPandas()
            assert set(after.doc_id) == set(quality_scores.id[quality_scores.score >= quality.THRESHOLD]) and 0 < len(after) < len(before)
        if name == "minhash_near_dedup":
            _, want = brute_near(list(zip(before.doc_id, before.text)), 2, 80)
            assert set(after.doc_id) == {k for k, c in want.items() if k == c}
        if name == "packing":
            assert set(after.doc_id) == set(before.doc_id)
    assert set(corpus_pipeline.run(spark, sf).toPandas().doc_id) == set(after.doc_id)
