"""Personal data: base spans against brute force with Python's patterns, models against slow versions, planted candidates of other forms."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import pii
from tests.llm.test_llm import documents, odd_texts, prose


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


PATTERNS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
}


def base(text):
    text = text or ""
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, (p, ok)) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if ok(m.group(0))]
    counts = [sum(x[1] == k for x in found) for k in range(4)]
    return (*counts, hashlib.sha256(",".join(x[2] for x in sorted(found)).encode()).hexdigest())


def card(rng, n=16, sep=""):
    body = "4" + "".join(str(rng.randrange(10)) for _ in range(n - 2))
    last = next(str(c) for c in range(10) if luhn(body + str(c)))
    raw = body + last
    return sep.join(raw[k : k + 4] for k in range(0, n, 4))


def jumble(rng):
    parts = ["a", "b1", "@", ".", "-", "_", "%", "+", " ", "  ", "(", ")", "1", "12", "255", "256", "007", "é", "😀", "x@y.zz", "1.2.3.4", "+1 (523) 555-1055", "4785380592391139", "0" * 15, "\n", "٣"]
    return "".join(rng.choices(parts, k=rng.randint(1, 60)))


def test_base_spans_equal_the_definition(spark):
    rng = random.Random(1)
    texts = odd_texts(rng) + [jumble(rng) for _ in range(400)] + ["a@b.c_d@e.fg", "a@b.c+d@e.f@g.h", "1.2.3.4.5.6.7.8", "1.1.1.1.1", "++12345678901", "+1", "5 " * 30, "12-" * 8 + "1", card(rng, 19) + " 7", "4 7-8 5" * 3]
    texts += [" ".join(f"10.0.{k % 300}.{k % 256} é m{k}@x{k}.org {card(rng)}" for k in range(700))]  # more matches than a chunk has
    rows = [*enumerate(texts), (None, "a@b.cd"), (None, None), (3, "x@y.zz"), (3, "x@y.zz")]
    got = pii.digest(pii.find(documents(spark, rows).repartition(3)))
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    found = got.collect()
    assert sorted(repr(tuple(r)[:6]) for r in found) == sorted(repr((k, *base(t))) for k, t in rows)
    for r in found:  # base spans are among all spans, in order
        spans = [s.split(":") for s in r["spans"].split(",")] if r["spans"] else []
        assert [(int(a), pii.KINDS.index(k)) for k, a, _ in spans] == sorted((int(a), pii.KINDS.index(k)) for k, a, _ in spans)
        assert sum(r[f"n_{k}"] for k in pii.BASE) <= len(spans)


def planted(rng):
    """Texts with spans of kinds that no base pattern finds, and such that look like them."""
    hexed = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    real, clean = [], []
    for _ in range(40):
        secret = hexed(40)
        a = prose(rng, 12, ["lorem", "ipsum", "dolor", "amet"])
        real += [(f'{a} token = "{secret}" {a}', secret), (f"{a} password: {hexed(32)} {a}", None), (f"{a} call (523) 555-1055 {a}", "(523) 555-1055"), (f"{a} write to jo.do [at] mail [dot] org {a}", "jo.do [at] mail [dot] org"), (f"{a} me{rng.randrange(99)}@mail.org {a}", None), (f"{a} card {card(rng)} {a}", None)]
        clean += [f"{a} order {''.join(str(rng.randrange(10)) for _ in range(15))}9 {a}", f"{a} commit {hexed(40)} {a}", f"{a} {hexed(40)} {a}", f"{a} sha256: {hexed(64)} {a}", f"{a} version 1.2.3.400 {a}", f"{a} see /usr/share/doc-base/x11/readme-2 {a}", f"{a} {rng.randrange(1900, 2100)}-{rng.randrange(10, 99)} {a}", f"{a} supercalifragilistic words {a}"]
    return real, clean


def test_planted_spans_are_found_and_clean_texts_left_alone(spark):
    rng = random.Random(2)
    real, clean = planted(rng)
    clean = [t for t in clean if base(t)[:4] == (0, 0, 0, 0)]
    rows = [*enumerate([t for t, _ in real]), *((1000 + k, t) for k, t in enumerate(clean))]
    found = {r["doc_id"]: r["spans"] for r in pii.find(documents(spark, rows)).collect()}
    missed = [t for k, (t, s) in enumerate(real) if s and s not in [t[x["start"] : x["stop"]] for x in found[k]]]
    assert not missed
    wrong = [(t, found[1000 + k]) for k, t in enumerate(clean) if found[1000 + k]]
    assert not wrong, wrong[:3]


def test_estimate_equals_a_slow_version(spark):
    rng = random.Random(3)
    rows = [(rng.choice(pii.KINDS), "".join(rng.choice("0122") for _ in pii.LABELERS), 0, rng.randint(1, 50)) for _ in range(60)]
    got = pii.estimate(spark.createDataFrame(rows, "kind string, votes string, shape int, n long"), rounds=4)
    hit, right, prior = ({k: a / b for k, (a, b) in pii.KNOWN.items()} for _ in "ab"), None, dict.fromkeys(pii.KINDS, 0.5)
    hit, right = hit
    for _ in range(4):
        p = []
        for kind, votes, _, n in rows:
            z = math.log(prior[kind] / (1 - prior[kind]))
            for name, v in zip(pii.LABELERS, votes):
                z += {"2": math.log(hit[name] / (1 - right[name])), "0": math.log((1 - hit[name]) / right[name]), "1": 0}[v]
            p.append(1 / (1 + math.exp(-z)))
        share = lambda name, i, want, real: sum(n * (x if real else 1 - x) for (_, v, _, n), x in zip(rows, p) if v[i] in want)
        hit, right = (
            {name: (share(name, i, yes, real) + pii.KNOWN[name][0]) / (share(name, i, "02", real) + pii.KNOWN[name][1]) for i, name in enumerate(pii.LABELERS)} for yes, real in (("2", True), ("0", False))
        )
        prior = {k: (sum(r[3] * x for r, x in zip(rows, p) if r[0] == k) + 5) / (sum(r[3] for r in rows if r[0] == k) + 10) for k in pii.KINDS}
    for a, b in ((got.hit, hit), (got.right, right), (got.prior, prior)):
        assert a == pytest.approx(b)


def test_classifier_follows_the_posteriors(spark):
    rows = [("secret", "22222", 1, 90), ("secret", "00000", 0, 80), ("card", "20111", 0, 40), ("phone", "22111", 4, 60)]
    patterns = spark.createDataFrame(rows, "kind string, votes string, shape int, n long")
    known = pii.estimate(patterns)
    weights = pii.train(patterns, known)
    got = patterns.select("votes", known.posterior().alias("p"), pii.score(*weights, F.col("kind"), F.col("votes"), F.col("shape")).alias("s")).collect()
    assert all(abs(r["p"] - r["s"]) < 0.2 for r in got), got


def test_checksums(spark):
    rows = [("GB82WEST12345698765432", "4785380592391139", "1.2.3.255"), ("GB83WEST12345698765432", "4785380592391138", "1.2.3.256"), ("DE89370400440532013000", "0", "0.00.007.0255")]
    df = spark.createDataFrame(rows, "i string, c string, a string").select(pii.mod97(F.col("i")), pii.luhn(F.col("c")), pii.octets(F.col("a")))
    assert [tuple(r) for r in df.collect()] == [(True, True, True), (False, False, False), (True, True, True)]


def test_empty_table_and_texts_without_candidates(spark):
    assert pii.find(documents(spark, [])).count() == 0
    got = pii.digest(pii.find(documents(spark, [(1, None), (2, "plain words")]))).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "")] * 2


def test_long_texts_take_time_that_grows_with_their_length(spark):
    n = 200_000
    texts = ["a" * n, "1 " * n, "a@" * n, "a@" + "b" * n, "1." * n, "+1 " * n, "a" * n + "@x.org", "x@y" + ".z" * n, "/" * n, "ab1-" * n, "+" + "1" * n, "4785380592391139, " * 20_000]
    start = time.time()
    found = {r["doc_id"]: r for r in pii.digest(pii.find(documents(spark, [*enumerate(texts)]).repartition(4))).collect()}
    assert time.time() - start < 150
    assert found[11]["n_card"] == 20_000 and found[6]["n_email"] == 1 and found[7]["n_email"] == 1
