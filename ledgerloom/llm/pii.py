"""Personal data by weak supervision, in DataFrame functions only.

Base spans are what four patterns define. Besides these, a wide pattern takes
candidates: numbers, addresses and opaque strings that may be personal. Five
labelers vote on each candidate, base spans included: its form, a checksum, a
gazetteer, the words before it, and what it touches. A vote is for, against or
none. Expectation-maximisation estimates from agreement alone how far each
labeler is to be believed, and how often each kind is real. Its posteriors train
the final span classifier, a logistic regression on votes, kind and shape, which
decides on the candidates; base spans always stay.

Texts are read once and never shuffled. A candidate's kind, votes and shape are
one of a few thousand patterns, so that what is counted over the corpus, and
what models are fitted to, is a table of bounded size.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from .lineage import cut, drop

#: The base kinds in the order of equal starts, then the kinds that only candidates have.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "ssn", "opaque")
LABELERS = ("form", "checksum", "gazetteer", "before", "edge")
SHAPES = ("assigned", "long", "separated", "letters")
THRESHOLD = 0.7
ROUNDS = 20
CONTEXT = 40
#: What is known of a labeler before: right in so many of so many cases. A checksum is seldom wrong.
KNOWN = {"form": (8, 10), "checksum": (97, 100), "gazetteer": (8, 10), "before": (27, 30), "edge": (8, 10)}

# Each pattern starts at the first place of a run only and takes runs possessively: what it finds is what the contract's
# pattern finds from the left, in time that grows with the text's length.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+"  # shorter chains are no cards
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({] ?(?i:at) ?[\])}] ?[A-Za-z0-9-]{1,63}+(?: ?[\[({] ?(?i:dot) ?[\])}] ?[A-Za-z0-9-]{2,63}+){1,8}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])"
OPAQUE = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+"
#: Base forms come first, so that candidates don't lie within them. After another kind's match no address begins within a run: that would be tried once for each match.
WIDE = "|".join((EMAIL.replace(r"\G|", ""), PHONE, CARD, IP, SPELLED, IBAN, SSN, LOCAL_PHONE, OPAQUE))

# Word lists of the gazetteer and context labelers.
TLDS = "com org net edu gov mil int info biz name io dev app me tv online site xyz".split()
DIALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 351 352 353 354 358 380 420 421".split()
IBAN_COUNTRIES = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GI GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split()
KEY_PREFIXES = "AKIA ASIA ghp_ gho_ sk- pk- xoxb- xoxp- AIza eyJ".split()
PLACEHOLDERS = "example placeholder changeme your_ xxxx test dummy sample".split()
WORDS_FOR = {
    "email": "email e-mail mail mailto contact correo courriel write reach".split(), "ip": "ip host server address client login logged peer".split(),
    "card": "card visa mastercard amex credit debit pan payment tarjeta karte carte".split(), "phone": "phone tel telephone call mobile cell fax sms whatsapp teléfono telefon téléphone".split(),
    "secret": "token secret password passwd pwd api_key apikey api-key access_key auth credential bearer private_key".split(), "iban": "iban account bank konto cuenta compte transfer".split(), "ssn": "ssn social security taxpayer".split(),
}
WORDS_FOR["opaque"] = WORDS_FOR["secret"]
WORDS_AGAINST = {
    "email": "pip npm git@".split(), "ip": "version release build firmware section chapter oid".split(), "card": "isbn ean order invoice tracking serial barcode sku".split(), "phone": "isbn order invoice lot serial page".split(),
    "secret": "commit sha sha1 sha256 md5 checksum digest hash etag uuid revision integrity href src url http".split(), "iban": "serial model part".split(), "ssn": "part model order sku".split(),
}

WORDS_AGAINST["opaque"] = WORDS_AGAINST["secret"]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, -1 or 0; without ``no``, whatever isn't a vote for is one against."""
    return F.when(F.coalesce(yes, F.lit(False)), 1).when(F.lit(True) if no is None else F.coalesce(no, F.lit(False)), -1).otherwise(0)


def luhn(digits: Column) -> Column:
    """Whether digits pass the Luhn check. Every second one from the right is doubled, its digits added up."""
    one = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.try_cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(F.filter(one, lambda d: d.isNotNull()), F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits are right."""
    turned = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    place = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(place(c) > 9, 100).otherwise(10) + place(c)) % 97) == 1


def octets(ip: Column) -> Column:
    """Whether the parts of an address are at most 255."""
    return ip.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9]?)(?:\.|$)){4}")


def valid(kind: str, match: Column) -> Column:
    """Whether what a base pattern found counts."""
    n = F.length(_digits(match))
    return {"email": F.lit(True), "ip": octets(match), "card": n.between(14, 19) & luhn(_digits(match)), "phone": n.between(10, 15)}[kind]


_FOUND = "array<struct<before:string,match:string,after:string>>"


def _found(gaps: str, matches: str) -> Column:
    """Matches with the text before and after each, up to the neighbouring matches."""
    n = F.size(matches)
    return F.arrays_zip(F.slice(gaps, F.lit(1), n), F.col(matches), F.slice(gaps, F.lit(2), n)).cast(_FOUND)


_PLACED = "array<struct<start:int,before:string,match:string,after:string>>"
CHUNK = 256


def _placed(found: Column) -> Column:
    """Matches with their starts in code points, and the context next to them. Starts are summed within chunks first, so that
    a text of many matches takes time that grows with their number."""
    size = lambda x: F.length(x["before"]) + F.length(x["match"])
    first = F.array().cast(_PLACED)

    def scan(part: Column, start: Column) -> Column:
        one = lambda at, x: F.struct((at + F.length(x["before"])).cast("int").alias("start"), F.right(x["before"], F.lit(CONTEXT)).alias("before"), x["match"].alias("match"), F.left(x["after"], F.lit(2)).alias("after"))
        step = lambda s, x: F.struct((s["at"] + size(x)).cast("int").alias("at"), F.concat(s["out"], F.array(one(s["at"], x))).alias("out"))
        return F.aggregate(part, F.struct(start.cast("int").alias("at"), first.alias("out")), step, lambda s: s["out"])

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / CHUNK).cast("int")), lambda k: F.slice(found, k * CHUNK + 1, F.lit(CHUNK)))
    totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + size(x)))
    before = F.aggregate(totals, F.array(F.lit(0)), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    many = F.flatten(F.transform(F.arrays_zip(parts.alias("part"), F.slice(before, F.lit(1), F.size(parts)).alias("start")), lambda x: scan(x["part"], x["start"])))
    return F.when(F.size(found) == 0, first).when(F.size(found) <= CHUNK, scan(found, F.lit(0))).otherwise(many)


def _any(words: list[str]) -> str:
    return r"(?i)(?<![\p{L}0-9])(?:" + "|".join(w.replace("-", r"\-") for w in words) + r")(?![\p{L}0-9])"


def labels(kind: Column, match: Column, before: Column, after: Column) -> dict[str, Column]:
    """The vote of each labeler on a candidate. The kind may be a literal, so that the others' rules fold away."""

    def by_kind(rules: dict[str, Column]) -> Column:
        return reduce(lambda rest, kv: F.when(kind == kv[0], kv[1]).otherwise(rest), rules.items(), F.lit(0))

    digits = _digits(match)
    n = F.length(digits)
    domain = F.lower(F.regexp_extract(F.right(match, F.lit(80)), r"([A-Za-z0-9-]+)[ \])}]*$", 1))
    mixed = (F.size(F.array_distinct(F.split(match, ""))) >= 10) & (n / F.length(match)).between(0.15, 0.85) & match.rlike("[0-9][a-zA-Z]+[0-9]")
    known = match.rlike("^(?:" + "|".join(KEY_PREFIXES) + ")")
    path = F.left(match, F.lit(200)).rlike("/.*/|[_-].*[_-].*[_-]")
    string = _vote(known | (mixed & ~path))
    grouped = r"^(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,4})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"
    local = r"^\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$"
    form = {
        "email": _vote(match.rlike(r"^[A-Za-z0-9]") & domain.rlike("^[a-z]{2,24}$")), "ip": _vote(~match.rlike(r"(?:^|\.)0[0-9]") & ~after.startswith(".") & ~before.rlike(r"[A-Za-z0-9.]$")), "card": _vote(match.rlike(grouped)),
        "phone": _vote(match.rlike(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$") | match.rlike(local)),
        "secret": string, "opaque": string, "iban": F.lit(1), "ssn": F.lit(1),
    }
    checksum = {
        "ip": _vote(octets(match)), "card": _vote(n.between(12, 19) & luhn(digits)), "phone": _vote(n.between(10, 15)), "iban": _vote(mod97(F.regexp_replace(match, " ", ""))),
    }
    key = _vote(known, F.lower(match).rlike("|".join(PLACEHOLDERS)))
    prefix = "^(?:" + "|".join(DIALLING) + ")"
    gazetteer = {
        "email": _vote(domain.isin(TLDS) | domain.rlike("^[a-z]{2}$")), "ip": _vote(~match.rlike(r"^(?:0*10|0*127|0+|192\.168|169\.254)\.")), "card": _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)")),
        "phone": _vote(match.startswith("+") & digits.rlike(prefix), match.startswith("+")), "secret": key, "opaque": key,
        "iban": _vote(F.substring(match, 1, 2).isin(IBAN_COUNTRIES)), "ssn": _vote(~match.rlike("^(?:000|666|9)")),
    }
    words = {k: _vote(before.rlike(_any(WORDS_FOR[k])), before.rlike(_any(WORDS_AGAINST[k]))) for k in KINDS}
    words["opaque"] = F.lit(-1)  # it isn't called a credential
    quoted = before.rlike("[\"'`<(]$") & after.rlike("^[\"'`>)]")
    touches = before.rlike(r"[\p{L}0-9_]$") | after.rlike(r"^[\p{L}0-9_]")
    return {"form": by_kind(form), "checksum": by_kind(checksum), "gazetteer": by_kind(gazetteer), "before": by_kind(words), "edge": _vote(quoted | before.rlike(r"[=:] ?[\"']?$"), touches)}


def _candidate(kind: Column, base: bool, x: Column) -> Column:
    """A candidate's place, votes (a digit for each labeler: 0 against, 1 none, 2 for) and shape (bits)."""
    match, before, after = x["match"], x["before"], x["after"]
    shape = (before.rlike(r"[=:] ?[\"']?$"), F.length(match) >= 24, match.rlike(r"[ ().\[\]-]"), match.rlike("[A-Za-z]"))
    votes = F.concat(*((v + 1).cast("string") for v in labels(kind, match, before, after).values()))
    bits = sum((F.when(s, 1 << k).otherwise(0) for k, s in enumerate(shape)), F.lit(0))
    return F.struct(kind.alias("kind"), x["start"].alias("start"), (x["start"] + F.length(match)).alias("stop"), F.lit(base).alias("base"), votes.alias("votes"), bits.alias("shape"))


def _kind_of(x: Column) -> Column:
    """The kind of what the wide pattern found; null for base spans, which stand for themselves, and for opaque strings without digits or letters."""
    m = x["match"]
    n = F.length(_digits(m))
    number = m.rlike("^[0-9]") & ~m.rlike("[^0-9 -]")
    called = x["before"].rlike(_any(WORDS_FOR["secret"])) & ~x["before"].rlike(_any(WORDS_AGAINST["secret"]))
    return (
        F.when(m.contains("@"), F.lit(None)).when(m.startswith("+") & m.rlike(r"^\+[\x20().0-9-]+$"), F.when(n.between(10, 15), F.lit(None)).otherwise("phone")).when(m.contains(".") & m.rlike(r"^[0-9.]+$"), F.when(octets(m), F.lit(None)).otherwise("ip"))
        .when(m.rlike(f"^{SSN}$"), "ssn").when(m.rlike(f"^{LOCAL_PHONE}$"), "phone").when(number & (n >= 14), F.when(n.between(14, 19) & luhn(_digits(m)), F.lit(None)).otherwise("card"))
        .when(m.rlike(r"[\[({] ?(?i:at) ?[\])}]"), "email").when(m.rlike(f"^{IBAN}$") & mod97(F.regexp_replace(m, " ", "")), "iban").when(m.rlike("[0-9]") & m.rlike("[A-Za-z]"), F.when(called, "secret").otherwise("opaque"))
    )


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, candidates): for each row of df its base spans and candidates, with what the labelers say of each."""
    out = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    some = {"email": F.contains("text", F.lit("@")), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"), "card": F.col("text").rlike(r"(?:[0-9][\x20-]?){13}"), "phone": F.contains("text", F.lit("+")), "wide": F.lit(True)}
    patterns = {k: F.lit(p) for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE), ("wide", WIDE))}
    none = F.array().cast("array<string>")
    gaps = [F.when(some[k], F.split("text", p, -1)).otherwise(none).alias(f"{k}_gaps") for k, p in patterns.items()]
    matches = [F.when(some[k], F.regexp_extract_all("text", p, F.lit(0))).otherwise(none).alias(f"{k}_matches") for k, p in patterns.items()]
    out = out.select("doc_id", *gaps, *matches)
    out = out.select("doc_id", *(_found(f"{k}_gaps", f"{k}_matches").alias(k) for k in patterns))
    out = out.select("doc_id", *(_placed(F.col(k)).alias(k) for k in patterns))
    base = lambda kind: F.transform(F.filter(kind, lambda x: valid(kind, x["match"])), lambda x: _candidate(F.lit(kind), True, x))
    known = F.filter(F.transform("wide", lambda x: F.struct(_kind_of(x).alias("kind"), x.alias("x"))), lambda y: y["kind"].isNotNull())
    return out.select("doc_id", F.concat(*map(base, BASE), F.transform(known, lambda y: _candidate(y["kind"], False, y["x"]))).alias("candidates"))


def pattern_counts(found: DataFrame) -> DataFrame:
    """(kind, votes, shape, n): how many candidates there are of each pattern; at most 8 kinds x 3^5 votes x 16 shapes."""
    return found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.shape").agg(F.count("*").alias("n"))


class Reliabilities:
    """How often each labeler is right about real and about other candidates, and how often each kind is real."""

    def __init__(self, hit: dict[str, float] | None = None, right: dict[str, float] | None = None, prior: dict[str, float] | None = None):
        before = {k: a / b for k, (a, b) in KNOWN.items()}
        self.hit, self.right = hit or before, right or before
        self.prior = prior or dict.fromkeys(KINDS, 0.5)

    def posterior(self, kind: str = "kind", votes: str = "votes") -> Column:
        """The probability that a candidate is real; a labeler without vote says nothing."""
        logit = reduce(lambda rest, k: F.when(F.col(kind) == k, math.log(self.prior[k] / (1 - self.prior[k]))).otherwise(rest), KINDS, F.lit(0.0))
        for i, name in enumerate(LABELERS):
            v = F.substring(votes, i + 1, 1)
            logit += F.when(v == "2", math.log(self.hit[name] / (1 - self.right[name]))).when(v == "0", math.log((1 - self.hit[name]) / self.right[name])).otherwise(0.0)
        return 1 / (1 + F.exp(-logit))


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> Reliabilities:
    """Expectation-maximisation over the pattern counts, a table of bounded size: a round is one aggregation to a row.

    The observations of KNOWN, and ten of each kind of which five are real, stand
    for what was known before; they also keep all rates within 0 and 1. Without
    candidates the estimate is that.
    """
    now = Reliabilities()
    for _ in range(rounds):
        tagged = patterns.withColumn("p", now.posterior())
        real, other = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        total = lambda x, on: F.coalesce(F.sum(F.when(on, x)), F.lit(0.0))
        sums = {}
        for i, name in enumerate(LABELERS):
            v = F.substring("votes", i + 1, 1)
            sums |= {f"hit_{name}": total(real, v == "2"), f"real_{name}": total(real, v != "1"), f"right_{name}": total(other, v == "0"), f"other_{name}": total(other, v != "1")}
        for k in KINDS:
            sums |= {f"real_{k}": total(real, F.col("kind") == k), f"all_{k}": total(F.col("n"), F.col("kind") == k)}
        r = tagged.agg(*(c.alias(k) for k, c in sums.items())).first()
        new = Reliabilities(
            {x: (r[f"hit_{x}"] + a) / (r[f"real_{x}"] + b) for x, (a, b) in KNOWN.items()}, {x: (r[f"right_{x}"] + a) / (r[f"other_{x}"] + b) for x, (a, b) in KNOWN.items()}, {k: (r[f"real_{k}"] + 5) / (r[f"all_{k}"] + 10) for k in KINDS}
        )
        moved = max(abs(a[k] - b[k]) for a, b in ((now.hit, new.hit), (now.right, new.right), (now.prior, new.prior)) for k in a)
        now = new
        if moved < 1e-4:
            break
    return now


def _features(kind, votes, shape) -> dict[str, Column]:
    """The classifier's indicators: each kind, each vote for and against, each bit of the shape."""
    out = {f"kind_{k}": kind == k for k in KINDS}
    for i, name in enumerate(LABELERS):
        v = F.substring(votes, i + 1, 1)
        out |= {f"{name}_for": v == "2", f"{name}_against": v == "0"}
    return out | {s: shape.bitwiseAND(F.lit(1 << k)) != 0 for k, s in enumerate(SHAPES)}


def train(patterns: DataFrame, known: Reliabilities) -> tuple[dict[str, float], float]:
    """The span classifier's coefficients and intercept: a logistic regression on the patterns, each as real and as other, by its posterior and count."""
    names = _features(F.col("kind"), F.col("votes"), F.col("shape"))
    base = patterns.withColumn("p", known.posterior()).select("kind", "votes", "shape", "n", "p", *(c.cast("double").alias(k) for k, c in names.items()))
    sides = [base.withColumn("label", F.lit(y)).withColumn("weight", F.col("n") * w) for y, w in ((1.0, F.col("p")), (0.0, 1 - F.col("p")))]
    both = cut(sides[0].unionByName(sides[1]).where("weight > 0").coalesce(1).sortWithinPartitions("kind", "votes", "shape", "label"))
    if both.isEmpty():
        return dict.fromkeys(names, 0.0), -30.0
    rows = VectorAssembler(inputCols=list(names), outputCol="features").transform(both)
    model = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=100, standardization=False).fit(rows)
    out = dict(zip(names, model.coefficients.toArray().tolist())), float(model.intercept)
    drop(both)
    return out


def score(coefficients: dict[str, float], intercept: float, kind, votes, shape) -> Column:
    """The classifier's probability of a candidate."""
    z = sum((F.when(c, coefficients[k]).otherwise(0.0) for k, c in _features(kind, votes, shape).items()), F.lit(intercept))
    return 1 / (1 + F.exp(-z))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans): for each row of df its spans (start, rank, stop, kind, base, score) in order; rank is the kind's place in KINDS.

    Places are code points from 0, ends exclusive. All base spans are there, and
    the candidates that the classifier gives ``threshold`` or more. A null or
    empty text has no spans; rows that repeat, and rows without id, are rows of
    their own; of other columns none is read. An empty table gives no rows. The
    model is fitted to the rows of df, all of them.
    """
    found = cut(candidates(df, id_col, text_col))
    patterns = cut(pattern_counts(found).coalesce(1))
    weights = train(patterns, estimate(patterns))
    drop(patterns)
    rank = lambda c: reduce(lambda rest, kv: F.when(c["kind"] == kv[1], kv[0]).otherwise(rest), enumerate(KINDS), F.lit(0))
    scored = F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), rank(c).alias("rank"), c["stop"].alias("stop"), c["kind"].alias("kind"), c["base"].alias("base"), score(*weights, c["kind"], c["votes"], c["shape"]).alias("score")))
    return found.select("doc_id", F.array_sort(F.filter(scored, lambda c: c["base"] | (c["score"] >= threshold))).alias("spans"))


def named(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of what :func:`find` returns."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))
