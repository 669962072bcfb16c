"""URL verdicts: host and path rules, and for the rest a ratio of character language models. DataFrame functions only.

The rules decide some urls; those are the accepted and rejected examples of the
models. Each model is a variable-order Markov model of characters, orders 0 to
3, smoothed by interpolation with the number of distinct successors
(Witten-Bell). Characters are folded to 33 symbols, so that there are at most
33^4 contexts with successors: the table of log ratios has a proven bound, and
is broadcast. A url's score is the mean log ratio of its characters; the
threshold is the one with the least balanced error on a fifth of the decided
urls that the models haven't seen.

All sums are of integers (log ratios times 2^20), so scores don't depend on the
order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .lineage import cut
from .salted import looked_up

#: (verdict, host and path)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

MODELS = ("allow", "block")
ORDER = 3
SYMBOLS = 33
UNIT = 1 << 20
SHIFT = 1 << 25
EVEN = 32_000
HELD_OUT = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as struct(rule, verdict), else null. Rules are a short configured list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, _, below = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """The url over 33 symbols: a-z, 0 for digits, / . - : ? for the rest, and ^ before the start."""
    lower = F.translate(F.coalesce(url, F.lit("")), _UPPER, _LOWER)
    return F.concat(F.lit("^" * ORDER), F.regexp_replace(F.regexp_replace(lower, "[0-9]", "0"), "[^a-z0/.:-]", "?"))


def log_ratios(grams: DataFrame) -> DataFrame:
    """(gram, weight) for every gram of ``grams`` (gram, allow, block: how often each model's urls have it)."""
    out, p = grams.select("gram"), {}
    for size in range(1, ORDER + 2):
        n = grams.groupBy(F.substring("gram", ORDER + 2 - size, size).alias("g")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        sums = [x for v in MODELS for x in (F.sum(v).alias(f"{v}_all"), F.sum((F.col(v) > 0).cast("long")).alias(f"{v}_kinds"))]
        contexts = n.groupBy(F.substring("g", 1, size - 1).alias("c")).agg(*sums)
        out = out.withColumn("g", F.substring("gram", ORDER + 2 - size, size)).withColumn("c", F.substring("gram", ORDER + 2 - size, size - 1))
        out = out.join(n, "g", "left").join(contexts, "c", "left")
        for v in MODELS:
            count, every, kinds = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in (v, f"{v}_all", f"{v}_kinds"))
            lower = p.get(v, F.lit(1.0) / F.lit(float(SYMBOLS)))
            p[v] = F.when(every > 0, (count + kinds * lower) / (every + kinds)).otherwise(lower)
        out = out.select("gram", *(p[v].alias(f"p_{v}") for v in MODELS))
        p = {v: F.col(f"p_{v}") for v in MODELS}
    return out.select("gram", F.round((F.log("p_allow") - F.log("p_block")) * UNIT).cast("long").alias("weight"))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per input row.

    A null url, or one without ://, has an empty host and path and no rule; a
    null url has a score of 0. Without examples of both verdicts the threshold
    is 0. Repeated rows are judged alike; an empty table gives an empty result.
    """
    host, path = split_url(F.col("url"))
    base = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    base = base.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("fit", rule_for(F.col("host"), F.col("path"), rules))

    # copies of a url count each, but are cut into grams once; a gram's row carries the url's digest, so that a very long url makes no long rows
    base = base.withColumn("key", F.md5("url"))
    urls = base.where("url <> ''").groupBy("key", "url").agg(F.first("fit.verdict").alias("known"), F.count("*").alias("times"))
    held = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % HELD_OUT == 0
    every = F.regexp_extract_all(symbols(F.col("url")), F.lit(f"(?=(.{{{ORDER + 1}}}))"), F.lit(1))
    grams = urls.select("key", "known", "times", held.alias("held"), F.explode(every).alias("gram"))
    learn = lambda v: F.sum(F.when((F.col("known") == v) & ~F.col("held"), F.col("times")).otherwise(0)).alias(v)
    counted = cut(grams.groupBy("gram").agg(learn("allow"), learn("block")))  # at most 33^4 rows
    weights = log_ratios(counted)

    scores = grams.join(F.broadcast(weights), "gram").groupBy("key").agg(F.sum("weight").alias("total"), F.count("*").alias("size"), F.first("known").alias("known"), F.first("held").alias("held"), F.first("times").alias("times"))
    scores = scores.withColumn("q", F.expr(f"((total + size * {SHIFT}) * 1000) div (size * {UNIT})"))
    scores = cut(scores)
    limit = threshold(scores.where("held and known is not null"))

    out = looked_up(base.drop("url"), "key", ["page_id"], scores.select("key", "q"), "left").withColumn("q", F.coalesce("q", F.lit(EVEN)))
    verdict = F.coalesce("fit.verdict", F.when(F.col("q") >= limit, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), (F.col("q") / 1000.0 - 32.0).alias("score"))


def threshold(held: DataFrame) -> int:
    """The least score, in thousandths and shifted, that is accepted: the one with the least balanced error.

    There is a row for each distinct score, at most 64,000, whatever the input.
    """
    by = held.groupBy("q").agg(*(F.sum(F.when(F.col("known") == v, F.col("times")).otherwise(0)).alias(v) for v in ("allow", "block")))
    below = W.orderBy("q").rowsBetween(W.unboundedPreceding, -1)
    errors = by.select("q", F.coalesce(F.sum("allow").over(below), F.lit(0)).alias("lost"), (F.sum("block").over(W.partitionBy()) - F.coalesce(F.sum("block").over(below), F.lit(0))).alias("let"), F.sum("allow").over(W.partitionBy()).alias("allows"), F.sum("block").over(W.partitionBy()).alias("blocks"))
    best = errors.where("allows > 0 and blocks > 0").orderBy(F.expr("let * allows + lost * blocks"), "q").first()
    return best["q"] if best else EVEN
