"""URL rules and a character language-model ratio (operator 3), in DataFrame functions only.

URLs that a rule allows and URLs that a rule blocks train one character model each: counts of each character after its last
ORDER, ORDER - 1, ... 0 characters, over all of them, smoothed by falling back to the shorter context in proportion to the
longer one's support.  A URL's score is the difference of its log-likelihoods divided by its length.  The threshold lies
between the mean scores of the two training classes, nearer to the one that varies less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: (action, host, path): longest wins (fixed values)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
ORDER = 3
BACKOFF = 2.0  # weight of the shorter context, in observations
ALPHABET = 256.0  # characters that the shortest context spreads its weight over
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SMALL = 16 << 20  # bytes of grams or scored URLs that are broadcast at most


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    u = F.coalesce(url, F.lit(""))
    pattern = r"://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, action) of the longest rule that fits, else null."""
    out = None
    for action, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of each row of ``pages(page_id, url)``.

    The model reads host and path in lower case.  A URL without host and path scores 0.  Where one of the classes has no
    URL there is no model, and what no rule fits is allowed.
    """
    host, path = url_parts(F.col("url"))
    d = pages.select("page_id", host.alias("host"), path.alias("path"))
    d = d.withColumn("hit", rule_column(F.col("host"), F.col("path"), rules))
    d = d.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.action").alias("action"))
    # equal URLs are scored once, however often they occur
    urls = d.groupBy("host", "path").agg(F.count("*").alias("n"), F.first("action").alias("action"))
    urls = C.save(urls.withColumn("u", F.lower(F.concat(F.rpad(F.lit(""), ORDER, "\x01"), "host", "path", F.lit("\x02")))).withColumn("key", F.xxhash64("host", "path")), "op3-urls")
    # one row for each place: the character with its ORDER characters of context
    gram = F.explode(F.expr(f"transform(sequence(1, char_length(u) - {ORDER}), i -> substring(u, i, {ORDER + 1}))"))
    full = C.save(urls.select(gram.alias("g"), "n", "action").groupBy("g").agg(*[F.sum(F.when(F.col("action") == a, F.col("n")).otherwise(F.lit(0))).alias(a) for a in ("allow", "block")]), "op3-grams")
    p = {a: F.lit(1.0 / ALPHABET) for a in ("allow", "block")}
    model = full.select("g")
    for k in range(ORDER + 1):  # k characters of context
        tail = F.substring("g", ORDER + 1 - k, k + 1)
        sums = full.groupBy(tail.alias("t")).agg(F.sum("allow").alias(f"a{k}"), F.sum("block").alias(f"b{k}"))
        context = full.groupBy(F.substring("g", ORDER + 1 - k, k).alias("c")).agg(F.sum("allow").alias(f"ca{k}"), F.sum("block").alias(f"cb{k}"))
        model = model.withColumn("t", tail).join(sums, "t").drop("t")
        model = model.withColumn("c", F.substring("g", ORDER + 1 - k, k)).join(context, "c").drop("c")
        p["allow"] = (F.col(f"a{k}") + BACKOFF * p["allow"]) / (F.col(f"ca{k}") + BACKOFF)
        p["block"] = (F.col(f"b{k}") + BACKOFF * p["block"]) / (F.col(f"cb{k}") + BACKOFF)
    model = C.save(model.select("g", (F.log(p["allow"]) - F.log(p["block"])).alias("s")), "op3-model")
    few = model.agg(F.coalesce(F.sum(F.octet_length("g") + 16), F.lit(0))).first()[0] <= SMALL
    places = urls.select("key", gram.alias("g"))
    scored = places.join(F.broadcast(model) if few else model, "g").groupBy("key").agg(F.avg("s").alias("score"))
    scored = C.save(urls.join(scored, "key", "left").select("host", "path", "n", "action", F.when((F.col("host") == "") & (F.col("path") == ""), F.lit(0.0)).otherwise(F.col("score")).alias("score")), "op3-scores")
    of = {r["action"]: r for r in scored.where("action is not null").groupBy("action").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean"), F.coalesce(F.stddev("score"), F.lit(0.0)).alias("sd")).collect()}
    if len(of) == 2:
        a, b = of["allow"], of["block"]
        sa, sb = a["sd"] + 1e-9, b["sd"] + 1e-9
        limit = (a["mean"] * sb + b["mean"] * sa) / (sa + sb)
        model_verdict = F.when(F.col("score") >= limit, "allow").otherwise("block")
    else:
        model_verdict = F.lit("allow")
    few = scored.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 24), F.lit(0))).first()[0] <= SMALL
    by_url = scored.select("host", "path", "score")
    out = d.join(F.broadcast(by_url) if few else by_url, ["host", "path"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", model_verdict).alias("verdict"), "score")
