"""URL filter: block and allow rules, and for all other URLs two smoothed character Markov models.

Native DataFrame operations only. The URLs of a rule teach the rule's class, but for one in HELD_OUT of them, by a
hash of the URL: on these, which the models have not seen, the threshold is calibrated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Characters of a gram: up to this less one are context.
ORDER = 5
#: One in so many URLs is kept from the counts.
HELD_OUT = 5
#: Scores of grams are broadcast up to this many rows (about 60 bytes each), and shuffled beyond, but for those of
#: grams that make up one in HOT of all characters (so HOT at most), which are broadcast.
BROADCAST_GRAMS = 300_000
HOT = 4096

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """After the first '://': the host (A-Z lower-cased) up to /, ?, # or the end, then the path up to ? or #."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    return F.translate(rest, UPPER, LOWER), path


def longest_rule(rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits `host` or a parent of it and begins `path`; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith("/" + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def gram_list(order: int) -> Column:
    """The grams of a URL without its scheme: each character and the end with `order` - 1 characters before."""
    padded = F.concat(F.lit("\u0002" * (order - 1)), F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"(?s)^.*?://", ""), F.lit("\u0003"))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - order + 1), lambda i: F.substring(padded, i, F.lit(order)))


def gram_scores(counts: DataFrame, order: int) -> DataFrame:
    """(gram, gain): log p(last character | context) as an allowed URL, less that as a blocked one.

    `counts` has gram, allow, block. Witten-Bell: an order's estimate counts as much as its context was seen,
    the lower order's as much as the context had different characters. A context not seen leaves the lower
    order's estimate; below order 1 stands the same chance for each character.
    """
    full = counts.select("gram", *[F.col(c) for c in ("allow", "block")])
    alphabet = full.select(F.substring("gram", order, 1).alias("c")).distinct().count() or 1
    lower = None
    for k in range(1, order + 1):
        grams = full.select(F.substring("gram", order - k + 1, k).alias("g"), "allow", "block").groupBy("g").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
        context = F.substring("g", 1, k - 1)
        totals = grams.groupBy(context.alias("h")).agg(*[f for c in ("allow", "block") for f in (F.sum(c).alias(f"n_{c}"), F.sum((F.col(c) > 0).cast("long")).alias(f"t_{c}"))])
        table = grams.withColumn("h", context).join(totals, "h")
        if lower is None:
            table = table.withColumn("l_allow", F.lit(1.0 / alphabet)).withColumn("l_block", F.lit(1.0 / alphabet))
        else:
            table = table.withColumn("s", F.substring("g", 2, k - 1)).join(lower, "s")
        p = {c: F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"l_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"l_{c}")) for c in ("allow", "block")}
        lower = table.select(F.col("g").alias("s"), p["allow"].alias("l_allow"), p["block"].alias("l_block"))
    return lower.select(F.col("s").alias("gram"), (F.log("l_allow") - F.log("l_block")).alias("gain"))


def with_gains(exploded: DataFrame, counts: DataFrame, scores: DataFrame, most: int) -> DataFrame:
    """`exploded` (url, gram) with each gram's gain. Beyond `most` grams only the rows of grams that are not hot are shuffled."""
    if scores.count() <= most:
        return exploded.join(F.broadcast(scores), "gram").select("url", "gain")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = scores.join(F.broadcast(counts.filter(F.col("n") * HOT >= total).select("gram")), "gram")
    first = exploded.join(F.broadcast(hot), "gram", "left").select("url", "gram", "gain")
    rest = first.filter("gain IS NULL").drop("gain").join(scores, "gram").select("url", "gain")
    return first.filter("gain IS NOT NULL").select("url", "gain").unionByName(rest)


def held_out():
    """Whether a URL is kept from the counts, for the calibration."""
    return F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0


def filter_urls(pages: DataFrame, rules=RULES, order: int = ORDER, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """Judge each row of `pages` (page_id, url): page_id, host, path, rule, verdict, score, by_model
    (what the models alone would say) and held (whether the URL is held out).

    `rule` is the longest that fits, else null, and gives the verdict. Else the verdict is 'allow' if `score`,
    the mean log ratio of a character under the models of allowed and blocked URLs, reaches a threshold: the
    point between the two classes' mean scores of held-out URLs, nearer to the class that spreads less. Without
    held-out URLs of both classes the threshold is 0. An empty table gives no rows. Null URLs and those without '://' have an empty host and path and are scored
    as they are (null as empty). Only page_id and url are read; repeated rows are judged each. Counts cover all
    rows but the held-out ones.
    """
    host, path = host_and_path()
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(rules)
    urls = urls.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    # Equal URLs are scored once.
    distinct = stored(urls.groupBy("url").agg(F.first("ruled").alias("ruled"), F.count("*").alias("rows")), "urls")
    exploded = distinct.select("url", "ruled", "rows", F.explode(gram_list(order)).alias("gram"))
    classes = [F.sum(F.when((F.col("ruled") == c) & ~held_out(), F.col("rows")).otherwise(0)).alias(c) for c in ("allow", "block")]
    counts = stored(exploded.groupBy("gram").agg(*classes, F.count("*").alias("n")), "grams")
    scores = stored(gram_scores(counts, order), "scores")
    scored = with_gains(exploded.select("url", "gram"), counts, scores, broadcast_grams).groupBy("url").agg(F.avg("gain").alias("score"))
    judged = stored(urls.join(scored.withColumnRenamed("url", "__url"), F.col("url").eqNullSafe(F.col("__url"))).withColumn("held", held_out()).drop("__url", "url"), "judged")
    spread = {c: judged.filter(F.col("held") & (F.col("ruled") == c)).agg(F.avg("score"), F.coalesce(F.stddev_pop("score"), F.lit(0.0))).first() for c in ("allow", "block")}
    (a, sa), (b, sb) = spread["allow"], spread["block"]
    threshold = 0.0 if a is None or b is None else (a + b) / 2 if sa + sb == 0 else (a * sb + b * sa) / (sa + sb)
    by_model = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score", by_model.alias("by_model"), "held")


def op9_url_language_models(spark, sf_dir: str) -> DataFrame:
    """The verdict on every URL of pages."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("score", "by_model", "held")
