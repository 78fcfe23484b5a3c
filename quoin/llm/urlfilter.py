"""URL filter: longest matching rule, else a ratio of character language models. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.lineage import cut

ORDER = 4
PRIOR = 2.0
LEAST_CONTEXT = 2
ALPHABET = 256
UNIT = 1_000_000
BINS = 2000
MOST_GRAMS = 500_000
SALTS = 32
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a URL; both empty for null or without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule (host and path together) that fits, and its verdict; both null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _smoothed(grams: DataFrame, order: int) -> DataFrame:
    """grams(gram, yes, no) -> (gram, gain): log p(last char | context) of accepted over rejected URLs, in millionths.

    p is interpolated from order 0 up with a Dirichlet prior; contexts a class has seen fewer than
    LEAST_CONTEXT times leave it to the next shorter one (variable order).
    """
    level = grams
    levels = {order: grams}
    for k in range(order - 1, -1, -1):
        level = level.groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        levels[k] = level
    total = levels[0].agg(F.sum("yes").alias("cy"), F.sum("no").alias("cn"))
    base = lambda n, c: (F.col(n) + F.lit(1.0)) / (F.col(c) + F.lit(float(ALPHABET)))
    model = levels[0].crossJoin(F.broadcast(total)).select("gram", base("yes", "cy").alias("py"), base("no", "cn").alias("pn"))
    for k in range(1, order + 1):
        context = Window.partitionBy(F.expr(f"substring(gram, 1, {k})"))
        here = levels[k].withColumn("cy", F.sum("yes").over(context)).withColumn("cn", F.sum("no").over(context)).withColumn("tail", F.expr("substring(gram, 2)"))
        lower = model.select(F.col("gram").alias("tail"), "py", "pn")
        mixed = lambda n, c, p: F.when(F.col(c) < LEAST_CONTEXT, F.col(p)).otherwise((F.col(n) + PRIOR * F.col(p)) / (F.col(c) + PRIOR))
        model = here.join(lower, "tail").select("gram", mixed("yes", "cy", "py").alias("py"), mixed("no", "cn", "pn").alias("pn"))
    return model.select("gram", F.round(F.log(F.col("py") / F.col("pn")) * UNIT).cast("long").alias("gain"))


def _grams(url: Column, order: int) -> Column:
    """Every character of a lower-cased URL (and its end) behind the order characters before it."""
    line = F.concat(F.lit("\x02" * order), F.lower(url), F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(line) - order), lambda i: F.substring(line, i, F.lit(order + 1)))


def _gains(chars: DataFrame, model: DataFrame, most: int = MOST_GRAMS) -> DataFrame:
    """chars with the gain of their gram.

    A model of at most most grams (counted) is broadcast, so characters aren't shuffled; a larger one
    meets them by gram and a salt of their URL, so that no task holds all rows of a common gram.
    """
    if model.limit(most + 1).count() <= most:
        return chars.join(F.broadcast(model), "gram")
    spread = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<int>")))
    return chars.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int")).join(spread, ["gram", "salt"]).drop("salt")


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row of pages.

    URLs that a rule judges train the models: half of them (by hash) give the counts of accepted and
    rejected character sequences, the other half calibrates the cut on the length-normalised
    log-likelihood difference (score): the one with the best mean of both classes' accuracies. A URL
    without a rule is allowed if its score reaches the cut. Each distinct URL is scored once, with
    whole-number sums, so reruns agree.

    Null URLs have empty host and path, no rule and a null score; they are blocked, as nothing
    speaks for them, and so is an empty URL. With no judged URLs (an empty table, or no rule that
    fits) all scores are 0 and the verdict is allow. Null and repeated ids stay; other columns are
    ignored.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict).withColumn("k1", F.xxhash64("url")).withColumn("k2", F.hash("url"))
    half = F.pmod(F.xxhash64(F.lit(5), "url"), F.lit(2))
    part = F.when(F.col("ruled").isNull(), F.lit(2)).otherwise(half)
    urls = rows.where("url is not null and url <> ''").groupBy("k1", "k2").agg(F.first("url").alias("url"), F.first("ruled").alias("ruled")).withColumn("part", part)
    chars = urls.select("k1", "k2", "part", "ruled", F.explode(_grams(F.col("url"), order)).alias("gram"))
    counted = cut(chars.groupBy("gram").agg(F.count(F.when((F.col("part") == 0) & (F.col("ruled") == "allow"), 1)).alias("yes"), F.count(F.when((F.col("part") == 0) & (F.col("ruled") == "block"), 1)).alias("no")))
    model = cut(_smoothed(counted, order))
    sums = _gains(chars.where("part > 0"), model).groupBy("k1", "k2").agg(F.sum("gain").alias("gain"), F.count("*").alias("chars"), F.first("part").alias("part"), F.first("ruled").alias("ruled"))
    scored = cut(sums.withColumn("score", F.floor(F.col("gain") / F.col("chars")).cast("long")))
    step = UNIT // 100
    bins = scored.where("part = 1").withColumn("bin", F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.floor(F.col("score") / step)))).groupBy("bin").agg(F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"))
    # at most 4,001 bins
    above, every = Window.orderBy(F.desc("bin")), Window.partitionBy()
    share = lambda n: F.coalesce(F.sum(n).over(above) / F.nullif(F.sum(n).over(every), F.lit(0)), F.lit(0.0))
    best = bins.withColumn("gap", share("good") - share("bad")).agg((F.coalesce(F.max_by("bin", F.struct("gap", "bin")), F.lit(0)) * step).alias("least"))
    known = scored.select("k1", "k2", "score").crossJoin(F.broadcast(best))
    out = rows.join(known, ["k1", "k2"], "left")
    own = F.when(F.coalesce("url", F.lit("")) == "", F.lit("block")).when(F.coalesce("score", F.lit(0)) >= F.coalesce("least", F.lit(0)), F.lit("allow")).otherwise(F.lit("block"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), (F.col("score") / UNIT).alias("score"))
