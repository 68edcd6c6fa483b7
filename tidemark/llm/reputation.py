"""URL filtering by rules and, where no rule fits, by empirical-Bayes host reputation.

Labelled page outcomes are counted per host, registered domain and suffix. Each level's bad rate has a
beta prior centred on the level above (the suffix on the corpus rate); the strength of a level's prior
is fitted from its own counts by moments. A url is blocked if the posterior bound of its host's bad rate
(mean plus ``DEVIATIONS`` standard deviations below) lies above ``LIMIT``.

Hosts without labels take their domain's, suffix's or the corpus posterior. Defined results: a null url
or one without ``://`` has empty host and path; null labels are not counted; a page labelled twice counts
twice; without any label everything outside the rules is allowed; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.native import _LOWER, _UPPER, small
from tidemark.llm.storage import materialize

# Verdict, host, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LIMIT = 0.5
DEVIATIONS = 1.64
#: Under a country's two letters these labels are part of the suffix, after which the registered domain has a third; all other suffixes have one label.
GENERIC = "ac|co|com|edu|gob|gov|go|gouv|ltd|me|mil|ne|net|nom|or|org|plc|sch"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host. User and port are no part of either; an address in numbers is a domain without suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    number = bare.rlike(r"^([0-9]+\.){3}[0-9]+$|^\[")
    two = F.substring_index(bare, ".", -2)
    long = two.rlike(rf"^({GENERIC})\.[a-z]{{2}}$")
    suffix = F.when(number, F.lit("")).when(long, two).otherwise(F.substring_index(bare, ".", -1))
    domain = F.when(number, bare).when(long, F.substring_index(bare, ".", -3)).otherwise(two)
    return domain, suffix


def _strength(counts: DataFrame, mean: Column) -> DataFrame:
    """One row: the prior's weight in pages, by moments of the level's rates around ``mean``; at most 1000, at least 1."""
    n, r = F.col("n"), F.col("bad") / F.col("n")
    parts = counts.agg(F.sum(n * (r - mean) * (r - mean)).alias("between"), F.sum(mean * (1 - mean)).alias("chance"), F.sum((n - 1) * mean * (1 - mean)).alias("room"))
    # E[n (r - m)^2] = m (1 - m) (1 + (n - 1) / (k + 1)) for a beta prior of weight k
    rho = F.try_divide(F.col("between") - F.col("chance"), F.col("room"))
    return parts.select(F.coalesce(F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.try_divide(1 - rho, F.greatest(rho, F.lit(0.0))))), F.lit(1000.0)).alias("k"))


def reputations(pages: DataFrame, labels: DataFrame, bad: Column, page_id: str = "page_id", label_id: str = "doc_id", url_col: str = "url") -> DataFrame:
    """level ('corpus', 'suffix', 'domain', 'host'), name, alpha, beta: the posteriors of every level that has labels."""
    marked = labels.select(F.col(label_id).alias("id"), bad.cast("int").alias("bad")).where("bad IS NOT NULL AND id IS NOT NULL")
    host = host_of(F.col(url_col).cast("string"))
    seen = pages.select(F.col(page_id).alias("id"), host.alias("host")).where("host <> ''").join(marked, "id")
    domain, suffix = levels(F.col("host"))
    hosts = materialize(seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    total = hosts.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5).alias("alpha"), (F.coalesce(F.sum(F.col("n") - F.col("bad")), F.lit(0)) + 1.0).alias("beta"))
    above = total.select(F.lit("").alias("up"), "alpha", "beta")
    out = total.select(F.lit("corpus").alias("level"), F.lit("").alias("name"), "alpha", "beta")
    for level, up in (("suffix", F.lit("")), ("domain", F.col("suffix")), ("host", F.col("domain"))):
        counts = hosts.groupBy(F.col(level).alias("name"), up.alias("up")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(above, "up").withColumn("m", F.col("alpha") / (F.col("alpha") + F.col("beta")))
        fitted = counts.join(F.broadcast(_strength(counts, F.col("m"))))
        posterior = materialize(fitted.select("name", (F.col("k") * F.col("m") + F.col("bad")).alias("alpha"), (F.col("k") * (1 - F.col("m")) + F.col("n") - F.col("bad")).alias("beta")), level)
        out = out.unionByName(posterior.select(F.lit(level).alias("level"), "name", "alpha", "beta"))
        above = posterior.withColumnRenamed("name", "up")
    return out


def filter_urls(pages: DataFrame, labels: DataFrame, bad: Column, page_id: str = "page_id", label_id: str = "doc_id", url_col: str = "url", rules: tuple = RULES, limit: float = LIMIT) -> DataFrame:
    """Per page: id, host, path, rule, verdict, and the bad rate's bound that decides where no rule fits."""
    known = materialize(reputations(pages, labels, bad, page_id, label_id, url_col), "reputations")
    a, b = F.col("alpha"), F.col("beta")
    mean = a / (a + b)
    known = known.select("level", "name", (mean - DEVIATIONS * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("bound"))
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(page_id).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    domain, suffix = levels(F.col("host"))
    rows = rows.withColumn("domain", domain).withColumn("suffix", suffix).withColumn("corpus", F.lit(""))
    for level in ("host", "domain", "suffix", "corpus"):
        at = materialize(known.where(F.col("level") == level).select(F.col("name").alias(level), F.col("bound").alias(f"{level}_bound")), level)
        rows = rows.join(small(at, at.count(), 500_000), level, "left")
    bound = F.coalesce("host_bound", "domain_bound", "suffix_bound", "corpus_bound")
    chosen = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select(F.col("_id").alias(page_id), "host", "path", chosen.alias("r"), bound.alias("bound"))
    return rows.select(page_id, "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.when(F.col("bound") > limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "bound")
