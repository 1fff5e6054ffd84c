"""URL verdicts: explicit host and path rules first, then host reputation by empirical Bayes.

Labelled outcomes of pages (1: bad) are summed per host, registered domain and public suffix. Each level's beta-binomial prior has the posterior mean of the level above
as its mean and a strength estimated by moments from the spread of that level's rates, so a host with few labelled pages leans on its domain, and a domain on its suffix.
A url is blocked when the lower posterior bound of its host's bad rate lies above the limit. DataFrame functions only.
"""
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import ascii_lower, saved

# Fixed values: (rule, verdict) in the order given.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
# The public suffixes of more than one label known without a table of the caller's; any other suffix is the last label.
LONG_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn"]


def url_host(url: str) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.expr(f"substring({url}, locate('://', {url}) + 3)")
    return F.when(F.instr(F.col(url), "://") > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))


def url_path(url: str) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.expr(f"substring({url}, locate('://', {url}) + 3)")
    return F.when(F.instr(F.col(url), "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def matching_rule(host: Column, path: Column, rules) -> Column:
    """struct(rule, verdict) of the longest rule that fits the host or a domain above it and starts the path; null if none does. Rules are a list of configuration size."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest is tested first, being outermost
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def registered_domain(host: Column, suffixes=tuple(LONG_SUFFIXES)) -> tuple[Column, Column]:
    """(domain, suffix): the public suffix and the label before it; a bare suffix is its own domain.

    The suffix is the longest one of `suffixes` (of any number of labels, some ten thousand at most: they are literals of the plan) that ends the host, else its last label.
    """
    last = lambda k: F.substring_index(host, ".", -k)
    domain, suffix = last(2), last(1)
    by_labels = {}
    for s in suffixes:
        by_labels.setdefault(s.count(".") + 1, []).append(s)
    for k in sorted(by_labels):  # the longest is tested first, being outermost
        fits = last(k).isin(by_labels[k])
        domain, suffix = F.when(fits, last(k + 1)).otherwise(domain), F.when(fits, last(k)).otherwise(suffix)
    return domain, suffix


def _strength(rows: DataFrame, prior: str, name: str, most: float) -> DataFrame:
    """At most one row (one, name): prior strength by moments, from rates around their prior means; between 1 and `most`, `most` where rates spread no more than chance would."""
    p, v = F.col("bad") / F.col("n"), F.col(prior) * (1 - F.col(prior))
    s = rows.groupBy("one").agg(F.sum(F.col("n") * (p - F.col(prior)) ** 2).alias("s"), F.sum(v).alias("v"), F.sum(F.col("n") * v).alias("nv"))
    rho = (F.col("s") - F.col("v")) / F.nullif(F.col("nv") - F.col("v"), F.lit(0.0))
    return s.select("one", F.coalesce(F.when(rho > 0, F.least(F.lit(most), F.greatest(F.lit(1.0), 1 / rho - 1))), F.lit(most)).alias(name))


def host_reputation(hosts: DataFrame, most_strength: float = 1000.0, suffixes=tuple(LONG_SUFFIXES)) -> DataFrame:
    """Rows (host, n, bad) get mean and weight of the posterior of the host's bad rate. Without any labelled page the rate is 1/2 with the least weight."""
    domain, suffix = registered_domain(F.col("host"), suffixes)
    hosts = saved(hosts.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix"), F.lit(1).alias("one")))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    total = hosts.groupBy("one").agg(((F.sum("bad") + 0.5) / (F.sum("n") + 1.0)).alias("prior"))
    levels = {"suffix": hosts.groupBy("one", "suffix").agg(*sums), "domain": hosts.groupBy("one", "suffix", "domain").agg(*sums), "host": hosts}
    above, keys = total, ["one"]
    for level, rows in levels.items():
        rows = rows.join(above, keys)
        rows = rows.join(_strength(rows.filter("n > 0"), "prior", "strength", most_strength), "one", "left").fillna({"strength": most_strength})
        rows = saved(rows.withColumn("weight", F.col("strength") + F.col("n")).withColumn("mean", (F.col("prior") * F.col("strength") + F.col("bad")) / (F.col("strength") + F.col("n"))))
        keys = keys + [level] if level != "host" else keys
        above = rows.select(*keys, F.col("mean").alias("prior"))
    return rows.select("host", "mean", "weight")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=tuple(RULES), limit: float = 0.5, z: float = 1.645, suffixes=tuple(LONG_SUFFIXES)) -> DataFrame:
    """page_id, host, path, rule, verdict, one row per row of `pages`; `outcomes` has page_id and bad (0/1, null: not labelled).

    Null urls and urls without :// have empty host and path; they share the empty host's reputation. A page with several outcomes is bad if one of them is. Rows without an
    id have a verdict but no outcome. `suffixes` is the caller's table of public suffixes of more than one label. Empty tables give no rows, or priors only; other columns are ignored.
    """
    rows = pages.select("page_id", "url").select("page_id", F.coalesce(url_host("url"), F.lit("")).alias("host"), F.coalesce(url_path("url"), F.lit("")).alias("path"))
    known = outcomes.filter("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = rows.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    good = host_reputation(hosts, suffixes=suffixes).select("host", F.when(F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1)) > limit, "block").otherwise("allow").alias("_by_host"))
    met = rows.join(good, "host", "left").withColumn("_m", matching_rule(F.col("host"), F.col("path"), rules))
    return met.select("page_id", "host", "path", F.col("_m.rule").alias("rule"), F.coalesce(F.col("_m.verdict"), F.col("_by_host"), F.lit("allow")).alias("verdict"))
