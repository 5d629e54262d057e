"""URL filter by rules and by the empirical-Bayes reputation of hosts (DataFrame functions only).

Rules judge the urls they fit, and the pages they judge are the labelled outcomes that reputations are learned from;
other outcomes can be given instead. The share of good pages of a host is shrunk towards that of its registered domain,
this towards that of the suffix, and this towards that of all pages. Each step is a beta-binomial model: what hangs
below one parent has shares drawn from Beta(strength * mean of the parent, strength * (1 - mean)), and the strength is
estimated from how much the children of all parents differ beyond chance (analysis of variance of nested groups). A
host is blocked if even the upper bound of its share of good pages is below the threshold, so hosts of which little
is known are let through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from silvaspark.runtime import written

#: Labels that registries put before a country's suffix, as in co.uk.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "or", "org"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    def __post_init__(self):
        if self.verdict not in ("allow", "block"):
            raise ValueError(f"a rule allows or blocks, not {self.verdict!r}")


@dataclass(frozen=True)
class Params:
    #: A host is blocked if mean + z standard deviations of the share of its good pages is below ``least_good``.
    least_good: float = 0.5
    z: float = 1.64
    #: Bounds of the strengths, for levels that differ as chance has it or have no two children to compare.
    weakest: float = 0.5
    strongest: float = 1000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _labels(host: Column) -> Column:
    return F.split(F.regexp_replace(host, ":[0-9]*$|^.*@", ""), "\\.")


def suffix_of(host: Column) -> Column:
    """Last label of a host, or two of a country's second level; a whole address of digits. No user, no port."""
    parts = _labels(host)
    n = F.size(parts)
    last, before = F.get(parts, n - 1), F.get(parts, n - 2)
    address = F.array_join(parts, ".").rlike("^[0-9.]+$|^\\[")
    return F.when(address, F.array_join(parts, ".")).when((F.length(last) == 2) & before.isin(SECOND_LEVEL) & (n > 2), F.concat_ws(".", before, last)).otherwise(last)


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix and the label before it."""
    bare = F.array_join(_labels(host), ".")
    rest = F.substr(bare, F.lit(1), F.length(bare) - F.length(suffix) - 1)
    return F.when(F.length(bare) <= F.length(suffix) + 1, bare).otherwise(F.concat_ws(".", F.substring_index(rest, ".", -1), suffix))


def rules_of_hosts(spark: SparkSession, hosts: DataFrame, rules: list[Rule]) -> DataFrame:
    """``hosts`` with the array ``rules`` of struct(path, size, block, name) that fit the host.

    Hosts meet rules by equality: each host comes with the ends of it that begin after a dot and have no more labels than
    the longest rule, so hosts of very many labels cost no more than others."""
    if not rules:
        return hosts.withColumn("rules", F.array().cast("array<struct<size:int,path_size:int,block:boolean,path:string,name:string>>"))
    given = spark.createDataFrame([(r.host, r.path, r.verdict == "block") for r in rules], "rule_host string, path string, block boolean")
    parts = F.split("host", "\\.")
    most = max(r.host.count(".") for r in rules) + 1
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(most))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    met = hosts.select("host", F.explode(ends).alias("rule_host")).join(given, "rule_host")
    name = F.concat("rule_host", "path")
    one = F.struct(F.length(name).alias("size"), F.length("path").alias("path_size"), "block", "path", name.alias("name"))
    fitting = met.groupBy("host").agg(F.collect_set(one).alias("rules"))
    return hosts.join(fitting, "host", "left").withColumn("rules", F.coalesce("rules", F.array()))


def best_rule(path: Column, rules: Column) -> Column:
    """The longest of the rules whose path begins ``path``; of equally long ones that of the longer path, then the one that blocks."""
    return F.array_max(F.filter(rules, lambda r: F.startswith(path, r["path"])))


def _strength(children: DataFrame, parent: str, p: Params) -> DataFrame:
    """One row: the strength of the beta distributions that the children (good, n) of each ``parent`` were drawn from."""
    x, n = F.col("good").cast("double"), F.col("n").cast("double")
    g = children.where("n > 0").groupBy(parent).agg(F.count("*").alias("k"), F.sum(x).alias("x"), F.sum(n).alias("n"), F.sum(x * x / n).alias("xx"), F.sum(n * n).alias("nn"))
    q = F.col("x") / F.col("n") * (1 - F.col("x") / F.col("n"))
    beyond = F.col("xx") - F.col("x") * F.col("x") / F.col("n") - (F.col("k") - 1) * q
    room = q * (F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1))
    s = g.agg(F.coalesce(F.sum(beyond), F.lit(0.0)).alias("beyond"), F.coalesce(F.sum(room), F.lit(0.0)).alias("room"))
    share = F.when((F.col("room") > 0) & (F.col("beyond") > 0), F.col("beyond") / F.col("room")).otherwise(0.0)
    share = F.least(F.greatest(share, F.lit(1 / (1 + p.strongest))), F.lit(1 / (1 + p.weakest)))
    return s.select(F.round(1 / share - 1, 6).alias("strength"))


def reputations(hosts: DataFrame, p: Params = Params()) -> DataFrame:
    """(host, n, good, mean, upper, blocked) from ``hosts(host, suffix, domain, n, good)``.

    All tables here have a row a host at most, and what is sent to all tasks is one row: the totals and three strengths."""
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(((F.coalesce(F.sum("good"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m0"))
    fit = total
    for name, children, parent in (("s1", suffixes.withColumn("all", F.lit(0)), "all"), ("s2", domains, "suffix"), ("s3", hosts, "domain")):
        fit = fit.crossJoin(F.broadcast(_strength(children, parent, p).withColumnRenamed("strength", name)))  # one row each
    n, good = F.col("n"), F.col("good")
    shrunk = lambda s, mean: (F.col(s) * F.col(mean) + good) / (F.col(s) + n)
    of_suffix = suffixes.crossJoin(F.broadcast(fit)).select("suffix", "s2", "s3", shrunk("s1", "m0").alias("m1"))
    of_domain = domains.join(of_suffix, "suffix").select("suffix", "domain", "s3", shrunk("s2", "m1").alias("m2"))
    a, b = F.col("s3") * F.col("m2") + good, F.col("s3") * (1 - F.col("m2")) + n - good
    mean = a / (a + b)
    upper = mean + F.lit(p.z) * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return hosts.join(of_domain, ["suffix", "domain"]).select("host", "n", "good", mean.alias("mean"), upper.alias("upper"), (upper < p.least_good).alias("blocked"))


def judge(pages: DataFrame, rules: list[Rule], p: Params = Params(), page_id: str = "page_id", url: str = "url", good: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``, repeated rows and null ids included.

    ``rule`` is the rule that fits, its host and path joined, or null; ``verdict`` is the rule's, else the reputation's
    of the host. ``good`` may give outcomes (true, false, null: unknown) as a column of ``pages``; by default a page that
    a rule allows is good and one that a rule blocks is not. A null url and one without ``://`` have an empty host and
    path, which are judged like any other. An empty table gives an empty result; further columns are ignored.

    Pages meet hosts in joins of one row a host. Hosts are written first, so their size is known: Spark sends them to
    all tasks below its broadcast threshold, and beyond splits the rows of hot hosts over tasks.
    """
    own = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), (F.lit(None).cast("boolean") if good is None else good).alias("good"))
    spark = pages.sparkSession
    named = own.groupBy("host").agg(F.count("*").alias("pages"))
    named = written(rules_of_hosts(spark, named, rules), "hosts")
    with_rule = lambda hosts: own.join(hosts, "host").withColumn("r", best_rule(F.col("path"), F.col("rules")))
    outcome = ~F.col("r.block") if good is None else F.col("good")
    counts = with_rule(named).groupBy("host").agg(F.count(outcome).alias("n"), F.count_if(outcome).alias("good"))
    suffix = suffix_of(F.col("host"))
    hosts = counts.select("host", suffix.alias("suffix"), domain_of(F.col("host"), suffix).alias("domain"), "n", "good")
    known = reputations(written(hosts, "outcomes"), p).select("host", "blocked")
    judged = with_rule(written(named.join(known, "host"), "reputations"))
    verdict = F.when(F.coalesce(F.col("r.block"), F.col("blocked")), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("r.name").alias("rule"), verdict.alias("verdict"))
