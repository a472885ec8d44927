"""URL filter by rules and by empirical-Bayes host reputation.

Rules decide first: a rule is host/path, it fits its host and all subdomains when the url's path starts with the rule's
path, and the longest fitting rule wins. All other urls go by reputation: the labelled outcomes of a host's pages are
shrunk through beta-binomial priors, from the whole table to the suffix, to the registered domain, to the host. The
strength of each prior is estimated from the spread between the groups of its level (moments of a beta-binomial).
A host is blocked when the upper bound of its posterior share of good pages is under the threshold.

Only expressions and SQL operators are used. Every group is summed before it is shuffled, so a host that holds a third
of all pages costs one row a task; the join back deals pages by host, where adaptive execution splits a hot one.

Edge cases: a null url, or one without "://", has an empty host and path, fits no rule and is judged like a host
without a name; pages without outcomes fall back to their domain's, suffix's and the table's share; a null outcome is no
outcome; repeated page ids each count; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapoint.llm.common import staged

#: Suffixes of two labels, for registered domains; a parameter. Fixed values.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def _ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def parsed(pages: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host and path of each row."""
    url = F.coalesce(F.col(url_column).cast("string"), F.lit(""))
    cut = pages.select(F.col(id_column).cast("long").alias("page_id"), url.alias("url"), F.instr(url, "://").alias("at"))
    cut = cut.withColumn("rest", F.when(F.col("at") > 0, F.substring("url", F.col("at") + 3, F.length("url"))).otherwise(""))
    cut = cut.withColumn("host", F.regexp_extract("rest", "^[^/?#]*", 0))
    path = F.regexp_extract(F.substring("rest", F.length("host") + 1, F.length("rest")), "^[^?#]*", 0)
    return cut.select("page_id", _ascii_lower(F.col("host")).alias("host"), path.alias("path"))


def rule_columns(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) for the columns host and path; null where none fits. rules: (verdict, host/path)."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def domain_columns(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a port is left out, and an IPv4 address is its own domain."""
    name = F.regexp_replace(host, "(:[0-9]*)?$", "")
    labels = F.split(F.regexp_replace(name, "\\.$", ""), "\\.")
    two = F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2))
    long = two.isin(*TWO_LABEL_SUFFIXES)
    three = F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 2), 3))
    address = name.rlike("^[0-9]+(\\.[0-9]+){3}$")
    suffix = F.when(address, "").when(long, two).otherwise(F.element_at(labels, -1))
    return F.when(address, name).when(long, three).otherwise(two), suffix


def strength(groups: DataFrame, mean: float) -> float:
    """Prior strength a + b of the beta distribution that the groups' shares (good of n) seem to come from."""
    has = groups.where("n > 0")
    r = has.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.lit(mean), 2.0)).alias("s")).first()
    spread = mean * (1 - mean)
    if not r["n"] or r["k"] < 2 or spread <= 0:
        return MOST_STRENGTH
    free = r["n"] - r["n2"] / r["n"] - (r["k"] - 1)
    rho = (r["s"] / spread - (r["k"] - 1)) / free if free > 0 else 0.0
    return min(MOST_STRENGTH, max(LEAST_STRENGTH, (1 - rho) / rho)) if rho > 0 else MOST_STRENGTH


def host_reputation(hosts: DataFrame, z: float) -> DataFrame:
    """hosts: host, good, n. Adds the posterior mean and the upper bound of the share of good pages."""
    totals = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    mean = (totals["good"] + 1) / (totals["n"] + 2) if totals["n"] else 0.5
    domain, suffix = domain_columns(F.col("host"))
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    k_suffix, k_domain, k_host = strength(suffixes, mean), strength(domains, mean), strength(hosts, mean)
    suffixes = suffixes.select("suffix", ((F.col("good") + k_suffix * mean) / (F.col("n") + k_suffix)).alias("prior"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", ((F.col("good") + k_domain * F.col("prior")) / (F.col("n") + k_domain)).alias("prior"))
    a, b = F.col("good") + k_host * F.col("prior"), F.col("n") - F.col("good") + k_host * (1 - F.col("prior"))
    share = a / (a + b)
    bound = F.least(F.lit(1.0), share + z * F.sqrt(share * (1 - share) / (a + b + 1)))
    return hosts.join(domains, ["domain", "suffix"]).select("host", "n", share.alias("posterior"), bound.alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], threshold: float = 0.5, z: float = 1.645, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, posterior, bound for every page. outcomes: page_id and good (1 or 0)."""
    urls = parsed(pages, id_column, url_column)
    known = outcomes.select(F.col("page_id").cast("long").alias("page_id"), F.col("good").cast("long").alias("good")).where("page_id is not null and good is not null")
    labelled = urls.select("page_id", "host").join(known, "page_id").groupBy("host").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))
    none = urls.groupBy("host").agg(F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("n"))
    hosts = none.unionByName(labelled).groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    reputation = host_reputation(staged(hosts, "url-hosts"), z)
    rule, verdict = rule_columns(rules)
    own = F.when(F.col("bound") < threshold, "block").otherwise("allow")
    return urls.join(reputation, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("posterior", 6).alias("posterior"), F.round("bound", 6).alias("bound"))
