"""URL filters: fixed rules first, and an empirical-Bayes reputation of hosts for the rest.

Labelled page outcomes give counts of good and bad pages by host. Beta-binomial priors are fitted by moments and
shrink host counts towards their registered domain, the domain towards its suffix and the suffix towards all
pages. A host is blocked if even the upper bound of its posterior share of good pages is below a threshold.
All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import common

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
BOUND_Z = 2.0  # standard deviations of the posterior
LEAST_GOOD = 0.5  # block hosts that are surely below this share of good pages
SECOND_LEVEL = ("co", "com", "net", "org", "gov", "edu", "ac")  # under a suffix of two letters these belong to the suffix


def with_host_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; both empty for a null url and for one without ``://``."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    after = F.coalesce(after, F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; both null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a later one is longer and wins
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _levels(hosts: DataFrame) -> DataFrame:
    """Adds the registered domain and the suffix of each host."""
    parts = F.split("host", r"\.")
    two = (F.size(parts) >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.element_at(parts, -2).isin(*SECOND_LEVEL)
    n = F.when(two, 2).otherwise(1)
    last = lambda k: F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - k + 1, F.lit(1)), k))
    return hosts.withColumn("suffix", last(n)).withColumn("domain", last(n + 1))


def _strength(groups: DataFrame, by: list[str]) -> DataFrame:
    """For each parent in ``by``: the prior's weight in pages, by the moments of its children's shares.

    With shares p of n pages around the mean m, the variance beyond the binomial one gives the weight
    m (1 - m) / excess - 1, held between 2 and 1000; without excess the children are alike and it is 1000.
    """
    total = groups.groupBy(*by).agg(F.sum("good").alias("_g"), F.sum("n").alias("_n"), F.count("*").alias("_k"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("_s"), F.sum(F.col("n") * F.col("n")).alias("_nn"))
    m = F.col("_g") / F.col("_n")
    between = F.col("_s") - F.col("_g") * m  # sum of n (p - m)^2
    excess = (between - (F.col("_k") - 1) * m * (1 - m)) / (F.col("_n") - F.col("_nn") / F.col("_n"))
    weight = F.when((F.col("_k") < 2) | (m <= 0) | (m >= 1), 20.0).when(excess <= 0, 1000.0).otherwise(F.least(F.greatest(m * (1 - m) / excess - 1, F.lit(2.0)), F.lit(1000.0)))
    return total.select(*by, weight.alias("weight"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """One row per host of ``outcomes`` (host, good 0/1 or null): posterior mean and deviation of its share of good pages.

    A host with nulls only has the prior of its domain, else of its suffix, else of all pages.
    Pages are summed by host before anything else, so a host with a third of all pages is one row a task.
    """
    every = common.written(_levels(outcomes.groupBy("host").agg(F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good"), F.count("good").cast("double").alias("n"))), "hosts")
    hosts = every.where("n > 0")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    # one row each: the prior of all pages
    mean = F.lit(suffixes.agg((F.coalesce(F.sum("good"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0.0)) + 2)).first()[0])
    weight = F.lit(_strength(suffixes, []).first()["weight"])
    top = suffixes.select("suffix", ((F.col("good") + mean * weight) / (F.col("n") + weight)).alias("mean"))
    under = top.join(_strength(domains, ["suffix"]), "suffix")
    middle = domains.join(under, "suffix")
    middle = middle.select("domain", ((F.col("good") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))).alias("mean"))
    middle = middle.join(_strength(hosts, ["domain"]), "domain")
    own = every.join(middle.withColumnsRenamed({"mean": "_m0", "weight": "_w0"}), "domain", "left").join(under.withColumnsRenamed({"mean": "_m1", "weight": "_w1"}), "suffix", "left")
    own = own.withColumn("mean", F.coalesce("_m0", "_m1", mean)).withColumn("weight", F.coalesce("_w0", "_w1", weight))
    a, b = F.col("good") + F.col("mean") * F.col("weight"), F.col("n") - F.col("good") + (1 - F.col("mean")) * F.col("weight")
    return own.select("host", (a / (a + b)).alias("reputation"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and reputation of every page.

    ``outcomes`` has page_id and good (0 or 1; other values and nulls are left out). A host without outcomes
    is judged by what is known of its domain, suffix or all pages. Repeated pages are judged as often as they occur. Null urls
    and those without ``://`` have the empty host, and so one reputation.
    """
    split = with_host_path(pages.select("page_id", "url"))
    known = outcomes.where(F.col("good").isin(0, 1) & F.col("page_id").isNotNull()).groupBy("page_id").agg(F.min("good").alias("good"))
    hosts = reputation(split.select("page_id", "host").join(known, "page_id", "left").select("host", "good"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    upper = F.col("reputation") + BOUND_Z * F.col("deviation")
    method = F.when(upper < LEAST_GOOD, F.lit("block")).otherwise(F.lit("allow"))
    return split.join(hosts, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "reputation")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are judged by the labels of the documents that carry their number."""
    labels = common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judge(common.table(spark, sf_dir, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(after, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), hosts AS (
  SELECT host, coalesce(sum(good), 0)::DOUBLE AS good, count(good)::DOUBLE AS n FROM split
  LEFT JOIN (SELECT doc_id AS page_id, min(quality) AS good FROM labels WHERE quality IN (0, 1) GROUP BY 1) USING (page_id) GROUP BY 1
), parts AS (SELECT *, string_split(host, '.') AS p FROM hosts
), leveled AS (
  SELECT host, good, n, array_to_string(p[greatest(len(p) - k + 1, 1):len(p)], '.') AS suffix, array_to_string(p[greatest(len(p) - k, 1):len(p)], '.') AS domain
  FROM (SELECT *, CASE WHEN len(p) >= 3 AND length(p[-1]) = 2 AND p[-2] IN ('co','com','net','org','gov','edu','ac') THEN 2 ELSE 1 END AS k FROM parts)
), rated AS (SELECT * FROM leveled WHERE n > 0
), domains AS (SELECT suffix, domain, sum(good) AS good, sum(n) AS n FROM rated GROUP BY 1, 2
), suffixes AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM domains GROUP BY 1
), moments AS (
  SELECT 'all' AS level, '' AS parent, sum(good) AS g, sum(n) AS n, count(*) AS k, sum(good * good / n) AS s, sum(n * n) AS nn FROM suffixes
  UNION ALL SELECT 'suffix', suffix, sum(good), sum(n), count(*), sum(good * good / n), sum(n * n) FROM domains GROUP BY 2
  UNION ALL SELECT 'domain', domain, sum(good), sum(n), count(*), sum(good * good / n), sum(n * n) FROM rated GROUP BY 2
), weights AS (
  SELECT level, parent, CASE WHEN k < 2 OR g / n <= 0 OR g / n >= 1 THEN 20.0 WHEN e <= 0 THEN 1000.0 ELSE least(greatest(g / n * (1 - g / n) / e - 1, 2.0), 1000.0) END AS weight
  FROM (SELECT *, CASE WHEN k < 2 THEN 0 ELSE (s - g * g / n - (k - 1) * (g / n) * (1 - g / n)) / (n - nn / n) END AS e FROM moments)
), everything AS (
  SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m2, (SELECT weight FROM weights WHERE level = 'all') AS w2 FROM suffixes
), under AS (
  SELECT suffix, (good + m2 * w2) / (n + w2) AS m1, weight AS w1 FROM suffixes, everything JOIN weights ON level = 'suffix' AND parent = suffix
), middle AS (
  SELECT domain, (good + m1 * w1) / (n + w1) AS m0, weight AS w0 FROM domains JOIN under USING (suffix) JOIN weights ON level = 'domain' AND parent = domain
), priors AS (
  SELECT host, good, n, coalesce(m0, m1, m2) AS mean, coalesce(w0, w1, w2) AS weight FROM leveled LEFT JOIN middle USING (domain) LEFT JOIN under USING (suffix), everything
), own AS (SELECT host, good + mean * weight AS a, n - good + (1 - mean) * weight AS b FROM priors
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN a / (a + b) + 2.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN own USING (host)
"""
