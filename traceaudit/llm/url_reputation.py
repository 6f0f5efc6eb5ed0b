"""URL filter: host reputation from labelled page outcomes by hierarchical empirical Bayes, under explicit rules.

Only DataFrame functions are used. Outcomes are counted per host, domain and suffix with partial
aggregation, so a host with a third of all rows is summed before it is shuffled. How far each level shrinks towards the level
above is estimated from the counts themselves (see shrinkage). Only (page, url) travels to the join with
the host table; that join is an ordinary equi-join, which Spark broadcasts when the host table is small and otherwise splits where a host is hot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceaudit.llm.common import cut
from traceaudit.llm.shrinkage import prior_strength

#: Public suffixes of two labels, under which a registered domain has three. A parameter; any longer list may be given.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.in", "co.jp", "ne.jp", "or.jp", "co.kr", "com.br", "com.mx", "com.ar", "com.tr", "com.cn", "com.tw", "com.hk", "com.sg", "github.io", "gitlab.io", "blogspot.com", "wordpress.com")
#: The rules of the registered query, as (verdict, rule).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What stands after the host up to ?, # or end; empty for null or without ://."""
    return F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def fits(host: Column, path: Column, rule: str) -> Column:
    """A rule fits its host and all subdomains, where the path starts with the rule's."""
    rule_host, slash, rule_path = rule.partition("/")
    of_host = (host == rule_host) | host.endswith("." + rule_host)
    return of_host & path.startswith(slash + rule_path)


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; ties go to the smaller rule text. rules: a parameter list of at most a few hundred."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    null = F.lit(None).cast("string")
    pick = lambda i: reduce(lambda rest, r: F.when(fits(host, path, r[1]), F.lit(r[i])).otherwise(rest), reversed(ordered), null)
    return pick(1), pick(0)


def bare(host: Column) -> Column:
    """The host without a port."""
    return F.substring_index(host, ":", 1)


def is_address(host: Column) -> Column:
    return bare(host).rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")


def suffix(host: Column, suffixes=SUFFIXES) -> Column:
    """The last label, or the last two where they are a suffix of the list; numeric addresses have none."""
    two = F.substring_index(bare(host), ".", -2)
    return F.when(is_address(host), F.lit("")).when(two.isin(*suffixes), two).otherwise(F.substring_index(two, ".", -1))


def registered_domain(host: Column, suffixes=SUFFIXES) -> Column:
    """The suffix and the label before it; a numeric address is a domain of its own."""
    two = F.substring_index(bare(host), ".", -2)
    return F.when(is_address(host), bare(host)).when(two.isin(*suffixes), F.substring_index(bare(host), ".", -3)).otherwise(two)


def levels(outcomes: DataFrame, suffixes=SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, tuple[int, int], tuple[float, float, float]]:
    """Counted outcomes(host, good 0/1) per host, domain and suffix, their totals, and the prior strength of each of these levels. Null outcomes take no part."""
    hosts = outcomes.filter(F.col("good").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    hosts = cut(hosts.withColumns({"domain": registered_domain(F.col("host"), suffixes), "suffix": suffix(F.col("host"), suffixes)}), "reputation-hosts")
    domains = cut(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "reputation-domains")
    ends = cut(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "reputation-suffixes")
    whole = ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    strengths = prior_strength(hosts, ["suffix", "domain"]), prior_strength(domains, ["suffix"]), prior_strength(ends, [])
    return hosts, domains, ends, (whole["n"], whole["k"]), strengths


def host_posteriors(known: DataFrame, outcomes: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """known(host) with the mean and sd of the posterior rate of good pages, from outcomes(host, good 0/1).

    The global rate centres the prior of the suffixes; a suffix's posterior mean centres the prior of its domains, a domain's that of its hosts. Each
    prior is Beta(s * mean, s * (1 - mean)) with the s of its level, so levels with few outcomes shrink towards the
    level above, and one without any takes its mean.
    """
    hosts, domains, ends, (n, k), (s_host, s_domain, s_suffix) = levels(outcomes, suffixes)
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    shrink = lambda k, n, strength, up: (count(k) + F.lit(strength) * up) / (count(n) + F.lit(strength))
    named = known.select("host", registered_domain(F.col("host"), suffixes).alias("domain"), suffix(F.col("host"), suffixes).alias("suffix"))
    joined = (
        named.join(hosts.select("host", F.col("n").alias("hn"), F.col("k").alias("hk")), "host", "left")
        .join(domains.select("suffix", "domain", F.col("n").alias("dn"), F.col("k").alias("dk")), ["suffix", "domain"], "left")
        .join(ends.select("suffix", F.col("n").alias("sn"), F.col("k").alias("sk")), "suffix", "left")
    )
    top = shrink("sk", "sn", s_suffix, F.lit((k + 1.0) / (n + 2.0)))
    mean = shrink("hk", "hn", s_host, shrink("dk", "dn", s_domain, top))
    sd = F.sqrt(F.col("mean") * (1 - F.col("mean")) / F.col("w")) if n else F.lit(None).cast("double")
    return joined.select("host", mean.alias("mean"), (count("hn") + F.lit(s_host + 1.0)).alias("w")).select("host", "mean", sd.alias("sd"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = 1.645, least: float = 0.5, suffixes=SUFFIXES) -> DataFrame:
    """Judge every pages(page_id, url): page_id, host, path, rule, verdict, bound.

    A rule that fits decides. Otherwise bound = posterior mean - z * posterior sd of the host, and the
    url is blocked when bound < least. A host without labelled outcomes takes its domain's mean, else
    its suffix's, else the global one (with no outcomes at all: bound null, allowed). Null urls and urls
    without :// have an empty host, which is judged like any other. outcomes: (host, good). Repeated page
    rows stay repeated; other columns of the inputs are ignored.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    seen = seen.withColumn("rule", rule).withColumn("ruled", verdict)
    post = host_posteriors(seen.select("host").distinct(), outcomes, suffixes)
    known = cut(post.select("host", F.round(F.col("mean") - z * F.col("sd"), 6).alias("bound")), "reputation-bounds")  # its size is then known: broadcast only if small
    return seen.join(known, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("bound") < least, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "bound"
    )


def op1_url_reputation(spark, sf_dir: str) -> DataFrame:
    """All pages, judged by labels.quality of the page with the same id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = pages.select("page_id", url_host(F.col("url")).alias("host")).join(labels.select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good")), "page_id")
    return judge_urls(pages, outcomes)


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND position('://' IN url) > 0
    THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
seen AS (
  SELECT page_id,
    translate(regexp_extract(rest, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(verdict, rule, rhost, rpath) AS (VALUES
  ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')),
ruled AS (
  SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(rules.verdict, length(rule)) AS verdict
  FROM seen, rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
outcomes AS (
  SELECT host, quality AS good FROM seen JOIN labels ON labels.doc_id = page_id WHERE quality IS NOT NULL),
parts AS (SELECT host, split_part(host, ':', 1) AS bare, string_split(split_part(host, ':', 1), '.') AS labels FROM (SELECT DISTINCT host FROM seen)),
named AS (
  SELECT host, CASE WHEN address THEN bare WHEN two IN (SUFFIX_LIST) THEN array_to_string(labels[-3:], '.') ELSE two END AS domain,
    CASE WHEN address THEN '' WHEN two IN (SUFFIX_LIST) THEN two ELSE labels[-1] END AS suffix
  FROM (SELECT *, array_to_string(labels[-2:], '.') AS two, regexp_matches(bare, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$') AS address FROM parts)),
hosts AS (SELECT host, domain, suffix, count(*) AS n, sum(good) AS k FROM outcomes JOIN named USING (host) GROUP BY ALL),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
g AS (SELECT (sum(k) + 1.0) / (sum(n) + 2.0) AS g FROM suffixes),
pooled AS (
  SELECT 'host' AS level, sum(n) AS pn, sum(k) AS pk, count(*) AS c, sum(n * n) AS squares, sum(k * k / n) AS kk FROM hosts GROUP BY suffix, domain
  UNION ALL SELECT 'domain', sum(n), sum(k), count(*), sum(n * n), sum(k * k / n) FROM domains GROUP BY suffix
  UNION ALL SELECT 'suffix', sum(n), sum(k), count(*), sum(n * n), sum(k * k / n) FROM suffixes),
moments AS (
  SELECT level, sum((kk - pk * (pk / pn)) / (pk / pn * (1 - pk / pn))) AS t, sum(c - 1) AS free, sum(pn - squares / pn) AS spread
  FROM pooled WHERE pk > 0 AND pk < pn AND c > 1 GROUP BY level),
shares AS (SELECT level, (t - free) / (spread - free) AS r FROM moments WHERE spread > free),
strengths AS (
  SELECT l.level, CASE WHEN r IS NULL THEN 20.0 WHEN r <= 0 THEN 10000.0 ELSE least(10000.0, greatest(1.0, 1 / r - 1)) END AS s
  FROM (VALUES ('host'), ('domain'), ('suffix')) l(level) LEFT JOIN shares USING (level)),
s3 AS (SELECT max(s) FILTER (level = 'host') AS sh, max(s) FILTER (level = 'domain') AS sd, max(s) FILTER (level = 'suffix') AS ss FROM strengths),
means AS (
  SELECT host, coalesce(h.n, 0) AS n, sh, (coalesce(h.k, 0) + sh * (coalesce(d.k, 0) + sd * (coalesce(x.k, 0) + ss * g) / (coalesce(x.n, 0) + ss)) / (coalesce(d.n, 0) + sd)) / (coalesce(h.n, 0) + sh) AS m
  FROM named LEFT JOIN hosts h USING (host) LEFT JOIN domains d ON d.domain = named.domain AND d.suffix = named.suffix LEFT JOIN suffixes x ON x.suffix = named.suffix, g, s3),
bounds AS (SELECT host, round(m - 1.645 * sqrt(m * (1 - m) / (n + sh + 1)), 6) AS bound FROM means)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, bound
FROM seen JOIN bounds USING (host) LEFT JOIN ruled USING (page_id)
""".replace("SUFFIX_LIST", ", ".join(f"'{x}'" for x in SUFFIXES))
