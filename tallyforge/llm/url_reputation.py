"""URL filter: fixed rules, then an empirical-Bayes reputation of hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import ascii_lower, table

#: (verdict, rule); a rule is a host, a slash and the start of a path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
LEVELS = ("host", "domain", "suffix")
MAX_BAD = 0.25
BOUND_SDS = 1.645
#: Limits of a level's prior strength, in pages.
STRENGTH = (2.0, 10000.0)
#: A host of more than this share of all pages is hot (there are at most as many as its inverse): its pages are
#: dealt among so many copies of its verdict.
HOT_SHARE, SALTS = 0.001, 64
#: Fixed: second labels under which country domains of two letters register names, as in ``co.uk``.
SECOND_LEVELS = ("ac", "co", "com", "edu", "gov", "net", "org")
ADDRESS = r"^[0-9.]+(:[0-9]+)?$"
TWO_LABELS = r"(^|\.)(" + "|".join(SECOND_LEVELS) + r")\.[a-z]{2}$"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one or for null."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct<verdict, rule>`` of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(found)
    return found


def _parents(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix: the last two labels and the last one, or the last three and two where the suffix
    is a country's second level such as ``co.uk``; an IPv4 address is its own of both."""
    labels = F.when(host.rlike(TWO_LABELS), 2).otherwise(1)
    last = lambda n: F.array_join(F.slice(F.split(host, r"\."), F.greatest(-F.size(F.split(host, r"\.")), -n), n), ".")
    address = host.rlike(ADDRESS)
    return F.when(address, host).otherwise(last(labels + 1)), F.when(address, host).otherwise(last(labels))


def _strength(groups: DataFrame) -> Column:
    """Kleinman's moment estimate of a beta-binomial prior's strength over ``n, bad`` rows, as an aggregate."""
    k, n, mean = F.count("*"), F.sum("n"), F.sum("bad") / F.sum("n")
    square = F.sum(F.col("bad") * F.col("bad") / F.col("n")) - F.sum("bad") * F.sum("bad") / F.sum("n")
    spread, within = square / n, mean * (1 - mean)
    between = spread - within * (k - 1) / n
    raw = F.when(between > 0, (within - spread) / between).otherwise(F.lit(STRENGTH[1]))
    return F.least(F.greatest(F.coalesce(raw, F.lit(STRENGTH[1])), F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))


def host_reputations(outcomes: DataFrame) -> DataFrame:
    """``host, n, bad, bad_rate, bad_sd, bad_lower`` from ``host, bad`` rows, ``bad`` null where unlabelled.

    Each level's rates are shrunk towards its parent's posterior mean: suffixes towards the overall rate,
    registered domains towards their suffix, hosts towards their domain, each with the strength that the
    moments of that level's groups give.  Hosts without a labelled page keep their domain's posterior.  With no
    labelled page at all the overall rate is taken as 0.
    """
    labelled = F.col("bad").isNotNull().cast("long")
    hosts = outcomes.groupBy("host").agg(F.sum(labelled).alias("n"), F.coalesce(F.sum(F.col("bad").cast("double")), F.lit(0.0)).alias("bad"))
    domain, suffix = _parents(F.col("host"))
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("prior"))

    def shrunk(groups: DataFrame, prior: DataFrame, on: str | None, name: str) -> DataFrame:
        strength = groups.where("n > 0").agg(_strength(groups).alias("m"))
        joined = groups.join(prior, on) if on else groups.join(F.broadcast(prior))  # one row
        joined = joined.join(F.broadcast(strength))  # one row
        return joined.withColumn(name, (F.col("prior") * F.col("m") + F.col("bad")) / (F.col("m") + F.col("n")))

    suffix_rate = shrunk(suffixes, whole, None, "rate").select("suffix", F.col("rate").alias("prior"))
    domain_rate = shrunk(domains, suffix_rate, "suffix", "rate").select("domain", F.col("rate").alias("prior"))
    rated = shrunk(hosts, domain_rate, "domain", "bad_rate")
    sd = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("m") + F.col("n") + 1))
    return rated.select("host", "n", "bad", "bad_rate", sd.alias("bad_sd"), (F.col("bad_rate") - BOUND_SDS * sd).alias("bad_lower"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, max_bad: float = MAX_BAD) -> DataFrame:
    """One row per row of ``pages``: ``id, host, path, rule, verdict, bad_lower``.

    ``outcomes`` is ``id, bad`` with bad 0 or 1 for pages that were labelled; ids it repeats count by their
    worst label.  A rule decides where one fits; otherwise a page goes when the lower bound of its host's
    posterior rate of bad pages exceeds ``max_bad``.  Null urls and urls without ``://`` share the empty host,
    which is judged like any other.  Repeated rows are judged alike.  An empty table gives an
    empty result.  Ids keep their type; other columns are not read.
    """
    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    marks = outcomes.groupBy("id").agg(F.max("bad").alias("bad"))
    rated = host_reputations(urls.select("id", "host").join(marks, "id", "left").select("host", "bad"))
    sizes = urls.groupBy("host").count()
    hot = sizes.join(F.broadcast(sizes.agg(F.sum("count").alias("all")))).where(F.col("count") > HOT_SHARE * F.col("all")).select("host", F.lit(SALTS).alias("salts"))
    hot = F.broadcast(hot)  # at most 1 / HOT_SHARE rows
    salts = F.coalesce("salts", F.lit(1))
    rated = rated.join(hot, "host", "left").select("host", "bad_lower", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    urls = urls.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("id", "path"), salts).cast("int"))
    found = matching_rule(F.col("host"), F.col("path"), rules)
    judged = urls.join(rated, ["host", "salt"], "left").withColumn("found", found)
    verdict = F.coalesce("found.verdict", F.when(F.col("bad_lower") > max_bad, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select("id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "bad_lower")


def op3_url_reputation(spark, sf_dir):
    """Outcomes are the quality labels of the documents that the pages hold; a page's url ends in its document's number."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    number = F.expr(r"try_cast(nullif(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1), '') AS long)")
    held = pages.select(F.col("page_id").alias("id"), number.alias("doc_id")).where("doc_id IS NOT NULL")
    outcomes = held.join(labels, "doc_id").select("id", (1 - F.col("quality")).cast("int").alias("bad"))
    return judge_urls(pages, outcomes).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


QUERIES = {"op3_url_reputation": op3_url_reputation}

ORACLES = {
    "op3_url_reputation": r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT page_id, max(1 - quality) AS bad FROM pages JOIN labels
      ON doc_id = try_cast(regexp_extract(url, '://[^/?#]*/[a-z]+/([0-9]+)', 1) AS BIGINT) GROUP BY 1),
h AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM u LEFT JOIN l USING (page_id) GROUP BY 1),
k AS (SELECT *, regexp_matches(host, '^[0-9.]+(:[0-9]+)?$') AS address, regexp_matches(host, '(^|\.)(ac|co|com|edu|gov|net|org)\.[a-z]{2}$') AS two FROM h),
p AS (SELECT *, CASE WHEN address THEN host WHEN two THEN regexp_extract(host, '([^.]*\.)?[^.]*\.[^.]*$', 0) ELSE regexp_extract(host, '([^.]*\.)?[^.]*$', 0) END AS domain,
             CASE WHEN address THEN host WHEN two THEN regexp_extract(host, '[^.]*\.[^.]*$', 0) ELSE regexp_extract(host, '[^.]*$', 0) END AS suffix FROM k),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM p GROUP BY 1, 2),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY 1),
g AS (SELECT 'h' AS lv, n, bad FROM p UNION ALL SELECT 'd', n, bad FROM d UNION ALL SELECT 's', n, bad FROM s),
mo AS (SELECT lv, count(*) AS k, sum(n) AS n, sum(bad) / sum(n) AS mu, sum(bad * bad / n) - sum(bad) * sum(bad) / sum(n) AS sq FROM g WHERE n > 0 GROUP BY 1),
st AS (SELECT lv, least(greatest(CASE WHEN sq / n - mu * (1 - mu) * (k - 1) / n > 0
              THEN (mu * (1 - mu) - sq / n) / (sq / n - mu * (1 - mu) * (k - 1) / n) ELSE 10000.0 END, 2.0), 10000.0) AS m FROM mo),
m AS (SELECT coalesce(max(m) FILTER (lv = 'h'), 10000.0) AS mh, coalesce(max(m) FILTER (lv = 'd'), 10000.0) AS md, coalesce(max(m) FILTER (lv = 's'), 10000.0) AS ms FROM st),
o AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS mu FROM s),
sr AS (SELECT suffix, (mu * ms + bad) / (ms + n) AS r FROM s, m, o),
dr AS (SELECT domain, (r * md + bad) / (md + n) AS r FROM d JOIN sr USING (suffix), m),
hr AS (SELECT host, n, mh, (r * mh + bad) / (mh + n) AS r FROM p JOIN dr USING (domain), m),
hv AS (SELECT host, r - 1.645 * sqrt(r * (1 - r) / (mh + n + 1)) > 0.25 AS gone FROM hr),
ru AS (SELECT * FROM (VALUES ('block', 'com/en/'), ('allow', 'example.com/en/7'), ('allow', 'net/de/'), ('block', 'example.net/de/8'), ('block', 'org/es/')) t(v, rule)),
b AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
      FROM u LEFT JOIN ru ON ('.' || host) LIKE ('%.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN gone THEN 'block' ELSE 'allow' END) AS verdict FROM b JOIN hv USING (host)"""
}
