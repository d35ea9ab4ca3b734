"""URL filtering by rules and by empirical-Bayes host reputation, in DataFrame functions only.

Outcomes of labelled pages are counted per host. Each level's counts are shrunk
towards the level above it: suffixes towards the whole, registered domains towards
their suffix, hosts towards their domain. The strength of a level's beta prior
comes from its own spread: with parent mean m, the sum over groups of
n (k/n - m)^2 / (m (1 - m)) is expected to be G + (N - G) r for intra-group
correlation r, and the prior counts as 1/r - 1 pages. A host is blocked when the
lower bound of its posterior share of bad pages (mean less z standard deviations of
the beta distribution) exceeds ``limit``; an unlabelled host has its domain's prior.

Counts are summed per host before anything else, so a host with a third of all
pages is one row from the first shuffle on; pages meet their host's verdict in a
join that the adaptive planner splits, or that needs no shuffle where Spark finds
the stored table of hosts below its broadcast threshold.

Defined results: a null url or one without ``://`` has empty host and path and is
judged like any other host; a null outcome is no outcome; a page with several
outcomes counts each; rows that repeat a page get the same answer; without
outcomes every host is allowed; empty tables give empty tables; other columns are
ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, only

LIMIT, Z = 0.25, 1.64
#: rules are literals of the plan, so their number is bounded
MOST_RULES = 1000

#: fixed values of the contract
CONTRACT_RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: tuple[str, ...]) -> Column:
    """The longest listed suffix of several labels that the host ends with, else its last label."""
    out = F.substring_index(host, ".", -1)
    for s in sorted(suffixes, key=len):
        out = F.when((host == s) | host.endswith("." + s), F.lit(s)).otherwise(out)
    return out


def rule_for(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as struct (text, verdict), or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<text:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0], r[1] != "block"))
    table = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(v).alias("verdict"), F.lit(t.split("/", 1)[0]).alias("host"), F.lit("/" + t.split("/", 1)[1] if "/" in t else "").alias("path")) for t, v in ordered])
    fits = F.filter(table, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    return F.get(fits, F.lit(0))


def _strength(groups: DataFrame, mean: str) -> DataFrame:
    """One row ``strength``: the prior's pages for groups (k, n) around a column of parent means."""
    m = F.greatest(F.least(F.col(mean), F.lit(0.999)), F.lit(0.001))
    labelled = groups.where("n > 0")
    sums = labelled.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - m, F.lit(2.0)) / (m * (1 - m))).alias("s"), F.count("*").alias("g"), F.sum("n").alias("all_n"))
    r = F.when(F.col("all_n") > F.col("g"), F.least(F.greatest((F.col("s") - F.col("g")) / (F.col("all_n") - F.col("g")), F.lit(0.001)), F.lit(0.999))).otherwise(F.lit(0.001))
    return sums.select((1 / F.coalesce(r, F.lit(0.001)) - 1).alias("strength"))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(host, n, k, bad_mean, bad_bound) of every host of ``pages`` (page_id, url); ``outcomes`` is (page_id, bad 0/1)."""
    scratch = Scratch(pages.sparkSession, "hosts")
    known = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("k"))
    counted = only(pages, "page_id", "url").join(known, "page_id", "left")
    hosts = counted.groupBy(host_of(F.col("url")).alias("host")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    # the registered domain is the suffix and one label before it
    rest = F.expr("left(host, greatest(length(host) - length(suffix) - 1, 0))")
    hosts = hosts.withColumn("domain", F.when(rest == "", F.col("host")).otherwise(F.concat_ws(".", F.substring_index(rest, ".", -1), "suffix")))
    hosts = scratch.store(hosts, "counts")
    whole = hosts.agg((F.coalesce(F.sum("k"), F.lit(0)) / F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))).alias("m0"))

    def level(groups: DataFrame, parent: str, name: str) -> DataFrame:
        shrunk = groups.crossJoin(F.broadcast(_strength(groups, parent)))  # one row
        return shrunk.withColumn(name, (F.col("k") + F.col("strength") * F.col(parent)) / (F.col("n") + F.col("strength")))

    sums = lambda key: hosts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    by_suffix = level(sums("suffix").crossJoin(F.broadcast(whole)), "m0", "m1").select("suffix", "m1")
    by_suffix = scratch.store(by_suffix, "suffixes")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(by_suffix, "suffix")
    by_domain = scratch.store(level(domains, "m1", "m2").select("domain", "m2"), "domains")
    placed = hosts.join(by_domain, "domain")
    out = level(placed, "m2", "bad_mean")
    spread = F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / (F.col("n") + F.col("strength") + 1))
    return scratch.store(out.select("host", "n", "k", "bad_mean", (F.col("bad_mean") - z * spread).alias("bad_bound")), "hosts")


def judge(pages: DataFrame, outcomes: DataFrame, rules=CONTRACT_RULES, limit: float = LIMIT, z: float = Z, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_bound) per row of ``pages`` (page_id, url)."""
    hosts = host_reputation(pages, outcomes, z, suffixes).select(F.col("host").alias("__host"), "bad_bound")
    rows = only(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("hit", rule_for(F.col("host"), F.col("path"), rules))
    out = rows.join(hosts, F.col("host") == F.col("__host"), "left")
    method = F.when(F.col("bad_bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("hit.text").alias("rule"), F.coalesce(F.col("hit.verdict"), method).alias("verdict"), "bad_bound")


def _level_sql(groups: str, parent: str, name: str, extra: str) -> str:
    m = f"greatest(least({parent}, 0.999), 0.001)"
    return f"""SELECT {extra}, n, k, strength, (k + strength * {parent}) / (n + strength) AS {name} FROM {groups}, (
  SELECT 1 / coalesce(CASE WHEN all_n > g THEN least(greatest((s - g) / (all_n - g), 0.001), 0.999) ELSE 0.001 END, 0.001) - 1 AS strength
  FROM (SELECT sum(n * pow(k::DOUBLE / n - {m}, 2) / ({m} * (1 - {m}))) AS s, count(*)::DOUBLE AS g, sum(n)::DOUBLE AS all_n FROM {groups} WHERE n > 0))"""


#: DuckDB's form of the registered query
JUDGE_SQL = f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
known AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS k FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
h0 AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k FROM u LEFT JOIN known USING (page_id) GROUP BY host),
h AS (SELECT *, list_extract(string_split(host, '.'), -1) AS suffix, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain FROM h0),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT sum(k) / greatest(sum(n), 1) FROM h) AS m0 FROM h GROUP BY suffix),
s1 AS ({_level_sql("s0", "m0", "m1", "suffix")}),
d0 AS (SELECT domain, any_value(s1.m1) AS m1, sum(h.n) AS n, sum(h.k) AS k FROM h JOIN s1 ON h.suffix = s1.suffix GROUP BY domain),
d1 AS ({_level_sql("d0", "m1", "m2", "domain")}),
g0 AS (SELECT h.host, h.n, h.k, d1.m2 FROM h JOIN d1 ON h.domain = d1.domain),
g1 AS ({_level_sql("g0", "m2", "mean", "host")}),
b AS (SELECT host, mean - {Z} * sqrt(mean * (1 - mean) / (n + strength + 1)) AS bound FROM g1),
r(rule, v, rhost, rpath) AS (VALUES {", ".join(f"('{t}', '{v}', '{t.split('/', 1)[0]}', '/{t.split('/', 1)[1]}')" for t, v in CONTRACT_RULES)}),
hit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM u JOIN r ON (u.host = rhost OR u.host LIKE '%.' || rhost) AND starts_with(u.path, rpath) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, hit.rule, coalesce(hit.v, CASE WHEN b.bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN hit USING (page_id) LEFT JOIN b ON u.host = b.host
"""
