"""URL filters: rules indexed by their rarest literal token.

A rule is (action, host, path). It fits a url whose host is the rule's or a subdomain of it and whose
path starts with the rule's; ``*`` in a rule's path stands for any run of characters. Each rule is
compiled to one regular expression and filed under one literal token: of the tokens that any fitting
url must hold, the one that fewest urls hold. Urls fetch candidate rules by their tokens; only those
run their expressions, and the longest that fits decides.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]

#: The token under which a rule without any literal token is filed; every url holds it.
ANY = "*"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path). Null or without ``://``: both empty. A host's A-Z are lower-cased, a port or user
    name stays part of it; a path ends before ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
    return ascii_lower(host), path


def _tokens(host: Column, path: Column) -> Column:
    """Host labels as ``h:label`` and whole path segments as ``p:segment``."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(F.array(F.lit(ANY)), labels, segments))


def compile_rule(host: str, path: str) -> tuple[str, list[str]]:
    """A rule's expression over host + path, and the tokens that each fitting url holds."""
    host = host.translate({i: i + 32 for i in range(65, 91)})
    inner = "".join(".*" if x == "*" else re.escape(x) for x in re.split(r"(\*)", path))
    head = rf"(?:[^/]*\.)?{re.escape(host)}" if host else r"[^/]*"
    pattern = rf"(?s)^{head}(?=/|\z){inner}"
    labels = [f"h:{x}" for x in host.split(".") if x]
    # A segment counts only where "/" stands on both sides: the last one may go on in the url.
    segments = [f"p:{x}" for x in path.split("/")[1:-1] if x and "*" not in x] if path.startswith("/") else []
    return pattern, sorted({*labels, *segments})


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (host + path of the rule that decides, else null) and verdict.

    ``rules``: columns action, host, path. The longest fitting rule (host and path together) wins, of
    equally long ones the one with the longer host, then ``block``, then the smaller text. A rule row
    with a null is left out; repeated rules count once. Urls are matched once for each distinct url, so
    a url that fills a third of the table costs one match. Null and empty urls have an empty host and
    fit only rules without a host. Empty tables give empty results. Columns of ``pages`` by the names
    of the four new ones are replaced.
    """
    host, path = url_parts(F.col(url))
    named = pages.drop(*[c for c in ("host", "path", "rule", "verdict") if c != url])
    compiled = F.udf(lambda h, p: compile_rule(h, p), "pattern string, tokens array<string>")
    held = rules.select("action", "host", "path").dropna().dropDuplicates()
    # Each rule is compiled once; what follows reads the result.
    held = written(held.withColumn("_c", compiled("host", "path")).select(
        "action", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length"),
        F.col("_c.pattern").alias("pattern"), F.col("_c.tokens").alias("tokens"),
    ), "rules")
    urls = named.select(F.col(url).alias("_url")).distinct().withColumns(dict(zip(("_host", "_path"), url_parts(F.col("_url")), strict=True)))
    spread = urls.select("_url", F.concat("_host", "_path").alias("_target"), F.explode(_tokens(F.col("_host"), F.col("_path"))).alias("token"))

    # Only tokens that rules hold are counted: as many rows as the rules have tokens.
    wanted = held.select(F.explode("tokens").alias("token")).distinct()
    counts = spread.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = (
        held.select("rule", "pattern", F.explode("tokens").alias("token")).join(counts, "token", "left")
        .groupBy("rule", "pattern").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    )
    index = held.join(rarest, ["rule", "pattern"], "left").select(
        "action", "rule", "host_length", "pattern", F.coalesce("token", F.lit(ANY)).alias("token")
    )
    fits = spread.join(index, "token").filter(F.expr("_target rlike pattern"))
    best = fits.groupBy("_url").agg(
        F.max(F.struct(F.length("rule").alias("a"), F.col("host_length").alias("b"), (F.col("action") == "block").alias("c"), "rule", "action")).alias("_best")
    )
    joined = named.join(best, named[url].eqNullSafe(best["_url"]), "left").drop("_url")
    return joined.withColumns({
        "host": host, "path": path, "rule": F.col("_best.rule"),
        "verdict": F.coalesce(F.col("_best.action"), F.lit(default)),
    }).drop("_best")


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "action string, host string, path string")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, default_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
SQL = {
    "op10_url_filters": f"""
WITH rules(action, rhost, rpath) AS (VALUES {_VALUES}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, regexp_extract(r, '^[^/?#]*', 0) AS h, r FROM rest),
parts AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(r, length(h) + 1), '^[^?#]*', 0) AS path,
                 row_number() OVER () AS n FROM cut),
fit AS (SELECT n, rhost || rpath AS rule, action,
               row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC, length(rhost) DESC, action DESC) AS k
        FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (n)
""",
}
QUERIES = {"op10_url_filters": op10_url_filters}
