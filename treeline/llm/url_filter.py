"""Allow and block rules for urls, by a sort-merge range join in DataFrame operations only.

A rule is a host and a path prefix. It fits its host and all subdomains, if the url's path starts
with the rule's. Reversed-host keys (labels from the right, then the path) turn a rule into the
interval of keys that begin with the rule's key. A url with a host of n labels has one key for each
suffix of its host, so a rule fits exactly if one of these keys lies in its interval. Intervals of
one host are nested or disjoint; a sweep in key order keeps the stack of open intervals as a running
depth, and the innermost open rule at depth d is the last one that began at depth d.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the default
verdict. Rules that repeat a host and path collapse to one, block before allow. The longest rule
(host plus path, then host) wins, so there are no ties. Urls of any length are judged whole. Other columns of the input
are not read, whatever their names, but for those to ``keep``; rows are kept as they are, repeated ones too. No rules, or
no urls: every url gets the default, or no row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Keys of one host that a single sweep takes; hosts with more are salted.
SWEEP_ROWS = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    pattern = r"(?s)^([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(after, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(after, pattern, 2), F.lit(""))


def rules_frame(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """Rules as (verdict, host + path), the path from the first slash on."""
    rows = [(v, r.partition("/")[0].lower(), "/" + r.partition("/")[2] if "/" in r else "") for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def suffixes(host: Column, most: int) -> Column:
    """The host's last label, its last two and so on, up to ``most`` labels."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))),
        lambda n: F.concat_ws(".", F.slice(labels, F.size(labels) - n + 1, n)),
    )


def reversed_key(host: Column, path: Column) -> Column:
    """com,example,/path for example.com/path."""
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(","), path)


def match_rules(keys: DataFrame, rules: DataFrame, sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """For distinct (host, path), those that a rule fits, with that rule as rule_host, rule_path, rule_verdict."""
    rules = rules.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    probes = keys.select("host", "path", F.explode(suffixes(F.col("host"), most)).alias("at")).join(
        rules.select(F.col("host").alias("at")).distinct(), "at", "left_semi"
    )
    hot = probes.groupBy("at").count().filter(F.col("count") > sweep_rows).select("at", F.ceil(F.col("count") / sweep_rows).alias("salts"))
    salted = probes.join(hot, "at", "left").select(
        "at", F.pmod(F.xxhash64("host", "path"), F.coalesce("salts", F.lit(1))).alias("salt"),
        reversed_key(F.col("at"), F.col("path")).cast("binary").alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("step"),
        F.lit(None).cast("struct<host:string,path:string,blocks:boolean>").alias("rule"), "host", "path",
    )
    key = reversed_key(F.col("at"), F.col("rule.path")).cast("binary")
    bounds = (
        rules.select(F.col("host").alias("at"), F.struct("host", "path", "blocks").alias("rule"))
        .join(hot, "at", "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)))
        .withColumn("end", F.explode(F.array(F.lit(False), F.lit(True))))
        .select(
            "at", "salt",
            # no UTF-8 text holds the byte FF, so this end lies behind every key with the rule's prefix
            F.when(F.col("end"), F.concat(key, F.lit(b"\xff"))).otherwise(key).alias("key"),
            F.when(F.col("end"), 2).otherwise(0).alias("kind"), F.when(F.col("end"), -1).otherwise(1).alias("step"),
            F.when(~F.col("end"), F.col("rule")).alias("rule"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"),
        )
    )
    sweep = Window.partitionBy("at", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    stack = Window.partitionBy("at", "salt", "depth").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        salted.unionByName(bounds)
        .withColumn("depth", F.sum("step").over(sweep))
        .withColumn("rule", F.last("rule", ignorenulls=True).over(stack))
        .filter((F.col("kind") == 1) & (F.col("depth") > 0))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule.host") + F.length("rule.path"), F.length("rule.host"), "rule")).alias("best"))
        .select("host", "path", F.col("best.rule.host").alias("rule_host"), F.col("best.rule.path").alias("rule_path"), F.col("best.rule.blocks").alias("blocks"))
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """Every row of ``pages`` with host, path, rule (null if none fits) and verdict."""
    host, path = host_and_path(F.col(url))
    judged = pages.select(*keep, host.alias("host"), path.alias("path"))
    found = match_rules(judged.select("host", "path").distinct(), rules, sweep_rows)
    return judged.join(found, ["host", "path"], "left").select(
        *keep, "host", "path", F.concat("rule_host", "rule_path").alias("rule"),
        F.when(F.col("blocks"), "block").when(~F.col("blocks"), "allow").otherwise(default).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark, RULES))


ORACLE = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
r(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT b.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC) AS n
  FROM b LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
