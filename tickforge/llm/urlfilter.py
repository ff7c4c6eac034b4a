"""URL rules by host suffix and path prefix.

Each url is expanded into the host-suffix and path-prefix expressions that some rule could have, expressions meet rules
by an equi-join on four bytes of their SHA-256, and a candidate counts once the full digests are equal. Among a url's
rules the longest wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Most rules that are sent to all executors (about 100 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 100_000
#: Copies of the rules in a shuffled join, so that a rule that fits most urls isn't one task's.
SALTS = 32


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first ://, or empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def judge(df: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """key, host, path, rule (host and path of the winning rule, or null) and verdict (the rule's, else default).

    rules has host, path and verdict; it fits its host and all subdomains if the url's path starts with its path. The
    longest host and path together win, then the longer host, then block. A null url, or one without ://, has empty host
    and path. key may be null; a repeated row gives a repeated result. Rules with null columns are left out."""
    rules = rules.select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).na.drop()
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))  # block over allow
    shapes = rules.groupBy((F.size(F.split("rule_host", r"\."))).alias("labels"), F.length("rule_path").alias("chars")).agg(F.count("*").alias("n")).collect()  # at most labels times length of a url
    digest = F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)
    rules = rules.withColumn("rule_digest", digest).withColumn("prefix", F.substring("rule_digest", 1, 8))

    urls = df.select(F.col(key).alias(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    part = lambda n: F.when(F.size("labels") >= n, F.concat_ws(".", F.slice("labels", -n, n)))
    tries = [F.when(F.length("path") >= r["chars"], F.concat(part(r["labels"]), F.lit("\n"), F.substring("path", 1, r["chars"]))) for r in shapes]
    every = F.filter(F.array(*(F.sha2(x, 256) for x in tries)) if tries else F.array().cast("array<string>"), lambda x: x.isNotNull())
    # The empty expression keeps a url that no rule can fit, and counts repeated rows.
    urls = urls.withColumn("labels", F.split("host", r"\.")).select(key, "host", "path", F.explode(F.concat(F.array(F.lit("")), every)).alias("digest"))
    urls = urls.withColumn("prefix", F.substring("digest", 1, 8))
    if sum(r["n"] for r in shapes) <= BROADCAST_RULES:
        met = urls.join(F.broadcast(rules), "prefix", "left")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = urls.withColumn("salt", F.pmod(F.xxhash64(key, "path"), F.lit(SALTS)).cast("int")).join(salted, ["prefix", "salt"], "left")
    fits = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length(F.concat("rule_host", "rule_path")).alias("length"), F.length("rule_host").alias("host_length"), F.col("rule_verdict").alias("verdict"), F.concat("rule_host", "rule_path").alias("rule")))
    best = met.groupBy(key, "host", "path").agg(F.max(fits).alias("best"), F.sum(F.when(F.col("digest") == "", 1).otherwise(0)).alias("times"))
    best = best.withColumn("times", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))))
    return best.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
