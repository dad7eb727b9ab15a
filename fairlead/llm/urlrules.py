"""Allow and block rules for URLs, judged by a sort-merge range join over reversed-host keys.

Every URL has one key for each suffix of its host: the suffix with its labels reversed, a zero byte, the path.
A rule's key is built alike, so that the rule fits exactly the keys that begin with it: the interval from the
key itself to the key followed by byte FF, which UTF-8 never holds. Intervals of such prefixes nest or are
disjoint. Rules' ends and URLs are sorted together per host; in one sweep the number of open intervals is the
depth of the stack of active rules, and the stack's top is the last rule opened at that depth.

Only DataFrame operations run. Distinct (host, path) pairs are swept, not rows. A host with many of them is
split over salts, and its rules are repeated for each salt: one repetition per ``rows_per_sweep`` URLs.

Defined results: a null URL or one without ``://`` has an empty host and path and fits no rule. Of the rules
that fit, the longest (host and path together, in characters) wins; of equally long ones the one whose text
sorts last; of two rules for the same host and path, block wins. Without rules every URL gets the default.
Rules with a null host or path are ignored. Other columns are not needed, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SWEEP = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def sweep_key(host: Column, path: Column) -> Column:
    """Labels reversed, a zero byte, the path; as bytes, which sort alike everywhere."""
    return F.concat_ws("\u0000", F.array_join(F.reverse(F.split(host, r"\.")), "."), path).cast("binary")


def match(addresses: DataFrame, rules: DataFrame, rows_per_sweep: int = ROWS_PER_SWEEP) -> DataFrame:
    """The winning rule of every distinct (host, path) that any rule fits: host, path, rule, verdict."""
    rules = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
    rules = rules.groupBy(F.col("host").alias("level"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("verdict"))
    most = rules.agg(F.max(F.size(F.split("level", r"\.")))).first()[0] or 1  # labels of the longest rule's host

    labels = F.split("host", r"\.")
    # Suffixes of the host, no longer than the longest rule's host.
    steps = F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most)))
    urls = addresses.select("host", "path").where(F.col("host") != "").distinct()
    urls = urls.select("host", "path", F.explode(F.transform(steps, lambda i: F.array_join(F.slice(labels, -i, i), "."))).alias("level"))
    hosts = rules.select("level").distinct()
    urls = urls.join(hosts, "level")

    salts = urls.groupBy("level").agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_sweep)).cast("int").alias("salts"))
    urls = urls.join(salts, "level").withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int"))
    opened = rules.join(salts, "level").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    key = sweep_key(F.col("level"), F.col("rule_path"))
    text = F.concat("level", "rule_path")
    rule = F.struct(F.length(text).alias("size"), text.alias("rule"), "verdict")
    none = F.lit(None)
    nothing = none.cast("struct<size:int,rule:string,verdict:string>")
    events = (
        urls.select("level", "salt", sweep_key(F.col("level"), F.col("path")).alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("step"), nothing.alias("opens"), "host", "path")
        .unionByName(opened.select("level", "salt", key.alias("key"), F.lit(0).alias("kind"), F.lit(1).alias("step"), rule.alias("opens"), none.cast("string").alias("host"), none.cast("string").alias("path")))
        .unionByName(opened.select("level", "salt", F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"), F.lit(-1).alias("step"), nothing.alias("opens"), none.cast("string").alias("host"), none.cast("string").alias("path")))
    )
    sweep = Window.partitionBy("level", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    at_depth = Window.partitionBy("level", "salt", "depth").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("depth", F.sum("step").over(sweep)).withColumn("top", F.last("opens", ignorenulls=True).over(at_depth))
    found = swept.where((F.col("kind") == 1) & (F.col("depth") > 0))
    return found.groupBy("host", "path").agg(F.max("top").alias("top")).select("host", "path", "top.rule", "top.verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url", rows_per_sweep: int = ROWS_PER_SWEEP) -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path; null if none fits), verdict.

    ``rules`` has host, path and verdict (allow or block).
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    found = match(rows, rules, rows_per_sweep)
    return rows.join(found, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
