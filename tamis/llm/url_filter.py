"""URL filters by host suffix and path prefix.

Each distinct (host, path) is expanded into the expressions `host suffix + path prefix` that a rule could have, the
expressions meet the rules in an equi-join on the first 32 bits of their SHA-256, and the full digests confirm. Only
suffixes with as many labels as some rule's host, and prefixes as long as some rule's path, are made, so a url gives
at most (label counts of the rules) x (path lengths of the rules) expressions, however long it is.

Defined results: a null url, or one without `://`, has an empty host and path and takes the default verdict; repeated
rows stay repeated; a rule without a host and a path is an error; columns of the input that clash with host, path, rule or verdict are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

RULE_SCHEMA = "verdict string, rule string"


def parse_url(url):
    """(host, path) columns: the host after the first `://`, A-Z lower-cased; the path up to `?` or `#`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """rules: (verdict, `host/path`) pairs, or a DataFrame of verdict and rule. Digest, 32-bit prefix, label count and path length."""
    df = rules if isinstance(rules, DataFrame) else spark.createDataFrame([tuple(r) for r in rules], RULE_SCHEMA)
    if wrong := df.where(~F.coalesce(F.contains("rule", F.lit("/")), F.lit(False))).first():
        raise ValueError(f"a rule needs a host and a path, as in example.com/: {wrong.rule!r}")
    host = ascii_lower(F.substring_index("rule", "/", 1))
    path = F.expr("substring(rule, instr(rule, '/'))")
    return (
        df.select("verdict", "rule", host.alias("_rh"), path.alias("_rp"))
        .select("verdict", "rule", "_rh", F.sha2(F.concat("_rh", "_rp"), 256).alias("digest"), F.size(F.split("_rh", r"\.")).alias("labels"), F.char_length("_rp").alias("plen"))
        .withColumn("short", F.substring("digest", 1, 8))
    )


def judge(pages: DataFrame, rules, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict. The longest rule wins; among equally long ones the longer host, then block."""
    spark = pages.sparkSession
    table = rule_table(spark, rules)
    shapes = [tuple(r) for r in table.select("labels", "plen").distinct().collect()]  # bounded by the rules' own shapes
    own = pages.drop("host", "path", "rule", "verdict").withColumn("_url", F.col(url_col))
    host, path = parse_url(F.col("_url"))
    own = own.withColumn("host", host).withColumn("path", path).drop("_url")
    if not shapes:
        return own.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    counts = sorted({s[0] for s in shapes})
    lengths = sorted({s[1] for s in shapes})
    pairs = own.where("host <> '' and path <> ''").select("host", "path").distinct()
    labels = pairs.withColumn("_labels", F.split("host", r"\."))
    suffixes = F.array_compact(F.array(*[F.when(F.size("_labels") >= n, F.array_join(F.slice("_labels", -n, n), ".")) for n in counts]))
    prefixes = F.array_compact(F.array(*[F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths]))
    spread = labels.select("host", "path", F.explode(suffixes).alias("_s"), prefixes.alias("_p")).select("host", "path", "_s", F.explode("_p").alias("_p"))
    hashed = spread.select("host", "path", F.sha2(F.concat("_s", "_p"), 256).alias("_digest")).withColumn("short", F.substring("_digest", 1, 8))
    hits = hashed.join(table, "short").where(F.col("_digest") == F.col("digest"))
    order = F.struct(F.char_length("rule"), F.char_length("_rh"), (F.col("verdict") == "block").cast("int"), F.col("rule"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("_best"))
    # a url without host or path fits no rule: null urls, however many, stay where they are
    may = (F.col("host") != "") & (F.col("path") != "")
    none = F.lit(None).cast(best.schema["_best"].dataType)
    met = own.where(may).join(best, ["host", "path"], "left").select(*own.columns, "_best").unionAll(own.where(~may).select("*", none.alias("_best")))
    return met.withColumn("rule", F.col("_best.rule")).withColumn("verdict", F.coalesce("_best.verdict", F.lit(default))).drop("_best")
