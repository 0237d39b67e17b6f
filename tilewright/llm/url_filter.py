"""URL filters: expand, equi-join on short hash prefixes, confirm full digests, then rule precedence.

A url becomes expressions (host suffix, path prefix up to a slash). A rule has the same key: its host, and its path
up to the last slash. They meet on the first ``PREFIX_HEX`` hex digits of the key's SHA-256; the full digest, and the
rest of the rule's path, are confirmed after the join. Suffixes have no more labels and prefixes no more slashes than
some rule, so expansion is bounded by the rules and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8
#: Rules up to this many are broadcast; more are joined by a shuffle, whose hot keys adaptive execution splits.
BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)\A(.*/)?", 0)


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _host_suffixes(host: Column, most: Column) -> Column:
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.greatest(F.lit(1), n - most + 1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))


def _path_prefixes(path: Column, most: Column) -> Column:
    parts = F.split(path, "/")
    deepest = F.least(F.size(parts) - 1, most)
    return F.transform(F.sequence(F.lit(0), deepest), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))


def url_filter(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages`` (page_id, url); other columns are not read.

    The longest rule string (host and path) that fits wins; of equally long ones the longer host, then the larger
    string, then ``block``. Rules with a null host or path fit nothing. Null or malformed urls have an empty host and
    path and are judged as such. Repeated rows stay repeated; an empty table gives an empty result.
    """
    rules = (
        rules.where("host is not null and path is not null")
        .select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
        .withColumn("r_dir", _directory(F.col("r_path")))
        .withColumn("r_digest", F.sha2(F.concat_ws("\n", "r_host", "r_dir"), 256))
        .withColumn("r_short", F.substring("r_digest", 1, PREFIX_HEX))
    )
    shape = rules.agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(F.size(F.split("r_dir", "/")) - 1), F.lit(0)).alias("slashes"),
    ).first()
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    expressions = (
        judged.select("host", "path")
        .withColumn("suffix", F.explode(_host_suffixes(F.col("host"), F.lit(shape["labels"]))))
        .withColumn("prefix", F.explode(_path_prefixes(F.col("path"), F.lit(shape["slashes"]))))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256))
        .drop("suffix", "prefix")
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    found = expressions.join(F.broadcast(rules) if shape["n"] <= BROADCAST_RULES else rules, F.col("short") == F.col("r_short")).where("digest = r_digest and startswith(path, r_path)")
    text = F.concat("r_host", "r_path")
    best = found.groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path")).agg(
        F.max_by(F.struct(text.alias("rule"), F.col("r_verdict").alias("verdict")), F.struct(F.length(text), F.length("r_host"), text, F.col("r_verdict"))).alias("best")
    )
    return judged.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark, RULES))


SQL = """
with u as (
  select page_id, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end as rest from pages
), h as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from u
), r(r_host, r_path, r_verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), m as (
  select h.*, r_host || r_path as rule, r_verdict,
         row_number() over (partition by page_id, host, path order by length(r_host || r_path) desc) as k
  from h left join r on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
)
select page_id, host, path, rule, coalesce(r_verdict, 'allow') as verdict from m where k = 1
"""
