"""URL filter by hashed host-suffix and path-prefix expressions, in DataFrame operations only.

A rule is a host and a path. Each URL is expanded into every suffix of its host at a label
border times every prefix of its path that is as long as some rule's path. Expressions
meet rules by an equi-join on the first bytes of a digest, the full digest confirms
the match, and the longest rule decides (of equal lengths the longer host, then block).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tideline.llm.common import query, shielded, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` with host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    after = df.withColumn("_at", F.instr(F.col(url), "://")).withColumn(
        "_rest", F.when(F.col("_at") > 0, F.expr(f"substring(`{url}`, _at + 3)")).otherwise(F.lit("")))
    host = F.regexp_extract("_rest", r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract("_rest", r"(?s)\A[^/?#]*([^?#]*)", 1)
    return (
        after.withColumn("_rest", F.coalesce("_rest", F.lit("")))
        .withColumn("host", F.translate(host, UPPER, LOWER)).withColumn("path", path)
        .drop("_at", "_rest")
    )


def _digest(expression):
    return F.sha2(expression, 256)


@shielded("url")
def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
          prefix_hex: int = 8) -> DataFrame:
    """``pages`` with host, path, rule (host and path of the rule that decides, or null) and verdict.

    ``rules``: host, path, verdict (allow or block). A rule fits its host and all subdomains
    where the URL's path starts with the rule's; without a fitting rule the verdict is
    ``default``. Null, empty and malformed URLs have an empty host, which fits no rule.
    Every row of ``pages`` gives one row, repeated ones too; other columns pass through, whatever their names; columns
    named like an output are replaced. A long URL is cut at the lengths that rule paths have, so it makes no more expressions
    than a short one with as many host labels. Ties between rules of one length go to the longer host, then to block. Rules that are given twice count once; rules with a null or an empty
    host fit nothing. No table has to fit into memory: small rules are broadcast by Spark
    on their measured size, large ones meet the expressions in a shuffle.
    """
    known = (
        rules.where("host <> '' AND path IS NOT NULL AND verdict IS NOT NULL")
        .groupBy("host", "path").agg(F.max("verdict").alias("_verdict"))  # block is after allow
        .select(F.concat("host", "path").alias("_rule"), F.length("host").alias("_host_length"), "_verdict",
                _digest(F.concat_ws("\n", "host", "path")).alias("_full"))
        .withColumn("_short", F.substring("_full", 1, prefix_hex))
    )
    # as many rows as rule paths have lengths, which URLs bound
    lengths = sorted(r[0] for r in rules.where("path IS NOT NULL").select(F.length("path")).distinct().collect())
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    row = with_host_and_path(pages.select(*[f"`{c}`" for c in kept]), url).withColumn(
        "_row", F.monotonically_increasing_id())
    labels = row.withColumn("_labels", F.split("host", r"\."))
    suffixes = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.size("_labels")),
        lambda i: F.array_join(F.slice("_labels", i, F.size("_labels")), ".")))
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    expanded = (
        labels.withColumn("_suffix", F.explode_outer(suffixes))
        .withColumn("_path_length", F.explode_outer(fitting)).drop("_labels")
        .withColumn("_full", _digest(F.concat(
            F.col("_suffix"), F.lit("\n"), F.expr("substring(path, 1, _path_length)"))))
        .withColumn("_short", F.substring("_full", 1, prefix_hex))
    )
    met = expanded.join(known.withColumnRenamed("_full", "_rule_full"), "_short", "left")
    sure = F.col("_full") == F.col("_rule_full")
    best = F.max(F.when(sure, F.struct(
        F.length("_rule").alias("length"), "_host_length", F.col("_verdict").alias("verdict"),
        F.col("_rule").alias("rule")))).alias("_best")
    columns = [f"`{c}`" for c in kept]
    return (
        met.groupBy("_row", *columns, "host", "path").agg(best)
        .select(*columns, "host", "path", F.col("_best.rule").alias("rule"),
                F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
    )


#: The rules that the query applies.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

SQL = rf"""
WITH rest AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(h, p, v) AS (VALUES {", ".join(map(str, RULES))}),
met AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC, v DESC) AS k
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM met WHERE k = 1
"""


@query("op6_url_filter", SQL)
def op6_url_filter(spark, sf_dir):
    """Every page's URL by the fixed rules; what no rule fits is allowed."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select(
        "page_id", "host", "path", "rule", "verdict")
