"""URL filters by host-suffix and path-prefix expressions.

Each URL is expanded into the expressions that a rule could be written as; a
short hash prefix is the join key to the rules, the full digest confirms, and
the longest rule that fits decides. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_RULES, BROADCAST_BYTES = 100_000, 32 << 20  # rules up to this number and size are broadcast; more are joined by a shuffle


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) as a table of literals."""
    kind = "array<struct<verdict:string,host:string,path:string>>"
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]).cast(kind)
    return spark.range(1).select(F.inline(rows))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: page_id, host, path, rule (host and path of the deciding rule, or null), verdict.

    ``rules`` has verdict, host and path. A rule fits its host and every
    subdomain of it, if the path starts with the rule's; of those that fit the
    longest wins, then the one with the longer host, then block before other
    verdicts. Rules with a null part are ignored. A null URL, or one without
    ``://``, has an empty host and path, which an empty rule host alone would
    fit. Without a fitting rule the verdict is ``default``. Repeated rows are
    judged one by one; other columns are ignored.
    """
    known = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")).dropna()
    known = known.groupBy("r_host", "r_path").agg(F.min(F.struct((F.col("verdict") != "block").alias("o"), "verdict")).alias("v"))
    digest = F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256)
    known = known.select("r_host", "r_path", F.col("v.verdict").alias("r_verdict"), digest.alias("r_digest"), F.substring(digest, 1, 8).alias("r_prefix"))
    # the shapes that rules have: labels of the host and characters of the path
    shapes = known.agg(
        F.collect_set(F.size(F.split("r_host", r"\."))).alias("labels"), F.collect_set(F.char_length("r_path")).alias("lengths"), F.count("*").alias("n"), F.sum(F.octet_length("r_host") + F.octet_length("r_path") + 200).alias("size")
    ).first()
    labels, lengths = sorted(shapes.labels), sorted(shapes.lengths)
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), F.monotonically_increasing_id().alias("row"))
    if not labels:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # a host has a suffix of n labels if it has as many; a path has a prefix of m characters if it is as long
    count = F.char_length("host") - F.char_length(F.replace("host", F.lit("."))) + 1
    suffixes = F.array_distinct(F.array_compact(F.array(*[F.when(count >= n, F.substring_index("host", ".", -n)) for n in labels])))
    prefixes = F.array_compact(F.array(*[F.when(F.char_length("path") >= m, F.substring(F.col("path"), 1, m)) for m in lengths]))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("h"), p.alias("p")))))
    hashed = rows.select("*", F.explode_outer(pairs).alias("e")).withColumn("digest", F.sha2(F.concat_ws("\n", "e.h", "e.p"), 256))
    hashed = hashed.withColumn("prefix", F.substring("digest", 1, 8))
    side = F.broadcast(known) if shapes.n <= BROADCAST_RULES and shapes.size <= BROADCAST_BYTES else known
    # the short prefix finds candidates, the whole digest confirms them
    joined = hashed.join(side, F.col("prefix") == F.col("r_prefix"), "left").withColumn("fits", F.coalesce(F.col("digest") == F.col("r_digest"), F.lit(False)))
    rule = F.concat("r_host", "r_path")
    best = F.max(
        F.when(
            F.col("fits"),
            F.struct(F.char_length(rule).alias("size"), F.char_length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), rule.alias("rule"), F.col("r_verdict").alias("verdict")),
        )
    )
    # a URL's expressions stay in one partition up to here, so each comes to one row before the shuffle
    judged = joined.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
