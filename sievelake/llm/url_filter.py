"""URL filters: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

A rule is a host and a path with a verdict. It fits its host and every subdomain of it when
the url's path starts with the rule's path; the longest fitting rule decides. Each url is
expanded into the expressions that rules of the table could have (host suffixes by number of
labels, path prefixes by length), the expressions meet the rules on the first 32 bits of their
digest, and the whole digest confirms the hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import fresh
from sievelake.operators.skew import spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8
#: Rules up to this number are sent to every executor (about 300 bytes each).
BROADCAST_RULES = 100_000


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path).cast("binary"), 256)


def prepared(rules: DataFrame) -> DataFrame:
    """One row per hash prefix with the rules behind it.

    Hosts are lower-cased; a null path counts as empty; rules without a host or with a
    verdict other than `allow` and `block` are ignored; of equal rules with both verdicts
    `block` holds.
    """
    host, path = F.translate(F.col("host"), UPPER, LOWER), F.coalesce(F.col("path"), F.lit(""))
    own = (
        rules.where((F.col("host") != "") & F.col("verdict").isin("allow", "block"))
        .select(host.alias("host"), path.alias("path"), "verdict")
        .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    )
    own = own.withColumn("digest", _digest(F.col("host"), F.col("path")))
    own = own.withColumn("labels", F.size(F.split("host", r"\."))).withColumn("cut", F.length("path"))
    return own.groupBy(F.substring("digest", 1, PREFIX_DIGITS).alias("prefix")).agg(
        F.collect_list(F.struct("digest", "host", "path", "verdict", "labels", "cut")).alias("found"))


def judged(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
           broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """`urls` with `host`, `path`, `rule` (host and path, null if none fits) and `verdict`.

    Every row gives one row, repeated urls too; columns of those four names are replaced.
    Pass only the columns to keep: they travel with the row through one aggregate. A null url,
    or one without `://`, has an empty host and path, fits no rule and gets `default`.

    A rule table of at most `broadcast_rules` rules is broadcast; a larger one is joined with
    the frequent expressions (every `.com` page has the expression `com/`) spread over tasks.
    """
    table = prepared(rules)
    shapes = table.select(F.explode("found").alias("r")).select("r.labels", "r.cut").distinct().collect()
    counted = table.agg(F.coalesce(F.sum(F.size("found")), F.lit(0))).first()[0]
    out = ["host", "path", "rule", "verdict"]
    kept = [c for c in urls.columns if c.lower() not in out]
    row, parts = fresh("row", urls), fresh("parts", urls)
    base = urls.withColumn(row, F.monotonically_increasing_id()).select(
        row, F.struct(*[F.col(f"`{c}`") for c in kept]).alias(parts) if kept else F.lit(None).alias(parts),
        host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    labels = F.split("host", r"\.")
    suffix = lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), ".")
    each = F.filter(
        F.array(*[F.struct(F.lit(s["labels"]).alias("k"), F.lit(s["cut"]).alias("n")) for s in shapes]),
        lambda s: (F.col("host") != "") & (s["k"] <= F.size(labels)) & (s["n"] <= F.length("path")),
    ) if shapes else F.array().cast("array<struct<k:int,n:int>>")
    asked = base.withColumn("s", F.explode_outer(each))
    asked = asked.withColumn("digest", _digest(suffix(F.col("s.k")), F.substring(F.col("path"), F.lit(1), F.col("s.n"))))
    asked = asked.withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS)).drop("s")
    if counted <= broadcast_rules:
        met = asked.join(F.broadcast(table), "prefix", "left")
    else:
        met = spread_join(asked, table, ["prefix"], salt_by=row)
    hit = F.get(F.filter("found", lambda r: r["digest"] == F.col("digest")), F.lit(0))
    size = F.length(hit["host"]) + F.length(hit["path"])
    # The longest rule; of two of the same length the one with the longer host.
    rank = F.struct(size.alias("n"), F.length(hit["host"]).alias("h"), F.concat(hit["host"], hit["path"]).alias("rule"),
                    hit["verdict"].alias("verdict"))
    best = met.withColumn("hit", F.when(hit.isNotNull(), rank)).groupBy(row).agg(
        F.first(parts).alias(parts), F.first("host").alias("host"), F.first("path").alias("path"), F.max("hit").alias("hit"))
    return best.select(*[F.col(f"{parts}.`{c}`") for c in kept], "host", "path", F.col("hit.rule").alias("rule"),
                       F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
