"""Citation edges: one hop from seeds, provider fallback, and the branch they form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import identifiers as ids
from sievelake.functions import screening
from sievelake.functions.text import strip
from sievelake.operators.skew import spread_join
from sievelake.session import spread_work

UNAVAILABLE = "取得不可"


def choose_seeds(dropped: DataFrame, references: DataFrame, definitional: DataFrame) -> DataFrame:
    """(seed, title, doi): dropped items found in the reference list, plus the definitional
    seeds that are not among them."""
    pick = lambda d: d.join(references, "seed").select(
        "seed", strip(F.col("title")).alias("title"), ids.extract_doi(F.col("doi")).alias("doi"))
    extra = definitional.join(dropped, "seed", "left_anti")
    return pick(dropped.select("seed").distinct()).unionByName(pick(extra.select("seed").distinct()))


def with_fallback(seeds: DataFrame, primary: DataFrame, secondary: DataFrame,
                  names: tuple[str, str] = ("S2", "Crossref")) -> DataFrame:
    """(seed, found, ref_source): primary edges, else secondary, else one row marked unavailable.

    Which provider a seed uses is one number per seed, found with a mergeable aggregate; the
    edges are moved once, to as many tasks as the session has partitions, since keys that
    pack well would else make few and large ones.
    """
    edges = primary.select("seed", "found", F.lit(0).alias("_place")).unionByName(
        secondary.select("seed", "found", F.lit(1).alias("_place")))
    served = edges.groupBy("seed").agg(F.min("_place").alias("_place"))
    chosen = spread_work(seeds.select("seed"), "seed").join(served, "seed", "left")
    source = F.when(F.col("_place") == 0, names[0]).otherwise(names[1])
    found = spread_work(edges, "seed", "_place").join(chosen.where("_place IS NOT NULL"), ["seed", "_place"], "left_semi")
    return found.select("seed", "found", source.alias("ref_source")).unionByName(chosen.where("_place IS NULL").select(
        "seed", F.lit(None).cast(edges.schema["found"].dataType).alias("found"), F.lit(UNAVAILABLE).alias("ref_source")))


def expand(seeds: DataFrame, edges: DataFrame, no_forward: DataFrame | None = None,
           per_seed: int = 0) -> DataFrame:
    """(seed, direction, found, place): one hop along (src cites dst, place).

    Backward follows `src`, forward `dst`; definitional seeds skip forward. With a limit,
    each seed keeps its first `per_seed` edges per direction: Spark applies such a rank
    limit before the shuffle too, so a seed with very many edges sends few. A second hop
    is the same step with the found nodes as seeds.
    """
    backward = edges.join(seeds.select(F.col("seed").alias("src")), "src", "left_semi").select(
        F.col("src").alias("seed"), F.lit("backward").alias("direction"), F.col("dst").alias("found"), "place")
    ahead = seeds if no_forward is None else seeds.join(no_forward.select("seed"), "seed", "left_anti")
    forward = edges.join(ahead.select(F.col("seed").alias("dst")), "dst", "left_semi").select(
        F.col("dst").alias("seed"), F.lit("forward").alias("direction"), F.col("src").alias("found"), "place")
    hops = backward.unionByName(forward)
    if per_seed <= 0:
        return hops
    order = Window.partitionBy("seed", "direction").orderBy("place", "found")
    return hops.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_seed).drop("n")


def citation_branch(found: DataFrame, exclusions) -> DataFrame:
    """Tags each found row with what happens to it on the way to screening.

    `found` has (ord, in_corpus, title, abstract, doi). The concept filter and the venue
    ranking do not apply to this branch; keyword exclusion does. Rows without a title are
    kept apart, repeats over seeds count once.
    """
    rows = found.withColumn("title", strip(F.col("title"))).withColumn("abstract", strip(F.col("abstract")))
    rows = rows.withColumn("record_key", ids.record_key(F.col("doi"), F.col("title")))
    new = (F.col("in_corpus") == "N") & (F.col("title") != "")
    firsts = rows.where(new).groupBy("record_key").agg(F.min("ord").alias("_first"))
    joined = screening.with_keywords(spread_join(rows, firsts, ["record_key"], "left", "ord"), exclusions)
    hit = F.size("kw_keywords") > 0
    outcome = (
        F.when(F.col("in_corpus") != "N", "known")
        .when(F.col("title") == "", "no title")
        .when(F.col("ord") != F.col("_first"), "repeat")
        .when(hit, "keyword")
        .otherwise("to screening")
    )
    return joined.withColumn("outcome", outcome).drop("_first", "kw_keywords", "kw_categories")
