"""Checking quotations against paged text, and how far repeated runs agree.

Pages are brought into a comparison form, joined per record and cut into strips, so a
long record is spread over many tasks and no page list is ever collected.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions.similarity import canonical_text, no_space, no_space_or_hyphen
from sievelake.functions.text import squeeze
from sievelake.operators.skew import spread_join
from sievelake.session import cut

SEED = 16
STRIP = 4096


def loose_form(c: Column) -> Column:
    return no_space(canonical_text(c))


def exact_form(c: Column) -> Column:
    return squeeze(canonical_text(c))


def span_form(c: Column) -> Column:
    return no_space_or_hyphen(canonical_text(c))


def page_offsets(pages: DataFrame, form=span_form) -> DataFrame:
    """(record_id, page, body, start): pages in comparison form with their place in the whole.

    Pages of a record are summed in blocks of 1,000 page numbers.
    """
    bodies = cut(pages.select("record_id", "page", form(F.col("text")).alias("body")))
    sized = bodies.select("record_id", "page", F.length("body").cast("bigint").alias("size"),
                          F.floor(F.col("page") / 1000).alias("block"))

    def before(keys, order):
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    blocks = sized.groupBy("record_id", "block").agg(F.sum("size").alias("total"))
    block_starts = blocks.select("record_id", "block", F.coalesce(
        F.sum("total").over(before(["record_id"], "block")), F.lit(0)).alias("block_start"))
    places = (
        sized.withColumn("inside", F.coalesce(F.sum("size").over(before(["record_id", "block"], "page")), F.lit(0)))
        .join(block_starts, ["record_id", "block"])
        .select("record_id", "page", (F.col("block_start") + F.col("inside")).alias("start"))
    )
    return cut(bodies.join(places, ["record_id", "page"]))


def strips_of(text: DataFrame) -> DataFrame:
    """(record_id, strip, chars, own): the joined pages in strips of 4,096 characters.

    `own` is the length of the strip's own part; `chars` goes on into the next strip as
    far as a block needs. A strip is put together from the pages it touches: at most one
    piece per character.
    """
    reach = STRIP + SEED - 1
    end = F.col("start") + F.length("body")
    first = F.floor(F.greatest(F.col("start") - (SEED - 1), F.lit(0)) / STRIP)
    touched = text.where("body <> ''").select(
        "record_id", "start", "body", F.explode(F.sequence(first, F.floor((end - 1) / STRIP))).alias("strip"))
    begin = F.col("strip") * STRIP
    left, right = F.greatest(F.col("start"), begin), F.least(end, begin + reach)
    part = F.substring("body", (left - F.col("start") + 1).cast("int"), (right - left).cast("int"))
    pieces = touched.where(right > left).select("record_id", "strip", F.struct(left.alias("at"), part.alias("part")).alias("p"))
    return pieces.groupBy("record_id", "strip").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["part"]), "").alias("chars")
    ).withColumn("own", F.least(F.length("chars"), F.lit(STRIP)))


def seed_size(length: Column) -> Column:
    """Largest power of two up to 16 of which a text this long holds an aligned block at any shift."""
    size = F.lit(1)
    for k in (2, 4, 8, 16):
        size = F.when(length >= 2 * k - 1, F.lit(k)).otherwise(size)
    return size


def occurrences(needles: DataFrame, text: DataFrame) -> DataFrame:
    """(id, at, one_page, size): where the needles (id, record_id, q) stand in their record.

    The joined text is cut at every 16th character. A needle of 31 characters or more
    holds one of these blocks whole, at one of its first 16 shifts, so blocks and needles
    are joined on their content; shorter needles use smaller blocks. Every match of a
    block is one place to compare. The needle's own text joins only different places: not
    its 16 shifts, and not every block that tells the same place.
    """
    strips = cut(strips_of(text.join(needles.select("record_id").distinct(), "record_id", "left_semi")))
    named = needles.select("id", "record_id", "q", F.xxhash64("q").alias("mark"))
    sized = named.withColumn("size", F.length("q")).withColumn("seed", seed_size(F.length("q")))
    probes = sized.withColumn("shift", F.explode(F.sequence(F.lit(0), F.col("seed") - 1))).withColumn(
        "gram", F.substring("q", F.col("shift") + 1, F.col("seed"))).drop("q")
    seeds = sized.groupBy("record_id").agg(F.collect_set("seed").alias("seeds"))  # at most five
    cutting = spread_join(strips, seeds, ["record_id"], "inner", "strip").withColumn("seed", F.explode("seeds"))
    # STRIP is a multiple of every seed, so blocks start at the strip's own beginning.
    grams = cutting.withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("own") - 1, F.col("seed")))
    ).select("record_id", "seed", (F.col("strip") * STRIP + F.col("i")).alias("block_at"),
             F.substring("chars", F.col("i") + 1, F.col("seed")).alias("gram"))
    places = grams.join(probes, ["record_id", "seed", "gram"]).select(
        "id", "record_id", "mark", "size", (F.col("block_at") - F.col("shift")).alias("at")).where("at >= 0").distinct()
    return _compare(places.join(named, ["id", "record_id", "mark"]).drop("mark"), strips, text)


def _compare(places: DataFrame, strips: DataFrame, text: DataFrame) -> DataFrame:
    """The places where the whole needle stands, compared strip by strip."""
    end = F.col("at") + F.col("size")
    parts = places.withColumn("strip", F.explode(F.sequence(
        F.floor(F.col("at") / STRIP), F.floor((end - 1) / STRIP))))
    begin = F.col("strip") * STRIP
    left, right = F.greatest(F.col("at"), begin), F.least(end, begin + STRIP)
    width = (right - left).cast("int")
    same = F.substring("chars", (left - begin + 1).cast("int"), width) == F.substring(
        "q", (left - F.col("at") + 1).cast("int"), width)
    whole = cut(
        parts.join(strips, ["record_id", "strip"], "left")
        .groupBy("id", "record_id", "at", "size").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("same"))
        .where("same").drop("same")
    )
    # A needle crosses pages when one starts inside it.
    edges = text.where("body <> ''").select("record_id", F.col("start").alias("edge"),
                                            F.floor(F.col("start") / STRIP).alias("strip"))
    crossing = whole.withColumn("strip", F.explode(F.sequence(
        F.floor(F.col("at") / STRIP), F.floor((end - 1) / STRIP)))).join(edges, ["record_id", "strip"]).where(
        "edge > at AND edge < at + size").select("id", "at", F.lit(True).alias("crosses")).distinct()
    return whole.join(crossing, ["id", "at"], "left").select(
        "id", "at", F.col("crosses").isNull().alias("one_page"), "size")


def locate_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, status, start, stop): where each quotation stands in its record's text.

    `quotes` has (quote_id, record_id, page, quote). The stated page is tried first, then
    the other pages in order, then the joined pages; what is still open is cut into pieces
    of 40 characters and counts as PARTLY when three tenths of them occur.
    """
    text = page_offsets(pages)
    asked = cut(quotes.select("quote_id", "record_id", "page", span_form(F.col("quote")).alias("q")).where("q <> ''"))
    place = F.instr("body", F.col("q"))
    stated = cut(asked.join(text, ["record_id", "page"]).where(place > 0).select(
        "quote_id", F.lit("OK").alias("status"), (F.col("start") + place - 1).alias("at"), F.length("q").alias("size")))
    open_quotes = cut(asked.join(stated, "quote_id", "left_anti"))
    hits = occurrences(open_quotes.select(F.col("quote_id").alias("id"), "record_id", "q"), text)
    elsewhere = cut(hits.groupBy(F.col("id").alias("quote_id")).agg(
        F.min_by("at", F.struct((~F.col("one_page")).cast("int"), "at")).alias("at"), F.min("size").alias("size")
    ).select("quote_id", F.lit("WRONG_PAGE").alias("status"), "at", "size"))
    missing = open_quotes.join(elsewhere, "quote_id", "left_anti")
    piece = fixed.QUOTE_PIECE
    starts = F.sequence(F.lit(0), F.greatest(F.length("q") - (piece - 1), F.lit(1)) - 1, F.lit(piece))
    pieces = cut(missing.select("quote_id", "record_id", F.posexplode(F.transform(
        starts, lambda k: F.substring("q", k + 1, F.lit(piece)))).alias("n", "q")))
    held = occurrences(pieces.select(F.struct("quote_id", "n").alias("id"), "record_id", "q"), text)
    counted = pieces.groupBy("quote_id").agg(F.count("*").alias("pieces")).join(
        held.groupBy(F.col("id.quote_id").alias("quote_id")).agg(F.count_distinct("id").alias("held")), "quote_id")
    partly = counted.where(F.col("held") / F.col("pieces") >= fixed.QUOTE_PARTLY).select(
        "quote_id", F.lit("PARTLY").alias("status"), F.lit(None).cast("bigint").alias("at"),
        F.lit(None).cast("int").alias("size"))
    answers = stated.unionByName(elsewhere).unionByName(partly)
    return quotes.select("quote_id").join(answers, "quote_id", "left").select(
        "quote_id", F.coalesce("status", F.lit("ABSENT")).alias("status"),
        F.col("at").alias("start"), (F.col("at") + F.col("size")).alias("stop"))


def _held(quotes: DataFrame, pages: DataFrame, form) -> DataFrame:
    """(quote_id, on_stated, anywhere) in the given comparison form; a page at a time."""
    text = page_offsets(pages, form)
    asked = cut(quotes.select("quote_id", "record_id", "page", form(F.col("quote")).alias("q")))
    blank = F.col("q") == ""
    on_page = asked.join(text.select("record_id", "page", "body"), ["record_id", "page"], "left").select(
        "quote_id", "record_id", "q", F.coalesce(blank | F.contains("body", "q"), F.lit(False)).alias("on_stated"))
    on_page = cut(on_page)
    rest = on_page.where(~F.col("on_stated")).select(F.col("quote_id").alias("id"), "record_id", "q")
    found = occurrences(rest, text).where("one_page").select(F.col("id").alias("quote_id"), F.lit(True).alias("found")).distinct()
    return on_page.join(found, "quote_id", "left").select(
        "quote_id", "on_stated", F.coalesce(F.col("on_stated") | F.col("found"), F.lit(False)).alias("anywhere"))


def verify_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """(quote_id, status, exact, loose): spacing kept for an exact hit, ignored for a loose one."""
    exact, loose = _held(quotes, pages, exact_form), _held(quotes, pages, loose_form)
    joined = exact.select("quote_id", F.col("anywhere").alias("exact")).join(
        loose.select("quote_id", F.col("on_stated").alias("page_ok"), F.col("anywhere").alias("loose")), "quote_id")
    status = (
        F.when(F.col("exact") & F.col("page_ok"), "OK").when(F.col("loose") & F.col("page_ok"), "OK_LOOSE")
        .when(F.col("loose"), "WRONG_PAGE").otherwise("NOT_FOUND")
    )
    return joined.select("quote_id", status.alias("status"), "exact", "loose")


def field_gaps(answers: DataFrame, fields: list[str]) -> DataFrame:
    """(record_id, run, field) asked for but left without a quotation, and whether the key was there.

    `answers` has (record_id, run, fields: map of field to quotations), NULL when it could
    not be read: such a record gives one PARSE_ERROR row.
    """
    names = F.array(*[F.lit(f) for f in fields])
    rows = answers.select("record_id", "run", "fields", F.explode(
        F.when(F.col("fields").isNull(), F.array(F.lit(""))).otherwise(names)).alias("field"))
    cell = F.try_element_at("fields", F.col("field"))
    return rows.where(cell.isNull() | (F.size(cell) == 0)).select(
        "record_id", "run", "field",
        F.when(F.col("fields").isNull(), "PARSE_ERROR")
        .when(F.array_contains(F.map_keys("fields"), F.col("field")), "EMPTY").otherwise("MISSING_KEY").alias("status"))


def run_stability(quotes: DataFrame, runs: list[str]) -> DataFrame:
    """(record_id, field, identical, n_common, n_union, n_<run>...): sets of quotations over the runs.

    `quotes` has (record_id, field, run, quote). Equal quotations meet by key, so no set
    is collected.
    """
    form = quotes.select("record_id", "field", "run", loose_form(F.col("quote")).alias("q"))
    present = form.groupBy("record_id", "field", "q").agg(
        *[F.bool_or(F.col("run") == r).alias(f"in_{r}") for r in runs])
    everywhere = F.lit(True)
    for r in runs:
        everywhere = everywhere & F.col(f"in_{r}")
    return present.groupBy("record_id", "field").agg(
        F.bool_and(everywhere).alias("identical"), F.count_if(everywhere).alias("n_common"),
        F.count("*").alias("n_union"), *[F.count_if(F.col(f"in_{r}")).alias(f"n_{r}") for r in runs])


def covered(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, size): characters covered by the half-open spans (start, stop) of each group.

    Spans are cut at strip borders; per strip and start only the longest one counts, so a
    window holds at most one row per character of a strip.
    """
    cells = spans.where("stop > start").withColumn("strip", F.explode(F.sequence(
        F.floor(F.col("start") / STRIP), F.floor((F.col("stop") - 1) / STRIP))))
    begin = F.col("strip") * STRIP
    cells = cells.select(*keys, "strip", F.greatest("start", begin).alias("a"), F.least("stop", begin + STRIP).alias("b"))
    longest = cells.groupBy(*keys, "strip", "a").agg(F.max("b").alias("b"))
    earlier = Window.partitionBy(*keys, "strip").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("b").over(earlier), F.lit(-1))
    added = longest.withColumn("added", F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), reach)))
    return added.groupBy(*keys).agg(F.sum("added").alias("size"))


def span_agreement(spans: DataFrame, cells: DataFrame, runs: list[str]) -> DataFrame:
    """(record_id, field, jaccard, shared, empty_all) over three runs.

    `spans` has (record_id, field, run, start, stop), `cells` all (record_id, field). Sizes
    of unions over every subset of the runs give all intersections, so spans never meet
    in a range join.
    """
    subsets = [s for k in range(1, len(runs) + 1) for s in combinations(range(len(runs)), k)]
    names = ["u" + "".join(map(str, s)) for s in subsets]
    member = F.when(F.lit(False), F.array(F.lit("")))
    for place, run in enumerate(runs):
        member = member.when(F.col("run") == run, F.array(*[F.lit(n) for n, s in zip(names, subsets) if place in s]))
    spread = spans.withColumn("subset", F.explode(member))
    sizes = covered(spread, ["record_id", "field", "subset"]).groupBy("record_id", "field").agg(
        *[F.coalesce(F.max(F.when(F.col("subset") == n, F.col("size"))), F.lit(0)).alias(n) for n in names])
    full = cells.join(sizes, ["record_id", "field"], "left").na.fill(0, names)
    u = {s: F.col(n) for s, n in zip(subsets, names)}
    pairs = list(combinations(range(len(runs)), 2))
    inter = {(a, b): u[(a,)] + u[(b,)] - u[(a, b)] for a, b in pairs}
    scores = [F.when(u[p] == 0, F.lit(1.0)).otherwise(inter[p] / u[p]) for p in pairs]
    everyone = tuple(range(len(runs)))
    in_all = u[everyone] - sum(u[(r,)] for r in range(len(runs))) + sum(inter.values())
    return full.select(
        "record_id", "field", (sum(scores) / len(pairs)).alias("jaccard"), (in_all > 0).alias("shared"),
        (u[everyone] == 0).alias("empty_all"))


def field_summary(agreement: DataFrame) -> DataFrame:
    """Per field: records, empty in all runs, shared passages, and means over the non-empty ones."""
    used = ~F.col("empty_all")
    return agreement.groupBy("field").agg(
        F.count("*").alias("records"), F.count_if("empty_all").alias("empty"),
        F.count_if("shared").alias("shared"),
        F.round(F.count_if("shared") / F.nullif(F.count_if(used), F.lit(0)), 2).alias("shared_share"),
        F.round(F.avg(F.when(used, F.col("jaccard"))), 2).alias("mean_jaccard"))
