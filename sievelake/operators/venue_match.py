"""Matching free-text venue names to the ranking lists, with guards, and auditing the result.

Names are resolved once per distinct (venue, issn); callers join the answer back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions import similarity, venues
from sievelake.functions.text import strip
from sievelake.operators import simjoin
from sievelake.operators.ranking import issn_list
from sievelake.operators.skew import spread_join
from sievelake.session import cut, spread_work

Lists = dict[str, DataFrame]

# Order in which the stages are tried; typed keys and acronyms take two places each.
CORE_RAW, CORE_TYPED, CORE_NORM = 10, 20, 30
SJR_ISSN, SJR_RAW, SJR_TYPED, SJR_NORM = 40, 50, 60, 70
CORE_ACRONYM, CORE_FUZZY = 80, 90


def _features(names: DataFrame) -> DataFrame:
    venue = F.col("venue")
    return (
        spread_work(names.select("venue").distinct(), "venue")
        .withColumn("norm", venues.normalize_venue(venue))
        .withColumn("low", F.lower(strip(venue)))
        .withColumn("short", venues.is_short_key(F.col("norm")))
        .withColumn("marker", venues.type_marker(venue))
        .withColumn("acronym", venues.trailing_acronym(venue))
    )


# What tells candidates of a stage apart: the table asked, its list, stage and note, and whether it needs no guard.
CANDIDATE = ["venue", "low", "place", "pos", "source", "stage", "label", "title", "entry_acronym", "rank", "exempt"]


def _asked(kind: str, keys: Column, source: str, stage: str, label: str, first_place: int, exempt: bool = False) -> Column:
    """The questions of one stage: `keys` is an array of keys, tried in order."""
    return F.transform(keys, lambda k, n: F.struct(
        F.lit(kind).alias("kind"), k.alias("key"), (F.lit(first_place) + n).alias("place"), n.alias("pos"),
        F.lit(source).alias("source"), F.lit(stage).alias("stage"), F.lit(label).alias("label"), F.lit(exempt).alias("exempt")))


def key_table(a: Lists, b: Lists) -> DataFrame:
    """(kind, key, title, entry_acronym, rank): the keys of both lists that exact stages ask for by name, in one table."""
    parts = [rows.select(F.lit(kind).alias("kind"), "key", F.col("entry.title").alias("title"),
                         F.col("entry.acronym").alias("entry_acronym"), F.col("entry.rank").alias("rank"))
             for kind, rows in (("a", a["keys"]), ("a typed", a["typed"]), ("b", b["keys"]), ("b typed", b["typed"]))]
    table = parts[0]
    for more in parts[1:]:
        table = table.unionByName(more)
    return table


def _guarded(candidates: DataFrame) -> DataFrame:
    """Adds `passes` and, for failures, `note`.

    Containment is asked first; the string ratio only of candidates that it does not decide.
    """
    venue, title = F.col("venue"), F.col("title")
    backward = F.col("stage") == "core_acronym"
    words = spread_work(candidates, "venue", "title").withColumn(
        "cont", F.when(~F.col("exempt"), venues.containment(title, venue))
    ).withColumn("back", F.when(backward, venues.containment(venue, title)))
    held = (F.col("cont") >= fixed.SANITY_CONTAINMENT) & (F.size(venues.content_tokens(title)) >= 3)
    known = F.col("exempt") | held | (backward & (F.col("back") >= fixed.SANITY_CONTAINMENT))
    judged = cut(words.withColumn("known", F.coalesce(known, F.lit(False))))
    rest = judged.where("NOT known").withColumn("sim", similarity.raw_similarity(venue, title))
    passes = F.col("sim") >= fixed.SANITY_SIMILARITY
    two = lambda c: F.format_number(c, 2)
    note = F.concat(F.col("label"), F.lit(":'"), title, F.lit("'(sim="), two(F.col("sim")),
                    F.lit("/cont="), two(F.col("cont")), F.lit(")"))
    back_note = F.concat(F.lit("core_acronym:'"), title, F.lit("'(back_cont="), two(F.col("back")), F.lit(")"))
    notes = F.when(backward, F.array(note, back_note)).otherwise(F.array(note))
    columns = ["venue", "place", "pos", "source", "stage", "title", "rank"]
    sure = judged.where("known").select(*columns, F.lit(True).alias("passes"), F.lit(None).cast("array<string>").alias("notes"))
    return sure.unionByName(rest.select(*columns, passes.alias("passes"), F.when(~passes, notes).alias("notes")))


def fuzzy_best(names: DataFrame, keys: DataFrame, threshold: float = fixed.FUZZY_VENUE,
               length_rule: bool = True) -> DataFrame:
    """(norm, key, score): the most similar key; equal scores go to the key written first.

    `keys` has (key, first_place, ...).
    """
    best = simjoin.top_by_ratio(names.select("norm"), keys.select("key", "first_place"), threshold, 1,
                                F.asc("first_place"), length_rule)
    return best.select(F.col("l").alias("norm"), F.col("r").alias("key"), "score")


def resolve_venues(names: DataFrame, a: Lists, b: Lists,
                   fuzzy_threshold: float = fixed.FUZZY_VENUE) -> DataFrame:
    """(venue, issn, source, matched_title, rank, stage, rejected) per distinct name.

    Every exact stage of both lists comes before similarity. Short names may only match
    by their exact title, ISSN or acronym. A match on a key has to be sane: similar
    enough as written, or its words nearly all present. All stages but the ISSN's look at
    the venue alone, so they are asked once per venue, however many ISSNs it comes with.
    """
    asked_names = cut(names.select(
        F.coalesce("venue", F.lit("")).alias("venue"), F.coalesce("issn", F.lit("")).alias("issn")).distinct())
    features = cut(_features(asked_names))
    one = lambda c: F.array(c)
    none = F.array().cast("array<string>")
    long_key = (F.col("norm") != "") & ~F.col("short")
    typed = F.when(long_key, venues.typed_keys(F.col("venue"), F.col("norm"))).otherwise(none)
    plain = F.when(long_key & (F.col("marker") == ""), one(F.col("norm"))).otherwise(none)
    acronyms = F.filter(
        F.when(F.col("acronym") != "",
               F.array(F.lower("acronym"), venues.normalize_venue(F.col("acronym")))).otherwise(none),
        lambda k: k != "",
    )
    raw_is_title = (F.col("low") == F.lower(strip(F.col("title")))) | (
        (F.col("entry_acronym") != "") & (F.col("low") == F.lower(strip(F.col("entry_acronym"))))
    )
    low = one(F.col("low"))
    questions = F.concat(
        _asked("a", low, "CORE", "core_exact_raw", "", CORE_RAW, True),
        _asked("a typed", typed, "CORE", "core_exact_typed", "core_typed", CORE_TYPED),
        _asked("a", plain, "CORE", "core_exact_norm", "core_norm", CORE_NORM),
        _asked("b", low, "SJR", "sjr_exact_raw", "", SJR_RAW, True),
        _asked("b typed", typed, "SJR", "sjr_exact_typed", "sjr_typed", SJR_TYPED),
        _asked("b", plain, "SJR", "sjr_exact_norm", "sjr_norm", SJR_NORM),
        _asked("a", acronyms, "CORE", "core_acronym", "core_acronym", CORE_ACRONYM),
    )
    asked = features.select("venue", "low", F.explode(questions).alias("q")).select("venue", "low", "q.*")
    raw = F.col("stage").isin("core_exact_raw", "sjr_exact_raw")
    everything = asked.join(key_table(a, b), ["kind", "key"]).where(~raw | F.coalesce(raw_is_title, F.lit(False))).select(*CANDIDATE)
    judged = cut(_guarded(everything))
    choice = F.struct("place", "source", "title", "rank", "stage")
    order = F.struct("place", "pos")
    winners = judged.where("passes").select("venue").distinct()
    by_issn = cut(issn_answers(asked_names, b))

    # Similarity is asked for venues that no exact stage answers, in at least one of their rows.
    unanswered = asked_names.where("issn <> ''").join(by_issn, "issn", "left_anti")
    left_open = asked_names.where("issn = ''").unionByName(unanswered).select("venue").distinct()
    open_names = features.join(winners, "venue", "left_anti").join(left_open, "venue", "left_semi")
    hopeful = open_names.where(long_key)
    best = fuzzy_best(hopeful.select("norm").distinct(), a["keys"], fuzzy_threshold)
    near = hopeful.join(best.select("norm", "key"), "norm").join(a["keys"], "key").select(
        "venue", "low", F.lit(CORE_FUZZY).alias("place"), F.lit(0).alias("pos"), F.lit("CORE").alias("source"),
        F.lit("core_fuzzy").alias("stage"), F.lit("core_fuzzy").alias("label"),
        F.col("entry.title").alias("title"), F.col("entry.acronym").alias("entry_acronym"),
        F.col("entry.rank").alias("rank"), F.lit(False).alias("exempt"),
    )
    judged_near = _guarded(near)
    # At most three winners' fields and, per venue, one entry per stage: small by construction.
    outcome = judged.unionByName(judged_near).groupBy("venue").agg(
        F.min_by(choice, F.when(F.col("passes"), order)).alias("w"),
        F.array_sort(F.collect_list(F.when(~F.col("passes"), F.struct("place", "notes")))).alias("failed"),
    )
    failed = F.slice(F.flatten(F.transform(F.coalesce("failed", F.array()), lambda f: f["notes"])), 1, 3)
    guard = F.when(F.col("short") & (F.col("norm") != ""),
                   F.concat(F.lit("短キーガード(tokens<=2: '"), "norm", F.lit("')")))
    refused = F.when(F.size(failed) > 0, F.concat(F.lit("サニティ棄却 "), F.array_join(failed, "; ")))
    by_venue = cut(features.join(outcome, "venue", "left").select(
        "venue", "w", F.concat_ws(" / ", guard, refused).alias("rejected")))
    answered = spread_join(
        spread_join(asked_names, by_venue, ["venue"], "inner", "issn"), by_issn, ["issn"], "left", "venue")
    exact = F.col("w.place") < SJR_ISSN
    won = F.when(F.coalesce(exact, F.lit(False)) | F.col("by_issn").isNull(), F.col("w")).otherwise(
        F.struct(F.lit(SJR_ISSN).alias("place"), F.lit("SJR").alias("source"), F.col("by_issn.title").alias("title"),
                 F.col("by_issn.rank").alias("rank"), F.lit("sjr_issn").alias("stage")))
    return answered.withColumn("w", won).select(
        "venue", "issn", "w.source", F.col("w.title").alias("matched_title"), "w.rank",
        F.coalesce("w.stage", F.lit("unmatched")).alias("stage"),
        F.when(F.col("w").isNotNull(), "").otherwise(F.col("rejected")).alias("rejected"),
    )


def issn_answers(names: DataFrame, b: Lists) -> DataFrame:
    """(issn, by_issn): per ISSN cell the entry of list B of its first number that is known."""
    numbers = names.select("issn").where("issn <> ''").distinct().select("issn", F.posexplode(issn_list(F.col("issn"))).alias("pos", "key"))
    return spread_join(numbers, b["issn"].select("key", "entry"), ["key"], "inner", "issn").groupBy("issn").agg(
        F.min_by(F.struct("entry.title", "entry.rank"), "pos").alias("by_issn"))


def rank_names(names: DataFrame, a: Lists, b: Lists, aliases: Lists | None = None,
               resolved: DataFrame | None = None) -> DataFrame:
    """(venue, issn, ranking columns, included) per distinct name; the alias list is asked first, once per venue."""
    from sievelake.operators.ranking import alias_lookup

    answers = resolve_venues(names, a, b) if resolved is None else resolved
    if aliases is not None:
        known = alias_lookup(names.select("venue").distinct(), aliases).where("alias IS NOT NULL").select("venue", "alias")
        answers = spread_join(answers, known, ["venue"], "left", "issn")
    else:
        answers = answers.withColumn("alias", F.lit(None).cast("struct<canonical:string,source:string,rank:string>"))
    by_alias = F.col("alias").isNotNull()
    source = F.coalesce("alias.source", "source")
    rank = F.coalesce("alias.rank", "rank")
    high = venues.adopted(source, rank)
    low_alias = F.concat(source, F.lit(" rank '"), rank, F.lit("' below threshold (via author-verified alias)"))
    reason = (
        F.when(source.isNull(), "Venue not found in CORE or SJR")
        .when(high, "")
        .when(by_alias, low_alias)
        .when(source == "CORE", F.concat(F.lit("CORE Rank '"), rank, F.lit("' < A")))
        .otherwise(F.concat(F.lit("SJR Quartile '"), rank, F.lit("' is not Q1")))
    )
    return answers.select(
        "venue", "issn",
        F.coalesce("alias.canonical", "matched_title", F.lit("")).alias("matched_venue"),
        F.when(by_alias, F.concat(source, F.lit("(alias)"))).otherwise(F.coalesce(source, F.lit(""))).alias("ranking_source"),
        F.when(source == "CORE", rank).otherwise("").alias("core_rank"),
        F.when(source == "SJR", rank).otherwise("").alias("sjr_quartile"),
        reason.alias("excl_reason"),
        F.when(by_alias, "alias").otherwise(F.col("stage")).alias("match_stage"),
        F.when(by_alias, "").otherwise(F.col("rejected")).alias("match_guard_note"),
        high.alias("included"),
    )


def counted_names(records: DataFrame) -> DataFrame:
    """(venue, issn, n): the distinct names of the records, missing ones empty, with the number of records."""
    return records.groupBy(F.coalesce("venue", F.lit("")).alias("venue"), F.coalesce("issn", F.lit("")).alias("issn")).agg(F.count("*").alias("n"))


def rank_records(records: DataFrame, a: Lists, b: Lists, aliases: Lists | None = None,
                 resolved: DataFrame | None = None) -> DataFrame:
    """Records with their ranking columns and `included`; the alias list is asked first."""
    rows = records.withColumn("venue", F.coalesce("venue", F.lit(""))).withColumn(
        "issn", F.coalesce("issn", F.lit("")))
    names = cut(counted_names(rows))
    columns = rank_names(names, a, b, aliases, resolved)
    return spread_join(rows, columns, ["venue", "issn"], "left", sizes=names.withColumnRenamed("n", "_rows"))


# --- audits ------------------------------------------------------------------------------------

def nearest_entries(names: DataFrame, keys: DataFrame, cutoff: float, candidates: int = 5) -> DataFrame:
    """(norm, key, similarity): of the closest few by ratio, the closest by edit distance.

    `names` is a report's top-N list. Equal ratios prefer the later key in text order,
    equal edit similarities the better ratio.
    """
    top = simjoin.top_by_ratio(names.select("norm"), keys.select("key"), cutoff, candidates, F.desc("r"),
                               length_rule=False, swap=True)
    scored = top.withColumn("similarity", similarity.edit_similarity(F.col("l"), F.col("r")))
    return scored.where("similarity > 0").groupBy(F.col("l").alias("norm")).agg(
        F.max_by(F.struct(F.col("r").alias("key"), "similarity"), F.struct("similarity", -F.col("n"))).alias("b")
    ).select("norm", "b.key", "b.similarity")


def unmatched_report(unmatched: DataFrame, a: Lists, b: Lists, top: int = 50,
                     flag_at: float = 0.85) -> DataFrame:
    """The most frequent unmatched venue names with their nearest entries on both lists.

    `unmatched` has one row per record, or names with their number of records in `n`; counting
    comes first, so only the report's own top-N names are compared.
    """
    records = F.sum("n") if "n" in unmatched.columns else F.count("*")
    name = F.when(strip(F.col("venue")) == "", "(空欄)").otherwise(strip(F.col("venue")))
    counted = (
        unmatched.groupBy(name.alias("venue_raw")).agg(records.alias("record_count"))
        .orderBy(F.desc("record_count"), "venue_raw").limit(top)
    )
    listed = cut(counted.withColumn(
        "norm", F.when(F.col("venue_raw") == "(空欄)", "").otherwise(venues.normalize_venue(F.col("venue_raw")))))
    asked = listed.where("norm <> ''").select("norm").distinct()
    parts = []
    for keys, cutoff, side in ((a["keys"], 0.5, "core"), (b["keys"], 0.6, "sjr")):
        near = nearest_entries(asked, keys, cutoff).join(keys.select("key", "entry"), "key")
        parts.append(near.select(
            "norm", F.col("entry.title").alias(f"{side}_title"), F.col("entry.rank").alias(f"{side}_rank"),
            F.col("similarity").alias(f"{side}_similarity")))
    joined = listed.join(parts[0], "norm", "left").join(parts[1], "norm", "left")
    close_a, close_b = F.col("core_similarity") >= flag_at, F.col("sjr_similarity") >= flag_at
    return joined.withColumn(
        "high_rank_miss",
        F.coalesce(close_a & F.col("core_rank").isin(*fixed.HIGH_RANKS), F.lit(False))
        | F.coalesce(close_b & (F.col("sjr_rank") == "Q1"), F.lit(False)),
    ).withColumn("q2_neighbour", F.coalesce(close_b & (F.col("sjr_rank") == "Q2"), F.lit(False)))


def classify_matches(matches: DataFrame, a: Lists, b: Lists, watched: tuple[str, ...] = fixed.WATCHED_VENUE_WORDS) -> DataFrame:
    """Re-derives, per distinct match, the stage by which its venue would match today.

    `matches` has (venue, issn, matched_venue, source, rank, included, n). Adds `stage`,
    `similarity` and `suspect`; a venue with a `watched` word is always suspect.
    """
    rows = matches.withColumn("norm", venues.normalize_venue(F.col("venue"))).withColumn(
        "low", F.lower(strip(F.col("venue")))).withColumn("acronym", venues.trailing_acronym(F.col("venue")))
    rows = rows.withColumn("acronym_norm", venues.normalize_venue(F.col("acronym")))
    rows = rows.withColumn("acronym", F.lower("acronym"))
    on_a = rows.where("source = 'CORE'")
    found = {}
    for column in ("norm", "low", "acronym", "acronym_norm"):
        keys = a["keys"].select(F.col("key").alias(column), F.lit(True).alias(f"has_{column}"))
        on_a = on_a.join(keys, column, "left")
        found[column] = F.coalesce(F.col(f"has_{column}"), F.lit(False)) & (F.col(column) != "")
    exact_norm, exact_low = found["norm"], F.coalesce(F.col("has_low"), F.lit(False))
    exact = exact_norm | exact_low | found["acronym"] | found["acronym_norm"]
    on_a = cut(on_a.withColumn("stage", F.when(exact_norm, "exact_norm").when(exact_low, "exact_lower")
                               .when(exact, "acronym")))
    open_norms = on_a.where("stage IS NULL AND norm <> ''").select("norm").distinct()
    best = fuzzy_best(open_norms, a["keys"])
    on_a = on_a.join(best.select("norm", "score"), "norm", "left").withColumn(
        "similarity", F.when(F.col("stage").isNotNull(), 1.0).otherwise(F.coalesce("score", F.lit(0.0)))
    ).withColumn("stage", F.coalesce("stage", F.when(F.col("score").isNotNull(), "fuzzy"), F.lit("none")))

    on_b = rows.where("source = 'SJR'")
    issn_keys = b["issn"].select("key")
    listed = on_b.select("venue", "issn", F.explode(issn_list(F.col("issn"))).alias("key")).join(
        issn_keys, "key").select("venue", "issn", F.lit(True).alias("has_issn")).distinct()
    on_b = on_b.join(listed, ["venue", "issn"], "left")
    for column in ("norm", "low"):
        keys = b["keys"].select(F.col("key").alias(column), F.lit(True).alias(f"has_{column}"))
        on_b = on_b.join(keys, column, "left")
    on_b = on_b.withColumn(
        "stage",
        F.when(F.col("has_issn"), "issn").when(F.col("has_norm") & (F.col("norm") != ""), "exact_norm")
        .when(F.col("has_low"), "exact_lower").otherwise("none"),
    ).withColumn("similarity", F.when(F.col("stage") == "none", 0.0).otherwise(1.0))

    columns = [*matches.columns, "norm", "stage", "similarity"]
    both = on_a.select(columns).unionByName(on_b.select(columns))
    suspect = (
        ((F.col("stage") == "fuzzy") & (F.col("similarity") <= fixed.SUSPECT_SIMILARITY))
        | F.col("stage").isin("acronym", "none")
    )
    for word in watched:
        suspect = suspect | F.lower("venue").contains(word)
    return both.withColumn("suspect", suspect)


def suspect_priorities(suspects: DataFrame, a: Lists, b: Lists) -> DataFrame:
    """Adds `priority` and `alternative` to suspect matches.

    P1: one of the five nearest entries of a list is similar and would turn the decision;
    P2: otherwise, and the names as written differ a lot; P3: the rest.
    """
    rows = cut(suspects.withColumn(
        "written_similarity", similarity.raw_similarity(F.col("venue"), F.col("matched_venue"))))
    norms = rows.where("norm <> ''").select("norm").distinct()
    options = None
    for place, (keys, cutoff) in enumerate(((a["keys"], 0.7), (b["keys"], 0.75))):
        near = simjoin.top_by_ratio(norms, keys.select("key"), cutoff, 5, F.desc("r"), length_rule=False, swap=True)
        few = near.select(F.col("l").alias("norm"), F.col("r").alias("key"), (F.lit(10 * place) + F.col("n")).alias("n"))
        options = few if options is None else options.unionByName(few)
    # A key that list A has too stands for the entry of list A.
    options = (
        options.join(a["keys"].select("key", F.col("entry").alias("ea")), "key", "left")
        .join(b["keys"].select("key", F.col("entry").alias("eb")), "key", "left")
        .withColumn("alt_source", F.when(F.col("ea").isNotNull(), "CORE").otherwise("SJR"))
        .withColumn("alt_title", F.coalesce("ea.title", "eb.title"))
        .withColumn("alt_rank", F.coalesce("ea.rank", "eb.rank"))
        .withColumn("alt_adopted", venues.adopted(F.col("alt_source"), F.col("alt_rank")))
        .withColumn("alt_similarity", similarity.ratio(F.col("norm"), F.col("key")))
        .where("alt_similarity >= 0.80")
    )
    ids = ["venue", "issn", "matched_venue", "source", "included"]
    turned = (
        rows.select(*ids, "norm").join(options, "norm")
        .where((F.col("alt_title") != F.col("matched_venue")) & (F.col("alt_adopted") != F.col("included")))
        .groupBy(*ids).agg(F.min_by(F.struct("alt_source", "alt_rank", "alt_title", "alt_similarity", "alt_adopted"), "n").alias("alt"))
    )
    side = F.when(F.col("alt.alt_adopted"), "採用側").otherwise("除外側")
    text = F.concat(F.col("alt.alt_title"), F.lit(" ["), F.col("alt.alt_source"), F.lit(" "), F.col("alt.alt_rank"),
                    F.lit("] sim="), F.format_number(F.col("alt.alt_similarity"), 2), F.lit(" ("), side, F.lit(")"))
    return rows.join(turned, ids, "left").withColumn(
        "priority",
        F.when(F.col("alt").isNotNull(), "P1").when(F.col("written_similarity") < 0.55, "P2").otherwise("P3"),
    ).withColumn("alternative", F.coalesce(F.when(F.col("alt").isNotNull(), text), F.lit(""))).drop("alt")


def priority_counts(judged: DataFrame) -> DataFrame:
    """(priority, venues, records): how many suspect matches of each priority, and how many records they hold."""
    return judged.groupBy("priority").agg(F.count("*").alias("venues"), F.sum("n").alias("records"))


def acronym_checklist(matches: DataFrame, acronyms: list[str] = fixed.ACRONYM_CHECKLIST) -> DataFrame:
    """(acronym, stage, venues, records): by which stages venues matched that name an acronym.

    An acronym is named in parentheses, as a word between blanks, or before a year of this century.
    One that no venue names has one row without a stage.
    """
    venue = F.col("venue")
    named = lambda x: (
        venue.contains(f"({x})") | F.concat(F.lit(" "), venue, F.lit(" ")).contains(f" {x} ") | F.upper(venue).contains(f"{x} 20"))
    hits = F.array_compact(F.array(*[F.when(named(x), F.lit(x)) for x in acronyms]))
    found = matches.select(F.explode(hits).alias("acronym"), "stage", "n").groupBy("acronym", "stage").agg(
        F.count("*").alias("venues"), F.sum("n").alias("records"))
    listed = matches.sparkSession.createDataFrame([(x,) for x in acronyms], "acronym string")
    return listed.join(found, "acronym", "left").na.fill({"venues": 0, "records": 0})


def keyspace(a_rows: DataFrame, b_rows: DataFrame) -> DataFrame:
    """(key, source, kind, title, rank, place): every key of both lists, collisions kept.

    List A comes before list B.
    """
    title = strip(F.col("title"))
    parts = []
    for place, rows, source, second in (
        (0, a_rows, "CORE", ("acronym", F.lower(strip(F.col("acronym"))) if "acronym" in a_rows.columns else None)),
        (1, b_rows, "SJR", ("lower_title", F.lower(title))),
    ):
        named = F.array(
            F.struct(F.lit("norm_title").alias("kind"), venues.normalize_venue(title).alias("key")),
            F.struct(F.lit(second[0]).alias("kind"), second[1].alias("key")),
        )
        if source == "CORE":
            named = F.filter(named, lambda k: (k["kind"] != "acronym") | (k["key"] != ""))
        parts.append(rows.where(title != "").select(
            F.explode(named).alias("k"), F.lit(source).alias("source"), title.alias("title"),
            strip(F.col("rank")).alias("rank"), F.struct(F.lit(place).alias("list"), F.col("ord")).alias("place"),
        ).select("k.key", "source", "k.kind", "title", "rank", "place"))
    return parts[0].unionByName(parts[1])


def collisions(space: DataFrame, records: DataFrame) -> DataFrame:
    """Keys shared by two or more different entries, and the records they affect.

    Per key: how many entries, which kinds of keys and ranks, whether the entries would
    decide differently, the entry that wins today, the number of affected records and
    their three most frequent venue names. The entries themselves are `keyspace` rows.
    """
    entry = space.groupBy("key", "source", "title").agg(
        F.min("place").alias("place"), F.max("place").alias("last_place"),
        F.min_by("rank", "place").alias("rank"), F.max_by("rank", "place").alias("last_rank"),
        F.collect_set("kind").alias("kinds"),
    )
    high = venues.adopted(F.col("source"), F.col("rank"))
    winner_order = F.struct((F.col("source") == "CORE").cast("int"), F.col("last_place"))
    shared = entry.groupBy("key").agg(
        F.count("*").alias("entries"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))), " | ").alias("key_kinds"),
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(" ", "source", "rank"))), " | ").alias("ranks"),
        (F.bool_or(high) & F.bool_or(~high)).alias("rank_conflict"),
        F.max_by(F.concat(F.lit("["), "source", F.lit(" "), "last_rank", F.lit("] "), "title"), winner_order).alias("current_target"),
    ).where("entries > 1")
    names = records.groupBy(strip(F.col("venue")).alias("venue")).agg(F.count("*").alias("n")).where("venue <> ''")
    acronym = venues.trailing_acronym(F.col("venue"))
    name_keys = F.array_distinct(F.filter(
        F.array(venues.normalize_venue(F.col("venue")), F.lower("venue"), F.lower(acronym),
                venues.normalize_venue(acronym)), lambda k: k != ""))
    used = names.select("venue", "n", F.explode(name_keys).alias("key")).join(
        shared.select("key"), "key", "left_semi")
    top = Window.partitionBy("key").orderBy(F.desc("n"), "venue")
    totals = used.groupBy("key").agg(F.sum("n").alias("affected"))
    examples = used.withColumn("p", F.row_number().over(top)).where("p <= 3").groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "venue", "n"))),
                                 lambda e: F.concat(e["venue"], F.lit(" (x"), e["n"].cast("string"), F.lit(")"))),
                     " | ").alias("examples"))
    return shared.join(totals, "key", "left").join(examples, "key", "left").na.fill({"affected": 0, "examples": ""})
