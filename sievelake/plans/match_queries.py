"""Ranking lists, venue matching and its audits.

Parts are the ranking lists, order lines the records: each line names the venue of its
part in one of seven spellings.
"""

from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions import venues
from sievelake.operators import ranking, venue_match
from sievelake.operators.skew import spread_join
from sievelake.plans.registry import query
from sievelake.plans.text_queries import marker_sql, normalize_sql
from sievelake.session import cut

ON_LIST_A = ("ECONOMY", "SMALL", "PROMO")

LISTS_SQL = f"""named AS (
    SELECT *, p_name || ' ' || replace(p_brand, '#', ' ') AS topic,
      upper(substr(p_name, 1, 1)) || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || split_part(p_brand, '#', 2) AS acronym FROM part),
  list_a AS (SELECT p_partkey AS ord, 'International Conference on ' || topic || ' Systems' AS title, acronym,
      CASE WHEN p_size <= 10 THEN 'A*' WHEN p_size <= 20 THEN 'A' WHEN p_size <= 35 THEN 'B' ELSE 'C' END AS rank
    FROM named WHERE p_type IN {ON_LIST_A}),
  list_b AS (SELECT p_partkey AS ord, 'Journal of ' || topic || ' Research' AS title,
      CASE WHEN p_size <= 12 THEN 'Q1' WHEN p_size <= 25 THEN 'Q2' WHEN p_size <= 38 THEN 'Q3' ELSE 'Q4' END AS rank,
      substr(lpad(p_partkey::VARCHAR, 8, '0'), 1, 4) || '-' || substr(lpad(p_partkey::VARCHAR, 8, '0'), 5, 4) || ', ' ||
        lpad(p_size::VARCHAR, 7, '0') || 'X' AS issn
    FROM named WHERE p_type NOT IN {ON_LIST_A}),
  aliases AS (SELECT p_partkey AS ord, CASE WHEN p_size < 25 THEN ' ' || upper(p_name) ELSE 'The ' || p_name || ' of ' || p_type END AS raw,
      p_name || ' ' || p_brand AS canonical,
      CASE WHEN p_size < 5 THEN 'MANUAL' WHEN p_size < 9 THEN 'CORE' WHEN p_size < 15 THEN 'CORE  A*' WHEN p_size < 20 THEN 'SJR Q1'
        WHEN p_size < 25 THEN 'XYZ B' ELSE 'SJR Q3' END AS rank FROM part WHERE p_type = 'LARGE')"""


def _named(t):
    brand = F.col("p_brand")
    return t.part.withColumn("topic", F.concat_ws(" ", "p_name", F.replace(brand, F.lit("#"), F.lit(" ")))).withColumn(
        "acronym", F.concat(F.upper(F.substring("p_name", 1, 1)),
                            F.upper(F.substring(F.get(F.split("p_name", " "), F.lit(1)), 1, 1)),
                            F.get(F.split(brand, "#"), F.lit(1))))


def part_list_a(t):
    size = F.col("p_size")
    return _named(t).where(F.col("p_type").isin(*ON_LIST_A)).select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.lit("International Conference on "), "topic", F.lit(" Systems")).alias("title"), "acronym",
        F.when(size <= 10, "A*").when(size <= 20, "A").when(size <= 35, "B").otherwise("C").alias("rank"))


def part_list_b(t):
    size = F.col("p_size")
    number = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    return _named(t).where(~F.col("p_type").isin(*ON_LIST_A)).select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.lit("Journal of "), "topic", F.lit(" Research")).alias("title"),
        F.when(size <= 12, "Q1").when(size <= 25, "Q2").when(size <= 38, "Q3").otherwise("Q4").alias("rank"),
        F.concat(F.substring(number, 1, 4), F.lit("-"), F.substring(number, 5, 4), F.lit(", "),
                 F.lpad(size.cast("string"), 7, "0"), F.lit("X")).alias("issn"))


def part_aliases(t):
    size = F.col("p_size")
    return t.part.where("p_type = 'LARGE'").select(
        F.col("p_partkey").alias("ord"),
        F.when(size < 25, F.concat(F.lit(" "), F.upper("p_name")))
        .otherwise(F.concat(F.lit("The "), "p_name", F.lit(" of "), "p_type")).alias("raw"),
        F.concat_ws(" ", "p_name", "p_brand").alias("canonical"),
        F.when(size < 5, "MANUAL").when(size < 9, "CORE").when(size < 15, "CORE  A*").when(size < 20, "SJR Q1")
        .when(size < 25, "XYZ B").otherwise("SJR Q3").alias("rank"))


def line_venues(t):
    """(ord, venue, issn) of every order line."""
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", F.year("l_shipdate").cast("string").alias("year")).join(
        _named(t).select("p_partkey", "p_name", "p_type", "p_size", "topic", "acronym"), F.col("l_partkey") == F.col("p_partkey"))
    on_a = F.col("p_type").isin(*ON_LIST_A)
    title = F.when(on_a, F.concat(F.lit("International Conference on "), "topic", F.lit(" Systems"))).otherwise(
        F.concat(F.lit("Journal of "), "topic", F.lit(" Research")))
    line = F.col("l_linenumber")
    venue = (
        F.when(line == 1, F.concat(F.lit(" "), F.upper(title)))
        .when(line == 2, F.concat(F.lit("Proceedings of the "), "year", F.lit(" 12th "), title))
        .when(line == 3, F.concat("topic", F.lit(" Systems")))
        .when(line == 4, F.concat(F.lit("IEEE "), "topic", F.lit(" ("), "acronym", F.lit(")")))
        .when(line == 5, F.replace(F.concat("topic", F.lit(" System Conference")), F.lit("e"), F.lit("ee")))
        .when(line == 6, F.concat(F.lit("Unknown "), "p_name"))
        .otherwise(F.col("p_name"))
    )
    number = F.lpad(F.col("p_partkey").cast("string"), 8, "0")
    return rows.select(
        (F.col("l_orderkey") * 8 + line).alias("ord"), venue.alias("venue"),
        F.when(line == 6, F.concat(F.lit("9999-9999 "), number)).otherwise("").alias("issn"))


def lists(t):
    """Both lists' key tables, written once: every stage of the matching probes them."""
    a = {k: cut(v) for k, v in ranking.list_a(part_list_a(t)).items()}
    b = {k: cut(v) for k, v in ranking.list_b(part_list_b(t)).items()}
    return a, b


@query("ranking_list_a", f"""WITH {LISTS_SQL}, k AS (
    SELECT {normalize_sql('title')} AS key, title, rank, ord * 2 AS place FROM list_a
    UNION ALL SELECT lower(acronym), title, rank, ord * 2 + 1 FROM list_a)
  SELECT key, arg_max(title, place) AS title, arg_max(rank, place) AS rank, min(place) AS first_place FROM k GROUP BY key""")
def _(t):
    return ranking.list_a(part_list_a(t))["keys"].select("key", "entry.title", "entry.rank", "first_place")


@query("ranking_list_b", f"""WITH {LISTS_SQL}, k AS (
    SELECT 'title' AS kind, {normalize_sql('title')} AS key, title, rank, ord AS place FROM list_b
    UNION ALL SELECT 'title', lower(title), title, rank, ord FROM list_b
    UNION ALL SELECT 'issn', unnest(list_filter(string_split(replace(replace(issn, '-', ''), ',', ' '), ' '), lambda x: x <> '')), title, rank, ord FROM list_b)
  SELECT kind, key, arg_max(title, place) AS title, arg_max(rank, place) AS rank FROM k GROUP BY kind, key
  UNION ALL SELECT 'typed', m || ':' || n, arg_min(title, ord), arg_min(rank, ord) FROM (
    SELECT *, {normalize_sql('title')} AS n, CASE WHEN {marker_sql('title')} = '' THEN 'J' ELSE {marker_sql('title')} END AS m FROM list_b)
  GROUP BY 2""")
def _(t):
    b = ranking.list_b(part_list_b(t))
    rows = [b[k].select(F.lit(n).alias("kind"), "key", "entry.title", "entry.rank")
            for n, k in (("title", "keys"), ("issn", "issn"), ("typed", "typed"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


ALIAS_SQL = f"""{LISTS_SQL}, parsed AS (
    SELECT ord, trim(raw) AS raw, canonical, split_part(rank, ' ', 1) AS src, trim(substr(rank, position(' ' IN rank))) AS r,
      {normalize_sql('raw')} AS norm FROM aliases
    WHERE position(' ' IN rank) > 0 AND split_part(rank, ' ', 1) IN ('CORE', 'SJR')),
  exact AS (SELECT lower(raw) AS key, arg_max(canonical, ord) AS canonical, arg_max(src, ord) AS src, arg_max(r, ord) AS r
    FROM parsed GROUP BY 1),
  kept AS (SELECT norm, arg_min(canonical, ord) AS canonical, count(DISTINCT canonical) AS names FROM parsed GROUP BY norm),
  by_norm AS (SELECT p.norm AS key, k.canonical, arg_max(src, ord) AS src, arg_max(r, ord) AS r, any_value(k.names) AS names
    FROM parsed p JOIN kept k ON p.norm = k.norm AND p.canonical = k.canonical GROUP BY 1, 2)"""


@query("alias_tables", f"""WITH {ALIAS_SQL}
  SELECT 'exact' AS kind, key, canonical, src AS source, r AS rank FROM exact UNION ALL
  SELECT 'norm', key, canonical, src, r FROM by_norm""")
def _(t):
    tables = ranking.alias_lists(part_aliases(t))
    pick = lambda k: tables[k].select(F.lit(k).alias("kind"), "key", "entry.canonical", "entry.source", "entry.rank")
    return pick("exact").unionByName(pick("norm"))


@query("alias_conflicts", f"WITH {ALIAS_SQL} SELECT key, canonical AS kept, names FROM by_norm WHERE names > 1")
def _(t):
    return ranking.alias_lists(part_aliases(t))["conflicts"]


@query("alias_lookup", f"""WITH {ALIAS_SQL}, asked AS (
    SELECT p_partkey, CASE WHEN p_size < 25 THEN p_name ELSE 'Proceedings of ' || p_name || ' ' || p_type END AS venue FROM part)
  SELECT p_partkey, coalesce(e.canonical, n.canonical) AS canonical, coalesce(e.src || ' ' || e.r, n.src || ' ' || n.r) AS rank
  FROM asked LEFT JOIN exact e ON lower(trim(venue)) = e.key LEFT JOIN by_norm n ON {normalize_sql('venue')} = n.key""")
def _(t):
    asked = t.part.select("p_partkey", F.when(F.col("p_size") < 25, F.col("p_name")).otherwise(
        F.concat(F.lit("Proceedings of "), "p_name", F.lit(" "), "p_type")).alias("venue"))
    tables = ranking.alias_lists(part_aliases(t))
    return ranking.alias_lookup(asked, tables).select(
        "p_partkey", "alias.canonical",
        F.when(F.col("alias").isNotNull(), F.concat_ws(" ", "alias.source", "alias.rank")).alias("rank"))


@query("issn_lookup", f"""WITH {LISTS_SQL}, numbers AS (
    SELECT key, arg_max(title, ord) AS title, arg_max(rank, ord) AS rank FROM (
      SELECT unnest(list_filter(string_split(replace(replace(issn, '-', ''), ',', ' '), ' '), lambda x: x <> '')) AS key, title, rank, ord FROM list_b)
    GROUP BY key),
  asked AS (SELECT o_orderkey, list_filter(string_split('9999-9999, ' || lpad((o_custkey % 60)::VARCHAR, 7, '0') || 'X ' ||
      lpad(o_custkey::VARCHAR, 8, '0'), ' '), lambda x: x <> '') AS parts FROM orders),
  listed AS (SELECT o_orderkey, unnest(list_transform(parts, lambda x: replace(replace(x, '-', ''), ',', ''))) AS key, unnest(range(len(parts))) AS pos FROM asked)
  SELECT o_orderkey, arg_min(title, pos) AS title, arg_min(rank, pos) AS rank FROM listed JOIN numbers USING (key) GROUP BY o_orderkey""")
def _(t):
    cell = F.concat(F.lit("9999-9999, "), F.lpad((F.col("o_custkey") % 60).cast("string"), 7, "0"), F.lit("X "),
                    F.lpad(F.col("o_custkey").cast("string"), 8, "0"))
    asked = t.orders.select("o_orderkey", F.posexplode(ranking.issn_list(cell)).alias("pos", "key"))
    numbers = ranking.list_b(part_list_b(t))["issn"]
    return spread_join(asked, numbers, ["key"], "inner", "o_orderkey").groupBy("o_orderkey").agg(
        F.min_by("entry", "pos").alias("e")).select("o_orderkey", "e.title", "e.rank")


@query("rank_notes", f"""WITH {LISTS_SQL}, ka AS (
    SELECT key, arg_max(rank, place) AS rank FROM (SELECT {normalize_sql('title')} AS key, rank, ord * 2 AS place FROM list_a
      UNION ALL SELECT lower(acronym), rank, ord * 2 + 1 FROM list_a) GROUP BY key),
  kb AS (SELECT key, arg_max(rank, ord) AS rank FROM (SELECT {normalize_sql('title')} AS key, rank, ord FROM list_b
      UNION ALL SELECT lower(title), rank, ord FROM list_b) GROUP BY key),
  asked AS (SELECT ps.l_orderkey, ps.l_linenumber, CASE l_returnflag WHEN 'A' THEN 'The ' || topic || ' systems'
      WHEN 'R' THEN topic || ' Research, 2001' ELSE CASE l_linestatus WHEN 'F' THEN '' ELSE 'Some ' || p_name END END AS venue
    FROM lineitem ps JOIN named ON l_partkey = p_partkey)
  SELECT l_orderkey, l_linenumber, CASE WHEN venue = '' THEN '' WHEN ka.rank IS NOT NULL THEN 'CORE ' || ka.rank
    WHEN kb.rank IS NOT NULL THEN 'SJR ' || kb.rank ELSE '未照合' END AS note
  FROM asked LEFT JOIN ka ON ka.key = {normalize_sql('venue')} LEFT JOIN kb ON kb.key = {normalize_sql('venue')}""")
def _(t):
    flag = F.col("l_returnflag")
    venue = (
        F.when(flag == "A", F.concat(F.lit("The "), "topic", F.lit(" systems")))
        .when(flag == "R", F.concat("topic", F.lit(" Research, 2001")))
        .otherwise(F.when(F.col("l_linestatus") == "F", "").otherwise(F.concat(F.lit("Some "), "p_name")))
    )
    lines = t.lineitem.join(_named(t), F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "l_linenumber", venue.alias("venue"))
    notes = ranking.rank_note(lines.select("venue").distinct(), ranking.list_a(part_list_a(t)), ranking.list_b(part_list_b(t)))
    return spread_join(lines, notes, ["venue"], "inner", "l_orderkey").select(
        "l_orderkey", "l_linenumber", F.col("venue_rank_note").alias("note"))


# --- the cascade (its string ratio has no SQL counterpart; tests compare with brute force) --------

@query("venue_resolution")
def _(t):
    a, b = lists(t)
    return venue_match.resolve_venues(line_venues(t).select("venue", "issn"), a, b)


def list_tables(t):
    a, b = lists(t)
    return a, b, {k: cut(v) for k, v in ranking.alias_lists(part_aliases(t)).items()}


def ranked_names(t):
    """The lines' distinct names with their number of lines `n` and their ranking columns, for reports, and both lists."""
    a, b, aliases = list_tables(t)
    names = cut(venue_match.counted_names(line_venues(t)))
    ranked = names.join(venue_match.rank_names(names, a, b, aliases), ["venue", "issn"])
    return cut(ranked), a, b


@query("venue_ranking")
def _(t):
    return venue_match.rank_records(line_venues(t), *list_tables(t))


@query("venue_stage_counts")
def _(t):
    """Match stages of the records, and how often a stage other than an exact one decided."""
    rows, _, _ = ranked_names(t)
    return rows.groupBy("ranking_source", "match_stage", "included").agg(
        F.sum("n").alias("records"), F.sum(F.when(F.col("match_guard_note") != "", F.col("n")).otherwise(0)).alias("guard_notes"))


@query("rank_distribution")
def _(t):
    """Records per rank in rank order, and per reason of exclusion."""
    rows, _, _ = ranked_names(t)
    order = {r: i for i, r in enumerate(fixed.RANK_ORDER + fixed.QUARTILE_ORDER)}
    places = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    rank = F.concat("core_rank", "sjr_quartile")
    return rows.where(rank != "").groupBy("ranking_source", rank.alias("rank")).agg(
        F.sum("n").alias("records"), F.sum(F.when(F.col("included"), F.col("n")).otherwise(0)).alias("included")
    ).withColumn("place", F.coalesce(places[F.col("rank")], F.lit(99)))


@query("quartile_losses")
def _(t):
    """Venues lost to the first-quartile rule, with the number of records."""
    rows, _, _ = ranked_names(t)
    return rows.where((F.col("sjr_quartile") != "") & ~F.col("included")).groupBy(
        "matched_venue", "sjr_quartile").agg(F.sum("n").alias("record_count"))


@query("fuzzy_venue_best")
def _(t):
    """Nearest list-A key for every normalised part topic, at both thresholds in use."""
    a = cut(ranking.list_a(part_list_a(t))["keys"])
    norm = venues.normalize_venue(F.concat("topic", F.lit(" sytem")))
    names = cut(_named(t).select(norm.alias("norm")).distinct())
    late = venue_match.fuzzy_best(names, a).withColumn("rule", F.lit("pruned 0.82"))
    early = venue_match.fuzzy_best(names, a, fixed.FUZZY_VENUE_EARLY, length_rule=False).withColumn("rule", F.lit("unpruned 0.85"))
    return late.unionByName(early).withColumn("score", F.round("score", 6))


@query("unmatched_nearest")
def _(t):
    """The fifty most frequent unmatched venues with their nearest ranked entries."""
    rows, a, b = ranked_names(t)
    return venue_match.unmatched_report(rows.where("match_stage = 'unmatched'").select("venue", "n"), a, b).drop("norm")


def matched_groups(rows):
    return rows.where("matched_venue <> ''").groupBy(
        F.trim("venue").alias("venue"), "matched_venue",
        F.regexp_replace("ranking_source", r"\(alias\)", "").alias("source"),
        F.concat("core_rank", "sjr_quartile").alias("rank"), "included",
    ).agg(F.sum("n").alias("n"), F.max("issn").alias("issn"))


@query("match_stage_audit")
def _(t):
    """Stage by which each matched venue would match today, and which matches look suspect."""
    rows, a, b = ranked_names(t)
    audit = venue_match.classify_matches(matched_groups(rows), a, b)
    return audit.groupBy("source", "stage", "included", "suspect").agg(
        F.count("*").alias("venues"), F.sum("n").alias("records"))


@query("suspect_priorities")
def _(t):
    rows, a, b = ranked_names(t)
    audit = venue_match.classify_matches(matched_groups(rows), a, b)
    return venue_match.suspect_priorities(audit.where("suspect"), a, b).select(
        "venue", "matched_venue", "source", "rank", "included", "n", "stage", "priority", "alternative")


@query("suspect_priority_counts")
def _(t):
    """Suspect matches and their records per priority."""
    rows, a, b = ranked_names(t)
    audit = venue_match.classify_matches(matched_groups(rows), a, b)
    return venue_match.priority_counts(venue_match.suspect_priorities(audit.where("suspect"), a, b))


CHECKED_ACRONYMS = ["AL", "BR", "GR", "ZZ"]


@query("acronym_checklist", f"""WITH {LISTS_SQL}, v AS (
    SELECT CASE WHEN p_size < 20 THEN 'Meeting (' || upper(substr(p_name, 1, 2)) || ')' WHEN p_size < 35 THEN upper(substr(p_name, 1, 2)) || ' 2019'
      ELSE 'The ' || upper(substr(p_name, 1, 2)) || ' of ' || p_type END AS venue, CASE WHEN p_type IN {ON_LIST_A} THEN 'acronym' ELSE 'fuzzy' END AS stage FROM part),
  g AS (SELECT venue, stage, count(*) AS n FROM v GROUP BY ALL), x AS (SELECT unnest({CHECKED_ACRONYMS}) AS acronym)
  SELECT acronym, stage, count(venue) AS venues, coalesce(sum(n), 0)::BIGINT AS records
  FROM x LEFT JOIN g ON contains(venue, '(' || acronym || ')') OR contains(' ' || venue || ' ', ' ' || acronym || ' ') OR contains(upper(venue), acronym || ' 20')
  GROUP BY ALL""")
def _(t):
    """By which stages venues matched that name an acronym of a list; parts stand for matched venues."""
    two, size = F.upper(F.substring("p_name", 1, 2)), F.col("p_size")
    venue = F.when(size < 20, F.concat(F.lit("Meeting ("), two, F.lit(")"))).when(size < 35, F.concat(two, F.lit(" 2019"))).otherwise(
        F.concat(F.lit("The "), two, F.lit(" of "), "p_type"))
    stage = F.when(F.col("p_type").isin(*ON_LIST_A), "acronym").otherwise("fuzzy")
    matches = t.part.groupBy(venue.alias("venue"), stage.alias("stage")).agg(F.count("*").alias("n"))
    return venue_match.acronym_checklist(matches, CHECKED_ACRONYMS)


@query("key_collisions", f"""WITH {LISTS_SQL}, space AS (
    SELECT {normalize_sql('title')} AS key, 'CORE' AS source, 'norm_title' AS kind, title, rank, 0 AS l, ord FROM list_a
    UNION ALL SELECT lower(acronym), 'CORE', 'acronym', title, rank, 0, ord FROM list_a
    UNION ALL SELECT {normalize_sql('title')}, 'SJR', 'norm_title', title, rank, 1, ord FROM list_b
    UNION ALL SELECT lower(title), 'SJR', 'lower_title', title, rank, 1, ord FROM list_b),
  entry AS (SELECT key, source, title, l, max(ord) AS last, arg_min(rank, ord) AS rank, arg_max(rank, ord) AS last_rank FROM space GROUP BY ALL),
  kinds AS (SELECT key, string_agg(DISTINCT kind, ' | ' ORDER BY kind) AS key_kinds FROM space GROUP BY key),
  shared AS (
    SELECT key, count(*) AS entries, string_agg(DISTINCT source || ' ' || rank, ' | ' ORDER BY source || ' ' || rank) AS ranks,
      bool_or(rank IN ('A*', 'A', 'Q1')) AND bool_or(rank NOT IN ('A*', 'A', 'Q1')) AS rank_conflict,
      arg_max('[' || source || ' ' || last_rank || '] ' || title, (1 - l) * 1000000000000 + last) AS current_target
    FROM entry GROUP BY key HAVING count(*) > 1),
  names AS (SELECT trim(CASE WHEN p_size < 20 THEN topic || ' Systems' WHEN p_size < 40 THEN acronym ELSE 'Meeting (' || acronym || ')' END) AS venue, count(*) AS n
    FROM lineitem JOIN named ON l_partkey = p_partkey GROUP BY 1),
  used AS (SELECT DISTINCT venue, n, key FROM (
      SELECT venue, n, {normalize_sql('venue')} AS key FROM names UNION ALL SELECT venue, n, lower(venue) FROM names
      UNION ALL SELECT venue, n, lower(regexp_extract(venue, '\\(([^)]+)\\)$', 1)) FROM names) WHERE key <> ''),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, venue) AS p FROM used),
  totals AS (SELECT key, sum(n)::BIGINT AS affected, string_agg(venue || ' (x' || n || ')', ' | ' ORDER BY p) FILTER (WHERE p <= 3) AS examples
    FROM ranked GROUP BY key)
  SELECT s.*, k.key_kinds, coalesce(affected, 0)::BIGINT AS affected, coalesce(examples, '') AS examples
  FROM shared s JOIN kinds k USING (key) LEFT JOIN totals t USING (key)""")
def _(t):
    size = F.col("p_size")
    venue = (
        F.when(size < 20, F.concat("topic", F.lit(" Systems"))).when(size < 40, F.col("acronym"))
        .otherwise(F.concat(F.lit("Meeting ("), "acronym", F.lit(")")))
    )
    lines = t.lineitem.join(_named(t), F.col("l_partkey") == F.col("p_partkey")).select(venue.alias("venue"))
    return venue_match.collisions(venue_match.keyspace(part_list_a(t), part_list_b(t)), lines)
