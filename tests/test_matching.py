"""Similarity joins and the venue cascade against brute force over small lists."""

import difflib
import random
import re

import pytest
from pyspark.sql import functions as F

from sievelake.operators import citations, ranking, simjoin, venue_match


def words(rng, n):
    pool = ["spatial", "haptic", "virtual", "reality", "display", "systems", "human", "factors", "graphics", "vision"]
    return " ".join(rng.choice(pool) for _ in range(n))


def typo(rng, s):
    s = list(s)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(s))
        s[i] = rng.choice(["", "x", s[i] * 2])
    return "".join(s)


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def names():
    rng = random.Random(11)
    right = sorted({words(rng, rng.randrange(1, 6)) for _ in range(60)} | {"vr", "a", "ieee vr"})
    left = sorted({typo(rng, rng.choice(right)) or "q" for _ in range(50)} | {"vrx", "a", "ieee vr 3d"})
    return left, right


@pytest.mark.parametrize("threshold,rule", [(0.82, True), (0.85, False), (0.7, False), (0.5, False)])
def test_ratio_pairs_are_complete(spark, names, threshold, rule):
    left, right = names
    want = {(a, b) for a in left for b in right if ratio(a, b) >= threshold
            and (not rule or abs(len(a) - len(b)) <= max(len(a), len(b)) * (1 - threshold))}
    l = spark.createDataFrame([(x,) for x in left], "a string")
    r = spark.createDataFrame([(x,) for x in right], "b string")
    rows = simjoin.ratio_pairs(l, r, threshold, rule).collect()
    assert len(rows) == len(want) and {(x.l, x.r) for x in rows} == want


def test_edit_pairs_are_complete(spark, names):
    left, right = names
    want = {(a, b) for a in left for b in right if distance(a, b) <= int(max(len(a), len(b)) * (1 - 0.9))}
    l = spark.createDataFrame([(x,) for x in left], "a string")
    r = spark.createDataFrame([(x,) for x in right], "b string")
    rows = simjoin.edit_pairs(l, r, 0.9).collect()
    assert len(rows) == len(want) and {(x.l, x.r) for x in rows} == want


def test_edit_pairs_of_long_strings_move_little_and_keep_to_their_stage(spark):
    """No n-gram of a long string is shuffled that no left string asks for (F1, F2, F4)."""
    rng = random.Random(7)
    right = ["".join(rng.choice("abcdefghij klmnop") for _ in range(rng.randrange(1500, 2500))) for _ in range(200)]
    left = [right[k][:300] + "xyz" + right[k][310:] for k in range(3)]
    l = spark.createDataFrame([(left[0], "b"), (left[1], "b"), (left[2], "a")], "s string, stage string")
    r = spark.createDataFrame([(x, "a" if k == 1 else "b") for k, x in enumerate(right)], "s string, stage string")

    def moved():
        store = spark.sparkContext._jsc.sc().statusStore()
        none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = store.stageList(None, False, False, none, None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = moved()
    rows = simjoin.edit_pairs(l, r, 0.9).collect()
    bytes_moved = sum(n for s, n in moved().items() if s not in before)
    assert {(x.l, x.r) for x in rows} == {(left[0], right[0])}
    assert bytes_moved < 4 * sum(map(len, right))


def test_edit_pairs_at_the_limit_in_each_stage_once(spark):
    """Edits at the limit at all lengths, in few letters; what stands in five stages is compared once (F3, F4, F5)."""
    rng, left, right = random.Random(3), set(), set()
    for n in [*range(1, 40), 60, 90, 91, 150]:
        a = "".join(rng.choice("abc ") for _ in range(n))
        b = list(a)
        for _ in range(n // 9):
            i, what = rng.randrange(len(b)), rng.choice(["x", "", "xx"])
            b[i] = b[i] + "x" if what == "xx" else what
        left.add(a)
        right |= {"".join(b) or "q", a[:-1] or "z", "a" * n}
    left, right, stages = sorted(left | {"a" * 50}), sorted(right), ["s1", "s2", "s3", "s4", None]
    want = {(a, b) for a in left for b in right if distance(a, b) <= int(max(len(a), len(b)) * (1 - 0.9))}
    assert sum(a != b for a, b in want) > 40
    l = spark.createDataFrame([(a, stages[k % 5]) for k, a in enumerate(left)], "a string, stage string")
    here = lambda k, n: n if k % 2 else 3
    r = spark.createDataFrame([(b, g) for k, b in enumerate(right) for g in stages[:here(k, 5)]], "b string, stage string")
    rows = simjoin.edit_pairs(l, r, 0.9).collect()
    stage_of, index = {a: k % 5 for k, a in enumerate(left)}, {b: k for k, b in enumerate(right)}
    want = {(a, b) for a, b in want if stage_of[a] < here(index[b], 5)}
    assert len(rows) == len(want) and {(x.l, x.r) for x in rows} == want

    def moved(n):
        store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages_ = lambda: [(s.stageId(), s.shuffleWriteBytes()) for s in (x.apply(i) for x in [store.stageList(None, False, False, none, None)] for i in range(x.size()))]
        known = {s for s, _ in stages_()}
        titles = spark.createDataFrame([("".join(rng.choice("abcdefgh ") for _ in range(900)),) for _ in range(150)], "b string")
        many = titles.withColumn("stage", F.explode(F.array(*[F.lit(f"s{k}") for k in range(n)])))
        simjoin.edit_pairs(spark.createDataFrame([(a, f"s{k}") for a in left for k in range(n)], "a string, stage string"), many, 0.9).count()
        return sum(size for s, size in stages_() if s not in known)

    assert moved(5) < 2 * moved(1)


def test_top_by_ratio(spark, names):
    left, right = names
    l = spark.createDataFrame([(x,) for x in left], "a string")
    r = spark.createDataFrame([(x,) for x in right], "b string")
    rows = simjoin.top_by_ratio(l, r, 0.6, 3, F.desc("r"), length_rule=False, swap=True).collect()
    got = {}
    for x in sorted(rows, key=lambda x: x.n):
        got.setdefault(x.l, []).append(x.r)
    assert got == {a: c for a in left if (c := difflib.get_close_matches(a, right, n=3, cutoff=0.6))}


LIST_A = [
    ("IEEE Conference on Virtual Reality and 3D User Interfaces", "VR", "A*"),
    ("International Symposium on Haptic Graphics Systems", "ISHGS", "A"),
    ("Annual International Workshop on Presence", "", "C"),
    ("ACM Symposium on Applied Perception", "SAP", "B"),
    ("Conference on Spatial Vision Display Systems", "", "A"),
    ("Workshop on Spatial Vision Display Systems", "SVDS", "C"),
]
LIST_B = [
    ("Sensors", "Q1", "14248220, 1424-3210"), ("Journal of Sensors", "Q2", "1687725X"),
    ("ACM Transactions on Applied Perception", "Q2", "15443558"), ("Presence", "Q3", "10547460"),
    ("Journal of Spatial Vision Display Systems", "Q1", ""),
]
VR, HAPTIC, SAP, SPATIAL = (LIST_A[i][0] for i in (0, 1, 3, 4))
#: What each name of a venue must come to, worked out by hand from the two lists: (name, numbers, title, rank, stage).
VENUES = [
    # A title of list B letter for letter; white space and case around it do not count.
    ("Presence", "", "Presence", "Q3", "sjr_exact_raw"),
    ("presence ", "", "Presence", "Q3", "sjr_exact_raw"),
    ("Journal of Sensors", "", "Journal of Sensors", "Q2", "sjr_exact_raw"),
    ("ACM Transactions on Applied Perception", "", "ACM Transactions on Applied Perception", "Q2", "sjr_exact_raw"),
    # "sensors" is the key of two titles, and too short to be trusted without its type.
    ("Sensors", "", None, None, "unmatched"),
    ("The Sensors", "", None, None, "unmatched"),
    ("", "", None, None, "unmatched"),
    # An acronym of list A as the whole name, and in parentheses after words that fit its title, or do not.
    ("vr", "", VR, "A*", "core_exact_raw"),
    ("2015 IEEE virtual reality (VR)", "", VR, "A*", "core_acronym"),
    ("Something else (VR)", "", None, None, "unmatched"),
    ("Haptic Graphics (SAP)", "bad issn", None, None, "unmatched"),
    # Equal after years, ordinals and words of venue names are taken off; of two entries the first holds.
    ("Proceedings of the 12th Symposium on Haptic Graphics Systems", "", HAPTIC, "A", "core_exact_typed"),
    ("ACM Symposium on Applied Perception 2019", "", SAP, "B", "core_exact_typed"),
    ("Spatial Vision Display Systems", "", SPATIAL, "A", "core_exact_typed"),
    ("International Conference on Spatial Vision Display Systems, Adjunct", "", SPATIAL, "A", "core_exact_typed"),
    # A serial number, with or without its hyphen.
    ("anything", "9999, 1687-725X", "Journal of Sensors", "Q2", "sjr_issn"),
    # A letter or two off; another order of words is further than that. The key's entry is the last with it.
    ("Haptic Graphics Systemz", "", HAPTIC, "A", "core_fuzzy"),
    ("Spatial Visions Displays Systems", "", LIST_A[5][0], "C", "core_fuzzy"),
    ("Journal of Spatial Vision Display System", "", LIST_A[5][0], "C", "core_fuzzy"),
    ("Applied Perception of ACM", "", None, None, "unmatched"),
]


@pytest.fixture(scope="module")
def resolved(spark):
    a = ranking.list_a(spark.createDataFrame([(i, *r) for i, r in enumerate(LIST_A)], "ord bigint, title string, acronym string, rank string"))
    b = ranking.list_b(spark.createDataFrame([(i, *r) for i, r in enumerate(LIST_B)], "ord bigint, title string, rank string, issn string"))
    asked = spark.createDataFrame([v[:2] for v in VENUES], "venue string, issn string")
    return {(r.venue, r.issn): r for r in venue_match.resolve_venues(asked, a, b).collect()}


@pytest.mark.parametrize("venue,issn,title,rank,stage", VENUES)
def test_cascade_by_hand(resolved, venue, issn, title, rank, stage):
    got = resolved[venue, issn]
    assert (got.matched_title, got["rank"], got.stage) == (title, rank, stage)


def test_reasons_of_refusal(resolved):
    """A match leaves no reason; a short key and a refused acronym, with its three figures, do."""
    assert all(r.rejected == "" for r in resolved.values() if r.stage != "unmatched")
    assert "sensors" in resolved["Sensors", ""].rejected and "sensors" in resolved["The Sensors", ""].rejected
    refused = resolved["Something else (VR)", ""].rejected
    assert refused.count("core_acronym") == 3 and "back_cont=0.00" in refused and VR in refused
    # "something else (vr)" and the title share few letters in order, and no word.
    similar = float(re.search(r"sim=([0-9.]+)/cont=0.00", refused).group(1))
    assert similar == pytest.approx(ratio("something else (vr)", VR.lower()), abs=0.005)
    assert resolved["", ""].rejected == resolved["Applied Perception of ACM", ""].rejected == ""


def test_fuzzy_key_is_near_in_length(resolved):
    """A fuzzy match never differs from its key by more than the rule for lengths allows."""
    for r in resolved.values():
        if r.stage == "core_fuzzy":
            assert ratio(r.venue.lower(), r.matched_title.lower()) >= 0.6


def test_fallback_moves_edges_once_to_all_partitions(spark):
    """A seed of the first provider, of the second, of both, of none, twice among the seeds, and null (F6)."""
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    seeds = spark.createDataFrame([(1,), (2,), (3,), (4,), (4,), (None,)], "seed long")
    primary = spark.createDataFrame([(1, "a"), (1, "a"), (3, "b"), (9, "x"), (None, "n")], "seed long, found string")
    secondary = spark.createDataFrame([(2, "c"), (3, "d"), (9, "y")], "seed long, found string")
    df = citations.with_fallback(seeds, primary, secondary)
    got = sorted(((r.seed, r.found, r.ref_source) for r in df.collect()), key=str)
    none = citations.UNAVAILABLE
    assert got == sorted([(1, "a", "S2"), (1, "a", "S2"), (2, "c", "Crossref"), (3, "b", "S2"), (4, None, none), (4, None, none), (None, None, none)], key=str)
    assert df.rdd.getNumPartitions() == 2 * wanted


def test_a_venue_is_asked_once_however_many_issns_it_has(spark):
    rows = [("Journal of Old Rings", f"{n:04d}-000X") for n in range(40)] * 3 + [(None, None), ("", "")]
    records = spark.createDataFrame(rows, "venue string, issn string")
    names = venue_match.counted_names(records)
    assert sorted((r.n for r in names.collect())) == [2] + [3] * 40
    assert venue_match._features(names).count() == 2
    b = {"issn": spark.createDataFrame([("0007000X", {"title": "Rings", "rank": "Q1"})], "key string, entry struct<title:string,rank:string>")}
    got = venue_match.issn_answers(names, b).collect()
    assert [(r.issn, r.by_issn.title, r.by_issn.rank) for r in got] == [("0007-000X", "Rings", "Q1")]


def test_a_report_counts_names_as_it_counts_records(spark):
    from sievelake.plans import match_queries

    columns = "venue string, issn string, matched_venue string, ranking_source string, core_rank string, sjr_quartile string, included boolean, n long"
    rows = spark.createDataFrame([(" Ring", "1", "Rings", "SJR", "", "Q1", True, 5), ("Ring", "2", "Rings", "SJR", "", "Q1", True, 2)], columns)
    assert [(r.venue, r.n, r.issn) for r in match_queries.matched_groups(rows).collect()] == [("Ring", 7, "2")]


def test_a_list_in_one_small_file_is_spread_before_its_titles_are_normalised(spark):
    rows = spark.range(2000).coalesce(1).selectExpr("id AS ord", "concat('Title ', id) AS title", "'' AS acronym", "'A' AS rank", "'' AS issn")
    for tables in (ranking.list_a(rows), ranking.list_b(rows)):
        assert "REPARTITION_BY_NUM" in tables["keys"]._jdf.queryExecution().executedPlan().toString()
