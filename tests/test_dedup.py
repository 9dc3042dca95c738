import random
import re

from pyspark.sql import functions as F

from sievelake.functions import text
from sievelake.operators import dedup
from sievelake.operators.skew import record_breaking, spread_join


def sequential(rows):
    """The rule as one reads it: a row is dropped when a kept row has one of its identifiers."""
    owner, out = {}, {}
    for r in sorted(rows):
        names = [("DOI", r[1].strip().lower()), ("Key", r[2].strip()), ("Title", r[3].strip().lower())]
        names = [n for n in names if n[1]]
        hit = next((n for n in names if n in owner), None)
        if hit:
            out[r[0]] = (False, hit[0], owner[hit])
        else:
            out[r[0]] = (True, None, None)
            owner.update({n: r[0] for n in names})
    return out


def random_rows(rng, n):
    pick = lambda kind, size: rng.choice(["", " ", *[f"{kind}{i}" for i in range(size)]])
    return [(i, pick("D", n // 2), pick("k", n // 3), pick("Title ", n // 2),
             "x" * rng.randrange(6), rng.choice(["", "s1", "s2"])) for i in range(n)]


COLUMNS = "ord bigint, doi string, key string, title string, abstract string, issn string"


def test_greedy_equals_sequential(spark):
    rng = random.Random(3)
    for n in (1, 12, 60):
        rows = random_rows(rng, n)
        got = {r.ord: (r.kept, r.reason, r.target) for r in dedup.greedy_dedup(spark.createDataFrame(rows, COLUMNS)).collect()}
        assert got == sequential(rows)


def test_merge_takes_longest_and_fills_gaps(spark):
    rng = random.Random(5)
    rows = random_rows(rng, 50)
    df = spark.createDataFrame(rows, COLUMNS)
    verdicts = dedup.greedy_dedup(df)
    truth = sequential(rows)
    kept = {r[0]: {"abstract": r[4], "doi": r[1], "issn": r[5]} for r in rows if truth[r[0]][0]}
    filled = {"abstract": 0, "doi": 0, "issn": 0}
    for r in rows:
        keep, _, target = truth[r[0]]
        if keep:
            continue
        for field, value in (("abstract", r[4].strip()), ("doi", r[1].strip()), ("issn", r[5].strip())):
            old = kept[target][field].strip()
            if value and (len(value) > len(old) if field == "abstract" else not old):
                kept[target][field] = value
                filled[field] += 1
    got = {r.ord: {"abstract": r.abstract, "doi": r.doi, "issn": r.issn} for r in dedup.merge_fields(df, verdicts).collect()}
    assert got == kept
    counts = {r.field: r.filled for r in dedup.merge_counts(df, verdicts, chunk=7).collect()}
    assert counts == filled


def test_merge_reads_only_records_that_give(spark):
    """Givers are found from lengths and blanks: no text is compared in an aggregate, a group is a row per field at most."""
    rows = spark.createDataFrame([(i, "d", "", "", "x" * (i % 7), "" if i < 5 else f"s{i}") for i in range(100)], COLUMNS)
    merged = dedup.merge_fields(rows, dedup.greedy_dedup(rows))
    assert [(r.ord, r.doi, r.abstract, r.issn) for r in merged.collect()] == [(0, "d", "x" * 6, "s5")]
    assert "max_by(" not in merged._jdf.queryExecution().optimizedPlan().toString()


def test_merge_counts_read_the_texts_once(spark):
    """Lengths and blanks are taken in one pass over the records; what counts them reads numbers only."""
    rows = spark.createDataFrame(random_rows(random.Random(6), 40), COLUMNS)
    counts = dedup.merge_counts(rows, dedup.greedy_dedup(rows))
    assert not re.search(r"\babstract#", counts._jdf.queryExecution().optimizedPlan().toString())


def test_identifiers_of_one_record_are_left_out(spark):
    ids = spark.createDataFrame([(4, 0, "a"), (2, 0, "a"), (2, 1, "a"), (3, 1, "b"), (9, 1, "b"), (5, 2, "c")], "ord bigint, kind int, value string")
    got = sorted(map(tuple, dedup.shared_identifiers(ids).select("ord", "kind", "value").collect()))
    assert got == [(2, 0, 2), (3, 1, 3), (4, 0, 2), (9, 1, 3)]


def test_strip_takes_what_the_pattern_takes(spark):
    """Every character of the first plane at both ends, by the pattern and by its list; strip runs no pattern over the text."""
    one = F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE")
    rows = spark.range(1, 65536).where("id < 55296 OR id > 57343").select(F.concat(one, F.lit("a b"), one, one).alias("c"))
    by_pattern = F.regexp_replace("c", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    assert rows.where(text.strip(F.col("c")) != by_pattern).isEmpty()
    assert rows.where(by_pattern == "a b").count() == len(text.SPACES) == len(set(text.SPACES))
    assert "regexp" not in rows.select(text.strip(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()


def test_record_breaking_over_chunks(spark):
    rng = random.Random(1)
    rows = [("a" if i % 3 else "b", i, rng.randrange(1000)) for i in range(300)]
    best, want = {}, {}
    for g, i, v in rows:
        want[i] = v > best.get(g, -1)
        best[g] = max(v, best.get(g, -1))
    got = record_breaking(spark.createDataFrame(rows, "g string, i bigint, v bigint"), "g", "i", "v", 11)
    assert {r.i: r.breaks for r in got.collect()} == want


def test_spread_join_equals_join_on_hot_keys(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else (None if i % 2 else f"k{i}")) for i in range(600)], "i bigint, k string")
    dim = spark.createDataFrame([("hot", 1), ("k6", 2), ("unused", 3)], "k string, v int")
    for how in ("left", "inner"):
        plain = sorted(map(str, facts.join(dim, ["k"], how).select("i", "k", "v").collect()))
        spread = sorted(map(str, spread_join(facts, dim, ["k"], how, "i", hot_rows=50).select("i", "k", "v").collect()))
        assert spread == plain


def test_a_long_chain_takes_few_rounds(spark):
    """Every record shares an identifier with the next only: 5,000 of them are settled in 16 steps."""
    chain = spark.range(5000).selectExpr("id AS ord", "concat('d', id div 2) AS doi", "concat('k', (id + 1) div 2) AS key", "'' AS title")
    rounds = []
    owners = dedup.identifier_owners(dedup.identifiers(chain), rounds)
    assert len(rounds) <= 20, rounds
    kept = sorted(r[0] for r in owners.select("owner").distinct().collect())
    truth = sequential([(i, f"d{i // 2}", f"k{(i + 1) // 2}", "") for i in range(5000)])
    assert kept == [i for i, (keep, *_) in sorted(truth.items()) if keep]
