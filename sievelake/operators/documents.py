"""Finding the record a document belongs to by its title or DOI."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions.identifiers import norm_doi, norm_title
from sievelake.operators.skew import spread_join
from sievelake.session import cut

TITLE_PHRASE, TITLE_WORDS, FIRST_PAGE_DOI = "タイトル一致", "タイトル語の一致", "1ページ目の DOI"
HOW = (TITLE_PHRASE, TITLE_WORDS, FIRST_PAGE_DOI)
NO_RECORD, SEVERAL = "該当なし", "候補が複数"
#: Title words are broadcast up to this number, and joined with salted keys beyond it.
SMALL_VOCABULARY = 100_000


def positions(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(doc_id, word, places): where the words of `vocabulary` stand in the documents.

    Hyphens at line ends are closed up. Places are gathered per document first, so that a
    frequent word is one row per document, and its rows are salted.
    """
    text = norm_title(F.regexp_replace("text", r"-\n(?=[a-z])", ""))
    tokens = documents.select("doc_id", F.posexplode(F.split(text, " ")).alias("place", "word")).where("word <> ''")
    small = vocabulary.limit(SMALL_VOCABULARY + 1).count() <= SMALL_VOCABULARY
    if small:  # other words go before anything is moved
        tokens = tokens.join(F.broadcast(vocabulary), "word", "left_semi")
    held = tokens.groupBy("doc_id", "word").agg(F.collect_list("place").alias("places"))
    if small:
        return held
    return spread_join(held, vocabulary, ["word"], "inner", "doc_id").select("doc_id", "word", "places")


def in_window(hits: DataFrame, pair: list[str]) -> DataFrame:
    """Adds up, per pair, the most different words that stand within `span` places: (pair, words).

    `hits` has (pair, word, places, span). A word at place x counts in the windows that end
    from x on until it leaves them or occurs again: it comes at x and goes at the earlier
    of x + span and its next place, so a running sum over these events counts every window.
    """
    at = hits.select(*pair, "word", "span", F.explode("places").alias("x"))
    following = Window.partitionBy(*pair, "word").orderBy("x")
    gone = at.withColumn("y", F.least(F.col("x") + F.col("span"), F.lead("x").over(following)))
    event = lambda place, by: F.struct(F.col(place).alias("place"), F.lit(by).alias("by"))
    events = gone.select(*pair, F.explode(F.array(event("x", 1), event("y", -1))).alias("e")).groupBy(*pair, "e.place").agg(
        F.sum("e.by").alias("by"))
    running = Window.partitionBy(*pair).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("words", F.sum("by").over(running)).groupBy(*pair).agg(F.max("words").alias("words"))


def record_candidates(documents: DataFrame, records: DataFrame, share: float = 0.9) -> DataFrame:
    """(doc_id, record_id, level): every record that fits a document, and by which rule.

    `documents` has (doc_id, text, first_page), `records` (record_id, title, doi). Level 1: a
    title of 20 characters occurs as a phrase; 2: one of five words has `share` of its words
    within a window of its length plus five; 3: the DOI stands on the first page.

    Both title rules need `share` of the distinct words, so a document must hold one of the
    title's rarest `n - ceil(share n) + 1`: only those words are joined. Everything else is
    read from the places of title words; no text is moved.
    """
    wanted = (
        records.select("record_id", norm_title(F.col("title")).alias("title"))
        .where("title <> ''")
        .withColumn("words", F.split("title", " "))
        .where((F.length("title") >= 20) | (F.size("words") >= 5))
        .select("record_id", F.length("title").alias("length"), F.size("words").alias("total"), "words")
    )
    title_words = wanted.select("record_id", "length", "total", F.posexplode("words").alias("k", "word")).groupBy(
        "record_id", "length", "total", "word").agg(F.collect_list("k").alias("ks"))
    title_words = cut(title_words)  # few and short, read in many places
    held = cut(positions(documents, title_words.select("word").distinct()))
    frequency = held.groupBy("word").agg(F.count("*").alias("freq"))
    ranked = title_words.join(frequency, "word", "left").groupBy("record_id").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "word"))).alias("ws"))
    n = F.size("ws")
    prefix = ranked.select(
        "record_id", F.explode(F.slice("ws", F.lit(1), (n - F.ceil(n * F.lit(share) - F.lit(1e-9)) + 1).cast("int"))).alias("w")
    ).select("record_id", "w.word")
    pairs = held.select("doc_id", "word").join(prefix, "word").select("doc_id", "record_id").distinct()
    pair = ["doc_id", "record_id"]
    hits = cut(pairs.join(title_words, "record_id").join(held, ["doc_id", "word"]))
    # Of the title's words, repeats counted, how many the document holds; of different ones, how many there are.
    counts = hits.groupBy(*pair, "length", "total").agg(F.sum(F.size("ks")).alias("held"))
    distinct = title_words.groupBy("record_id").agg(F.count("*").alias("different"))
    enough = cut(counts.where(F.col("held") / F.col("total") >= share).join(distinct, "record_id"))

    # A phrase: all words of the title at their places behind one start.
    whole = enough.where((F.col("length") >= 20) & (F.col("held") == F.col("total"))).select(*pair)
    starts = hits.join(whole, pair, "left_semi").select(*pair, "total", F.explode("ks").alias("k"), "places").select(
        *pair, "total", F.explode(F.transform("places", lambda x: x - F.col("k"))).alias("start"))
    phrases = starts.groupBy(*pair, "total", "start").agg(F.count("*").alias("n")).where("n = total").select(*pair).distinct()
    near = enough.where("total >= 5").select(*pair, "different", (F.col("total") + 5).alias("span"))
    close = in_window(hits.join(near.select(*pair, "span"), pair).select(*pair, "word", "places", "span"), pair)
    close = close.join(near, pair).where(F.col("words") / F.col("different") >= share).select(*pair)

    # A DOI inside the text is a prefix of some run that starts with "10.", as long as a wanted one.
    known = records.select("record_id", norm_doi(F.col("doi")).alias("doi")).where("doi <> ''")
    lengths = known.agg(F.collect_set(F.length("doi")).alias("n")).scalar()
    runs = documents.select("doc_id", F.explode(F.regexp_extract_all(
        F.lower("first_page"), F.lit(r"(?=(10\.\S+))"), 1)).alias("run"))
    heads = runs.withColumn("lengths", lengths).select("doc_id", F.explode(F.transform(
        F.filter("lengths", lambda n: n <= F.length("run")), lambda n: F.substring("run", F.lit(1), n))).alias("doi")).distinct()
    by_doi = heads.join(known, "doi").select(*pair, F.lit(3).alias("level"))
    found = phrases.withColumn("level", F.lit(1)).unionByName(close.withColumn("level", F.lit(2))).unionByName(by_doi)
    return found.groupBy(*pair).agg(F.min("level").alias("level"))


def titles_in_documents(documents: DataFrame, records: DataFrame, share: float = 0.9) -> DataFrame:
    """(doc_id, record_id, how, candidates) for all documents; the record if exactly one fits.

    The rules are those of `record_candidates`; a later one is asked if no record fits by the earlier.
    """
    best = record_candidates(documents, records, share).groupBy("doc_id", "level").agg(
        F.count("*").alias("n"), F.min("record_id").alias("record_id"))
    chosen = best.groupBy("doc_id").agg(F.min_by(F.struct("level", "n", "record_id"), "level").alias("b"))
    return documents.select("doc_id").join(chosen, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("b.n") == 1, F.col("b.record_id")).alias("record_id"),
        F.when(F.col("b").isNull(), NO_RECORD).when(F.col("b.n") > 1, SEVERAL)
        .otherwise(F.get(F.array(*[F.lit(h) for h in HOW]), F.col("b.level") - 1)).alias("how"),
        F.coalesce("b.n", F.lit(0)).cast("bigint").alias("candidates"),
    )


def claimed(candidates: DataFrame) -> DataFrame:
    """(doc_id, record_id, how, candidates) as if documents came one after the other, in `place` order.

    `candidates` has (doc_id, place, record_id, level), `place` unique per document and sortable.
    Every document sees only records that no earlier one took. A document is decided once it is
    the first undecided one for all records it could take; those it takes are closed for the
    others, so the rounds follow the longest chain of documents that wait for each other.
    Documents left without an open record are not in the result.
    """
    open_, decided = cut(candidates), None
    while not open_.isEmpty():
        first = open_.groupBy("record_id").agg(F.min("place").alias("first"))
        ready = open_.join(first, "record_id").groupBy("doc_id").agg(
            F.bool_and(F.col("place") == F.col("first")).alias("ready")).where("ready").select("doc_id")
        levels = open_.join(ready, "doc_id", "left_semi").groupBy("doc_id", "level").agg(
            F.count("*").alias("n"), F.min("record_id").alias("record_id"))
        taken = cut(levels.groupBy("doc_id").agg(F.min_by(F.struct("level", "n", "record_id"), "level").alias("b")))
        decided = taken if decided is None else decided.unionByName(taken)
        open_ = cut(open_.join(taken.select("doc_id"), "doc_id", "left_anti").join(
            taken.where("b.n = 1").select("b.record_id"), "record_id", "left_anti"))
    if decided is None:
        return candidates.select("doc_id", "record_id", F.lit("").alias("how"), F.lit(0).cast("bigint").alias("candidates"))
    alone = F.col("b.n") == 1
    return decided.select(
        "doc_id", F.when(alone, F.col("b.record_id")).alias("record_id"),
        F.when(alone, F.get(F.array(*[F.lit(h) for h in HOW]), F.col("b.level") - 1)).otherwise(SEVERAL).alias("how"),
        F.col("b.n").cast("bigint").alias("candidates"))
