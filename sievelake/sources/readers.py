"""Reading exports: CSV, ranking lists, BibTeX, RIS, JSON pages, paged text, progress files."""

from __future__ import annotations

import csv
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.functions import fixed_values as fixed
from sievelake.functions import identifiers as ids
from sievelake.functions.text import first_filled, strip
from sievelake.session import cut


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Quoted, multi-line CSV as strings, with blanks for missing values.

    A byte-order mark at the start of the header is dropped.
    """
    rows = (
        spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
        .option("sep", sep).option("encoding", "UTF-8").option("inferSchema", False).csv(path)
    )
    return rows.toDF(*[c.lstrip("\ufeff") for c in rows.columns]).na.fill("")


def _line_states(lines: DataFrame, sep: str) -> DataFrame:
    """Adds `_o` and `_i`: whether a line of CSV ends inside a quoted field when it begins outside one, and when it begins inside one.

    A quote opens a field only where one begins; elsewhere in a plain field it is a character. Inside, two are one character.
    Lines without quotes, and those of quoted fields without quotes inside, are told by plain tests; only others are followed.
    """
    start, middle, inside, closed = range(4)
    empty, ended, other = range(3)  # kinds of pieces between quotes: nothing, one that ends with the separator, another one
    at_quote = {start: inside, middle: middle, inside: closed, closed: inside}

    def moved(state: int, kind: int) -> int:
        state = at_quote[state]
        return state if state == inside or kind == empty else start if kind == ended else middle

    value, pieces = F.col("value"), F.col("_pieces")
    plain = ~F.contains(value, F.lit('"'))
    between = F.replace(F.substr(value, F.lit(2), F.length(value) - 2), F.lit(f'"{sep}"'), F.lit(""))
    quoted = (F.length(value) > 1) & value.startswith('"') & value.endswith('"') & ~F.contains(between, F.lit('"'))
    # Begun inside, the first filled field that does not end with the separator brings such a line back into step.
    in_step = value.rlike(f'[^"{re.escape(sep)}]"')
    # Both begins are followed at once: a state is 4 times the one and the other.
    moves = F.array(*[F.lit(4 * moved(a, kind) + moved(b, kind)) for a in range(4) for b in range(4) for kind in range(3)])
    kind = lambda piece: F.when(piece == "", empty).when(F.endswith(piece, F.lit(sep)), ended).otherwise(other)
    first = F.when(kind(F.get(pieces, F.lit(0))) == other, 4 * middle + inside).otherwise(4 * start + inside)
    final = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), first, lambda state, piece: F.get(moves, state * 3 + kind(piece)))
    simple = F.when(plain, "plain").when(quoted if len(sep) == 1 else F.lit(False), "quoted").otherwise("")
    rows = lines.withColumn("_simple", simple).withColumn("_pieces", F.when(F.col("_simple") == "", F.split("value", '"', -1)))
    rows = rows.withColumn("_final", F.when(F.col("_simple") == "", final))
    return rows.withColumns({
        "_o": (F.col("_simple") == "") & (F.floor(F.col("_final") / 4) == inside),
        "_i": F.when(F.col("_simple") == "plain", True).when(F.col("_simple") == "quoted", ~in_step).otherwise(F.col("_final") % 4 == inside),
    }).drop("_simple", "_pieces", "_final")


def csv_records(spark: SparkSession, paths: list[str] | str, sep: str = ",", chunk: int = 10_000) -> DataFrame:
    """(path, record, text) of quoted CSV files: every record with its place, 0 for the header, read in blocks of lines.

    Whether a line begins inside a quoted field follows from the lines before it: each line maps the state at
    its begin to that at its end. These maps are put together per chunk of lines, then over the chunks of a file.
    In a chunk that begins outside fields and whose every line is a whole record, a record's number is the line's, and no line
    is moved; lines of the other chunks are put in order and together.
    A line ends with \\n or \\r\\n, which a field gets as \\n. Blank lines between records are none.
    """
    lines = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    rows = _line_states(lines, sep)
    # Both states lead to the same one (given), or each stays as it is (0 turns), or to the other (1 turn).
    rows = rows.withColumns({"_given": F.when(F.col("_o") == F.col("_i"), F.col("_o").cast("int")),
                             "_turns": (F.col("_o") & ~F.col("_i")).cast("int"), "_whole": ~F.col("_o") & (F.col("value") != "")}).drop("_o", "_i")
    # Read several times below; taking lines apart is the costly part.
    rows = cut(rows).withColumn("_c", F.floor(F.col("n") / chunk))
    key = ["file", "part", "_c"]
    place = F.struct("part", "_c")

    def scanned(df: DataFrame, groups: list[str], order: Column) -> DataFrame:
        """Adds `_own` (the state before the row, null if no row of the group before it gives one) and `_odd` (turns before it)."""
        w = Window.partitionBy(*groups).orderBy(order)
        upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_odd", F.coalesce(F.sum("_turns").over(before), F.lit(0)))
        # Turns are counted from the begin of the group: a given state is put as the one that would have to hold there.
        df = df.withColumn("_key", F.when(F.col("_given").isNotNull(), F.pmod(F.col("_given") + F.sum("_turns").over(upto), F.lit(2))))
        return df.withColumn("_own", F.pmod(F.last("_key", True).over(before) + F.col("_odd"), F.lit(2)))

    chunks = cut(rows.groupBy(*key).agg(
        F.min("n").alias("_first"), F.count("*").alias("_lines"), F.bool_and("_whole").alias("_even"), F.min("_given").alias("_ends")))
    uneven = rows.select(*key, "n", "_given", "_turns").join(chunks.where("NOT _even").select(*key), key)
    totals = scanned(uneven, key, F.col("n")).groupBy(*key).agg(
        F.max_by("_key", F.when(F.col("_key").isNotNull(), F.col("n"))).alias("_last"), F.sum("_turns").alias("_all"))
    totals = totals.select(*key, F.pmod(F.col("_last") + F.col("_all"), F.lit(2)).cast("int").alias("_given"), F.pmod("_all", F.lit(2)).cast("int").alias("_turns"))
    # Lines that are whole records begun outside lead there from both states or leave both as they are.
    totals = totals.unionByName(chunks.where("_even").select(*key, F.col("_ends").alias("_given"), F.lit(0).alias("_turns")))
    entry = scanned(totals, ["file"], place).select(*key, F.coalesce("_own", F.pmod("_odd", F.lit(2))).alias("_entry"))
    entry = cut(chunks.join(entry, key).withColumn("_even", F.col("_even") & (F.col("_entry") == 0)))

    inner = scanned(rows.join(entry.where("NOT _even").select(*key, "_entry"), key), key, F.col("n"))
    known = inner.withColumn("open", F.coalesce("_own", F.pmod(F.col("_entry") + F.col("_odd"), F.lit(2))) == 1)
    known = cut(known.where("open OR value <> ''").select(*key, "n", "value", "open"))
    begun = known.groupBy(*key).agg(F.count_if(~F.col("open")).alias("_records"))
    counts = entry.join(begun, key, "left").withColumn("_records", F.when(F.col("_even"), F.col("_lines")).otherwise(F.coalesce("_records", F.lit(0))))
    before = Window.partitionBy("file").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select(*key, "_even", "_first", F.coalesce(F.sum("_records").over(before), F.lit(0)).alias("_carried"),
                               F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))).alias("path")))

    alone = rows.select(*key, "n", "value").join(starts.where("_even"), key).select(
        "path", (F.col("_carried") + F.col("n") - F.col("_first")).alias("record"), F.col("value").alias("text"))
    upto = Window.partitionBy(*key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    numbered = known.withColumn("_seen", F.sum((~F.col("open")).cast("long")).over(upto)).join(starts.where("NOT _even"), key)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "n", "value"))), lambda x: x["value"]), "\n")
    together = cut(numbered.groupBy("path", (F.col("_carried") + F.col("_seen") - 1).alias("record")).agg(text.alias("text")))
    return alone.unionByName(together)


def _parsed(records: DataFrame, header: str, sep: str) -> DataFrame:
    """Records of files with this header: its columns as strings, blanks for what is missing, with `ord` and their file in `_file`."""
    names = next(csv.reader([header], delimiter=sep))
    fields = ", ".join(f"_{i} string" for i in range(len(names)))
    row = F.from_csv("text", fields, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"})
    parsed = records.select(F.struct("label", "file_no").alias("_file"), "ord", row.alias("row"))
    return parsed.select("_file", "ord", *[F.coalesce(f"row._{i}", F.lit("")).alias(name) for i, name in enumerate(names)])


def source_of_file(name: Column) -> Column:
    """Source label of a file name by its prefix, else the name without its ending."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]+)\z", 1), r"\.[^.]*\z", "")
    label = F.lit(None).cast("string")
    for prefix, value in reversed(fixed.SOURCE_PREFIXES):
        label = F.when(F.lower(stem).startswith(prefix), value).otherwise(label)
    return F.coalesce(label, stem)


def _absolute(path: str) -> str:
    """A path without the scheme and host of its file system."""
    bare = re.sub(r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)", "", path)
    return bare.rstrip("/") if bare.startswith("/") else os.path.abspath(bare)


def concat_exports(spark: SparkSession, paths: list[str], skip: list[str] = fixed.SKIPPED_SOURCES,
                   column: str = "Source_DB") -> DataFrame:
    """All exports (files, or folders of files) in name order as one table with the union of their columns.

    Adds the source, `file_no` and `ord`: rows count from the file's number, which orders
    the files, and then by their place in it. Input that has the source column already
    is refused. All files are read at once, in blocks; then there is one plan for each different header.
    """
    if not paths:
        raise ValueError("no files")
    given = sorted(paths)
    # Names of the given exports only, no rows of theirs; what follows from a name is worked out once for it.
    numbers = spark.createDataFrame([(n, _absolute(p), p) for n, p in enumerate(given)], "file_no long, at string, export string")
    numbers = numbers.withColumn("label", source_of_file(F.col("export")))
    records = csv_records(spark, given)
    sizes = records.groupBy("path").agg(F.max("record").alias("rows"))
    heads = records.where("record = 0").select("path", F.col("text").alias("header"))
    bare = F.regexp_replace("path", r"\A[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?(?=/)", "")
    at = F.explode(F.array("bare", F.regexp_replace("bare", r"/[^/]*\z", "")))
    files = sizes.join(heads, "path").withColumn("bare", bare).withColumn("at", at).join(F.broadcast(numbers), "at")
    before = Window.partitionBy("file_no").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.shiftleft("file_no", 40) + F.coalesce(F.sum("rows").over(before), F.lit(0))
    files = cut(files.select("path", "file_no", "export", "label", "header", offset.alias("offset")))
    # Different headers, not files: exports of one source share theirs.
    headers = files.groupBy("header").agg(F.min("file_no").alias("first"), F.min("export").alias("export")).orderBy("first").collect()
    wanted = files.where(~F.col("label").isin(*skip) if skip else F.lit(True))
    merged = None
    for h in headers:
        own = wanted.where(F.col("header") == h["header"]).select("path", "file_no", "label", "offset")
        rows = records.where("record > 0").join(own, "path").withColumn("ord", F.col("offset") + F.col("record"))
        rows = _parsed(rows, h["header"].lstrip("\ufeff"), ",")
        if column in rows.columns:
            raise ValueError(f"{h['export']} already has a column {column}")
        rows = rows.withColumn(column, F.col("_file.label")).withColumn("file_no", F.col("_file.file_no")).drop("_file")
        merged = rows if merged is None else merged.unionByName(rows, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no headers")
    return merged.na.fill("")


def resolve_columns(rows: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """Renames the first accepted column present to its canonical name; absent ones are blank."""
    names = []
    for canonical, accepted in wanted.items():
        present = [c for c in accepted if c in rows.columns]
        names.append((F.col(f"`{present[0]}`") if present else F.lit("")).alias(canonical))
    return rows.select(*names, *[c for c in rows.columns if c == "ord"])


RECORD_COLUMNS = {
    "title": fixed.TITLE_COLUMNS, "abstract": fixed.ABSTRACT_COLUMNS, "venue": fixed.VENUE_COLUMNS,
    "doi": fixed.DOI_COLUMNS, "key": fixed.KEY_COLUMNS, "issn": fixed.ISSN_COLUMNS,
}


def gold_rows(rows: DataFrame) -> DataFrame:
    """Gold-set rows under canonical names: per row the first non-blank accepted column; a DOI
    inside a URL is taken out of it."""
    columns = []
    for canonical, accepted in fixed.GOLD_COLUMNS.items():
        present = [F.col(f"`{c}`") for c in accepted if c in rows.columns]
        columns.append((first_filled(*present) if present else F.lit("")).alias(canonical))
    named = rows.select(*columns)
    doi = F.col("DOI")
    inside = F.regexp_extract(doi, r"(?U)(\b10\.\d{4,9}/\S+)", 1)
    fixed_doi = F.when((doi != "") & ~doi.startswith("10.") & (inside != ""), inside).otherwise(doi)
    return named.withColumn("DOI", fixed_doi)


def read_ranking_a(spark: SparkSession, path: str) -> DataFrame:
    """(ord, title, acronym, rank) of the headerless list; rows of fewer than five fields are dropped."""
    rows = (
        spark.read.option("header", False).option("quote", '"').option("escape", '"')
        .schema("id string, title string, acronym string, source string, rank string, rest string").csv(path)
    )
    return rows.where("rank IS NOT NULL").select(
        F.monotonically_increasing_id().alias("ord"), "title", F.coalesce("acronym", F.lit("")).alias("acronym"), "rank")


def read_ranking_b(spark: SparkSession, path: str) -> DataFrame:
    """(ord, title, rank, issn) of the `;`-separated list."""
    rows = read_csv(spark, path, ";")
    issn = F.col("Issn") if "Issn" in rows.columns else F.lit("")
    return rows.select(F.monotonically_increasing_id().alias("ord"), F.col("Title").alias("title"),
                       F.col("SJR Best Quartile").alias("rank"), issn.alias("issn"))


# --- text formats ----------------------------------------------------------------------------------

def file_name() -> Column:
    """Plain name of the file a row was read from (the metadata column is URL-encoded)."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, n, value): the lines of text files, read in blocks by many tasks; (part, n) orders those of a file."""
    return spark.read.option("lineSep", "\n").text(path).select(
        file_name().alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("n"), "value")


def counted_before(lines: DataFrame, count: Column, out: str, chunk: int = 10_000) -> DataFrame:
    """`lines` with the sum of `count` over all earlier lines of the file.

    Sums are taken per chunk of lines with the totals of the chunks before it carried in, so a long file
    is not one task.
    """
    rows = lines.withColumn("_count", count.cast("bigint")).withColumn(
        "_chunk", F.struct(F.col("part"), F.floor(F.col("n") / chunk).alias("c")))
    totals = rows.groupBy("file", "_chunk").agg(F.sum("_count").alias("_total"))
    before = Window.partitionBy("file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("file", "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy("file", "_chunk").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.withColumn("_seen", F.coalesce(F.sum("_count").over(inside), F.lit(0))).join(carried, ["file", "_chunk"])
    return seen.withColumn(out, F.col("_carried") + F.col("_seen")).drop("_count", "_chunk", "_carried", "_seen")


def parts_of_lines(lines: DataFrame, split: str, start: str, chunk: int = 10_000) -> DataFrame:
    """(file, place, part): the parts of files, counted from 0, from ordered lines (file, part, n, value).

    `split` cuts a line, and what then matches `start` begins a part, which goes on until the next one in the
    file begins. What comes before the first is dropped. The line end that closes a file belongs to no part.
    """
    pieces = F.split("value", split)
    begins = F.size(F.filter(pieces, lambda p: p.rlike(start)))
    numbered = counted_before(lines, begins, "before", chunk)
    # A line's own end was read with the line before it.
    first = F.struct(F.lit(-1).alias("place"), F.lit("\n").alias("piece"), F.lit(0).alias("started"))
    each = F.transform(pieces, lambda p, i: F.struct(
        i.alias("place"), p.alias("piece"), F.size(F.filter(F.slice(pieces, 1, i + 1), lambda q: q.rlike(start))).alias("started")))
    rows = numbered.select("file", "part", "n", "before", F.explode(F.concat(F.array(first), each)).alias("x")).select(
        "file", (F.col("before") + F.col("x.started") - 1).alias("number"), F.struct("part", "n", "x.place", "x.piece").alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"]), "")
    return rows.where("number >= 0").groupBy("file", "number").agg(text.alias("part")).withColumnRenamed("number", "place")


def slice_order(name: Column) -> Column:
    """Files go by the number in parentheses, those without one after them by name."""
    number = F.regexp_extract(name, r"\((\d+)\)", 1)
    return F.struct((number == "").cast("int").alias("last"), number.try_cast("int").alias("number"), name.alias("name"))


def _entries(parts: DataFrame) -> DataFrame:
    body = F.concat(F.regexp_replace("part", r"(?U)\s+\z", ""), F.lit("\n"))
    head = r"(?U)^@(\w+)\{([^,]+),"
    return parts.select(
        "file", "place", F.regexp_extract("part", head, 1).alias("kind"),
        strip(F.regexp_extract("part", head, 2)).alias("entry_key"), body.alias("body")).where("entry_key <> ''")


def bibtex_entries(files: DataFrame) -> DataFrame:
    """(file, place, kind, entry_key, body) from (file, value).

    An entry starts after a closing brace, a line break or at the beginning; the break
    may be missing. Text such as `@article{` inside a field does not start one.
    """
    start = r"[ \t\r\n]*@\w+\{"
    split = F.split("value", rf"(?U)(?:(?<=[}}\n])|\A)(?={start})")
    parts = F.transform(F.filter(split, lambda p: p.rlike(rf"(?U)\A{start}")), lambda p: F.regexp_replace(p, r"\A[ \t\r\n]+", ""))
    return _entries(files.select("file", F.posexplode(parts).alias("place", "part")))


def read_bibtex(spark: SparkSession, path: str, chunk: int = 10_000) -> DataFrame:
    """The same of files of any size, read in blocks: starts are counted over the blocks before."""
    start = r"[ \t\r]*@\w+\{"
    parts = parts_of_lines(read_lines(spark, path), rf"(?U)(?:(?<=\}})|\A)(?={start})", rf"(?U)\A{start}", chunk)
    return _entries(parts.withColumn("part", F.regexp_replace("part", r"\A[ \t\r\n]+", "")))


def merge_bibtex(entries: DataFrame) -> DataFrame:
    """First entry per key in file order, with its copies and whether a body differs."""
    order = F.struct(slice_order(F.col("file")).alias("f"), F.col("place"))
    return entries.groupBy("entry_key").agg(
        F.min_by("body", order).alias("body"), F.min_by("file", order).alias("first_file"),
        F.count("*").alias("copies"), (F.min("body") != F.max("body")).alias("conflict"))


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """Lines of RIS files with their place: (file, part, n, value)."""
    return spark.read.text(path).select(
        file_name().alias("file"), F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("n"), "value")


def ris_keys(lines: DataFrame, chunk: int = 10_000) -> DataFrame:
    """(file, record, doi, title, record_key) from ordered lines (file, part, n, value).

    A record ends with its ER line; the number of ER lines before a line is its record. The
    last DOI and title line of a record count.
    """
    rows = lines.withColumn("er", F.col("value").startswith("ER").cast("bigint"))
    numbered = counted_before(rows, F.col("er"), "record", chunk)
    place = F.struct("part", "n")
    tag = lambda name: F.max_by(
        F.when(F.col("value").startswith(f"{name}  - "), F.substr("value", F.lit(7))),
        F.when(F.col("value").startswith(f"{name}  - "), place))
    records = numbered.groupBy("file", "record").agg(
        tag("DO").alias("doi"), tag("TI").alias("title"), F.max("er").alias("closed")).where("closed = 1")
    doi, title = ids.norm_doi(F.col("doi")), ids.norm_title(F.col("title"))
    key = F.when(doi != "", doi).when(title != "", F.concat(F.lit("T:"), title))
    return records.select("file", "record", doi.alias("doi"), title.alias("title"), key.alias("record_key"))


PAGE_SPLIT, PAGE_HEAD = r"(?m)(?=^\[p\.\d+\]\s*$)", r"(?m)\A\[p\.(\d+)\]\s*$"


def _pages(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.select(
        *keys, F.regexp_extract("part", PAGE_HEAD, 1).cast("int").alias("page"), F.regexp_replace("part", PAGE_HEAD, "").alias("text"))


def pages_of(files: DataFrame, id_column: str = "record_id") -> DataFrame:
    """(record_id, page, text) from texts with `[p.N]` lines (record_id, value)."""
    parts = F.filter(F.split("value", PAGE_SPLIT), lambda p: p.rlike(PAGE_HEAD))
    return _pages(files.select(id_column, F.explode(parts).alias("part")), id_column)


def read_pages(spark: SparkSession, path: str, chunk: int = 10_000) -> DataFrame:
    """(file, place, page, text) of files of any size with `[p.N]` lines, read in blocks; the line end that closes a
    file is in no page."""
    return _pages(parts_of_lines(read_lines(spark, path), PAGE_SPLIT, PAGE_HEAD, chunk), "file", "place")


# --- landed search results --------------------------------------------------------------------------

ARTICLE_SCHEMA = (
    "title string, article_title string, abstract string, publication_title string, publication_year string, doi string, "
    "issn string, html_url string, pdf_url string, content_type string, authors struct<authors: array<struct<full_name: string>>>"
)
ENTRY_SCHEMA = (
    "`dc:creator` string, `prism:aggregationType` string, authkeywords string, `dc:title` string, `dc:description` string, "
    "`prism:publicationName` string, `prism:coverDate` string, `prism:doi` string, `prism:issn` string, `prism:eIssn` string, "
    "link array<struct<`@ref`: string, `@href`: string>>"
)


def _filled(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit(""))


def map_articles(landed: DataFrame) -> DataFrame:
    """Search records from landed article objects (json, one per row)."""
    rows = landed.withColumn("a", F.from_json("json", ARTICLE_SCHEMA))
    names = F.filter(F.transform(F.coalesce("a.authors.authors", F.array()), lambda x: F.coalesce(x["full_name"], F.lit(""))),
                     lambda n: n != "")
    kind = F.lower(F.coalesce("a.content_type", F.lit("")))
    return rows.select(
        *[c for c in landed.columns if c != "json"],
        _filled("a.title", "a.article_title").alias("title"), _filled("a.abstract").alias("abstract"),
        _filled("a.publication_title").alias("venue"), _filled("a.publication_year").alias("year"), _filled("a.doi").alias("doi"),
        _filled("a.issn").alias("issn"), _filled("a.html_url", "a.pdf_url").alias("url"), names.alias("authors"),
        F.array().cast("array<string>").alias("keywords"),
        (kind.contains("conference") | kind.contains("proceeding")).alias("is_conference"))


def map_entries(landed: DataFrame) -> DataFrame:
    """Search records from landed entry objects; entries without a title are placeholders and dropped."""
    rows = landed.withColumn("e", F.from_json("json", ENTRY_SCHEMA)).where(F.col("e.`dc:title`").isNotNull())
    creator = _filled("e.`dc:creator`")
    words = F.filter(F.transform(F.split(_filled("e.authkeywords"), r"\|"), strip), lambda k: k != "")
    kind = F.lower(_filled("e.`prism:aggregationType`"))
    links = F.filter(F.coalesce("e.link", F.array()), lambda x: x["@ref"] == "scopus")
    return rows.select(
        *[c for c in landed.columns if c != "json"],
        _filled("e.`dc:title`").alias("title"), _filled("e.`dc:description`").alias("abstract"),
        _filled("e.`prism:publicationName`").alias("venue"), F.substring(_filled("e.`prism:coverDate`"), 1, 4).alias("year"),
        _filled("e.`prism:doi`").alias("doi"), _filled("e.`prism:issn`", "e.`prism:eIssn`").alias("issn"),
        F.coalesce(F.get(F.transform(links, lambda x: x["@href"]), F.lit(0)), F.lit("")).alias("url"),
        F.when(creator != "", F.array(creator)).otherwise(F.array().cast("array<string>")).alias("authors"),
        words.alias("keywords"), kind.isin("conference proceeding", "conference").alias("is_conference"))
