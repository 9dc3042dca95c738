import csv
import hashlib
import io
import random

import pytest

from sievelake.operators import agreement, workflow
from sievelake.sources import readers, sinks


def test_exports_are_united(spark, tmp_path):
    (tmp_path / "acm.csv").write_text('﻿Key,Title,Abstract Note\nk1,"A ""quoted"", title","two\nlines"\n', encoding="utf-8")
    (tmp_path / "ieee_wave2_x.csv").write_text("Key,DOI\nk2,10.1/x\n", encoding="utf-8")
    (tmp_path / "pubmed.csv").write_text("Key\nk3\n", encoding="utf-8")
    paths = [str(p) for p in tmp_path.iterdir()]
    rows = readers.concat_exports(spark, paths).orderBy("ord").collect()
    assert [(r.Key, r.Source_DB, r.DOI) for r in rows] == [("k1", "ACM", ""), ("k2", "IEEE(wave2)", "10.1/x")]
    assert rows[0]["Title"] == 'A "quoted", title' and rows[0]["Abstract Note"] == "two\nlines"
    united = readers.concat_exports(spark, paths)
    assert readers.resolve_columns(united, readers.RECORD_COLUMNS).columns == [*readers.RECORD_COLUMNS, "ord"]
    (tmp_path / "zz.csv").write_text("Key,Source_DB\nk,x\n")
    with pytest.raises(ValueError):
        readers.concat_exports(spark, [*paths, str(tmp_path / "zz.csv")])


@pytest.mark.parametrize("block", [400, 1 << 27])
def test_exports_are_read_in_blocks(spark, tmp_path, block):
    """Records are those of a sequential reader wherever blocks and chunks of lines end, with quotes inside plain fields too."""
    rng = random.Random(block)
    atoms = ["a", " ", ",", '"', "\n", "\n\n", '""', "é", "5", "x,y", ""]
    want = []
    for f in range(4):
        names = ["id", "t", "u"] if f % 2 else ["u", "id", "w"]
        lines = [",".join(names)]
        for i in range(60):
            cells = []
            for _ in range(3):
                plain = "".join(rng.choice(['b', 'c"', ' d', '7"" e']) for _ in range(rng.randrange(3))).lstrip('"')
                cell = "".join(rng.choice(atoms) for _ in range(rng.randrange(6)))
                cells.append(plain or "z" if rng.random() < 0.4 else '"' + cell.replace('"', '""') + '"')
            lines.append(",".join(cells))
        text = ("\ufeff" if f == 2 else "") + "\n".join(lines) + rng.choice(["", "\n", "\n\n"])
        (tmp_path / f"s{f}.csv").write_text(text, encoding="utf-8", newline="")
        rows = list(csv.reader(io.StringIO(text.lstrip("\ufeff"), newline="")))
        want += [(f"s{f}", *[dict(zip(names, r)).get(n, "") for n in ("id", "t", "u", "w")]) for r in rows[1:] if r]
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        rows = readers.concat_exports(spark, [str(p) for p in tmp_path.iterdir()]).orderBy("ord").collect()
        records = readers.csv_records(spark, str(tmp_path), chunk=3)
        assert records.where("record > 0").count() == len(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.Source_DB, r.id, r.t, r.u, r.w) for r in rows] == want
    assert len({r.ord for r in rows}) == len(rows)


def _ends_inside(line, inside):
    """Character by character: 0 at the begin of a field, 1 in a plain one, 2 in a quoted one, 3 after a quote in it."""
    state = 2 if inside else 0
    for c in line:
        state = {0: 2, 1: 1, 2: 3, 3: 2}[state] if c == '"' else state if state == 2 else 0 if c == "," else 1
    return state == 2


def test_lines_that_plain_tests_tell_end_as_if_followed(spark):
    rng = random.Random(8)
    lines = ["", '"', '""', '"""', '",","', '","', '"a","b"', '"","a,",""', '"a,"', '"a,","b,"']
    lines += ["".join(rng.choice(['"', ",", "a", '","', " "]) for _ in range(rng.randrange(9))) for _ in range(2000)]
    lines += [",".join('"' + rng.choice(["", ",", "a", "a,", ",a"]) + '"' for _ in range(rng.randrange(1, 5))) for _ in range(500)]
    rows = readers._line_states(spark.createDataFrame([(x,) for x in lines], "value string"), ",").collect()
    assert [(r._o, r._i) for r in rows] == [(_ends_inside(x, False), _ends_inside(x, True)) for x in lines]


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_records_of_several_lines_among_whole_ones(spark, tmp_path, chunk):
    """Lines that look like whole records stand in quoted fields too; chunks of whole lines lie between."""
    rng = random.Random(chunk)
    for f in range(3):
        cells = [[rng.choice(["x", "a,b", "", 'l1\n"m","n"\n,"o"', "p\n\nq"] if i % 23 == 5 else ["x", "a,b", ""]), f"{i}"] for i in range(150)]
        gaps = [rng.choice(["", "\n"]) if i % 31 == 7 else "" for i in range(150)]
        text = "".join(gap + ",".join('"' + c.replace('"', '""') + '"' for c in row) + "\n" for gap, row in zip(gaps, cells))
        (tmp_path / f"m{f}.csv").write_text(text, encoding="utf-8", newline="")
    got = {}
    for r in readers.csv_records(spark, str(tmp_path), chunk=chunk).orderBy("path", "record").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.record, next(csv.reader(io.StringIO(r.text, newline="")))))
    for name, records in got.items():
        want = [r for r in csv.reader(io.StringIO((tmp_path / name).read_text(encoding="utf-8"), newline="")) if r]
        assert records == list(enumerate(want))
    assert len(got) == 3


def test_sources_are_named_once_per_export(spark, tmp_path):
    """No row of an export has its source taken out of the file's name by patterns, and rows of skipped exports are not parsed first."""
    (tmp_path / "acm.csv").write_text("Key\nk1\n")
    (tmp_path / "pubmed.csv").write_text("Key\nk2\n")
    rows = readers.concat_exports(spark, [str(p) for p in tmp_path.iterdir()])
    assert [(r.Source_DB, r.Key) for r in rows.collect()] == [("ACM", "k1")]
    assert "regexp" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_gold_rows_take_first_filled_column(spark):
    rows = spark.createDataFrame([(" ", "7", "see https://doi.org/10.1145/abc.1 now"), ("3", "8", "10.5/x")], "`#` string, ID string, DOI_or_URL string")
    assert [(r["#"], r["DOI"]) for r in readers.gold_rows(rows).collect()] == [("7", "10.1145/abc.1"), ("3", "10.5/x")]


def test_ranking_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,Conf One,C1,x,A*,more\n2,too short\n3,Conf Two,,x,B\n")
    (tmp_path / "b.csv").write_text('Rank;Title;Issn;SJR Best Quartile\n1;"J; One";"12345678, 87654321";Q1\n')
    assert [r.title for r in readers.read_ranking_a(spark, str(tmp_path / "a.csv")).collect()] == ["Conf One", "Conf Two"]
    row = readers.read_ranking_b(spark, str(tmp_path / "b.csv")).first()
    assert (row.title, row["rank"], row.issn) == ("J; One", "Q1", "12345678, 87654321")


def test_bibtex_and_ris_files(spark, tmp_path):
    bib = tmp_path / "bib"
    bib.mkdir()
    (bib / "x (2).bib").write_text("@article{a, t={2}}\n\n@misc{b, note={mail @article{ inside}}")
    (bib / "x (1).bib").write_text("@article{a, t={1}}@inproceedings{c, t={3}}")
    merged = {r.entry_key: (r.first_file, r.copies, r.conflict) for r in readers.merge_bibtex(readers.read_bibtex(spark, str(bib))).collect()}
    assert merged == {"a": ("x (1).bib", 2, True), "b": ("x (2).bib", 1, False), "c": ("x (1).bib", 1, False)}
    ris = tmp_path / "ris"
    ris.mkdir()
    (ris / "r.ris").write_text("TY  - JOUR\nTI  - One\nDO  - https://doi.org/10.1/A\nER  - \n\nTY  - JOUR\nTI  - Two!\nER  - \nTI  - open\n")
    keys = readers.ris_keys(readers.read_ris(spark, str(ris)), chunk=2).orderBy("record").collect()
    assert [k.record_key for k in keys] == ["10.1/a", "T:two"]


@pytest.mark.parametrize("block", [64, 1000, 1 << 27])
def test_files_read_in_blocks(spark, tmp_path, block):
    """Entries and pages are those of the whole text wherever the blocks of a file end."""
    rng = random.Random(block)
    ends = ["", "\n", "\n\n", " \r\n\t", "\n  "]
    texts, paged = {}, {}
    for f in range(3):
        entries = [f"@a{{k{rng.randrange(40)}, t = {{{'x' * rng.randrange(30)}" + rng.choice(["", "\n y @b{z}", "} @b{z, c}", "\r\n\u2028w"]) + "}}" + rng.choice(ends) for _ in range(40)]
        texts[f"e ({f}).bib"] = rng.choice(["", "junk\n", "\n\n "]) + "".join(entries)
        pages = [f"[p.{i}]" + rng.choice(["", "  ", " x", "\r", "\n\n"]) + "\n" + rng.choice(["a\nb\n", "\n", "[p.7] no\n", "\u2028[p.8]\u2028c\n", "é\n"]) for i in range(40)]
        paged[f"p{f}.txt"] = rng.choice(["", "head\n"]) + "".join(pages) + "end"
    paged["none.txt"], texts["none.bib"] = "no page", ""
    for folder, files in (("e", texts), ("p", paged)):
        (tmp_path / folder).mkdir()
        for name, text in files.items():
            (tmp_path / folder / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        entries = readers.read_bibtex(spark, str(tmp_path / "e"), chunk=7)
        lines = readers.read_lines(spark, str(tmp_path / "p"))
        assert block > 64 or lines.select("part").distinct().count() > 5
        got = sorted(tuple(r) for r in entries.collect())
        got_pages = sorted(tuple(r) for r in readers.read_pages(spark, str(tmp_path / "p"), chunk=7).drop("place").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    whole = spark.createDataFrame(list(texts.items()), "file string, value string")
    assert got == sorted(tuple(r) for r in readers.bibtex_entries(whole).collect()) and len(got) > 100
    whole = spark.createDataFrame(list(paged.items()), "file string, value string")
    assert got_pages == sorted(tuple(r) for r in readers.pages_of(whole, "file").collect()) and len(got_pages) > 100


def test_sinks_guard_what_is_there(spark, tmp_path):
    log, table = str(tmp_path / "log"), str(tmp_path / "table")
    sinks.append_log(spark.range(2), log)
    sinks.append_log(spark.range(3), log)
    assert spark.read.parquet(log).count() == 5
    with pytest.raises(ValueError):
        sinks.append_log(spark.range(1).withColumnRenamed("id", "other"), log)
    sinks.write_guarded(spark.range(2), table)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_guarded(spark.range(9), table)
    sinks.write_guarded(spark.range(9), table, force=True)
    assert spark.read.parquet(table).count() == 9
    stage = spark.createDataFrame([(1, "included", "x"), (2, "excluded", "y")], "ord int, decision string, extra string")
    sinks.write_stage(stage, str(tmp_path / "stage"), columns=["ord", "absent"])
    assert sorted(spark.read.parquet(str(tmp_path / "stage")).where("decision = 'included'").columns) == ["decision", "ord"]
    hit = spark.createDataFrame([("T\nx", "", "V", "2020", "", "", "", ["A", " "], [], True)],
                                "title string, abstract string, venue string, year string, doi string, issn string, url string, "
                                "authors array<string>, keywords array<string>, is_conference boolean")
    sinks.write_ris(hit, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [
        "TY  - CONF", "TI  - T x", "T2  - V", "PY  - 2020", "AU  - A", "ER  - ", ""]


def test_kappa_limits(spark):
    rows = [("flat", "x", "x")] * 4 + [("constant", "x", v) for v in "xyxy"] + [("equal", v, v) for v in "xyxy"]
    got = {r.k: r.kappa for r in agreement.cohen_kappa(spark.createDataFrame(rows, "k string, a string, b string"), ["k"]).collect()}
    assert got["flat"] != got["flat"] and got["constant"] == 0 and got["equal"] == 1


def test_fingerprint_of_a_million_ids(spark):
    sheet = spark.range(1_000_020).selectExpr("id", "if(id < 20, 's', 'large') AS sheet", "concat('R', id) AS record_id").repartition(7)
    got = {r.sheet: r.fingerprint for r in workflow.fingerprints(sheet, ["sheet"], "id").collect()}
    want = lambda ids: hashlib.sha1("\n".join(f"R{i}" for i in ids).encode()).hexdigest()[:7]
    assert got == {"s": "20:" + want(range(20)), "large": "1000000:" + want(range(20, 1_000_020))}
