"""Compare registered queries with their SQL; also runnable: oracle_check.py FOLDER [NAME ...]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def family(value_type: str) -> str:
    v = value_type.lower()
    if any(x in v for x in ("int", "long", "short")):
        return "int" if "huge" not in v else "HUGE"
    if "double" in v or "float" in v:
        return "double"
    return {"varchar": "string", "string": "string", "boolean": "bool"}.get(v, v)


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and a statement's result, empty when equal."""
    names = sorted(df.columns)
    kinds = {c: family(k) for c, k in df.dtypes}
    cursor = con.execute(sql)
    other = {d[0]: family(str(d[1])) for d in cursor.description}
    problems = []
    if kinds != other:
        problems.append(f"schema {sorted(kinds.items())} != {sorted(other.items())}")
        if set(kinds) != set(other):
            return problems
    order = [[d[0] for d in cursor.description].index(n) for n in names]
    expected = sorted(tuple(cell(r[i]) for i in order) for r in cursor.fetchall())
    got = sorted(tuple(cell(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    if len(got) != len(expected):
        problems.append(f"{len(got)} rows, expected {len(expected)}")
    if got != expected:
        extra = sorted(set(got) - set(expected))[:2]
        missing = sorted(set(expected) - set(got))[:2]
        problems.append(f"columns {names}\n   got     {str(extra)[:900]}\n   wanted  {str(missing)[:900]}")
    return problems


def main() -> None:
    from sievelake.session import local_session

    import __spark_entry__ as entry

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    con = connect(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in sql:
                problems = compare(df, con, sql[name])
                state = "ok" if not problems else "DIFF"
                rows = ""
            else:
                problems, rows, state = [], df.count(), "rows"
        except Exception as error:  # report and go on
            problems, state, rows = [str(error)[:1500]], "ERROR", ""
        bad += bool(problems)
        print(f"{state:5} {time.time() - start:6.1f}s {name} {rows}", flush=True)
        for p in problems:
            print("      ", p, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
