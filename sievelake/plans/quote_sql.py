"""The quotation queries in SQL.

Texts are compared here as they stand: the statements hold for texts that NFKC leaves as they are,
as all given ones do. Other texts are in tests/test_quotes.py.
"""


def canonical_sql(c: str) -> str:
    """Straight quotation marks, no soft hyphens, lower case."""
    return f"""lower(translate(coalesce({c}, ''), '’‘“”' || chr(173), '''''""'))"""


def loose_sql(c: str) -> str:
    return rf"regexp_replace({canonical_sql(c)}, '[\s\x1c-\x1f]+', '', 'g')"


def span_sql(c: str) -> str:
    return f"replace({loose_sql(c)}, '-', '')"


def exact_sql(c: str) -> str:
    return rf"trim(regexp_replace({canonical_sql(c)}, '[\s\x1c-\x1f]+', ' ', 'g'))"


CANONICAL_SQL = f"""SELECT conv_id, turn, md5({canonical_sql('text')}) AS canonical, md5({loose_sql('text')}) AS no_space,
  md5({span_sql('text')}) AS no_hyphen FROM conversations"""

#: The quotations that are asked for: four of every turn.
QUOTES_SQL = r"""follows AS (SELECT conv_id, turn - 1 AS turn, text AS next FROM conversations),
  turns AS (SELECT c.conv_id, c.turn, c.text, string_split(c.text, chr(10)) AS lines, f.next FROM conversations c LEFT JOIN follows f USING (conv_id, turn)),
  asked AS (SELECT conv_id AS record_id, turn AS page, 'opening' AS field, split_part(text, '.', 1) || '.' AS quote, turn FROM turns
    UNION ALL SELECT conv_id, turn, 'closing', upper(replace(lines[-1], 'ß', 'SS')), turn FROM turns
    UNION ALL SELECT conv_id, turn + 1, 'whole', regexp_replace(text, '\s+', '', 'g'), turn FROM turns
    UNION ALL SELECT conv_id, turn, 'absent', coalesce(lines[-1] || ' ' || split_part(next, chr(10), 1), reverse(text)), turn FROM turns),
  quoted AS (SELECT record_id || '-' || turn || '-' || field AS quote_id, record_id, page, field, quote FROM asked)"""

#: Where the quotations (quote_id, record_id, page, quote) of a table `quoted` stand.
LOCATED_SQL = f"""pages AS (SELECT conv_id AS record_id, turn AS page, {span_sql('text')} AS body FROM conversations),
  places AS (SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY record_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM pages),
  whole AS (SELECT record_id, string_agg(body, '' ORDER BY page) AS body FROM pages GROUP BY record_id),
  formed AS (SELECT quote_id, record_id, page, {span_sql('quote')} AS q FROM quoted),
  found AS (SELECT f.quote_id, p.page = f.page AS stated, p.page, p.at + instr(p.body, f.q) - 1 AS start
    FROM formed f JOIN places p USING (record_id) WHERE f.q <> '' AND contains(p.body, f.q)),
  best AS (SELECT quote_id, bool_or(stated) AS stated, coalesce(min(start) FILTER (WHERE stated), arg_min(start, page)) AS start FROM found GROUP BY quote_id),
  across AS (SELECT f.quote_id, instr(w.body, f.q) - 1 AS start FROM formed f JOIN whole w USING (record_id)
    WHERE f.q <> '' AND contains(w.body, f.q) AND f.quote_id NOT IN (SELECT quote_id FROM best)),
  pieces AS (SELECT quote_id, record_id, unnest(list_transform(range(0, greatest(length(q) - 39, 1), 40), lambda k: substr(q, (k + 1)::BIGINT, 40))) AS piece
    FROM formed WHERE q <> ''),
  parts AS (SELECT quote_id, avg(CASE WHEN contains(w.body, piece) THEN 1 ELSE 0 END) AS share FROM pieces JOIN whole w USING (record_id) GROUP BY quote_id),
  located AS (SELECT f.quote_id, CASE WHEN b.stated THEN 'OK' WHEN coalesce(b.start, a.start) IS NOT NULL THEN 'WRONG_PAGE'
      WHEN parts.share >= 0.3::DOUBLE THEN 'PARTLY' ELSE 'ABSENT' END AS status, coalesce(b.start, a.start)::BIGINT AS start,
      coalesce(b.start, a.start)::BIGINT + length(f.q) AS stop
    FROM formed f LEFT JOIN best b USING (quote_id) LEFT JOIN across a USING (quote_id) LEFT JOIN parts USING (quote_id))"""


def held_sql(name: str, form) -> str:
    """For each quotation whether its form stands on the stated page, and on any page."""
    return f"""{name}_pages AS (SELECT conv_id AS record_id, turn AS page, {form('text')} AS body FROM conversations),
  {name}_quotes AS (SELECT quote_id, record_id, page, {form('quote')} AS q FROM quoted),
  {name} AS (SELECT q.quote_id, bool_or(q.q = '' OR q.page = p.page AND contains(p.body, q.q)) AS on_stated,
    bool_or(contains(p.body, q.q)) AS anywhere FROM {name}_quotes q JOIN {name}_pages p USING (record_id) GROUP BY q.quote_id)"""


STATUS_SQL = f"""WITH {QUOTES_SQL}, {held_sql('exact', exact_sql)}, {held_sql('loose', loose_sql)},
  verdicts AS (SELECT field, CASE WHEN exact.anywhere AND loose.on_stated THEN 'OK' WHEN loose.anywhere AND loose.on_stated THEN 'OK_LOOSE'
      WHEN loose.anywhere THEN 'WRONG_PAGE' ELSE 'NOT_FOUND' END AS status, exact.anywhere AS e, loose.anywhere AS l
    FROM quoted JOIN exact USING (quote_id) JOIN loose USING (quote_id))
  SELECT field, status, count(*) AS n, count(*) FILTER (WHERE e) AS exact, count(*) FILTER (WHERE l) AS loose FROM verdicts GROUP BY field, status"""

#: Agreement of three runs, character by character.
AGREEMENT_SQL = f"""runs AS (
    SELECT conv_id AS record_id, role AS field, 'run' || (turn % 3 + 1) AS run, split_part(text, chr(10), 1) AS quote, turn AS page FROM conversations
    UNION ALL SELECT conv_id, role, unnest(['run1', 'run2', 'run3']), split_part(text, '.', 1), turn FROM conversations),
  quoted AS (SELECT DISTINCT record_id || '|' || field || '|' || run || '|' || page || '|' || md5(quote) AS quote_id, record_id, field, run, page, quote FROM runs),
  {LOCATED_SQL},
  chars AS (SELECT record_id, field, spot, bool_or(run = 'run1') AS r1, bool_or(run = 'run2') AS r2, bool_or(run = 'run3') AS r3 FROM (
    SELECT record_id, field, run, unnest(range(start, stop)) AS spot FROM quoted JOIN located USING (quote_id) WHERE start IS NOT NULL) GROUP BY ALL),
  sums AS (SELECT record_id, field, count(*) AS n, count(*) FILTER (WHERE r1 AND r2 AND r3) AS every,
      count(*) FILTER (WHERE r1 AND r2)::DOUBLE / nullif(count(*) FILTER (WHERE r1 OR r2), 0) AS a,
      count(*) FILTER (WHERE r1 AND r3)::DOUBLE / nullif(count(*) FILTER (WHERE r1 OR r3), 0) AS b,
      count(*) FILTER (WHERE r2 AND r3)::DOUBLE / nullif(count(*) FILTER (WHERE r2 OR r3), 0) AS c FROM chars GROUP BY record_id, field),
  agreement AS (SELECT record_id, field, (coalesce(a, 1) + coalesce(b, 1) + coalesce(c, 1)) / 3 AS jaccard, coalesce(every, 0) > 0 AS shared,
      coalesce(n, 0) = 0 AS empty_all FROM (SELECT DISTINCT record_id, field FROM quoted) LEFT JOIN sums USING (record_id, field))"""

SUMMARY_SQL = f"""WITH {AGREEMENT_SQL} SELECT field, count(*) AS records, count(*) FILTER (WHERE empty_all) AS empty, count(*) FILTER (WHERE shared) AS shared,
  round(count(*) FILTER (WHERE shared) / nullif(count(*) FILTER (WHERE NOT empty_all), 0)::DOUBLE, 2) AS shared_share,
  round(avg(jaccard) FILTER (WHERE NOT empty_all), 2) AS mean_jaccard FROM agreement GROUP BY field"""


def ratio_sql(pairs: str) -> str:
    """CTEs `scored` (id, ratio) for a table of distinct (id, a, b): the Ratcliff/Obershelp ratio.

    The longest common block counts, the first one in `a` and then in `b` of those as long; then
    the same to its left and to its right. For strings of fewer than 200 characters.
    """
    return f"""seg(id, a, b, k) AS (
    SELECT id, a, b, 0::BIGINT FROM {pairs} UNION ALL
    SELECT id, unnest([substr(a, 1, i - 1), substr(a, i + k)]), unnest([substr(b, 1, j - 1), substr(b, j + k)]), unnest([k, 0]) FROM (
      SELECT id, a, b, m.k AS k, -m.i AS i, instr(b, substr(a, -m.i, m.k)) AS j FROM (
        SELECT id, a, b, list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2),
          lambda k: CASE WHEN contains(b, substr(a, i, k)) THEN {{'k': k, 'i': -i}} END)))) AS m FROM seg WHERE a <> '' AND b <> '') WHERE m IS NOT NULL)),
  scored AS (SELECT p.id, CASE WHEN length(p.a) + length(p.b) = 0 THEN 1.0 ELSE 2.0 * s.k::DOUBLE / (length(p.a) + length(p.b)) END AS ratio
    FROM {pairs} p JOIN (SELECT id, sum(k) AS k FROM seg GROUP BY id) s USING (id))"""
