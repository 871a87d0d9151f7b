"""Base columns of op2, op7, op9 and the statistics' counts against SQL over whole texts."""

from __future__ import annotations

import duckdb
import pytest

from momentlake.llm import queries

SF = "/root/testdata/sf0.01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SECRETS = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(t, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: len(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: len(x) >= 24)) AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""

QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d), h AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM g),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1), c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM r) GROUP BY 1),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d), x AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: len(y))), 0) AS word_chars, len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(x.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(w) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)
"""

LICENSES = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS place, CASE WHEN w[i] = 'cc' AND w[i + 1] = 'by' THEN 'cc-by' WHEN w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license' THEN 'gpl' WHEN w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved' THEN 'reserved' END AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
q AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels FROM p WHERE label IS NOT NULL GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN q USING (doc_id)
"""


@pytest.mark.parametrize(("name", "sql"), [("op2_secrets", SECRETS), ("op7_quality_rules", QUALITY), ("op9_licenses", LICENSES)])
def test_base_columns(spark, name, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    got = sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, SF).collect())
    assert got == sorted(want.fetchall())
