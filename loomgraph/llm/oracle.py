"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from loomgraph.llm import mixing, quality_rules, substring_dedup

KEY = "coalesce(CAST(doc_id AS VARCHAR), 'null')"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS4 = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (UPPER, LOWER)
OP4 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS4} AS w FROM benchmark),
v AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') AS body
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {WORDS4} AS w FROM documents),
p AS (SELECT doc_id, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS body
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n)),
h AS (SELECT doc_id, k, n, item FROM p JOIN v USING (n, body)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0, false) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
PLAIN = mixing.NO_LETTERS.replace("'", "''")
OP5 = f"""
WITH r AS (
  SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(coalesce(text, chr(0))) AS tie,
    greatest(coalesce(length(translate(text, '{PLAIN}', '')) / greatest(length(text), 1), 0.01::DOUBLE), 0.01::DOUBLE) AS quality FROM documents),
k AS (SELECT *, -ln((CAST(CAST('0x' || substr(md5('{mixing.SEED}/' || {KEY} || '/' || tie), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE)
  / 4503599627370496.0::DOUBLE) / quality AS key FROM r),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM r GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size AS most, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS turn FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM o)::DOUBLE - coalesce(sum(most) OVER b, 0.0::DOUBLE))
  / ((SELECT sum(weight) FROM o) - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level FROM o WINDOW b AS (ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT source, source_size, least(most, coalesce((SELECT arg_min(level, turn) FROM l WHERE level * weight <= most), 'inf'::DOUBLE) * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM a),
x AS (SELECT *, round(target - epochs * source_size) AS rest FROM e),
q AS (SELECT k.doc_id, k.size, x.*, coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM k JOIN x ON k.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(least(size, rest - before), 0) AS BIGINT) AS taken FROM q"""


def covered(n: int) -> str:
    """Words of each document inside n-word windows that occur twice or more in it: (doc_id, k)."""
    return f"""SELECT DISTINCT doc_id, unnest(range(k, k + {n})) AS k FROM (
  SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (
    SELECT doc_id, k, array_to_string(list_slice(w, k, k + {n - 1}), ' ') AS g FROM p WHERE k + {n - 1} <= len(w))) WHERE c > 1"""


LENGTHS = quality_rules.MAX_COVERED
_joins = "\n".join(
    f"LEFT JOIN (SELECT doc_id, count(*) AS n, sum(length(x)) AS c FROM ({covered(n)}) JOIN (SELECT doc_id, k, w[k] AS x FROM p) USING (doc_id, k) "
    f"GROUP BY doc_id) g{n} USING (doc_id)"
    for n in (3, *LENGTHS)
)
_shares = ", ".join(f"coalesce(CAST(g{n}.c AS DOUBLE), 0) / greatest(word_chars, 1) AS covered_{n}" for n in LENGTHS)
_limits = " AND ".join(f"covered_{n} <= {most}::DOUBLE" for n, most in LENGTHS.items())
OP7 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM d),
n AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
li AS (SELECT doc_id, j, s[j] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS j FROM d)),
lo AS (SELECT *, list_sum(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: length(x))) AS c,
  row_number() OVER (PARTITION BY doc_id, line ORDER BY j) > 1 AS later FROM li WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l AS (SELECT doc_id, count(*) FILTER (WHERE later) AS n_dup_lines, sum(c) FILTER (WHERE later) AS dup_chars FROM lo GROUP BY doc_id),
m AS (SELECT n.*, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(g3.n, 0) AS n_repeat_words,
  coalesce(CAST(dup_chars AS DOUBLE), 0) / greatest(word_chars, 1) AS dup_line_share, {_shares}
  FROM n LEFT JOIN l USING (doc_id) {_joins}),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND dup_line_share <= {quality_rules.MAX_LINE_SHARE}::DOUBLE AND n_symbols <= {quality_rules.MAX_SYMBOL_SHARE}::DOUBLE * word_chars
  AND {_limits} AS kept FROM b"""

WINDOW = substring_dedup.WINDOW
OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
p AS (SELECT r, k, array_to_string(list_slice(w, k, k + {WINDOW - 1}), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS k FROM d WHERE len(w) >= {WINDOW})),
x AS (SELECT DISTINCT r, unnest(range(k, k + {WINDOW})) AS k FROM (SELECT r, k, count(*) OVER (PARTITION BY md5(g)) AS c FROM p) WHERE c > 1),
y AS (SELECT r, list(k) AS gone FROM x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda v, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256 FROM d LEFT JOIN y USING (r)"""

TERMS = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')" % (UPPER, LOWER)
OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents),
l AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM l),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
i AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark)),
t AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM p, c WHERE term IN (SELECT term FROM i) GROUP BY term, docs),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM i JOIN t USING (term) JOIN p USING (term) JOIN l USING (r), c GROUP BY item_id, r, doc_id),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS w, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS lo, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS hi FROM u),
p AS (SELECT doc_id, t, n, array_to_string(w[1:lo], '') AS a, array_to_string(w[lo + 1:hi], '') AS m, array_to_string(w[hi + 1:], '') AS s,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || a || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""

SQL = {
    "op4_decontamination": OP4,
    "op5_mixing": OP5,
    "op7_quality_rules": OP7,
    "op9_substring_dedup": OP9,
    "op12_ranked_search": OP12,
    "op13_fill_middle": OP13,
}
