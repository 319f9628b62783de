"""DuckDB SQL of the operators whose rows SQL can express."""

from __future__ import annotations

from .line_frequency import DEPLETED, LEAST_WORDS, LIMIT, MOST_REPEAT_PERCENT

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

SQL["op2_line_frequency"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win)
          WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice)
        GROUP BY doc_id),
ln AS (SELECT doc_id, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
              array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ') AS joined
       FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)),
full_ln AS (SELECT doc_id, source, line, words,
                   regexp_replace({LOWER.format('joined')}, '[0-9]+', '0', 'g') AS norm FROM ln WHERE words > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM full_ln GROUP BY doc_id),
freq AS (SELECT source, norm FROM full_ln GROUP BY ALL HAVING count(DISTINCT doc_id) > {LIMIT}),
gone AS (SELECT doc_id, sum(words) AS n FROM full_ln l
         JOIN freq f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm GROUP BY doc_id),
facts AS (
SELECT d.doc_id, len(ws)::BIGINT AS n_words,
       length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
       coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
       coalesce(gone.n, 0)::BIGINT AS removed_words
FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words) AS base_failed,
       removed_words,
       (NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEAT_PERCENT} * n_words)
        AND removed_words <= {DEPLETED} * n_words) AS kept
FROM facts
"""

SQL["op3_digest_index"] = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""

SQL["op5_setsketch"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws
           FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
         SELECT doc_id, unnest(CASE WHEN len(ws) >= 3
                THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM d)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
           GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
         WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT d.doc_id, coalesce(size.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m.b, d.doc_id)) AS kept
FROM d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id
"""

TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL["op13_bag_search"] = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {TERMS.format(LOWER.format("text"))} AS ts FROM documents),
total AS (SELECT count(*) FILTER (WHERE len(ts) > 0) AS n, sum(len(ts))::BIGINT AS l FROM t),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM t) GROUP BY ALL),
item AS (SELECT DISTINCT item_id, unnest({TERMS.format(LOWER.format("text"))}) AS term FROM benchmark),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
           FROM tf, total WHERE term IN (SELECT term FROM item) GROUP BY term),
m AS (SELECT r, doc_id, 10 + (90 * len(ts) * n) // l AS m FROM t, total WHERE len(ts) > 0),
score AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
          FROM item JOIN weight USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0)
WHERE rank <= 10
"""
