"""The queries as SQL for an independent engine, where SQL can express them."""

from __future__ import annotations

SPACE_WORDS = r"'[^\x20\x09-\x0D]+'"
LOWER_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
FOLDED = ("translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

OP2 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLDED.format("coalesce(text, '')")}, {LOWER_WORDS}) w
           FROM documents),
b AS (SELECT item_id, regexp_extract_all({FOLDED.format("coalesce(text, '')")}, {LOWER_WORDS}) w
      FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS span
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) i
             FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS span
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i
             FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, span FROM dw WHERE span IN (SELECT span FROM iw)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) p FROM hits) GROUP BY doc_id),
listed AS (SELECT doc_id, count(*) AS n_items,
                  string_agg(item, ',' ORDER BY item COLLATE "C") AS items
           FROM (SELECT DISTINCT h.doc_id, CAST(iw.item_id AS VARCHAR) AS item
                 FROM hits h JOIN iw USING (span)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id LEFT JOIN listed l ON l.doc_id = d.doc_id
""".replace(' COLLATE "C"', "")

_RUN = """
r{n} AS (SELECT doc_id, count(*) AS words, sum(chars) AS chars FROM
         (SELECT DISTINCT t.doc_id, t.i, t.chars FROM tok t JOIN
          (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c
            FROM (SELECT doc_id, i, array_to_string(w[i:i + {n} - 1], ' ') AS g FROM
              (SELECT doc_id, w, unnest(generate_series(1, len(w) - {n} + 1)) i
               FROM d WHERE len(w) >= {n}))) WHERE c > 1) s
          ON t.doc_id = s.doc_id AND t.i BETWEEN s.i AND s.i + {n} - 1) GROUP BY doc_id)"""

OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS low FROM p WHERE octet_length(b) >= 100 GROUP BY d)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN low < page_id THEN low END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), {SPACE_WORDS}) w FROM documents),
tok AS (SELECT doc_id, i, length(w[i]) AS chars
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) i FROM d WHERE len(w) > 0)),
total AS (SELECT doc_id, sum(chars) AS word_chars FROM tok GROUP BY doc_id),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS k
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, {SPACE_WORDS})),
dup AS (SELECT doc_id, count(*) AS n_dup_lines,
               sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars
        FROM lines WHERE k > 1 GROUP BY doc_id),
{",".join(_RUN.format(n=n) for n in (3, 5, 8, 10))},
f AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(word_chars, 0) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r3.words, 0) AS n_repeat_words,
        coalesce(dup.chars, 0) AS cl, coalesce(r5.chars, 0) AS c5, coalesce(r8.chars, 0) AS c8,
        coalesce(r10.chars, 0) AS c10
      FROM d LEFT JOIN total USING (doc_id) LEFT JOIN dup USING (doc_id)
        LEFT JOIN r3 USING (doc_id) LEFT JOIN r5 USING (doc_id) LEFT JOIN r8 USING (doc_id)
        LEFT JOIN r10 USING (doc_id)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND 100 * cl <= 40 * word_chars AND 100 * c5 <= 50 * word_chars
    AND 100 * c8 <= 45 * word_chars AND 100 * c10 <= 40 * word_chars AS kept
FROM g
"""

OP7 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACE_WORDS}) w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS span
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) i
              FROM d WHERE len(w) >= 50)),
firsts AS (SELECT md5(span) AS k, min(doc_id) AS low, max(doc_id) AS high FROM win GROUP BY 1),
late AS (SELECT win.doc_id, win.i FROM win JOIN firsts ON md5(win.span) = firsts.k
         WHERE low < high AND win.doc_id > low),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM late),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
left_over AS (SELECT d.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
    CASE WHEN ps IS NULL THEN w ELSE
      list_filter(list_transform(generate_series(1, len(w)),
        lambda j: CASE WHEN list_contains(ps, j) THEN NULL ELSE w[j] END), lambda x: x IS NOT NULL)
    END AS kept FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM left_over
"""

OP8 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({FOLDED.format("coalesce(text, '')")}, {SPACE_WORDS}) w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) i
            FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
           FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
         WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS seen FROM both_ways
          UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
comp AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       coalesce(component_id, d.doc_id) AS component_id,
       coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.node = d.doc_id
"""

OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text,
                  string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
win AS (SELECT doc_id, i, array_to_string(l[i:i + 2], chr(10)) AS w
        FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 2)) i FROM d WHERE len(l) >= 3)
        WHERE regexp_matches(w, '[^\x20\x09-\x0D]')),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (
           PARTITION BY w ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 2)) AS line FROM late),
each AS (SELECT doc_id, i, l[i] AS line
         FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) i FROM d)),
kept AS (SELECT e.doc_id, count(g.line) AS n_removed,
                string_agg(CASE WHEN g.line IS NULL THEN e.line END, chr(10) ORDER BY e.i) AS text
         FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.line = e.i GROUP BY e.doc_id)
SELECT d.doc_id, CAST(CASE WHEN d.text = '' THEN 0 ELSE len(l) END AS BIGINT) AS n_lines,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang,
  CASE WHEN contains(b, ' | ') THEN 'table' WHEN regexp_matches(b, '(?i)licen[sc]e') THEN 'legal'
       WHEN regexp_matches(b, '[0-9]{2}') THEN 'figures' ELSE 'prose' END AS topic,
  len(regexp_extract_all(b, '[^\x20\x09-\x0D]+')) AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS b FROM documents)),
cell AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
s AS (SELECT source, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) OVER () AS t0 FROM cell GROUP BY 1),
l AS (SELECT lang, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) OVER () AS t1 FROM cell GROUP BY 1),
t AS (SELECT topic, sqrt(sum(tokens)) / sum(sqrt(sum(tokens))) OVER () AS t2 FROM cell GROUP BY 1),
start AS (SELECT source, lang, topic, tokens, t0, t1, t2, tokens AS weight
          FROM cell JOIN s USING (source) JOIN l USING (lang) JOIN t USING (topic)),
rake AS (
  SELECT 0 AS k, source, lang, topic, tokens, t0, t1, t2, weight FROM start
  UNION ALL
  SELECT k + 1, source, lang, topic, tokens, t0, t1, t2,
         w2 * t2 / sum(w2) OVER (PARTITION BY topic) FROM
   (SELECT *, w1 * t1 / sum(w1) OVER (PARTITION BY lang) AS w2 FROM
     (SELECT *, weight * t0 / sum(weight) OVER (PARTITION BY source) AS w1
      FROM rake WHERE k < 40))),
f AS (SELECT source, lang, topic, tokens, weight / tokens AS factor FROM rake WHERE k = 40 AND tokens > 0),
scale AS (SELECT 0 AS k, CAST(0 AS DOUBLE) AS v UNION ALL
  SELECT k + 1, (0.5 * t - held) / rest FROM
   (SELECT scale.k, sum(tokens) AS t,
      sum(CASE WHEN factor * v >= 1 THEN tokens ELSE 0 END) AS held,
      sum(CASE WHEN factor * v >= 1 THEN 0 ELSE tokens * factor END) AS rest
    FROM f, scale WHERE scale.k < 60 GROUP BY scale.k, scale.v)),
p AS (SELECT source, lang, topic, round(least(1.0, factor * v), 12) AS p
      FROM f, scale WHERE k = 60)
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens,
  round(coalesce(p, 1.0), 6) AS probability,
  CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0
    < coalesce(p, 1.0) AS kept
FROM d LEFT JOIN p USING (source, lang, topic)
"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS digest,
             regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n,
        CAST('0x' || substr(digest, 1, 8) AS BIGINT) % (len(u) + 1) AS c1,
        CAST('0x' || substr(digest, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
               OR CAST('0x' || substr(digest, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
             WHEN CAST('0x' || substr(digest, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm'
             ELSE 'psm' END AS form FROM d),
cut AS (SELECT doc_id, t, n, form, array_to_string(u[1:least(c1, c2)], '') AS p,
          array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
          array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM h)
SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
         ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM cut
"""

QUERIES = {"op2_decontamination": OP2, "op4_warc": OP4, "op5_quality_rules": OP5, "op7_substring_dedup": OP7,
           "op8_minhash": OP8, "op9_mixing": OP9,
           "op10_line_dedup": OP10, "op12_fill_middle": OP12}
