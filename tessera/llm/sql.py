"""DuckDB statements for the results of the operators that SQL can express."""

from tessera.llm.licenses import HOLE, HOLES, NOTICE, SPDX_JOIN, SPDX_MARK, known_sentences, rules


def _values(rows) -> str:
    def quote(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(quote, row))})" for row in rows)


EXACT_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n
  FROM documents
), r AS (
  SELECT doc_id, n, count(*) OVER (PARTITION BY n) AS group_size,
         first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM r
"""

LINE_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
  SELECT doc_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM d
), full_lines AS (
  SELECT doc_id, i, x, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
  FROM lines WHERE NOT regexp_full_match(x, '[\x20\x09-\x0D]*')
), win AS (
  SELECT a.doc_id, a.k, a.i AS i0, b.i AS i1, c.i AS i2,
         min((a.doc_id, a.k)) OVER (PARTITION BY a.x, b.x, c.x) AS first_at
  FROM full_lines a JOIN full_lines b ON b.doc_id = a.doc_id AND b.k = a.k + 1
  JOIN full_lines c ON c.doc_id = a.doc_id AND c.k = a.k + 2
), gone AS (
  SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i FROM win WHERE (doc_id, k) > first_at
)
SELECT s.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
       coalesce(string_agg(s.x, chr(10) ORDER BY s.i) FILTER (g.i IS NULL), '') AS text
FROM lines s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.i = s.i
GROUP BY s.doc_id
"""

MIX_SQL = r"""
WITH per AS (
  SELECT source, sum(coalesce(length(text), 0))::DOUBLE AS chars FROM documents GROUP BY source
), rates AS (
  SELECT source, CASE WHEN chars > 0
           THEN sqrt(chars) / (SELECT sum(sqrt(chars)) FROM per) * (SELECT sum(chars) FROM per) / chars
           ELSE 1 END AS rate
  FROM per
), cdf AS (
  SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM rates, LATERAL (SELECT unnest(range(0, ceil(rate + 12 * sqrt(rate) + 51)::BIGINT)) AS k)
), draws AS (
  SELECT doc_id, source, text,
         (('0x' || substr(md5('17|' || doc_id), 1, 13))::BIGINT + 0.5) / pow(2, 52) AS u
  FROM documents
), counts AS (
  SELECT d.doc_id, count(*) AS n FROM draws d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c < d.u
  GROUP BY d.doc_id
), copies AS (SELECT doc_id, unnest(range(n))::INTEGER AS copy FROM counts)
SELECT d.doc_id, d.source, p.copy, md5('17#' || d.doc_id || '#' || p.copy) AS mix_key, d.text
FROM draws d JOIN copies p ON p.doc_id = d.doc_id
"""

SUBSTRING_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), win AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13
), keyed AS (
  SELECT doc_id, k, min(doc_id) OVER (PARTITION BY array_to_string(w[k:k + 12], ' ')) AS first_doc FROM win
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS i FROM keyed WHERE first_doc < doc_id
), gone_list AS (SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(len(g), 0) AS n_removed,
         CASE WHEN g IS NULL THEN d.w
              ELSE list_transform(list_filter(list_zip(d.w, range(1, len(d.w) + 1)), lambda p: NOT list_contains(g, p[2])),
                                  lambda p: p[1]) END AS k
  FROM d LEFT JOIN gone_list USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""

LICENSE_SQL = r"""
WITH known(s, id) AS (VALUES {known}), rule(licence, p) AS (VALUES {rules}), hole(id, a, b) AS (VALUES {holes}),
parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), '{mark}') AS p FROM documents
), lines AS (
  SELECT doc_id, p, list_transform(p, lambda x: regexp_extract(x, '\A[^\r\n]*')) AS l FROM parts
), spdx AS (
  SELECT doc_id, p[1] || coalesce(array_to_string(list_transform(range(2, len(p) + 1), lambda i:
           chr(1) || '{word} ' || regexp_replace(regexp_replace(l[i], '{join}', chr(1) || '{word} ', 'g'), '\+', '-or-later', 'g')
           || chr(1) || substr(p[i], length(l[i]) + 1)), ''), '') AS t
  FROM lines
), cut AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(
           lower(regexp_replace(t, '\n[ \t]*(\p{Lu}\p{Ll})', chr(1) || '\1', 'g')),
           '[.!?;:]+([ \t\n\x0b\f\r]|\z)|\r?\n[ \t\r]*\n', chr(1), 'g'), '[^\p{L}\p{N}\x01]+', ' ', 'g'), chr(1)) AS l
  FROM spdx
), sent AS (
  SELECT doc_id, unnest(list_transform(l, lambda x: trim(regexp_replace(trim(x), '{notice}', 'cited ')))) AS s, unnest(range(len(l))) AS i FROM cut
), full_sent AS (SELECT * FROM sent WHERE s <> ''
), named AS (
  SELECT f.doc_id, f.i, coalesce(h.id, k.id) AS id
  FROM full_sent f LEFT JOIN known k ON k.s = f.s
  LEFT JOIN hole h ON starts_with(f.s, h.a || ' ') AND ends_with(f.s, ' ' || h.b) AND length(f.s) <= length(h.a) + length(h.b) + {hole_size}
), seqs AS (
  SELECT doc_id, count(*) AS n_sentences, count(id) AS n_known,
         coalesce(string_agg(id, '|' ORDER BY i) FILTER (id IS NOT NULL), '') AS sentence_ids
  FROM named GROUP BY doc_id
), found AS (
  SELECT q.doc_id, r.licence, r.p FROM seqs q JOIN rule r ON contains('|' || q.sentence_ids || '|', r.p)
), whole AS (
  SELECT DISTINCT doc_id, licence FROM found f
  WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.doc_id = f.doc_id AND g.p <> f.p AND contains(g.p, f.p))
), names AS (SELECT doc_id, string_agg(licence, ',' ORDER BY licence) AS licenses FROM whole GROUP BY doc_id)
SELECT d.doc_id, coalesce(q.n_sentences, 0) AS n_sentences, coalesce(q.n_known, 0) AS n_known,
       coalesce(q.sentence_ids, '') AS sentence_ids, coalesce(n.licenses, '') AS licenses
FROM documents d LEFT JOIN seqs q USING (doc_id) LEFT JOIN names n USING (doc_id)
"""
for _name, _value in (("known", _values(sorted(known_sentences().items()))), ("rules", _values(rules())), ("holes", _values(HOLES)),
                      ("mark", SPDX_MARK), ("word", SPDX_MARK[:-1]), ("join", SPDX_JOIN), ("notice", NOTICE), ("hole_size", str(HOLE))):
    LICENSE_SQL = LICENSE_SQL.replace("{" + _name + "}", _value)

FILL_MIDDLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), l AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1,
         ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM l
), p AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS m,
         coalesce(array_to_string(u[b + 1:n], ''), '') AS s
  FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || x || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE x || m || s END) AS restored_sha256
FROM p
"""

AUDIT_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
  FROM documents
), f AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c,
         regexp_matches(t, '[#$%&*|]') AS dd, coalesce(first_id < doc_id, false) AS e
  FROM d
), lab AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * dd::INT + 16 * e::INT AS mask, count(*) AS n,
         count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN lab USING (doc_id) GROUP BY ALL
), letter(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders AS (
  SELECT x.l || y.l || z.l || u.l || v.l AS o, [x.bit, y.bit, z.bit, u.bit, v.bit] AS bits
  FROM letter x, letter y, letter z, letter u, letter v
  WHERE x.bit | y.bit | z.bit | u.bit | v.bit = 31 AND x.bit + y.bit + z.bit + u.bit + v.bit = 31
), steps AS (
  SELECT o, unnest(range(1, 6)) AS s, unnest(bits) AS bit, unnest(list_transform(range(1, 6), lambda k: list_sum(bits[1:k - 1]))) AS p
  FROM orders
), counted AS (
  SELECT part, o, s, bit,
         sum(CASE WHEN mask & (bit | coalesce(p, 0)::INT) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit > 0 AND mask & coalesce(p, 0)::INT = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & coalesce(p, 0)::INT > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & coalesce(p, 0)::INT = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit > 0 AND mask & coalesce(p, 0)::INT = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, steps GROUP BY ALL
)
SELECT part, o AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
