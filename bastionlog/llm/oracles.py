"""DuckDB SQL for the queries of this package that SQL can express.

Without SQL: toxicity and quality (trained models), neighbours (an approximate search), simhash (XXH64 and
components), bpe and packing (merges). They are tested against brute force, round trips or held-out labels.
"""

from __future__ import annotations

from bastionlog.llm.secrets import BASE_RULES, RULES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WARC = """
WITH digests AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first,
    list_aggregate(list_transform(range(40), lambda i: lpad(bin(instr('0123456789abcdef', hex[i + 1]) - 1), 4, '0')), 'string_agg', '') AS b
  FROM digests
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * b[5 * j + 1]::INT + 8 * b[5 * j + 2]::INT + 4 * b[5 * j + 3]::INT + 2 * b[5 * j + 4]::INT + b[5 * j + 5]::INT, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM bits
"""


def secret_sql() -> str:
    branches = []
    for number, rule in enumerate(RULES):
        pattern = quoted(rule.pattern)
        branches.append(f"""
  SELECT doc_id, {number} AS ord, '{rule.kind}' AS kind, unnest(regexp_split_to_array(t, {pattern})[:-2]) AS gap,
    unnest(regexp_extract_all(t, {pattern}, 0)) AS hit, unnest(regexp_extract_all(t, {pattern}, {rule.group})) AS tested,
    unnest(range(len(regexp_extract_all(t, {pattern}, 0)))) AS i, {rule.least} AS least
  FROM d WHERE regexp_matches(t, {pattern})""")
    counts = ", ".join(
        f"count(*) FILTER (kind = '{rule.kind}')::BIGINT AS n_{rule.kind}" for rule in BASE_RULES
    )
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(branches)}),
ended AS (
  SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, ord ORDER BY i) AS stop FROM hits
), spans AS (
  SELECT doc_id, ord, kind, (stop - length(hit))::BIGINT AS start, stop::BIGINT AS stop FROM ended WHERE length(tested) >= least
)
SELECT d.doc_id, {counts}, sha256(coalesce({listed} FILTER (ord < {len(BASE_RULES)}), '')) AS base_sha256,
  coalesce({listed} FILTER (kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""


CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\e'), '</turn>', '<\t/turn>'), '##', '#\h#') AS et,
    replace(replace(replace(replace(role, '\', '\e'), '</turn>', '<\t/turn>'), '##', '#\h#'), ':', '\c') AS er
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || er || ': ' || et || '</turn>' || chr(10)))::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(role, ' ' ORDER BY turn, role, text), '(system )?user( assistant user)*( assistant)?') AS valid
FROM e GROUP BY conv_id
"""

SUBSTRINGS = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), said AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d
), starts AS (
  SELECT doc_id, p, lead(p, 19) OVER own IS NOT NULL AS whole,
    concat_ws(' ', word, LEADS) AS passage
  FROM said WINDOW own AS (PARTITION BY doc_id ORDER BY p)
), ranked AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY md5(passage) ORDER BY doc_id, p) AS n FROM starts WHERE whole
), last AS (
  SELECT s.doc_id, s.p, s.word, max(r.p) OVER (PARTITION BY s.doc_id ORDER BY s.p) AS latest
  FROM said s LEFT JOIN ranked r ON s.doc_id = r.doc_id AND s.p = r.p AND r.n > 1
), kept AS (
  SELECT doc_id, count(*) FILTER (latest + 19 >= p) AS n_removed,
    string_agg(word, ' ' ORDER BY p) FILTER (latest IS NULL OR latest + 19 < p) AS words
  FROM last GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.words, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
""".replace("LEADS", ", ".join(f"lead(word, {k}) OVER own" for k in range(1, 20)))

DECONTAMINATION = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), placed AS (
  SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0
), wanted AS (
  SELECT DISTINCT item_id, n, md5(array_to_string(w[i:i + n - 1], ' ')) AS k FROM placed
), sizes AS (
  SELECT DISTINCT n FROM wanted
), starts AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
), met AS (
  SELECT doc_id, i, n, item_id
  FROM (SELECT doc_id, i, n, md5(array_to_string(w[i:i + n - 1], ' ')) AS k FROM starts) JOIN wanted USING (n, k)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM met) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

PREFIXES = r"""
WITH slim AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, strlen(coalesce(text, ''))::BIGINT AS size,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS said
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'said': said, 'size': size} ORDER BY turn NULLS FIRST, role, said) AS turns,
    xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda s, b: list_reduce(list_concat([xor(s, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda t, z: xor(t >> 1, 3988292384 * (t & 1))))) % 9 AS h
  FROM slim GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(b.turns, [])[1:o.h], o.turns[o.h + 1:]) AS turns
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), member AS (
  SELECT conv_id, len(turns) AS whole, d, md5(list_aggregate(list_transform(turns[1:d], lambda t: t.said), 'string_agg', ',')) AS node,
    md5(list_aggregate(list_transform(turns[1:d - 1], lambda t: t.said), 'string_agg', ',')) AS up, CASE WHEN d > 0 THEN turns[d].size ELSE 0 END AS size
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, coalesce(node, '') AS node, CASE WHEN d > 0 THEN coalesce(up, '') END AS up, min(conv_id) AS conv_id, count(*) AS n,
    (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole = d), '')) AS ends
  FROM member GROUP BY ALL
), children AS (
  SELECT up AS node, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), sized AS (
  SELECT nodes.*, coalesce(c.n, 0) AS n_children FROM nodes LEFT JOIN children c USING (node, d)
), below AS (
  SELECT m.node, m.d, sum(s.saved) AS saved, count(*) FILTER (s.n_children = 0) AS leaves
  FROM sized s JOIN (SELECT conv_id, d, coalesce(node, '') AS node FROM member) m ON m.conv_id = s.conv_id AND m.d <= s.d
  GROUP BY ALL
)
SELECT s.conv_id, s.d::BIGINT AS depth, p.conv_id AS parent_conv_id, s.n::BIGINT AS n_convs, s.n_children::BIGINT AS n_children,
  b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, s.ends AS ends_sha256
FROM sized s JOIN below b USING (node, d) LEFT JOIN nodes p ON p.node = s.up AND p.d = s.d - 1
"""

COLLOCATIONS = rf"""
WITH said AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), totals AS (
  SELECT lang, sum(len(w)) AS n FROM said GROUP BY lang
), often AS (
  SELECT lang, k, phrase, count(*) AS a
  FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM said, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k))
  GROUP BY ALL HAVING count(*) >= 100
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS w FROM often WHERE k > 1
), cuts AS (
  SELECT c.lang, c.phrase, c.w, c.a, c.cut, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN often l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN often r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.cut + 1:], ' ')
  JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), within AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates)) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
  r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM lowest LEFT JOIN within USING (lang, phrase) WHERE NOT coalesce(100 * longer >= 100 * a, false)
QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_warc": WARC,
    "op6_secrets": secret_sql(),
    "op8_chat": CHAT,
    "op9_substrings": SUBSTRINGS,
    "op10_decontaminate": DECONTAMINATION,
    "op12_prefixes": PREFIXES,
    "op13_collocations": COLLOCATIONS,
}
