"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .license_texts import DIGESTS, TEXTS
from .licenses import COPYRIGHT_LINE, NOT_WORD, PHRASES, SPELLINGS
from .mixing import WEIGHTS
from .queries import CONTROL_TEXT


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _replaced(x: str, pairs) -> str:
    for a, b in pairs:
        x = f"replace({x}, ' {a} ', ' {b} ')"
    return x


def _license_words(text: str) -> str:
    body = f"regexp_replace({text}, {_quote(COPYRIGHT_LINE)}, '', 'g')"
    form = f"' ' || replace(lower(regexp_replace({body}, {_quote(NOT_WORD)}, ' ', 'g')), chr(10), ' ' || chr(10) || ' ') || ' '"
    return _replaced(form, SPELLINGS)


def _license_form(words: str) -> str:
    return f"trim({_replaced(f"regexp_replace(' ' || {words} || ' ', '[ \n]+', ' ', 'g')", PHRASES)}, ' ')"


_KNOWN = ", ".join(f"({_quote(i)}, {_quote(t)}, NULL)" for i, t in TEXTS) + "".join(f", ({_quote(i)}, NULL, {_quote(d)})" for i, d in DIGESTS)

OP1 = f"""
WITH known(license_id, text, digest) AS (VALUES {_KNOWN}),
known_words AS (SELECT license_id, digest, {_license_words('text')} AS words FROM known),
digests AS (SELECT coalesce(digest, sha256({_license_form('words')})) AS digest, min(license_id) AS license_id FROM known_words GROUP BY 1),
w AS (SELECT doc_id, {_license_words('text')} AS words FROM documents WHERE text IS NOT NULL),
whole AS (SELECT doc_id, true AS whole, words FROM w),
line AS (SELECT doc_id, false AS whole, unnest(string_split(words, chr(10))) AS words FROM w),
parts AS (SELECT doc_id, whole, {_license_form('words')} AS form FROM (SELECT * FROM whole UNION ALL SELECT * FROM line)),
found AS (SELECT doc_id, whole, license_id FROM parts JOIN digests ON sha256(form) = digests.digest WHERE form != ''),
per AS (SELECT doc_id, min(license_id) FILTER (whole) AS text_license, count(*) FILTER (NOT whole) AS n,
  coalesce(string_agg(DISTINCT license_id, ',' ORDER BY license_id) FILTER (NOT whole), '') AS names FROM found GROUP BY doc_id)
SELECT d.doc_id, text_license, coalesce(names, '') AS line_licenses, coalesce(n, 0) AS n_license_lines
FROM documents d LEFT JOIN per ON d.doc_id = per.doc_id"""

OP2 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {_quote(CONTROL_TEXT)}), (-1, 1, 'assistant', {_quote(CONTROL_TEXT)})),
o AS (SELECT *, row_number() OVER w AS k, coalesce(lag(role) OVER w, '') AS before, lead(role) OVER w IS NULL AS last FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (SELECT *, NOT ((before = '' AND k = 1 AND role IN ('system', 'user')) OR (before = 'system' AND k > 1 AND role = 'user') OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user')) OR (last AND role != 'assistant') AS refused FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars,
  NOT bool_or(refused) AS valid, min(k - 1) FILTER (refused) AS error_turn
FROM f GROUP BY conv_id"""

OP5 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f"""

OP6 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, coalesce(length(text), 0) AS chars FROM documents),
q AS (SELECT doc_id, source, size, CASE WHEN chars / greatest(size, 1) BETWEEN 3 AND 12 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS quality FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM q GROUP BY source),
w AS (SELECT *, [{', '.join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 150 / 100 - coalesce(sum(source_size) OVER r, 0) * 2)::DOUBLE / ((sum(w) OVER ()) - coalesce(sum(w) OVER r, 0)) AS level
  FROM w WINDOW r AS (ORDER BY source_size * 2 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
final AS (SELECT level FROM l WHERE source_size * 2 > level * w ORDER BY source_size * 2 / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, n, CASE WHEN (SELECT level FROM final) IS NULL THEN source_size * 2.0::DOUBLE ELSE least(source_size * 2.0::DOUBLE, (SELECT level FROM final) * w) END AS target FROM l),
k AS (SELECT q.*, t.source_size, t.target, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || 'mix'), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE) / quality AS key FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
  CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::BIGINT - epochs * source_size - ahead)))::BIGINT AS taken FROM c"""

OP9 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
low AS (SELECT a, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(low.c, d.doc_id) AS component_id, coalesce(low.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN low ON low.a = d.doc_id"""

ORACLES = {"op1_license_scan": OP1, "op2_chat_format": OP2, "op5_warc": OP5, "op6_mixing": OP6, "op9_minhash": OP9}
