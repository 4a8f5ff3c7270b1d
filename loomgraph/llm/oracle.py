"""DuckDB SQL of the operators that SQL can express: op4, op6, op9, op10 and op11. The others learn, need a
tokenizer, or hash with XXH64."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[^\x20\x09-\x0D]+"
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


OP4 = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 20], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 19)) AS i FROM w)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM f WHERE r > 1),
p AS (SELECT doc_id, i, ws[i + 1] AS word FROM (SELECT doc_id, ws, unnest(range(0, len(ws))) AS i FROM w)),
k AS (SELECT p.doc_id, CAST(count(gone.i) AS BIGINT) AS n_removed, string_agg(CASE WHEN gone.i IS NULL THEN word END, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""

OP6 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, 15 + length(regexp_replace(role, '(\\|###|</turn>|:)', 'x\1', 'g')) + length(regexp_replace(text, '(\\|###|</turn>)', 'x\1', 'g')) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM c),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""

OP9 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_low("text")}, '{SPACE}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 5], ' ') AS k FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE range(0, greatest(1, len(ws) - 4)) END) AS i FROM w)),
n AS (SELECT w.doc_id, count(s.k) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT r.doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(reach) AS component_id FROM r JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

LINKS = f"""WITH w AS (SELECT doc_id, regexp_extract_all({_low("text")}, '{SPACE}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 5], ' ') AS k FROM (SELECT doc_id, ws, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE range(0, greatest(1, len(ws) - 4)) END) AS i FROM w)),
n AS (SELECT w.doc_id, count(s.k) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b, common = x.n AND common = y.n AS same FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
c AS (SELECT n.doc_id, n.n, least(n.doc_id, coalesce(min(e.b) FILTER (WHERE e.same), n.doc_id)) AS class_id FROM n LEFT JOIN e ON e.a = n.doc_id GROUP BY n.doc_id, n.n)
SELECT c.doc_id, CAST(any_value(c.n) AS BIGINT) AS n_shingles, any_value(c.class_id) AS class_id, CAST(count(DISTINCT o.class_id) FILTER (WHERE NOT e.same) AS BIGINT) AS n_classes, CAST(count(e.b) AS BIGINT) AS n_links
FROM c LEFT JOIN e ON e.a = c.doc_id LEFT JOIN c o ON o.doc_id = e.b GROUP BY c.doc_id"""

OP10 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_low("text")}, '{PLAIN}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_low("text")}, '{PLAIN}') AS ws FROM benchmark),
v AS (SELECT DISTINCT item_id, least(13, len(ws)) AS size, array_to_string(ws[i + 1:i + least(13, len(ws))], ' ') AS k FROM (SELECT item_id, ws, unnest(range(0, greatest(1, len(ws) - 12))) AS i FROM b WHERE len(ws) > 0)),
g AS (SELECT doc_id, size, i, array_to_string(ws[i + 1:i + size], ' ') AS k FROM (SELECT doc_id, ws, size, unnest(range(0, len(ws) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM v))),
h AS (SELECT g.doc_id, g.i, g.size, v.item_id FROM g JOIN v ON v.size = g.size AND v.k = g.k),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM h) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN own ON own.doc_id = d.doc_id"""

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
OP11 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNITS}') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT doc_id, text, u, len(u) AS n, {", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT doc_id, n, form, text, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
