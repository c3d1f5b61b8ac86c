"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

from . import decontam, fim, lm, neardup, secrets, vectors
from .columns import LOWER, UPPER


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PREFERENCE = """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
y AS (SELECT *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM t),
c AS (SELECT conv_id, max(i) FILTER (role = 'assistant') AS place, arg_max(text, i) FILTER (role = 'assistant') AS reply, string_agg(shown, '' ORDER BY i) AS shown, any_value(shown) FILTER (i = 0) AS head FROM y GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY shown, conv_id) AS k, count(*) OVER () AS total FROM c WHERE place IS NOT NULL),
p AS (SELECT a.conv_id AS pair_id, b.conv_id AS other, a.place, b.reply, a.head = b.head AS whole FROM o a JOIN o b ON b.k = a.k % a.total + 1),
x AS (SELECT pair_id, 'chosen' AS side, i, role, text FROM p JOIN t ON t.conv_id = pair_id
  UNION ALL SELECT pair_id, 'rejected', i, role, text FROM p JOIN t ON t.conv_id = other WHERE whole
  UNION ALL SELECT pair_id, 'rejected', i, role, CASE WHEN i = place THEN reply ELSE text END FROM p JOIN t ON t.conv_id = pair_id WHERE NOT whole),
d AS (SELECT pair_id, min(i) AS i FROM x a JOIN x b USING (pair_id, i) WHERE a.side = 'chosen' AND b.side = 'rejected' AND (a.role <> b.role OR a.text <> b.text) GROUP BY 1),
m AS (SELECT pair_id, least(count(*) FILTER (side = 'chosen'), count(*) FILTER (side = 'rejected')) AS n FROM x GROUP BY 1),
q AS (SELECT pair_id, coalesce(d.i, m.n) AS prompt_turns FROM m LEFT JOIN d USING (pair_id)),
r AS (SELECT x.*, prompt_turns, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown, i >= prompt_turns AS tail FROM x JOIN q USING (pair_id)),
s AS (SELECT *, coalesce(sum(length(shown)) OVER (PARTITION BY pair_id, side, tail ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r)
SELECT pair_id, any_value(prompt_turns) AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (NOT tail AND side = 'chosen'), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (tail AND side = 'chosen'), '') AS chosen,
  coalesce(string_agg((pos + 13 + length(role)) || ':' || (pos + length(shown)), ',' ORDER BY i) FILTER (tail AND side = 'chosen' AND role = 'assistant'), '') AS chosen_loss,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (tail AND side = 'rejected'), '') AS rejected,
  coalesce(string_agg((pos + 13 + length(role)) || ':' || (pos + length(shown)), ',' ORDER BY i) FILTER (tail AND side = 'rejected' AND role = 'assistant'), '') AS rejected_loss
FROM s GROUP BY 1"""


def _secrets() -> str:
    """Matches are put between two private-use characters, so their places follow from the lengths of the parts."""
    parts = []
    for k, rule in enumerate(secrets.RULES):
        pattern = rule.pattern
        if k == 0:  # any ASCII case, and no other letters that fold to these
            head, tail = pattern.split(")", 1)
            pattern = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in head) + ")" + tail
        least = f"length(regexp_extract(m, {_quoted(pattern)}, {rule.group})) >= {rule.least}"
        parts.append(
            f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, start, start + length(m) AS stop FROM (
              SELECT doc_id, string_split(piece, chr(57345))[1] AS m, n, sum(length(replace(piece, chr(57345), ''))) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) - length(replace(piece, chr(57345), '')) AS start
              FROM (SELECT doc_id, unnest(pieces) AS piece, unnest(range(len(pieces))) AS n FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), {_quoted('(' + pattern + ')')}, chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS pieces FROM documents))
            ) WHERE n > 0 AND {least}"""
        )
    span = "kind || ':' || start || ':' || stop"
    return f"""WITH s AS ({' UNION ALL '.join(parts)})
      SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        sha256(coalesce(string_agg({span}, ',' ORDER BY start, k) FILTER (k < 3), '')) AS base_sha256, coalesce(string_agg({span}, ',' ORDER BY start, k) FILTER (k IS NOT NULL), '') AS spans
      FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id"""


DECONTAMINATION = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
i AS (SELECT item_id, n, array_to_string(w[s + 1:s + n], ' ') AS win FROM (SELECT item_id, w, least(len(w), {decontam.WINDOW}) AS n, unnest(range(len(w) - least(len(w), {decontam.WINDOW}) + 1)) AS s FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM i), v AS (SELECT doc_id, n, s, array_to_string(w[s + 1:s + n], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, l WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, s, n, item_id FROM v JOIN i USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)"""

LM = f"""WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS w3, unnest(range(len(w))) AS i FROM d),
g AS (SELECT *, lag(w3) OVER o AS w2, lag(w3, 2) OVER o AS w1 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c1 AS (SELECT w3, count(*) AS n1 FROM g GROUP BY 1), c2 AS (SELECT w2, w3, count(*) AS n2 FROM g WHERE i >= 1 GROUP BY 1, 2), c3 AS (SELECT w1, w2, w3, count(*) AS n3 FROM g WHERE i >= 2 GROUP BY 1, 2, 3),
a AS (SELECT g.*, c1.n1, c2.n2, c3.n3, p1.n1 AS h1, p2.n2 AS h2, (SELECT count(*) FROM t) AS total FROM g JOIN c1 USING (w3) LEFT JOIN c2 ON c2.w2 = g.w2 AND c2.w3 = g.w3 LEFT JOIN c3 ON c3.w1 = g.w1 AND c3.w2 = g.w2 AND c3.w3 = g.w3
  LEFT JOIN c1 p1 ON p1.w3 = g.w2 LEFT JOIN c2 p2 ON p2.w2 = g.w1 AND p2.w3 = g.w2),
s AS (SELECT *, CASE WHEN i >= 2 AND n3 >= {lm.LEAST_COUNT} THEN 3 WHEN i >= 1 AND n2 >= {lm.LEAST_COUNT} THEN 2 ELSE 1 END AS level, least(i + 1, 3) AS most FROM a),
f AS (SELECT doc_id, count(*) FILTER (level = most) AS n_known, avg(ln(CASE level WHEN 3 THEN n3 / h2 WHEN 2 THEN n2 / h1 ELSE n1 / total END) + (most - level) * ln({lm.BACKOFF})) AS m FROM s GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_known, 0) AS n_known, round(m, 6) AS lm_score FROM d LEFT JOIN f USING (doc_id)"""

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + n], ' ') AS g FROM (SELECT doc_id, w, least(len(w), {neardup.WORDS}) AS n, unnest(range(len(w) - least(len(w), {neardup.WORDS}) + 1)) AS k FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN z x ON x.doc_id = u JOIN z y ON y.doc_id = v WHERE k >= {neardup.SIMILARITY} * (x.n + y.n - k) - 1e-9),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v)
SELECT doc_id, least(doc_id, coalesce((SELECT min(v) FROM r WHERE u = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM l WHERE u = doc_id) AS n_links FROM d"""



def _vector_codes() -> str:
    """Every round as a full scan of all entries."""
    n = vectors.PARTS
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, v) - 1 AS r, v, len(v) // {n} AS width FROM (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({vectors.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0))""",
        "c AS MATERIALIZED (SELECT r, i // width AS part, i % width AS pos, x FROM (SELECT r, width, unnest(range(len(v))) AS i, unnest(v) AS x FROM k))",
        f"b0 AS MATERIALIZED (SELECT r AS entry, part, pos, x FROM c WHERE r < {vectors.ENTRIES})",
    ]
    for k in range(vectors.ROUNDS + 1):
        near = f"SELECT r, c.part, b.entry, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d FROM c JOIN b{k} b USING (part, pos) GROUP BY 1, 2, 3"
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM ({near}) GROUP BY 1, 2)")
        if k < vectors.ROUNDS:
            steps.append(f"m{k} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM c JOIN a{k} USING (r, part) GROUP BY 1, 2, 3)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - (s % n + n) % n) // n, x) AS x FROM b{k} LEFT JOIN m{k} USING (part, entry, pos))")
    return f"""WITH {', '.join(steps)},
e AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{vectors.ROUNDS} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(x, ',' ORDER BY part, entry, pos)) FROM b{vectors.ROUNDS}) AS codebooks_sha256 FROM k JOIN e USING (r)"""


def _hash(k: int) -> str:
    return f"CAST('0x' || substr(h, {8 * k - 7}, 8) AS BIGINT)"


FIM = f"""WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, length(t) AS n, {_hash(1)} % (length(t) + 1) AS u, {_hash(2)} % (length(t) + 1) AS v,
  CASE WHEN t = '' OR contains(t, '{fim.PREFIX}') OR contains(t, '{fim.SUFFIX}') OR contains(t, '{fim.MIDDLE}') OR {_hash(3)} % 100 >= 90 THEN 'plain' WHEN {_hash(4)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, substr(t, 1, least(u, v)) AS p, substr(t, least(u, v) + 1, abs(u - v)) AS m, substr(t, greatest(u, v) + 1) AS s FROM n)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN least(u, v) END AS prefix_chars, CASE WHEN form <> 'plain' THEN abs(u - v) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{fim.PREFIX}' || p || '{fim.SUFFIX}' || s || '{fim.MIDDLE}' || m ELSE '{fim.SUFFIX}' || s || '{fim.PREFIX}' || p || '{fim.MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS t, url FROM pages),
o AS (SELECT *, CASE WHEN page_id IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY t, page_id IS NULL ORDER BY page_id DESC, url) END AS k, max(page_id) OVER (PARTITION BY t) AS top, sha1(t) AS h FROM p)
SELECT page_id, strlen(t) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to FROM o"""

ORACLES = {
    "op1_preference_formatting": PREFERENCE,
    "op2_secret_scan": _secrets(),
    "op3_decontamination": DECONTAMINATION,
    "op9_lm_scoring": LM,
    "op10_ngram_jaccard_join": NEAR,
    "op11_vector_codes": _vector_codes(),
    "op12_fill_in_middle": FIM,
    "op13_warc_archives": WARC,
}
