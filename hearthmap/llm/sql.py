"""The same queries in SQL (DuckDB), where SQL can express them.

Language models, tokenizers and passages are beyond SQL; tests hold those queries against brute force.
"""

from hearthmap.llm import infill, lines, mixing, preferences

_WORDS = r"'[^\x20\x09-\x0D]+'"


def _closure(links: str) -> str:
    """CTEs ``reach`` and ``roots`` over a CTE ``links(a, b)`` that has both directions."""
    return f"""links AS ({links}),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        roots AS (SELECT a, least(a, min(b)) AS root FROM reach GROUP BY a)"""


_QUALITY = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT doc_id, text, regexp_extract_all(text, {_WORDS}) AS w FROM texts),
grams AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
          FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS p FROM worded)),
often AS (SELECT doc_id, g FROM grams GROUP BY 1, 2 HAVING count(*) > 1),
marked AS (SELECT doc_id, count(DISTINCT q) AS n FROM (
             SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM grams JOIN often USING (doc_id, g)) GROUP BY 1),
split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
lined AS (SELECT doc_id, line, regexp_extract_all(line, {_WORDS}) AS w FROM split),
judged AS (SELECT doc_id, line, len(w) AS n, len(w) > 0 AND (
               right(w[len(w)], 1) NOT IN ({", ".join("'" + c.replace("'", "''") + "'" for c in lines.CLOSING)})
               OR 100 * (length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) > {lines.SYMBOL_PERCENT} * length(line)
               OR 100 * len([x FOR x IN w IF suffix(x, '!!')]) > {lines.SHOUT_PERCENT} * len(w)
               OR len([x FOR x IN w IF x IN {lines.SEPARATOR_WORDS}]) >= {lines.NAVIGATION_MARKS}
               OR {" OR ".join(f"contains(lower(line), '{p}')" for p in lines.BOILERPLATE)}) AS failed FROM lined),
counted AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (failed) AS n_failed_lines,
              coalesce(sum(n) FILTER (failed), 0) AS n_lost_words,
              count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines FROM judged GROUP BY 1),
figures AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0) AS word_chars,
              length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, n_dup_lines,
              coalesce(marked.n, 0) AS n_repeat_words, n_lines, n_failed_lines, n_lost_words
            FROM worded JOIN counted USING (doc_id) LEFT JOIN marked USING (doc_id)),
base AS (SELECT *, n_words < {lines.LEAST_WORDS} OR 100 * n_repeat_words > {lines.REPEAT_PERCENT} * n_words AS base_failed FROM figures)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_lost_words <= {lines.LOST_PERCENT} * n_words AS kept, n_lines, n_failed_lines,
  CAST(n_lost_words AS BIGINT) AS n_lost_words FROM base"""

_NEAR = rf"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
shingled AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s FROM (
  SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS p FROM worded WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingled x JOIN shingled y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
{_closure("SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 75 * (x.n + y.n - c.n)")}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, d.doc_id = coalesce(root, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN roots r ON r.a = d.doc_id"""

_VECTORS = f"""
WITH RECURSIVE given AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sound AS (SELECT * FROM given WHERE len(v) > 0 AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0
          AND len([x FOR x IN v IF x <> 0]) > 0),
{_closure("SELECT x.vec_id AS a, y.vec_id AS b FROM sound x JOIN sound y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.9")},
counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, vec_id = coalesce(root, vec_id) AS kept
FROM given LEFT JOIN roots r ON r.a = vec_id LEFT JOIN counts c ON c.a = vec_id"""

_MIX = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS size FROM documents),
by_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
weighed AS (SELECT *, {list(mixing.WEIGHTS)}[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS INT) + 1] AS weight,
  {mixing.MOST_COPIES} * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM by_source),
run AS (SELECT *, CAST(coalesce(sum(cap) OVER upto, 0) AS BIGINT) AS capped,
  CAST(sum(weight) OVER () - coalesce(sum(weight) OVER upto, 0) AS BIGINT) AS weights FROM weighed
  WINDOW upto AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT capped AS c, weights AS w FROM run WHERE (total - capped) * weight / weights <= cap ORDER BY 1, 2 LIMIT 1),
wanted AS (SELECT source, source_size, CASE WHEN capped >= c THEN least((total - c) * weight / w, CAST(cap AS DOUBLE)) ELSE CAST(cap AS DOUBLE) END AS target FROM run, level),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(CAST(doc_id AS VARCHAR)), doc_id) AS r,
  CAST('0x' || substr(md5('{mixing.SEED}|' || coalesce(source, chr(0))), 1, 8) AS UBIGINT) / 4294967296.0 AS o FROM sized),
rated AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN least(target / source_size, {mixing.MOST_COPIES}.0) ELSE 0.0 END AS rate
          FROM ranked r JOIN wanted t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size > 0 THEN least(floor(r * rate + o) - floor((r - 1) * rate + o), {mixing.MOST_COPIES}) ELSE 0 END AS BIGINT) * size AS taken
FROM rated"""

_ROLE = preferences.LEARNED_ROLE

_CHAT = f"""
WITH turns AS (SELECT conv_id, turn, role, text FROM conversations),
last AS (SELECT conv_id, max(turn) AS last_turn FROM turns WHERE role = '{_ROLE}' GROUP BY 1),
answer AS (SELECT t.conv_id, last_turn, max(t.text) AS text FROM turns t JOIN last l ON t.conv_id = l.conv_id AND turn = last_turn
           WHERE role = '{_ROLE}' GROUP BY 1, 2),
sides AS (
  SELECT t.conv_id AS pair_id, 'chosen' AS side, turn, role, t.text FROM turns t
  UNION ALL SELECT t.conv_id, 'rejected', turn, role, t.text FROM turns t LEFT JOIN answer a ON t.conv_id = a.conv_id
  WHERE last_turn IS NULL OR turn < last_turn
  UNION ALL SELECT a.conv_id, 'rejected', a.last_turn, '{_ROLE}', b.text FROM answer a JOIN answer b ON b.conv_id = xor(a.conv_id, 1)),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS p,
             '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS head, coalesce(text, '') AS body,
             chr(10) || '<|end|>' || chr(10) AS tail FROM sides),
differing AS (SELECT pair_id, min(p) AS p FROM (
    SELECT pair_id, p FROM placed GROUP BY 1, 2 HAVING count(*) < 2 OR min(role) <> max(role) OR min(body) <> max(body)) GROUP BY 1),
prefixed AS (SELECT placed.*, coalesce(d.p - 1, max(placed.p) OVER (PARTITION BY placed.pair_id)) AS n FROM placed LEFT JOIN differing d USING (pair_id)),
spanned AS (SELECT *, CAST(coalesce(sum(length(head || body || tail)) FILTER (p > n) OVER (PARTITION BY pair_id, side ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + length(head) AS a FROM prefixed)
SELECT pair_id, max(n) AS n_prompt_turns,
  coalesce(string_agg(head || body || tail, '' ORDER BY p) FILTER (p <= n AND side = 'chosen'), '') AS prompt,
  {", ".join(f"coalesce(string_agg(head || body || tail, '' ORDER BY p) FILTER (p > n AND side = '{s}'), '') AS {s}, coalesce(string_agg(a || '-' || (a + length(body)), ' ' ORDER BY p) FILTER (p > n AND side = '{s}' AND role = '{_ROLE}'), '') AS {s}_mask" for s in ("chosen", "rejected"))},
  count(*) FILTER (p > n) = 0 AS identical
FROM spanned GROUP BY 1"""

_P, _S, _M = infill.MARKS

_INFILL = f"""
WITH drawn AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
  sha256('{infill.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
numbered AS (SELECT *, {", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))} FROM drawn),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '{_P}') OR contains(t, '{_S}') OR contains(t, '{_M}') OR h3 % 100 >= {infill.REORDERED_PERCENT} THEN 'plain'
       WHEN h4 % 100 < {infill.SUFFIX_FIRST_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM numbered),
parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{_P}' || p || '{_S}' || s || '{_M}' || m ELSE '{_S}' || s || '{_P}' || p || '{_M}' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM parts"""

ORACLE: dict[str, str] = {
    "op3_quality_rules": _QUALITY,
    "op5_minhash_dedup": _NEAR,
    "op7_embedding_dedup": _VECTORS,
    "op8_source_mix": _MIX,
    "op10_chat_format": _CHAT,
    "op12_fill_in_middle": _INFILL,
}
