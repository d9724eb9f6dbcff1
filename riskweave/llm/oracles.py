"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

#: Words of a text, mixing weights and limit: the same values as in ``common`` and ``mixing``.
MIX = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix-1' || coalesce(':' || doc_id, '')) AS order_key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM sized GROUP BY source),
weighted AS (
  SELECT *, CAST([5, 2, 1][(source_rank - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sources),
levels AS (
  SELECT *, 3 * source_size / weight AS full_at,
         (total - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 3 * source_size / weight, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
targets AS (
  SELECT *, least(CAST(3 * source_size AS DOUBLE), weight * (
           SELECT level FROM levels WHERE level <= full_at ORDER BY full_at, source_rank LIMIT 1)) AS target,
         greatest(1, least(64, total // 10000)) AS block_words FROM levels),
alive AS (SELECT *, CAST(round(total / block_words) AS BIGINT) AS blocks FROM targets WHERE target > 0),
-- the quotients of every seat that could be won, ranked as a whole
quotients AS (
  SELECT source_rank, blocks, target / (2 * seat + 1) AS quotient, seat
  FROM (SELECT *, unnest(range(0, CAST(ceil(target / block_words) AS BIGINT) + 2)) AS seat FROM alive)),
awarded AS (
  SELECT source_rank, CAST(count(*) AS BIGINT) AS source_blocks
  FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, source_rank, seat) AS place FROM quotients) WHERE place <= blocks GROUP BY 1),
plan AS (
  SELECT t.*, coalesce(a.source_blocks, 0) AS source_blocks,
         least(coalesce(a.source_blocks, 0) * block_words, 3 * source_size) AS source_taken
  FROM targets t LEFT JOIN awarded a USING (source_rank)),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.source_blocks, p.block_words, p.source_taken,
         coalesce(sum(s.size) OVER (PARTITION BY p.source_rank ORDER BY s.order_key, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(source_blocks AS BIGINT) AS source_blocks, CAST(block_words AS BIGINT) AS block_words,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (source_taken // source_size) * size
         + greatest(0, least(size, source_taken - (source_taken // source_size) * source_size - start)) END AS BIGINT) AS taken
FROM placed
"""

REPETITION = r"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
counted AS (SELECT doc_id, len(w) AS n, length(array_to_string(w, '')) AS word_chars, greatest(51, len(w) // 10 + 1) AS long_words,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM split),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split),
grams AS (SELECT words.*, n, long_words,
    word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS gram,
    CASE WHEN p + long_words - 1 <= n THEN md5(string_agg(word, ' ') OVER (
      PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND long_words - 1 FOLLOWING)) END AS long_gram
  FROM words JOIN counted USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
twice AS (SELECT *, gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, gram) > 1 AS again,
    long_gram IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, long_gram) > 1 AS long_again FROM grams),
covered AS (SELECT doc_id, word, long_again, coalesce(max(CASE WHEN again THEN p END) OVER (
    PARTITION BY doc_id ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) > 0 AS inside FROM twice),
summed AS (SELECT doc_id, count(*) FILTER (inside) AS repeat_words, coalesce(sum(length(word)) FILTER (inside), 0) AS covered_chars,
    bool_or(long_again) AS long_repeat FROM covered GROUP BY doc_id),
judged AS (SELECT doc_id, n, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS dup_lines, coalesce(repeat_words, 0) AS repeat_words,
    coalesce(covered_chars, 0) AS covered_chars, coalesce(long_repeat, false) AS long_repeat FROM counted LEFT JOIN summed USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(dup_lines AS BIGINT) AS n_dup_lines, CAST(repeat_words AS BIGINT) AS n_repeat_words,
  n < 10 OR 100 * repeat_words > 20 * n AS base_failed, CAST(covered_chars AS BIGINT) AS covered_chars,
  NOT (n < 10 OR 100 * repeat_words > 20 * n OR 100 * covered_chars > 20 * word_chars OR long_repeat) AS kept
FROM judged
"""

#: Every window of fifty words that occurs twice in the corpus, joined to spans.
PASSAGES = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split WHERE len(w) >= 50),
windows AS (SELECT doc_id, p, n, CASE WHEN p + 49 <= n THEN md5(string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) END AS h FROM words),
again AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM windows WHERE h IS NOT NULL) WHERE c > 1),
begun AS (SELECT *, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, 0) AS apart FROM again),
numbered AS (SELECT *, sum(CAST(apart AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM begun)
SELECT doc_id, CAST(min(p) - 1 AS INTEGER) AS start, CAST(max(p) + 49 AS INTEGER) AS until FROM numbered GROUP BY doc_id, span
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split),
grams AS (SELECT doc_id, n, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o
    || ' ' || lead(word, 4) OVER o AS gram FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
shingles AS (SELECT DISTINCT doc_id, gram FROM grams WHERE gram IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM split WHERE len(w) BETWEEN 1 AND 4),
sizes AS (SELECT doc_id, count(gram) AS n FROM (SELECT doc_id FROM documents) LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 75 * (s.n + t.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.other)
SELECT doc_id, n AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""

#: Links of sets of four-word shingles at 85 in a hundred, followed to the least id.
NGRAM_JOIN = r"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM split WHERE len(w) >= 4),
grams AS (SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS gram
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
shingles AS (SELECT DISTINCT doc_id, gram FROM grams WHERE gram IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM split WHERE len(w) BETWEEN 1 AND 3),
sizes AS (SELECT doc_id, count(gram) AS n FROM (SELECT doc_id FROM documents) LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * c >= 85 * (s.n + t.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT r.doc_id, w.b FROM reached r JOIN ways w ON w.a = r.other)
SELECT doc_id, n AS n_shingles, min(other) AS component_id FROM reached JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""


def centroids_sql(rounds: int = 3) -> str:
    """Rounds of assignment and update over (row, component) pairs."""
    steps = [r"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (SELECT r, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM kept),
seeded AS (SELECT w, row_number() OVER (ORDER BY sha256('1:' || vec_id), w) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT c, unnest(w) AS v, generate_subscripts(w, 1) AS p FROM seeded WHERE c < 16)"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place FROM (
  SELECT x.r, y.c, CAST(sum((x.v - y.v) * (x.v - y.v)) AS BIGINT) AS d FROM points x JOIN c{i} y USING (p) GROUP BY x.r, y.c)) WHERE place = 1)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT c, p, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v FROM (
  SELECT c, p, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN points USING (r) GROUP BY c, p)),
c{i + 1} AS MATERIALIZED (SELECT o.c, o.p, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN m{i} m ON m.c = o.c AND m.p = o.p)""")
    return ",".join(steps) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN kept USING (r)
JOIN (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p)) AS centroid_sha256 FROM c{rounds} GROUP BY c) t ON t.c = a.c
"""


#: crc32 by its table of 256 remainders, which follow from the reversed polynomial; deletions of one code point find the near words.
SPELLING = r"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i:
    list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda ch: CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [195, CAST(unicode(ch) AS BIGINT) - 64] END)) AS bytes FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_concat([4294967295], bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM counted, crc),
damaged AS (SELECT n, CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
vocabulary AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS (SELECT x.word, y.word AS near FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT c.word, v.word FROM cut c JOIN vocabulary v ON v.word = c.rest
  UNION SELECT v.word, c.word FROM cut c JOIN vocabulary v ON v.word = c.rest),
ranked AS (SELECT near.word, near, v.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, near) AS place FROM near JOIN vocabulary v ON v.word = near.near),
judged AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form,
    CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM vocabulary v LEFT JOIN ranked r ON r.word = v.word AND place = 1),
followed(word, root, steps) AS (SELECT word, word, 0 FROM judged
  UNION ALL SELECT f.word, j.form, steps + 1 FROM followed f JOIN judged j ON j.word = f.root WHERE j.form IS NOT NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n
FROM judged JOIN (SELECT word, arg_max(root, steps) AS root FROM followed GROUP BY word) USING (word)
"""

LLM_ORACLES: dict[str, str] = {
    "op2_mix_sources": MIX, "op3_repetition_rules": REPETITION, "op4_sparse_suffix_passages": PASSAGES, "op7_odd_sketch_dedup": NEAR_DUPLICATES,
    "op11_rotated_centroids": centroids_sql(), "op12_spelling_variants": SPELLING, "op13_ngram_rtree_join": NGRAM_JOIN,
}
