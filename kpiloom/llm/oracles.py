"""DuckDB SQL for the operators that SQL can express."""

#: Words as the contracts define them.
_N_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP1 = f"""
WITH sized AS (
  SELECT doc_id, source, {_N_WORDS}::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':mix-1'), 1, 8))::BIGINT AS k
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM sized GROUP BY source),
filling AS (  -- if all sources of a smaller cap for their weight are full, the level of the others
  SELECT cap / w AS own, row_number() OVER (ORDER BY cap / w, source) AS k,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
mix AS (
  SELECT source, source_size,
         least(cap, w * coalesce((SELECT arg_min(level, k) FROM filling WHERE level < own), 0))::DOUBLE AS target
  FROM ranked),
placed AS (
  SELECT doc_id, source, size,
         sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size
                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size AS before
  FROM sized)
SELECT p.doc_id, p.size, m.source_size, m.target,
       (CASE WHEN m.source_size = 0 THEN 0 ELSE floor(m.target)::BIGINT // m.source_size END * p.size
        + greatest(0, least(p.size, (CASE WHEN m.source_size = 0 THEN 0
                                     ELSE floor(m.target)::BIGINT % m.source_size END) - p.before)))::BIGINT AS taken
FROM placed p JOIN mix m ON p.source IS NOT DISTINCT FROM m.source
"""

OP6 = """
WITH sound AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM sound q JOIN sound d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.v) = len(d.v)),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH RECURSIVE steps AS (  -- the CRC-32 of each byte value, one bit at a time
  SELECT b AS byte, b::BIGINT AS c, 0 AS k FROM range(256) r(b)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
bytes AS (SELECT list(c ORDER BY byte) AS crcs FROM steps WHERE k = 8),
words AS (
  SELECT doc_id, true AS raw, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT item_id, false, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
counts AS (SELECT doc_id, raw, word, count(*)::BIGINT AS n FROM words GROUP BY ALL),
spelt AS (
  SELECT word, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS code
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM counts)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, code),
                               lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM spelt, bytes),
buckets AS (
  SELECT bucket, coalesce(sum(n) FILTER (raw), 0)::BIGINT AS s, coalesce(sum(n) FILTER (NOT raw), 0)::BIGINT AS t
  FROM counts JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::BIGINT AS raws, coalesce(sum(t), 0)::BIGINT AS targets FROM buckets),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (raws + 10000))::DOUBLE / ((s + 1) * (targets + 10000))::DOUBLE))::BIGINT AS gain
  FROM buckets, totals),
weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM counts JOIN hashed USING (word) JOIN gains USING (bucket) WHERE raw GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE)
                                                     / 4294967296.0::DOUBLE))))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id)),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed USING (doc_id)
"""

OP12 = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS words FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []
                      WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS s
  FROM worded),
sets AS (SELECT s, len(s) AS n, min(doc_id) AS first FROM (SELECT doc_id, list_sort(s) AS s FROM shingled) WHERE len(s) > 0 GROUP BY s),
entries AS (SELECT first, n, unnest(s) AS shingle FROM sets),
links AS (
  SELECT x.first AS a, y.first AS b FROM entries x JOIN entries y ON x.shingle = y.shingle AND x.first <> y.first
    AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
  GROUP BY x.first, x.n, y.first, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach AS (
  SELECT first AS a, first AS b FROM sets
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
classes AS (SELECT list_sort(s) AS s, doc_id, len(s)::BIGINT AS n FROM shingled)
SELECT c.doc_id, c.n AS n_shingles, CASE WHEN c.n = 0 THEN c.doc_id ELSE root END AS component_id
FROM classes c LEFT JOIN sets USING (s) LEFT JOIN roots ON first = a
"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP13 = f"""
WITH asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
sized AS (SELECT doc_id, {_TERMS} AS terms, len({_TERMS})::BIGINT AS n FROM documents),
totals AS (SELECT count(*) FILTER (n > 0) AS docs, coalesce(sum(n), 0)::BIGINT AS words FROM sized),
entries AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM entries, totals GROUP BY term, docs),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN entries USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id),
placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op1_mix_sources": OP1, "op6_top_k": OP6, "op11_resample": OP11, "op12_jaccard_groups": OP12,
                           "op13_lexical_search": OP13}
