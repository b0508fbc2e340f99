"""DuckDB texts that the registered queries are checked against."""

# The same answer from plain grouping, without runs.
LINE_RUNS = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no
  FROM documents
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), hot AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.no, k.line, hot.key IS NOT NULL AND k.doc_id <> hot.keeper AS gone FROM k LEFT JOIN hot ON k.key = hot.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: The ten best documents of each benchmark item.
RANKED_SEARCH = r"""
WITH terms AS (
  SELECT row_no, doc_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS row_no, doc_id, text FROM documents)
), lengths AS (SELECT row_no, count(*) AS n FROM terms GROUP BY row_no
), corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths
), wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), counts AS (
  SELECT row_no, doc_id, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY row_no, doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), corpus
), gains AS (
  SELECT row_no, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))) AS gain
  FROM counts JOIN weights USING (term) JOIN lengths USING (row_no), corpus
), scored AS (
  SELECT item_id, row_no, doc_id, sum(gain)::BIGINT AS score FROM wanted JOIN gains USING (term) GROUP BY item_id, row_no, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""

#: Components of documents whose sets of three-word runs have a Jaccard likeness of 0.9: every pair of different sets with a run in common is compared.
NGRAM_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
                      WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_sort(list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])) END AS s
  FROM words
), classes AS (
  SELECT s, len(s) AS n, min(doc_id) AS c FROM sets WHERE len(s) > 0 GROUP BY s
), tokens AS (SELECT c, n, unnest(s) AS t FROM classes
), shared AS (
  SELECT a.c AS x, b.c AS y, a.n AS n, b.n AS m, count(*) AS o
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.c < b.c AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n
), links AS (
  SELECT x, y FROM shared WHERE 100 * o >= 90 * (n + m - o)
), sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT c AS start, c AS reach FROM classes WHERE c IN (SELECT x FROM sides)
  UNION
  SELECT start, y FROM reached JOIN sides ON reach = x
), least AS (SELECT start, min(reach) AS component_id FROM reached GROUP BY start)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, c, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least ON c = start
"""
