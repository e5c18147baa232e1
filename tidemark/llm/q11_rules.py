"""op11: quality rules over all documents."""

from tidemark.llm.common import table
from tidemark.llm.rules import judge


def op11_quality_rules(spark, sf_dir):
    """doc_id, the base counts, base_failed and kept of every document."""
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "text", "lang")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wide AS (SELECT *, array_to_string(ws, '') AS j, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM docs),
places AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM docs)),
covered AS (SELECT DISTINCT r, i + k AS p FROM places JOIN (SELECT r, s FROM places GROUP BY ALL HAVING count(*) > 1) USING (r, s), range(5) x(k)),
repeats AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
base AS (SELECT r, doc_id, lang, len(ws)::BIGINT AS n_words, length(j)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  [length(regexp_replace(j, '[^a-z]', '', 'g')), length(regexp_replace(j, '[^A-Z]', '', 'g')), length(regexp_replace(j, '[^0-9]', '', 'g')),
    length(regexp_replace(j, '[^.,;:!?''"()-]', '', 'g')), length(regexp_replace(j, '[\x00-\x7F]', '', 'g'))] AS five FROM wide LEFT JOIN repeats USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, list_append(five, word_chars - list_sum(five)) AS c FROM base),
words AS (SELECT r, lang, word, count(*) AS n FROM (SELECT r, lang, unnest(ws) AS word FROM docs) GROUP BY ALL),
sizes AS (SELECT lang, sum(n) AS size FROM words WHERE lang IS NOT NULL GROUP BY lang HAVING sum(n) >= 1000),
top AS (SELECT lang, word, n / size AS share FROM (SELECT lang, word, sum(n) AS n, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, word) AS k FROM words GROUP BY lang, word)
  JOIN sizes USING (lang) WHERE k <= 20),
chars AS (SELECT lang, k, sum(c[k]) / sum(sum(c[k])) OVER (PARTITION BY lang) AS share FROM judged JOIN sizes USING (lang), range(1, 7) x(k) GROUP BY lang, k),
pairs AS (SELECT r, s.lang AS ref, n_words, word_chars, c FROM judged d JOIN sizes s ON d.lang = s.lang
  UNION ALL SELECT r, s.lang, n_words, word_chars, c FROM judged d, sizes s WHERE d.lang IS NULL OR d.lang NOT IN (SELECT lang FROM sizes)),
hits AS (SELECT p.r, ref, w.n / n_words AS p, share AS q FROM pairs p JOIN top ON top.lang = ref JOIN words w ON w.r = p.r AND w.word = top.word),
bins AS (SELECT r, ref, p, q FROM hits
  UNION ALL SELECT r, ref, 1 - coalesce((SELECT sum(p) FROM hits h WHERE h.r = x.r AND h.ref = x.ref), 0), 1 - (SELECT sum(share) FROM top WHERE lang = ref) FROM pairs x WHERE n_words > 0),
terms AS (SELECT r, ref, CASE WHEN p > 1e-12 THEN p * log2(2 * p / (p + q)) / 2 + q * log2(2 * q / (p + q)) / 2 - q / 2 ELSE 0 END AS term FROM bins),
far AS (SELECT r, min(d) AS word_far FROM (SELECT r, ref, sqrt(greatest(0.5 + sum(term), 0)) AS d FROM terms GROUP BY ALL) GROUP BY r),
spread AS (SELECT r, ref, c[k] / word_chars AS p, share AS q FROM pairs JOIN chars ON chars.lang = ref WHERE word_chars > 0),
char_far AS (SELECT r, min(d) AS char_far FROM (SELECT r, ref, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) / 2 ELSE 0 END) +
  (CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0 END)), 0)) AS d FROM spread GROUP BY ALL) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (n_words < 50 OR coalesce(word_far, 0) <= 0.45) AND (word_chars < 200 OR coalesce(char_far, 0) <= 0.3) AS kept
FROM judged LEFT JOIN far USING (r) LEFT JOIN char_far USING (r)"""

ORACLE_SQL = {"op11_quality_rules": SQL}
QUERIES = {"op11_quality_rules": op11_quality_rules}
