"""op12: spelling variants among the words of all documents."""

from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.spelling import runs, variants, vocabulary


def op12_spelling_variants(spark, sf_dir):
    """word, n, form, form_n, n_near and root of every word of six code points and five occurrences.

    A 199th of the runs, by a checksum of id and run, loses a code point first (a null id counts as an empty one).
    """
    every = runs(table(spark, sf_dir, "documents"), "doc_id", "text")
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.left("run", at), F.col("run").substr(at + 2, F.char_length("run")))
    words = every.select(F.when(h % 199 == 0, cut).otherwise(F.col("run")).alias("word"))
    return variants(vocabulary(words, "word"))


#: The checksum is written out, byte by byte, as SQL has none.
SQL = r"""
WITH RECURSIVE bits(b, k, c) AS (SELECT b, 0, b FROM range(256) r(b) UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
low AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs WHERE length(run) >= 6),
bytes AS (SELECT run, list_transform(range(1, 2 * octet_length(encode(id || ':' || run)), 2), lambda i: ('0x' || hex(encode(id || ':' || run))[i:i + 1])::BIGINT) AS x FROM low),
hashed AS (SELECT run, xor(list_reduce(x, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM bytes, tab),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
w AS (SELECT word, count(*) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
short AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
pairs AS (SELECT a.word AS u, b.word AS v FROM short a JOIN short b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT w.word, s.word FROM w JOIN short s ON s.rest = w.word UNION SELECT s.word, w.word FROM w JOIN short s ON s.rest = w.word),
best AS (SELECT u, count(*) AS n_near, first(v ORDER BY n DESC, v) AS form, max(n) AS form_n FROM pairs JOIN w ON w.word = v GROUP BY u),
res AS (SELECT word, n, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n, coalesce(n_near, 0) AS n_near
  FROM w LEFT JOIN best ON u = word),
steps(word, tip) AS (SELECT word, word FROM res UNION ALL SELECT s.word, r.form FROM steps s JOIN res r ON r.word = s.tip WHERE r.form IS NOT NULL)
SELECT res.word, res.n, res.form, res.form_n, res.n_near, s.tip AS root FROM res JOIN steps s USING (word) JOIN res e ON e.word = s.tip WHERE e.form IS NULL"""

ORACLE_SQL = {"op12_spelling_variants": SQL}
QUERIES = {"op12_spelling_variants": op12_spelling_variants}
