"""op13: the interaction of five filters over all documents, by source."""

from pyspark.sql import functions as F

from tidemark.llm.audit import failures, in_all_orders, lattice, with_outcomes
from tidemark.llm.common import table


def op13_filter_audit(spark, sf_dir):
    """A row for every source, order of the filters A to E and step; no documents give no rows."""
    flagged = failures(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    flagged = with_outcomes(flagged, table(spark, sf_dir, "labels"), "doc_id", good=F.col("quality") == 1, toxic=F.col("toxic") == 1)
    counts = lattice(flagged, list("abcde"), ["good", "toxic"])
    return in_all_orders(counts, "ABCDE", {"good": "good_lost", "toxic": "toxic_lost"})


SQL = r"""
WITH words AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT coalesce(text, '') AS text, min(doc_id) AS m FROM documents GROUP BY 1),
flags AS (SELECT doc_id, part, (len(ws) < 50)::INT AS a, (100 * len(list_distinct(ws)) < 65 * len(ws))::INT AS b,
  (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT AS c, regexp_matches(text, '[#$%&*|]')::INT AS d,
  coalesce(m < doc_id, false)::INT AS e FROM words JOIN firsts USING (text)),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS failed, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM flags LEFT JOIN known USING (doc_id)),
sets AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM letters p JOIN letters q ON q.l <> p.l
  JOIN letters r ON r.l NOT IN (p.l, q.l) JOIN letters s ON s.l NOT IN (p.l, q.l, r.l) JOIN letters t ON t.l NOT IN (p.l, q.l, r.l, s.l)),
steps AS (SELECT filter_order, k::INT AS step, coalesce(list_sum(bits[:k - 1]), 0)::INT AS earlier, bits[k]::INT AS bit FROM orders, range(1, 6) x(k)),
cells AS (SELECT part, filter_order, step, bit, sum(CASE WHEN failed & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
  sum(CASE WHEN failed & bit <> 0 AND failed & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN failed & bit <> 0 AND failed & earlier <> 0 THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failed = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN failed & bit <> 0 AND failed & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
  sum(CASE WHEN failed & bit <> 0 AND failed & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM sets, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM cells"""

ORACLE_SQL = {"op13_filter_audit": SQL}
QUERIES = {"op13_filter_audit": op13_filter_audit}
