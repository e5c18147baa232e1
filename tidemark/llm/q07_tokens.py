"""op7: token counts of every document."""

from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.token_counts import count_tokens

LIMIT = 512


def op7_token_counts(spark, sf_dir):
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op7_token_counts": op7_token_counts}
