"""op6: all documents in length buckets and batches."""

from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.packing import pack
from tidemark.llm.token_counts import count_tokens


def op6_packing(spark, sf_dir):
    """doc_id, piece, n_tokens, bucket, batch and slot of every piece of every document; lengths are op7's token counts."""
    return pack(count_tokens(table(spark, sf_dir, "documents")), length=F.col("n_tokens"))


QUERIES = {"op6_packing": op6_packing}
