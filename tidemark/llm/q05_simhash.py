"""op5: near-duplicate components of all documents by SimHash."""

from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.simhash import near_duplicates


def op5_simhash_dedup(spark, sf_dir):
    """doc_id, fingerprint (hex) and component_id of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash_dedup": op5_simhash_dedup}
