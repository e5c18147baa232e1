"""op2: documents that hold passages of benchmark items."""

from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.decontaminate import leaks


def op2_decontamination(spark, sf_dir):
    """doc_id, item_id, first word and similarity of every leak."""
    found = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", F.round("similarity", 6).alias("similarity"))


QUERIES = {"op2_decontamination": op2_decontamination}
