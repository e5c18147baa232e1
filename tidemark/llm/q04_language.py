"""op4: the language of every document."""

from pyspark.sql import functions as F

from tidemark.llm.common import remainder, table
from tidemark.llm.language import fit, predict


def op4_language_id(spark, sf_dir):
    """doc_id, held_out, lang_pred and score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    net = fit(docs.where(F.col("doc_id").isNotNull() & ~held))
    return predict(docs, net).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
