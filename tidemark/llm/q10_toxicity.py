"""op10: a toxicity score for every document."""

from pyspark.sql import functions as F

from tidemark.llm.common import remainder, table, with_labels
from tidemark.llm.toxicity import fit


def learning_rows(spark, sf_dir, docs=None):
    """Documents with their toxic label, without those held out (crc32 of the id modulo 5 is 0).

    Repeated label rows count once; a document labelled both ways is a row of either class.
    """
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    labels = table(spark, sf_dir, "labels").where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 5) != 0)).select("doc_id", "toxic").distinct()
    return with_labels(docs.select("doc_id", "text"), labels, "doc_id")


def op10_toxicity(spark, sf_dir):
    """doc_id, held_out, score and predicted of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit(learning_rows(spark, sf_dir)).score(docs)
    held = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held, "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}
