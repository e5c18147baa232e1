"""op8: a quality score for every document."""

from pyspark.sql import functions as F

from tidemark.llm.common import remainder, table, with_labels
from tidemark.llm.quality import fit, predict


def op8_quality(spark, sf_dir):
    """doc_id, held_out, score and predicted of every document.

    Positives are learning rows labelled 1; the unlabelled are all documents of the learning rows' side of the split;
    the prior is the share of label 1 among the learning labels. Repeated label rows count once; a document labelled
    both ways is a positive and counts on both sides of the prior.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 4) != 2)
    labels = table(spark, sf_dir, "labels").where(learn & F.col("quality").isin(0, 1)).select("doc_id", "quality").distinct()
    prior = labels.agg(F.avg("quality")).first()[0]
    positives = with_labels(docs, labels.where("quality = 1").select("doc_id").distinct(), "doc_id")
    model = fit(positives, docs.where(learn), 0.5 if prior is None else float(prior))
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return predict(docs, model).select("doc_id", held, "score", "predicted")


QUERIES = {"op8_quality": op8_quality}
