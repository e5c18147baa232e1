"""op1: the main text of every page."""

from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.html_text import extract


def op1_html_extraction(spark, sf_dir):
    """page_id, url, text and n_chars of every page."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES = {"op1_html_extraction": op1_html_extraction}
