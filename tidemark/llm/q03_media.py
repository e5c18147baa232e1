"""op3: every text as stored media, read back."""

from pyspark.sql import functions as F

from tidemark.llm.common import table
from tidemark.llm.media import read_pixels, stored_table


def op3_media_columns(spark, sf_dir):
    """doc_id, sizes, digests of the stored and of the read-back bytes, and a feature, of every document."""
    read = read_pixels(stored_table(table(spark, sf_dir, "documents").select("doc_id", "text")))
    size = F.octet_length("pixels").cast("long")
    return read.select(
        "doc_id",
        "n_bytes",
        size.alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


QUERIES = {"op3_media_columns": op3_media_columns}
