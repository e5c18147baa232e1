"""The queries' columns and types, whole tables in and out, and their behaviour without rows."""

import duckdb
import pytest

from tidemark.llm import registry

COLUMNS = {
    "op1": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op3": {"doc_id": "bigint", "n_bytes": "bigint", "payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"},
    "op4": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op5": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op7": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op8": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op9": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op10": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op12": {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"},
    "op13": {"part": "string", "filter_order": "string", "step": "int", **dict.fromkeys(("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"), "bigint")},
}
#: Columns that may be null; queries whose rows are not the table's.
NULLS, OTHER_ROWS = {"op12": {"form", "form_n"}}, {"op12", "op13"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_columns_and_rows(spark, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir)
    kinds = dict(got.dtypes)
    for column, kind in COLUMNS.get(name.split("_")[0], {}).items():
        assert kinds[column] == kind
    rows = got.collect()
    op = name.split("_")[0]
    if op == "op13":
        assert len(rows) == 600 * spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("coalesce(source, '')").distinct().count()
    if op in COLUMNS and op not in OTHER_ROWS:
        assert len(rows) == spark.read.parquet(f"{sf_dir}/{'pages' if name.startswith('op1_') else 'documents'}.parquet").count()
    assert all(r[c] is not None for r in rows for c in kinds if c not in NULLS.get(op, ()))
    if name.startswith("op3"):
        import hashlib
        import zlib

        texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
        for r in rows:
            raw = texts[r.doc_id]
            payload = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = c.execute(registry.oracle_sql()[name])
    names = [x[0] for x in want.description]
    got = registry.queries()[name](spark, sf_dir).select(names)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "labels", "pages", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name, f in registry.queries().items():
        assert f(spark, str(tmp_path)).count() == 0, name
