"""Registered queries against their SQL twins on the smallest tables, and their contract columns."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical
from logweir.llm.checks import CHECKS
from logweir.llm.queries import QUERIES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no tables")
COLUMNS = {
    "op1_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2_toxicity": "doc_id held_out score predicted",
    "op4_html": "page_id url text n_chars",
    "op6_mixture": "doc_id size source_size target taken",
    "op7_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op8_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op11_filter_audit": "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley",
    "op12_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op13_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256",
}


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(CHECKS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", CHECKS)
def test_twin(spark, name):
    found = QUERIES[name](spark, str(FOLDER)).toPandas()
    with duckdb.connect() as db:
        for table in TABLES:
            db.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
        expected = db.execute(CHECKS[name]).fetch_df()
    assert canonical(found) == canonical(expected)


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(spark, name):
    assert set(COLUMNS[name].split()) <= set(QUERIES[name](spark, str(FOLDER)).columns)
