"""Queries whose files hold all keys of a brand or nation, however far these lie apart."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lingualake.plans import catalogue

SF = "/root/testdata/sf0.001"
#: By table: its group, its key, and the names of three groups.
GROUPS = {"part": ("p_brand", "p_partkey", "Brand#"), "customer": ("c_nationkey", "c_custkey", ""), "supplier": ("s_nationkey", "s_suppkey", "")}
WHOLE = {
    "q59_arb_compile": "part",
    "q60_chrome_compile": "supplier",
    "q61_chrome_v3_compile": "supplier",
    "q75_json_duplicate_lines": "customer",
    "q15_sync_ordered": "part",
    "q22_chrome_units": "supplier",
    "q62_json_sync_template": "part",
    "q107_json_find_children": "part",
    "q24_android_strings": "part",
    "q26_android_plurals": "part",
    "q30_stringsdict_units": "part",
    "q34_po_duplicates": "part",
    "q63_structured_sync_template": "part",
    "q21_structured_compile_metadata": "part",
    "q58_json_compile_plain": "part",
    "q13_json_compile_prune": "part",
    "q55_stringsdict_compile": "part",
}


@pytest.fixture(scope="module")
def far_apart(spark, tmp_path_factory):
    """Tables of three groups each, their keys 301 apart."""
    folder = str(tmp_path_factory.mktemp("far"))
    for name, (group, key, prefix) in GROUPS.items():
        rows = spark.read.parquet(f"{SF}/{name}.parquet")
        named = F.concat(F.lit(prefix), F.floor(F.col(key) / 3) % 3).cast(rows.schema[group].dataType)
        rows.withColumns({group: named, key: F.col(key) * 301}).write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize("name", list(WHOLE))
def test_a_file_holds_its_whole_group(spark, far_apart, name):
    group, _, prefix = GROUPS[WHOLE[name]]
    found = catalogue.QUERIES[name](spark, far_apart)
    columns = sorted(found.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    assert {str(r[columns.index("doc_id")]) for r in ours} == {f"{prefix}{k}" for k in range(3)}
    con = duckdb.connect()
    for table in GROUPS:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{far_apart}/{table}.parquet/*.parquet'")
    expected = con.sql(catalogue.SQL[name])
    at = [expected.columns.index(c) for c in columns]
    assert ours == sorted((tuple(r[k] for k in at) for r in expected.fetchall()), key=repr)
