"""What keeps plans and tasks bounded when tables grow: joins that are not broadcast, batches of bounded size."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lingualake.plans import building, catalogue
from lingualake.sources import batches, json_files, xml_walk, yaml_files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q109_beta_android_comments", "q29_beta_android_units", "q26_android_plurals", "q24_android_strings"])
def test_android_units_are_read_without_joins(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert plan.count("mapInArrow") + plan.count("MapInArrow") == 1


@pytest.mark.parametrize("files", [1, 700])
def test_node_rows_leave_in_bounded_batches(files):
    text = "<resources>" + '<string name="a">b</string>' * (70_000 // files) + "</resources>"
    source = pa.RecordBatch.from_pydict({"doc_id": list(range(files)), "content": [text] * files})
    found = list(xml_walk._walk(frozenset())(iter([source])))
    assert max(b.num_rows for b in found) <= batches.ROWS
    assert sum(b.num_rows for b in found) == files * (70_000 // files + 1)


def test_json_objects_are_found_in_one_walk_and_never_broadcast(spark):
    plan = catalogue.QUERIES["q115_json_structures_by_key"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert plan.count("MapInArrow") == 1


def test_overwritten_members_and_lists_hold_no_keys(spark):
    text = '{"a": {"b": {"string": "x"}}, "a": {"c": 1, "b": {"string": "1", "string": "\\u0032", "context": {"d": 3}}}, "l": [{"a": 1}], "a.b": {"string": "y"}}'
    files = spark.createDataFrame([(1, text)], "doc_id int, content string")
    keys = spark.createDataFrame([(1, k) for k in ("a", "a.c", "a.b", "a.b.context.d", "a\\.b", "l.0", "l")], "doc_id int, key string")
    found = {r["key"]: (r["kind"], r["value"]) for r in json_files.at_keys(files, keys).collect()}
    assert found == {"a": ("dict", "{"), "a.c": ("scalar", "1"), "a.b": ("dict", "{"), "a.b.context.d": ("scalar", "3"), "a\\.b": ("dict", "{"), "l.0": (None, None), "l": ("list", "[")}
    objects = {r["key"]: (r["string"], r["context"]) for r in json_files.structure_of(files, keys).collect()}
    assert objects == {"a": ("", ""), "a.b": ("2", "{"), "a\\.b": ("y", "")}


def test_json_rows_leave_in_bounded_batches():
    source = pa.RecordBatch.from_pydict({"doc_id": [7], "content": ["[" + "1, " * 70_000 + "1]"]})
    found = list(json_files._walk(iter([source])))
    assert max(b.num_rows for b in found) <= batches.ROWS
    assert sum(b.num_rows for b in found) == 70_002


def test_a_file_is_made_where_its_parts_are(spark):
    rows = spark.range(100_000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("p"))
    found = building.file_rows(rows, F.col("k") % 2, "k", F.col("p"), ",", "<", ">")
    above = found._jdf.queryExecution().executedPlan().toString().partition("Exchange")[0]
    assert above.count("collect_list") == 4 and "partial" in above
    held = {r["doc_id"]: r["content"] for r in found.collect()}
    assert held == {d: "<" + ",".join(str(k) for k in range(d, 100_000, 2) if k % 3) + ">" for d in (0, 1)}
    none = building.file_rows(rows.filter("p is null"), F.col("k") % 2, "k", F.col("p"), ",", "<", ">")
    assert {r["content"] for r in none.collect()} == {"<>"}


@pytest.mark.parametrize("name", ["q30_stringsdict_units"])
def test_stringsdict_files_are_walked_once_and_never_broadcast(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "MapInArrow" not in plan


@pytest.mark.parametrize("name", ["q27_android_compile_semi", "q110_beta_android_compile", "q55_stringsdict_compile"])
def test_edits_are_never_broadcast(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_yaml_is_parsed_in_c_with_the_same_leaves(monkeypatch):
    texts = ["t:\n  a: 'x\n\n    y'\n  b: |\n    z\n  c: >+\n    w\n\n  d: \"\\u00e9\\\n    \\ x\" # c\n  e: [1, &a q, *a]\n", "a: 😀 é\nb: !t 'x'\n", "a: x\na: y", "a: [", "", "? a\n: b", "a:\tb", "\ufeffa: b", "---\n  ", "{!t a:ba: \n  \n}"]
    expected = [yaml_files._leaves_of(t) for t in texts]
    assert [yaml_files.rows_of(t) for t in texts] == expected

    def refuse(*_):
        raise AssertionError("parsed in Python")

    monkeypatch.setattr("yaml.reader.Reader.__init__", refuse)
    assert [yaml_files.rows_of(t) for t in texts[:2]] == expected[:2]


@pytest.mark.parametrize("name", ["q13_json_compile_prune", "q92_docx_right_to_left"])
def test_compiled_files_are_never_broadcast(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert "SortMergeJoin" in plan or name.startswith("q92")
