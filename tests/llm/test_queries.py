"""The registered corpus queries against their SQL, and the pipeline against brute-force stages."""

import collections
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lingualake.llm import queries
from lingualake.llm.shingles import shingle_set

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    ours = sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)
    expected = con.sql(queries.SQL[name])
    at = [expected.columns.index(c) for c in columns]
    assert ours == sorted((tuple(r[k] for k in at) for r in expected.fetchall()), key=repr)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 14)]


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    (_, by_quality), (_, by_toxicity), (_, by_lines), (_, by_copies), (_, packed) = corpus_pipeline.STAGES
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = by_quality(spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    assert sum((i in kept) == bool(r["quality"]) for i, r in labels.items()) >= 0.9 * len(labels)
    clean = by_toxicity(spark, good, SF)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} <= kept
    before = {r["doc_id"]: r["text"] for r in clean.collect()}
    lines = by_lines(spark, clean, SF)
    assert lines.columns == docs.columns and lines.filter(F.length("text") != F.col("n_chars")).isEmpty()
    owners = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\r\v\f").translate({c: c + 32 for c in range(65, 91)})
    for i, text in before.items():
        for line in text.split("\n"):
            owners[key(line)].add(i)
    after = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert after == {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 20 or len(owners[key(x)]) < 3 or i == max(owners[key(x)])) for i, t in before.items()}
    left = by_copies(spark, lines, SF)
    assert left.columns == docs.columns
    sets = {i: set(shingle_set(t.encode()).tolist()) for i, t in after.items()}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert {r["doc_id"] for r in left.collect()} == {i for i in sets if label[i] == i}
    done = packed(spark, left, SF)
    assert {r["doc_id"] for r in done.collect()} == {i for i in sets if label[i] == i}


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    long = " ".join(f"word{i % 997}" for i in range(20_000))
    odd = [(5, None), (3, ""), (1, "a b c"), (1, "a b c"), (2, long), (4, long + " end"), (None, "a b c"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in odd], "doc_id bigint, text string, lang string, source string, n_chars bigint, label string")
    found = stage(spark, docs, SF)
    rows = found.collect()
    ids = sorted(r["doc_id"] or 0 for r in rows)
    if name == "packing":
        assert set(ids) == {0, 1, 2, 3, 4, 5} and sum(i == 1 for i in ids) == 2
    else:
        assert found.columns == list(corpus_pipeline.COLUMNS) and all(i in {0, 1, 2, 3, 4, 5} for i in ids)
    if name == "line_dedup":
        assert ids == sorted(i or 0 for i, _ in odd)
    if name == "near_dedup":
        assert ids == [0, 0, 1, 1, 2, 3, 5]
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
