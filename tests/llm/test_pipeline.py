"""The pipeline's stages on planted cases, and on awkward and empty tables."""

import os
import random

import pytest
from conftest import ODD

import corpus_pipeline as pipeline

FOLDER = os.environ.get("VIGILOG_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def _prose(seed, words=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "house", "and", "sea", "of", "green", "hills", "where", "we", "walk"]) + str(rng.randrange(50)) for _ in range(words))


def test_stages_in_order():
    assert [name for name, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "token_files"]


def test_each_stage_on_planted_cases(spark, odd_docs):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    clean = [(i, _prose(i), "en", f"s{i % 3}", 1) for i in range(30)]
    near = [(100, _prose(0) + " more", "en", "s0", 1), (101, _prose(1), "en", "s1", 1), (101, _prose(1), "en", "s1", 1)]
    leaked = [(200, _prose(77, 20) + " " + item + " " + _prose(78, 20), "en", "s0", 1)]
    bad = [(300, None, "en", "s0", 1), (301, "123 456", "en", "s0", 1)]
    docs = odd_docs(clean + near + leaked + bad)
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept, FOLDER)
        assert out.columns == docs.columns
        kept = spark.createDataFrame(out.collect(), docs.schema)
        ids = {r.doc_id for r in kept.collect()}
        if name == "language":
            assert ids == set(range(30)) | {100, 101, 200}
        if name == "near_duplicates":
            assert ids == set(range(30)) | {200} and kept.count() == 31
        if name == "decontamination":
            assert ids == set(range(30))
    copies = [r.doc_id for r in kept.collect()]
    assert set(copies) <= set(range(30)) and max(map(copies.count, copies)) <= 3
    last = pipeline.STAGES[-1][1](spark, kept, FOLDER).collect()
    assert sorted(r.doc_id for r in last) == sorted(copies)


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_survive_odd_and_empty_tables(spark, odd_docs, rows):
    docs = odd_docs(rows)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        got = out.collect()
        assert (out.columns == docs.columns) == (name != "token_files")
        if name == "near_duplicates" and rows:
            named = sorted(r.doc_id for r in got if r.doc_id is not None)
            assert named == [-3, 1, 2, 3, 4, 5, 7, 9] and len(got) == 10
        if name == "decontamination" or not rows:
            assert len(got) == len(rows)


def test_stages_work_on_the_rows_they_are_given(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    part = docs.filter("doc_id >= 150")
    got = pipeline.drop_near_duplicates(spark, part, FOLDER)
    assert got.count() > 0 and got.filter("doc_id < 150").count() == 0
