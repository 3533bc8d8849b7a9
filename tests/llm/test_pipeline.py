"""Each stage of the pipeline on a small table, against what the stage is to do."""

from __future__ import annotations

import collections
import shutil

import corpus_pipeline
import pytest
from llm_tables import LONG
from martloom.llm.common import prepared
from martloom.llm.language import identify
from martloom.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    base = " ".join(f"word{k} of the story{k}" for k in range(60))
    rows = [(k, f"{k} " + " ".join(f"plain{k} text{j} here" for j in range(40)), "en", f"s{k % 3}", 1) for k in range(30)]
    rows += [(100, base, "en", "s0", 1), (101, base.upper(), "en", "s1", 1), (101, base, "en", "s1", 1), (102, base + " end", "en", "s1", 1), (103, "12 %", "en", "s0", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def as_files(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    return spark.read.parquet(str(tmp_path / "docs"))


@pytest.mark.parametrize("files", [True, False])
def test_stages(spark, tmp_path, files):
    docs = as_files(spark, documents(spark), tmp_path) if files else documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    spoken = stages[names[0]](spark, docs, "")
    assert spoken.columns == docs.columns
    assert sorted(r.doc_id for r in spoken.collect()) == [*range(30), 100, 101, 101, 102]
    once = stages[names[1]](spark, spoken, "")
    assert sorted(r.doc_id for r in once.collect()) == [*range(30), 101, 102]
    near = stages[names[2]](spark, once, "")
    assert sorted(r.doc_id for r in near.collect()) == [*range(30), 101]
    mixed = stages[names[3]](spark, near, "")
    assert mixed.columns == docs.columns
    words = collections.Counter()
    for r in mixed.collect():
        words[r.source] += len(r.text.split())
    total = sum(len(r.text.split()) for r in near.collect())
    assert all(abs(words[f"s{k}"] - total * (k + 1) / 6) <= 240 for k in range(3))
    coded = stages[names[4]](spark, mixed, "").collect()
    assert len(coded) == mixed.count() and all(r.n_tokens * 4 == len(r.ids) for r in coded)
    assert tokenizer_path().endswith(".json")


CLASHES = "_row long, _row_file string, row string, size int, root int, copies long, fp1 string, text_sha256 string, cls int"


@pytest.mark.parametrize("files", [True, False])
def test_columns_that_clash_nulls_and_long_texts(spark, tmp_path, files):
    """Stages return the columns that came in, with their own values, whatever their names are."""
    rows = [tuple(r) for r in documents(spark).collect()] + [(200, LONG, "en", "s2", 3), (201, "", "en", None, 0), (None, "plain text here " * 20, None, "s1", 1)]
    wide = spark.createDataFrame([(*r, 10 * k, "f", "r", 1, 2, 3, "x", "y", 4) for k, r in enumerate(rows)], f"{SCHEMA}, {CLASHES}").repartition(3)
    docs = as_files(spark, wide, tmp_path) if files else wide
    before = {tuple(r) for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert got and set(got) <= before


@pytest.mark.parametrize("files", [True, False])
def test_empty_tables(spark, tmp_path, files):
    docs = spark.createDataFrame([], SCHEMA)
    docs = as_files(spark, docs, tmp_path) if files else docs
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").isEmpty()


def test_numbers_of_rows_in_files(spark, tmp_path):
    docs = as_files(spark, documents(spark), tmp_path)
    found = corpus_pipeline.numbered(prepared(spark), docs)
    one, two = ({(r[found.row], r.doc_id, r.text) for r in found.df.repartition(n).collect()} for n in (1, 5))
    assert one == two and len({r for r, _, _ in one}) == docs.count()


def test_a_whole_run(spark, tmp_path):
    as_files(spark, documents(spark), tmp_path)
    shutil.move(tmp_path / "docs", tmp_path / "documents.parquet")
    whole = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert {r[0] for r in whole} <= {*range(30), 101} and whole == sorted(tuple(r) for r in docs.collect())


def test_rows_without_ids_teach_languages(spark):
    words = {"en": "the house of the people was there", "de": "das haus der leute war nicht dort"}
    rows = [(None, f"{words[lang]} {k}", lang) for lang in words for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = identify(docs, fit_docs=20).groupBy("lang_pred").count().collect()
    assert {r.lang_pred: r["count"] for r in got} == {"en": 60, "de": 60}
