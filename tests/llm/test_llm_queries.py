"""The registered queries: SQL where there is some, contracts of the rest, and the pipeline."""

from __future__ import annotations

import zlib

import pytest

import corpus_pipeline
from checks.compare import connect, sorted_rows
from keysift.llm import dedup, mixing, quality
from keysift.llm.queries import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, connection, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = connection.execute(ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted_rows(df.columns, map(tuple, df.collect())) == sorted_rows(names, cursor.fetchall())


@pytest.fixture(scope="module")
def larger():
    return connect("/root/testdata/sf0.01")


def test_quality_on_held_out_rows(spark, larger):
    labels = dict(larger.execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_on_held_out_rows(spark, larger):
    langs = dict(larger.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op5_language"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.97 * len(held)


def test_decontamination_equals_brute_force(spark, larger):
    from keysift.llm.decontam import best_run, words_of

    found = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op8_decontamination"](spark, "/root/testdata/sf0.01").collect()}
    items = {i: words_of(t) for i, t in larger.execute("SELECT * FROM benchmark").fetchall()}
    expected = {}
    for doc, text in larger.execute("SELECT doc_id, text FROM documents").fetchall():
        words = words_of(text)
        for item, own in items.items():
            distance, _ = best_run(own, words)
            if distance <= len(own) // 10:
                expected[doc, item] = distance
    assert found == expected and expected


def odd_documents(spark):
    """Documents of the smallest table, with nulls, repeats and columns of clashing names."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    text = docs.first().text
    odd = [(None, None, None, None, None), (None, text, "en", None, 3), (5, "", "en", "", 0), (5, "", "en", "", 0), (6, text * 30, None, "x", None)]
    return docs.union(spark.createDataFrame(odd, docs.schema))


def clashing(df):
    for name in ("score", "kept", "copies", "matches", "size", "node", "dedup_row", "mix_row", "clean_row", "positive"):
        df = df.withColumn(name, quality.F.lit(name))
    return df


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    docs = clashing(odd_documents(spark))
    result = stage(spark, docs, SF_DIR)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert result.columns == (["doc_id", "start", "n_tokens", "ids_crc32"] if last else docs.columns)
    assert result.count() > (0 if name != "tokens" else 200)
    assert stage(spark, docs.limit(0), SF_DIR).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), name)
        assert docs.columns == DOCUMENTS
        kept[name] = docs
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    unique = dedup.near_duplicates(kept["near_duplicates"], dedup.MinHash(words=5))
    assert unique.where("NOT kept").count() == 0
    weighed = mixing.with_copies(kept["decontamination"], mixing.word_count(mixing.F.col("text")))
    assert weighed.agg(mixing.F.sum("copies")).first()[0] == len(rows)
