"""What the random field adds to the patterns, on sentences and on kinds that it has never seen."""

import pytest
from pyspark.sql import functions as F

from plumbline.llm import secret_examples, secrets


@pytest.fixture(scope="module")
def field(spark):
    return secrets.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def _measured(spark, field, rows):
    """(precision, recall) of added spans against those that no pattern touches."""
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: {(s.start, s.end) for s in r.spans if s.kind == "crf"} for r in secrets.scan(docs, field).collect()}
    right = found = there = 0
    for i, (text, spans) in enumerate(rows):
        base = secrets.base_spans(text)
        want = {(s, e) for s, e in spans if not any(s < b and a < e for a, _, b, _ in base)}
        right, found, there = right + len(got[i] & want), found + len(got[i]), there + len(want)
    return right / max(1, found), right / max(1, there)


def test_held_out_sentences(spark, field):
    precision, recall = _measured(spark, field, secret_examples.examples(5, seed=501))
    assert precision > 0.88 and recall > 0.85


def test_kinds_never_trained_on(spark, field):
    precision, recall = _measured(spark, field, secret_examples.examples(20, seed=502, patterns=secret_examples.UNSEEN + secret_examples.OTHERS))
    assert precision > 0.9 and recall > 0.9


def test_base_spans_stay_and_clean_documents_are_left_alone(spark, field):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = secrets.scan(docs, field)
    for r in out.collect():
        assert [(s.start, s.kind, s.end) for s in r.spans if s.kind != "crf"] == [(s, secrets.KINDS[k], e) for s, k, e, _ in secrets.base_spans(r.text or "")]
    assert out.where(F.exists("spans", lambda s: s["kind"] == "crf")).count() <= 0.005 * docs.count()


def test_repeated_rows_and_null_ids(spark, field):
    text = "private key: 4F3A9C0D11B2E77A90C4D5E6F708192A3B4C5D6E"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    assert sorted(len(r.spans) for r in secrets.scan(docs, field).collect()) == [0, 1, 1, 1]
    assert secrets.scan(docs.limit(0), secrets.train(docs.limit(0))).count() == 0
