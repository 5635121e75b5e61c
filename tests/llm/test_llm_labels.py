"""Classifiers on rows they have not learned from, and benchmark items without an id."""

import zlib

from pyspark.sql import functions as F

from plumbline.llm import decontamination, queries

SF = "/root/testdata/sf0.1"


def _held_out(spark, name, column):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.col(column).isNotNull())
    scored = queries.queries()[name](spark, SF).join(labels.select("doc_id", column), "doc_id")
    rows = [(r.predicted, r[column]) for r in scored.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    hits, wrong = sum(p == 1 and y == 1 for p, y in rows), sum(p == 1 and y == 0 for p, y in rows)
    return hits / max(1, sum(y == 1 for _, y in rows)), wrong / max(1, sum(y == 0 for _, y in rows))


def test_toxicity_on_held_out_rows(spark):
    recall, false = _held_out(spark, "op8_toxicity", "toxic")
    assert recall > 0.85 and false < 0.05  # a constant gives 0 and 0, or 1 and 1


def test_quality_on_held_out_rows(spark):
    recall, false = _held_out(spark, "op6_quality_classifier", "quality")
    assert recall > 0.9 and false < 0.1


def test_items_without_an_id(spark):
    bench = [(None, "alpha beta gamma"), ("b", "alpha beta gamma"), (None, "delta"), ("a", None)]
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None), (None, "delta"), (1, "x")], "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id string, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.hit_items) for r in decontamination.decontaminate(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(1, 4, 4, [None, "b"]), (2, 0, 0, []), (None, 1, 1, [None]), (1, 1, 0, [])], key=str)
