"""Personal data: the patterns against plain regular expressions, the field on held-out sentences, pruning against enumeration."""

import re
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import crf, pii, pii_examples, secrets

TEXTS = [
    None, "", "no data", "a@b.co", "x.y+z@mail-1.example.com, q@w", "a@b.c_d@e.fr a@@b.cc @b.cc a@b@c.dd", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 01.02.003.0004 256.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "card 4111111111111111, 4111  1111", "+1 (555) 555-0000 and +49 30 123456. +1+2 +12", "call +1 555 0000 555 0000 555 0", "é+33 1 23 45 67 89é 😀a@b.co",
    "1" * 5000, "a" * 5000 + "@" + "b" * 5000, ("+1 " + "(" * 300) * 3, "12 34-56 78 90 12 34", "user@host user@host.", "4111 1111 1111 1111 4111 1111 1111 1111",
]


def plain(text):
    found = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for kind, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = digits(m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if (True, all(int(p) <= 255 for p in m[0].split(".") if p.isdigit()) if kind == 1 else True, 12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15)[kind]:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(pii_examples.labelled_table(spark))


def test_patterns_equal_plain_expressions():
    for text in TEXTS:
        if text is not None and len(text) < 3000:
            assert pii.base_spans(text) == plain(text), text
    assert pii.base_spans("1" * 5000) == [] and len(pii.base_spans("a" * 5000 + "@" + "b" * 5000 + ".cc")) == 1
    rng = np.random.default_rng(4)
    for _ in range(300):
        text = "".join(rng.choice(list("aB1.2@-+ 3(4)5_é"), 60))
        assert pii.base_spans(text) == plain(text), text


def test_base_spans_stay_and_corner_cases_are_defined(spark, field):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1), (None, TEXTS[4], "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_email int")
    out = pii.scan(docs, field)
    assert out.columns == ["doc_id", "text", "n_email", "spans"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        base = [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.spans if s.kind in pii.BASE]
        if len(r.text or "") < 3000:
            assert base == plain(r.text or "")
        added = [s for s in r.spans if s.kind not in pii.BASE]
        assert not any(a.start < e and s < a.end for a in added for s, _, e in base)
        assert [(s.start, pii.KINDS.index(s.kind)) for s in r.spans] == sorted((s.start, pii.KINDS.index(s.kind)) for s in r.spans)
    assert pii.scan(docs.limit(0), field).count() == 0
    nothing = pii.train(spark.createDataFrame([], "text string, spans array<struct<kind:string,start:int,end:int>>"))
    assert all(s.kind in pii.BASE for r in pii.scan(docs, nothing).collect() for s in r.spans)
    hidden = {r.doc_id: r.text for r in secrets.redact(out, "[PII]").collect()}
    assert hidden[3] == "[PII]" and hidden[2] == "no data"


def test_the_field_finds_what_patterns_cannot(spark, field):
    held = pii_examples.examples(4, seed=101)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id long, text string")
    got = {r.doc_id: {(s.kind[4:], s.start, s.end) for s in r.spans if s.kind.startswith("crf_")} for r in pii.scan(docs, field).collect()}
    right = wrong = missed = 0
    for i, (text, spans) in enumerate(held):
        base = plain(text)
        want = {(k, s, e) for k, s, e in spans if not any(s < b and a < e for a, _, b in base)}
        right, wrong, missed = right + len(got[i] & want), wrong + len(got[i] - want), missed + len(want - got[i])
    assert right / (right + wrong) > 0.88 and right / (right + missed) > 0.8


def test_clean_documents_are_left_alone(spark, field, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    touched = pii.scan(docs, field).where(F.exists("spans", lambda s: F.startswith(s["kind"], F.lit("crf_")))).count()
    assert touched <= 0.01 * docs.count()


def test_pruned_viterbi_equals_enumeration():
    rng = np.random.default_rng(8)
    for trial in range(30):
        chain = crf.Chain(12, 4)
        chain.emission[:] = rng.normal(0, 2, chain.emission.shape)
        chain.emission[:, 0] += rng.choice([0, 0, 3])
        chain.step[:] = rng.normal(0, 1.5, (4, 4))
        chain.trained = True
        chain.prepare()
        feats, row = rng.integers(0, 12, (9, 2)), np.array([0, 0, 0, 0, 0, 1, 2, 2, 2])
        e, got = chain.scores(feats), chain.tag(feats, row)
        for r in range(3):
            at = np.flatnonzero(row == r)
            worth = lambda path: sum(e[i, y] for i, y in zip(at, path)) + sum(chain.step[a, b] for a, b in zip((0, *path), (*path, 0)))  # noqa: B023, B905, E731
            assert worth(got[at]) == pytest.approx(max(map(worth, product(range(4), repeat=len(at)))), abs=1e-4), trial


def test_training_raises_the_likelihood_of_a_rule():
    rng = np.random.default_rng(1)
    feats, label = rng.integers(0, 5, (200, 10, 1)), np.zeros((200, 10), int)
    label[feats[..., 0] == 3] = 1
    mask = np.ones((200, 10), bool)
    chain = crf.Chain(5, 3).fit(feats, mask, label, steps=60)
    assert (chain.tag(feats.reshape(-1, 1), np.repeat(np.arange(200), 10)) == label.ravel()).mean() > 0.99
