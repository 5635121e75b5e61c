"""Lexical search against brute force, over several blocks and passes."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOW = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(_LOW))


def ranked(docs, items, top=10):
    counts = [Counter(terms(t)) for _, t in docs]
    n_docs, total = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    for item, words in asked.items():
        scores = []
        for (doc, _), c in zip(docs, counts, strict=True):
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if null else doc, -s) for k, (s, null, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "42", "the", "THE", "x_y", "[a]", "{b}", "@c", "­", " "]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice((0, 1, 3, 30, 90))))) for i in range(400)]
    docs += [(900 + i, docs[7][1]) for i in range(15)] + [(None, docs[8][1]), (None, "w1 w2"), (5, docs[5][1]), (999, None), (998, " ,.;"), (997, "w3 " * 5000)]
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 12)))) for i in range(30)] + [(50, None), (51, ""), (52, "unheard of"), (53, docs[7][1]), (2, "w9 w10"), (None, "w1 w40")]
    return docs, items


@pytest.mark.parametrize("block, passes", [(1 << 22, 1), (600, 1), (600, 3)])
def test_search_equals_brute_force(spark, corpus, monkeypatch, block, passes):
    docs, items = corpus
    monkeypatch.setattr(ls, "BLOCK_BYTES", block)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, score long, rank string").repartition(3)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    chars = sum(len(t or "") for _, t in items)
    got = ls.search(ls.build_index(df), asked, pass_chars=chars // passes + 1)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == ranked(docs, items)


def test_empty_tables(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string")
    items = spark.createDataFrame(corpus[1], "item_id long, text string")
    assert ls.search(ls.build_index(docs), items.limit(0)).count() == 0
    assert ls.search(ls.build_index(docs.limit(0)), items).count() == 0
    assert ls.search(ls.build_index(docs.where("doc_id IN (998, 999)")), items).count() == 0


def test_pair_bounds_hold_and_skip_more_than_single_maxima():
    """Every document's share of a pair stays within the pair's bound, and pair bounds leave less to score than term maxima."""
    rng = np.random.default_rng(3)
    items = {i: {f"t{k}" for k in rng.choice(40, 8, replace=False)} for i in range(20)}
    weights = {f"t{k}": int(1000 + 100 * k) for k in range(40)}
    queries = ls.Queries(items, weights, 300, 30_000)
    code, starts, docs, counts = [], [0], [], []
    for k in range(len(queries.terms)):
        mine = np.flatnonzero(rng.random(300) < 0.15)
        code.append(k)
        docs += mine.tolist()
        counts += rng.integers(1, 9, len(mine)).tolist()
        starts.append(len(docs))
    block = ls.Block(queries, np.full(300, 100), np.array(code), np.array(starts), np.array(docs, np.uint16), np.array(counts))
    single = np.array([block.postings(k)[1].max(initial=0) for k in range(len(queries.terms))] + [0])
    bounds = np.zeros(len(queries.pairs), np.int64)
    for p, (a, b) in enumerate(queries.pairs):
        share = np.zeros(300, np.int64)
        for t in (a, b):
            d, impact = block.postings(t)
            share[d] += impact
        bounds[p] = share.max()
    assert all(bounds[p] <= single[a] + single[b] for p, (a, b) in enumerate(queries.pairs)) and sum(bounds) < sum(single[a] + single[b] for a, b in queries.pairs)
    best, loose = ls.Best(np.zeros(len(queries.items), np.int64)), ls.Best(np.zeros(len(queries.items), np.int64))
    ls.score_block(queries, block, np.arange(300), bounds, best)
    ls.score_block(queries, block, np.arange(300), np.array([single[a] + single[b] for a, b in queries.pairs]), loose)
    assert all((x[0] == y[0]).all() and (x[1] == y[1]).all() for x, y in zip(best.rows, loose.rows, strict=True))
    loose_bounds = np.array([single[a] + single[b] for a, b in queries.pairs])
    totals = [np.add.reduceat(b[queries.pairs_of], queries.first[:-1]) for b in (bounds, loose_bounds)]
    between = ls.Best((totals[0] + totals[1]) // 2 + 1)
    opened = [ls.score_block(queries, block, np.arange(300), b, between) for b in (bounds, loose_bounds)]
    assert opened[0] == 0 and opened[1] == len(queries.items)
