"""The pipeline's near-duplicate stage against brute force, with null and repeated ids."""

import hashlib


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _survivors(rows):
    sets = [_shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root = [root[j] if r == root[i] else r for r in root]
    rank = lambda r: (r[0] is None, r[0] or 0, r[1] is None, hashlib.sha256((r[1] or "").encode()).hexdigest())
    groups = {}
    for r, row in zip(root, rows, strict=True):
        groups.setdefault(r, []).append(row)
    return sorted((min(g, key=rank) for g in groups.values()), key=str)


def _text(word, n=40, tail=""):
    return " ".join(f"{word}{i}" for i in range(n)) + tail


def _check(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for again in (docs, docs.repartition(2, "text")):
        kept = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.saved(again), "")
        assert kept.columns == docs.columns
        assert sorted((tuple(r) for r in kept.collect()), key=str) == _survivors(rows)


def test_null_and_repeated_ids(spark):
    rows = [
        (None, _text("a"), "x"), (None, _text("b"), "x"), (None, _text("c"), "x"),  # null ids of different texts
        (None, _text("a", tail=" more"), "x"),  # a near copy without an id
        (7, _text("d"), "x"), (7, _text("e"), "x"), (7, _text("f"), "x"),  # an id repeated by different texts
        (3, _text("d", tail=" more"), "x"), (None, _text("e", tail=" more"), "x"),  # near copies of two of them
        (5, _text("g"), "x"), (5, _text("g"), "x"), (5, _text("g", tail=" more"), "x"),  # equal rows and a near copy with the same id
        (9, "", "x"), (9, None, "x"), (None, "", "x"), (None, None, "x"),  # without words: near to nothing
        (1, _text("h"), "x"), (2, _text("h", tail=" more"), "x"),
    ]
    _check(spark, rows)


def test_a_single_null_id(spark):
    _check(spark, [(None, _text("a"), "x"), (4, _text("a", tail=" more"), "x"), (6, _text("b"), "x")])


def test_unique_ids(spark):
    _check(spark, [(8, _text("a"), "x"), (4, _text("a", tail=" more"), "x"), (6, _text("b"), "x")])


def _components(spark, texts, **how):
    from plumbline.llm import jaccard_join

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in jaccard_join.join_components(df, **how).collect()}


def test_periodic_words_are_told_apart(spark):
    """The Thue-Morse word and its complement collide under any polynomial modulo a power of two."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    assert _components(spark, [word, word.translate(str.maketrans("ab", "ba")), word]) == {0: 0, 1: 1, 2: 0}


def test_sets_with_one_equal_hash_are_told_apart(spark, monkeypatch):
    """With a first hash that is the same for all sets, the second one keeps them apart."""
    import numpy as np

    from plumbline.llm import jaccard_join

    real = jaccard_join.set_hashes
    monkeypatch.setattr(jaccard_join, "set_hashes", lambda found, at, n: (np.full(n, 77, np.uint64), real(found, at, n)[1]))
    texts = [_text("a"), _text("b"), _text("a", tail=" more"), _text("b"), None]
    assert _components(spark, texts) == {0: 0, 1: 1, 2: 0, 3: 1, 4: 4}
