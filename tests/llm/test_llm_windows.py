"""Benchmark windows against brute force and at their size bound; recall of the license bands against exact containment."""

import pickle
import random

import numpy as np

from plumbline.llm import decontamination, licenses
from plumbline.llm.decontamination import WuManber, item_words


def _brute(items, doc, window):
    marks, found = set(), set()
    for item, text in items:
        p = item_words(text)
        size = min(window, len(p))
        for s in range(len(p) - size + 1 if size else 0):
            for at in range(len(doc) - size + 1):
                if doc[at : at + size] == p[s : s + size]:
                    marks |= set(range(at, at + size))
                    found.add(item)
    return marks, found


def test_search_equals_brute_force_on_random_words():
    for seed in range(300):
        r = random.Random(seed)
        words = "a b c d".split()
        items = [(r.choice(["x", "y", "z", None]), r.choice([None, " ".join(r.choices(words, k=r.randint(0, 7)))])) for _ in range(r.randint(0, 6))]
        doc, window = item_words(" ".join(r.choices([*words, "unknown"], k=r.randint(0, 40)))), r.randint(1, 5)
        marks, found = WuManber(items, window).scan(doc)
        assert ({i for i, m in enumerate(marks) if m}, found) == _brute(items, doc, window)


def test_tables_stay_small_per_benchmark_word():
    r = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(20_000)])
    items = [(str(i), " ".join(r.choice(words, 120))) for i in range(2500)]  # a tenth of a pass
    tables = WuManber(items)
    assert sum(len(g.starts) for g in tables.groups) == 2500 * 108
    assert len(pickle.dumps(tables)) < 80 * 2500 * 120
    assert tables.scan(item_words("x " + items[7][1] + " y"))[1] == {"7"}
    assert len(item_words(items[7][1])) == sum(tables.scan(item_words("x " + items[7][1] + " y"))[0])


def test_passes_agree_on_repeated_rows_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a b c d", "k"), (1, "a b c d", "k"), (None, "b c", "k"), (2, None, "k"), (3, "", "k"), (4, "a " * 50_000, "k")], "doc_id long, text string, contaminated string")
    bench = spark.createDataFrame([("1", "b c"), (None, "d"), ("1", "b c"), ("2", None)], "item_id string, text string")
    rows = [sorted(tuple(map(str, r)) for r in decontamination.decontaminate(docs, bench, pass_chars=c).select("doc_id", "n_words", "n_hit", "hit_items", "contaminated").collect()) for c in (10**6, 3)]
    assert rows[0] == rows[1] and rows[0].count(("1", "4", "3", "[None, '1']", "True")) == 2 and ("4", "50000", "0", "[]", "False") in rows[0]
    assert decontamination.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_recall_of_license_bands(spark):
    """Templates of 30 to 400 words with some words changed, in other text: what exact containment finds in the windows, the bands retrieve."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    templates = {f"t{n}": r.choices(words, k=n) for n in (30, 80, 200, 400)}
    texts = []
    for i in range(400):
        said = list(templates[f"t{r.choice((30, 80, 200, 400))}"])
        for _ in range(r.randint(0, max(1, len(said) // 20))):  # around 0.8: every changed word costs up to five shingles
            said[r.randrange(len(said))] = "changed"
        texts.append((i, " ".join(r.choices(words, k=r.randint(0, 900)) + said + r.choices(words, k=r.randint(0, 900)))))

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    expected = set()
    for i, text in texts:
        w = text.split()
        for name, t in templates.items():
            own = shingles(t)
            if any(len(own & shingles(w[at : at + 2 * len(t)])) / len(own) >= 0.8 for at in range(0, len(w), len(t))):
                expected.add((i, name))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    table = spark.createDataFrame([(k, " ".join(v)) for k, v in templates.items()], "template_id string, text string")
    got = {(row.doc_id, x.template_id) for row in licenses.scan(docs, table).collect() for x in row.licenses}
    assert len(expected) > 200 and got <= expected and len(got & expected) >= 0.99 * len(expected)
