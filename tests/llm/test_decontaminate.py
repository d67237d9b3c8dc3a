import random

import numpy as np
import pytest

from wordloom.llm import decontaminate as d


def brute(item, text):
    """Least edits of item against any run of text."""
    prev = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        cur = [i]
        for j, y in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def edit(r, words, k):
    w = list(words)
    for _ in range(k):
        p = r.randrange(len(w))
        what = r.randrange(3)
        if what == 0:
            w[p] = f"z{r.randrange(999)}"
        elif what == 1:
            w.insert(p, f"z{r.randrange(999)}")
        else:
            del w[p]
    return w


def test_best_match_is_exact():
    r = random.Random(2)
    for _ in range(300):
        item = [r.randrange(6) for _ in range(r.randrange(1, 12))]
        text = [r.randrange(6) for _ in range(r.randrange(0, 40))]
        e, a, b = d.best_match(np.array(item), np.array(text))
        assert e == brute(item, text)
        if text:
            assert brute(item, text[a:b]) == e


@pytest.fixture(scope="module")
def planted():
    r = random.Random(8)
    word = lambda: f"w{min(int(r.expovariate(0.02)), 400)}"
    items = [[word() for _ in range(r.choice([6, 12, 20, 35, 60]))] for _ in range(40)]
    docs = []
    for n in range(250):
        fill = [word() for _ in range(r.randrange(40, 300))]
        if n % 2:
            item = items[n % 40]
            p = r.randrange(len(fill))
            fill[p:p] = edit(r, item, r.randrange(d.allowed(len(item)) + 1))
        docs.append(fill)
    return items, docs


def test_search_against_brute_force(spark, planted):
    items, docs = planted
    want = {(n, i): e for n, t in enumerate(docs) for i, x in enumerate(items) if (e := brute(x, t)) <= d.allowed(len(x))}
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    table = spark.createDataFrame([(n, " ".join(t).upper()) for n, t in enumerate(docs)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in d.find(table, bench).collect()}
    assert all(got[k] == want[k] for k in got)
    assert len(got) >= 0.95 * len(want) and len(want) > 100
    in_turns = {(r.doc_id, r.item_id): r.edits for r in d.find(table, bench, items_a_pass=15).collect()}
    assert all(in_turns[k] == want[k] for k in in_turns) and len(in_turns) >= 0.95 * len(want)


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    long = "filler words go on " * 100_000 + item + " and on" * 200_000
    rows = [(1, f"x {item} y", "a", None), (1, f"x {item} y", "a", None), (None, item, None, 1), (2, None, "b", 2), (3, "", "c", 3), (4, long, "d", 4), (5, "nothing to see", "e", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, M int")
    bench = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, None, 2), (None, "", 3)], "item_id long, text string, doc_id int")
    got = sorted((tuple(r) for r in d.find(docs, bench).collect()), key=str)
    one = [(1, 7, 0, 1, 10)] * 4 + [(4, 7, 0, 400_000, 10)] * 2 + [(None, 7, 0, 0, 10)] * 2
    assert got == sorted(one, key=str)
    clean = d.keep_clean(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [2, 3, 5]
    assert d.find(docs.limit(0), bench).collect() == [] and d.find(docs, bench.limit(0)).collect() == []
    assert d.keep_clean(docs, bench.limit(0)).count() == 7
