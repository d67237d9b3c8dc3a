import random
import re

import numpy as np
import pytest

from wordloom.llm import toxicity as t

FILL = "the house near river seemed quiet and we walked home after dinner with bread for all of them".split()


def corpus(n=600, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        w = [r.choice(FILL) for _ in range(r.randrange(8, 80))]
        bad = i % 5 == 0
        if bad:
            for _ in range(r.randrange(2, 6)):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "scum", "zorgle", "moron"]))
        out.append((i, " ".join(w), int(bad)))
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = corpus()
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    return t.train(docs, spark.createDataFrame([(x[0], x[2]) for x in rows], "doc_id long, toxic int"))


def test_held_out_accuracy_and_calibration(model):
    rows = corpus(400, 9)
    p, y = model.predict([x[1] for x in rows]), np.array([x[2] for x in rows])
    assert ((p >= 0.5) == y).mean() > 0.97
    assert abs(p.mean() - y.mean()) < 0.05
    assert "zorgle" in model.learned


def test_obfuscated_words_are_read():
    c, k = t.Counter(), t.FEATURES.index("hidden")
    f = c.features(["such an 1d10t today", "what a st*pid plan", "you m.o.r.o.n indeed", "an i d i o t there", "stuuuupid thing", "a quiet walk home 10 times"])
    assert (f[:5, k] > 0).all() and f[5, k] == 0


def test_obfuscated_words_in_long_tokens():
    c, k = t.Counter(), t.FEATURES.index("hidden")
    long = ["quiet/" * 9 + "st*pid", "st" + "u" * 60 + "pid", "x=1;" * 30 + "1d10t", "walk_home_" * 20 + "m0r0n"]
    assert (c.features(long)[:, k] == 1).all()
    assert (c.features(["quiet/" * 50 + "walk", "a9" * 500, "https://example.org/idiot-walk/10"])[:, k] == 0).all()


def plain_features(c, text):
    """FEATURES of a text of plain words, sign by sign."""
    words = re.findall(r"[^\W_]+", text)
    low = [w.lower() for w in words]
    n, chars = max(len(words), 1), max(len(text), 1)
    lex, learned, you = set(t.LEXICON), set(c[1]), set(t.SECOND_PERSON)
    hit = [i for i, w in enumerate(low) if w in lex or w in learned]
    near = sum(any(low[j] in you for j in range(max(0, i - t.NEAR), min(len(low), i + t.NEAR + 1))) for i in hit)
    letters = sum(x.isalpha() for x in text)
    sign = [not x.isalnum() and not x.isspace() for x in text]
    return {
        "lexicon": sum(w in lex for w in low), "lexicon_density": sum(w in lex for w in low) / n, "learned": sum(w in learned for w in low), "learned_density": sum(w in learned for w in low) / n,
        "near_you": near, "near_you_density": near / n, "you_density": sum(w in you for w in low) / n, "capitals": sum(x.isupper() for x in text) / max(letters, 1),
        "capital_words": sum(len(w) > 1 and w.isupper() and w.isalpha() for w in words) / n, "exclaims": text.count("!") / chars, "questions": text.count("?") / chars, "punctuation": sum(sign) / chars,
        "sign_runs": sum(a and b for a, b in zip(sign, sign[1:])) / chars, "digits": sum(x.isdigit() for x in text) / chars,
        "drawn_out": sum(a.isalpha() and a.lower() == b.lower() == d.lower() for a, b, d in zip(text, text[1:], text[2:])) / n,
    }


def test_features_match_plain_counting():
    r = random.Random(4)
    c = ((), ("zorgle",))
    counter = t.Counter(learned=c[1])
    texts = [" ".join(r.choice([*FILL, "idiot", "You", "SCUM", "zorgle", "du", "sooo", "12", "Dumm", "you!!", "why?!", "é", "(x)", "WOW"]) for _ in range(r.randrange(0, 60))) for _ in range(80)]
    got = counter.features(texts)
    for x, text in zip(got, texts):
        for name, want in plain_features(c, text).items():
            assert x[t.FEATURES.index(name)] == pytest.approx(want), (name, text)


def test_first_split_is_the_best_of_all():
    r = np.random.default_rng(5)
    x = np.round(r.random((300, 4)), 2)
    y = (x[:, 2] + 0.3 * r.random(300) > 0.7).astype(float)
    tree = t.boost(x, y, trees=1, depth=1, bins=10_000, rate=1.0)
    p = y.mean()
    g, h = y - p, np.full(300, p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    least = min(20.0, max(3.0, y.sum() / 4))
    every = [(gain(x[:, j] <= c) + gain(x[:, j] > c), j, c) for j in range(4) for u in [np.unique(x[:, j])] for c in (u[1:] + u[:-1]) / 2 if min((x[:, j] <= c).sum(), (x[:, j] > c).sum()) >= least]
    best = max(every)
    assert tree.feature[0, 0] == best[1] and tree.cut[0, 0] == pytest.approx(best[2])
    left = x[:, best[1]] <= best[2]
    assert tree.leaf[0].tolist() == pytest.approx([g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])
    assert tree.score(x) == pytest.approx(np.log(p / (1 - p)) + np.where(left, tree.leaf[0, 0], tree.leaf[0, 1]))


def test_isotonic_is_the_min_of_maxima():
    r = np.random.default_rng(2)
    s = np.sort(r.permutation(60)[:40]).astype(float)
    y = (r.random(40) < s / 60).astype(float)
    want = [max(min(y[a : b + 1].mean() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.interp(s, *t.isotonic(s, y)) == pytest.approx(want)


def test_a_score_at_the_threshold_is_toxic(spark, model):
    docs = spark.createDataFrame([(1, "you idiot scum"), (2, "a quiet walk")], "doc_id long, text string")
    p = {x.doc_id: x.toxicity for x in t.score(docs, model).collect()}
    assert {x.doc_id: x.toxic for x in t.score(docs, model, threshold=p[2]).collect()} == {1: True, 2: True}
    assert t.keep_clean(docs, model, threshold=p[2]).count() == 0


def test_second_person_near():
    c, k = t.Counter(), t.FEATURES.index("near_you")
    f = c.features(["you are an idiot", "you " + "word " * 30 + "idiot"])
    assert f[0, k] == 1 and f[1, k] == 0


def test_isotonic_is_pooled_and_monotone():
    r = np.random.default_rng(1)
    s = r.integers(0, 20, 300) / 3.0
    y = (r.random(300) < s / 8).astype(float)
    xs, ys = t.isotonic(s, y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    fitted = np.interp(s, xs, ys)
    assert fitted.sum() == pytest.approx(y.sum())


def test_odd_rows(spark, model):
    long = "quiet river " * 300_000
    rows = [(1, "you idiot scum idiot moron", "a", 1.0), (1, "you idiot scum idiot moron", "a", 1.0), (None, "a quiet walk", None, None), (2, None, "b", 1.0), (3, "", "b", 1.0), (4, long, "c", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string, TOXICITY double")
    got = sorted(((r.doc_id, r.toxic, r.toxicity is None) for r in t.score(docs, model).collect()), key=str)
    assert got == sorted([(1, True, False), (1, True, False), (None, False, False), (2, False, True), (3, False, False), (4, False, False)], key=str)
    kept = t.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, 2, 3, 4], key=str)
    assert t.score(docs.limit(0), model).collect() == []


def test_training_without_labels_is_a_rule(spark):
    docs = spark.createDataFrame([(1, "you idiot you scum")], "doc_id long, text string")
    for labels in ([], [(1, None), (None, 1)], [(1, 1), (1, 1)]):
        m = t.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert m.trees is None and t.score(docs, m).first().toxic
