import random
import re

import pytest

import corpus_pipeline
from wordloom.llm import decontaminate, minhash, pii, registry, toxicity
from wordloom.llm.transducer import encode_texts

FILL = "house near river seemed quiet and we walked home after dinner with bread for all of them while rain fell over wide fields".split()


def write(spark, at, docs, labels, bench):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    r = random.Random(12)
    w = lambda n: " ".join(r.choice(FILL) + str(r.choice("abcdefgh")) for _ in range(n))
    bench = [(i, w(30)) for i in range(5)]
    docs, kind = [], {}

    def add(text, what):
        kind[len(docs)] = what
        docs.append((len(docs), text, "en", "s", len(text) if text else None))

    for _ in range(120):
        add(w(r.randrange(35, 70)), "clean")
    for i in range(40):
        add(w(r.randrange(10, 40)) + " idiot scum moron " + w(20) + " worthless clown", "toxic")
    for i in range(10):
        add(docs[i][1] if i % 2 else docs[i][1] + " ending", "copy")
    for i in range(10):
        add(w(30) + " " + bench[i % 5][1].upper() + " " + w(10), "leak")
    for i in range(10):
        add(w(20) + f" joe.{i}@ex{i}.org " + w(20), "private")
    add(None, "null")
    add("", "empty")
    labels = [(d, 1, int(kind[d] == "toxic")) for d in kind if kind[d] in ("clean", "toxic")]
    at = str(tmp_path_factory.mktemp("sf") / "sf")
    write(spark, at, docs, labels, bench)
    return at, docs, kind, bench


def test_each_decision_takes_effect(spark, planted):
    at, docs, kind, bench = planted
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}
    assert set(rows) == {d for d, k in kind.items() if k in ("clean", "private", "null", "empty")}
    texts = {d: re.sub(r"\S+@\S+", "<EMAIL>", docs[d][1]) if kind[d] == "private" else docs[d][1] for d in rows}
    ids, off = encode_texts([texts[d] for d in sorted(rows)])
    for d, a, b in zip(sorted(rows), off, off[1:]):
        assert rows[d].text == texts[d] and rows[d].n_chars == (None if texts[d] is None else len(texts[d]))
        assert rows[d].token_ids == (None if texts[d] is None else ids[a:b].tolist()) and rows[d].round_trip is not False


def test_stages_match_the_operators_one_by_one(spark, planted):
    at, docs, _, bench = planted
    model = toxicity.train(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    p = model.predict([d[1] for d in docs])
    left = {d[0]: d[1] for d, x in zip(docs, p) if d[1] is None or x < 0.5}
    from test_minhash import brute_groups

    named = {d: t for d, t in left.items() if t is not None}
    gone = {d for _, d in brute_groups(list(named), list(named.values()), minhash.THRESHOLD)}
    left = {d: t for d, t in left.items() if d not in gone}
    from test_decontaminate import brute

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    left = {d: t for d, t in left.items() if all(brute(words(b), words(t)) > decontaminate.allowed(len(words(b))) for _, b in bench)}
    seeds = lambda t: pii._masked(t, [(a, b, k) for a, b, k, _ in pii.candidates(t) if k in pii.KINDS])
    want = {d: t if t is None else seeds(t) for d, t in left.items()}
    assert {r.doc_id: r.text for r in corpus_pipeline.run(spark, at).collect()} == want


def test_odd_rows(spark, tmp_path):
    at = str(tmp_path / "sf")
    long = " ".join(f"v{i % 991} walk" for i in range(60_000)) + " joe@ex.org"
    rows = [(1, "a quiet walk home", "x", 1), (1, "a quiet walk home", "x", 1), (1, "rain fell over fields", "x", 1), (None, "a quiet walk home", None, 2), (2, "a quiet walk home", None, 3), (3, long, "y", 4), (4, None, "z", 5), (4, None, "z", 5), (5, "", "z", 6), (6, "", "z", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, token_ids string, H1 int").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    out = corpus_pipeline.run(spark, at)
    assert out.columns == ["doc_id", "text", "token_ids", "H1", "_token_ids", "n_tokens", "round_trip"]
    got = sorted(((r.doc_id, r.text, r.token_ids) for r in out.collect()), key=str)
    masked = long.replace("joe@ex.org", "<EMAIL>")
    assert got == sorted([(1, "a quiet walk home", "x"), (1, "rain fell over fields", "x"), (None, "a quiet walk home", None), (3, masked, "y"), (4, None, "z"), (4, None, "z"), (5, "", "z")], key=str)


def test_empty_tables(spark, tmp_path):
    at = str(tmp_path / "sf")
    write(spark, at, [], [], [])
    out = corpus_pipeline.run(spark, at)
    assert out.collect() == [] and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_registry():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 11)] and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash", "decontamination", "pii", "bpe"]
