import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.functions import automata as au
from wordloom.functions import idsets as ids
from wordloom.functions.text import levenshtein

WORDS = sorted({"".join(random.Random(i).choice("abc") for _ in range(i % 7)) for i in range(400)})


def test_automata_of_lists_products_and_minimal_ones():
    a, b = au.strings_dfa(WORDS[::2]), au.strings_dfa(WORDS[::3])
    for d, want in ((a, set(WORDS[::2])), (au.union(a, b), {*WORDS[::2], *WORDS[::3]}), (au.intersection(a, b), {*WORDS[::2]} & {*WORDS[::3]}), (au.difference(a, b), {*WORDS[::2]} - {*WORDS[::3]})):
        assert {w for w in WORDS if d.accepts(w)} == want == set(au.find_all_matches(d, WORDS))
        m = d.minimized()
        assert {w for w in WORDS if m.accepts(w)} == want and len(m.states()) <= len(d.states())


@pytest.mark.parametrize("k", [0, 1, 2])
def test_edit_distance(k):
    n = au.levenshtein_automaton("abca", k)
    want = {w for w in WORDS if levenshtein(w, "abca") <= k}
    assert {w for w in WORDS if n.accepts(w)} == want == set(au.find_all_matches(n.to_dfa(), WORDS))
    p = au.levenshtein_automaton("abca", k, prefix=2).to_dfa()
    assert all(w.startswith("ab") for w in au.find_all_matches(p, WORDS))


@pytest.mark.parametrize("glob,regex", [("a*c", "a.*c"), ("?b*", ".b.*"), ("[ab]?[!a]", "[ab].[^a]"), ("*", ".*"), ("a\\*", "a\\*"), ("", "")])
def test_globs(glob, regex):
    n = au.glob_automaton(glob)
    for s in (*WORDS, "a*", "xyz", "zb"):
        assert n.accepts(s) == n.to_dfa().accepts(s) == bool(re.fullmatch(regex, s)), s


def test_regex_parts():
    b = au.RegexBuilder()
    n = b.finish(b.concat(b.char("a"), b.star(b.choice(b.char("b"), b.charset("cd"))), b.optional(b.any()), b.plus(b.char("e"))))
    for s in ("ae", "abbce", "axe", "aee", "abdxeee", "e", "a", "abx", "axxe"):
        assert n.accepts(s) == n.to_dfa().accepts(s) == bool(re.fullmatch("a(b|[cd])*.?e+", s)), s
    assert au.regex_limit("abc.*") == ("abc", "abd") and au.regex_limit("ab*c") == ("a", "b") and au.regex_limit("a|b") == ("", None) and au.regex_limit(".x") == ("", None)


def test_predicate_on_terms(spark):
    df = spark.createDataFrame([(w,) for w in [*WORDS, None]], "term string")
    got = {r.term for r in df.where(au.term_predicate(au.levenshtein_automaton("abca", 1))(df.term)).collect()}
    assert got == {w for w in WORDS if levenshtein(w, "abca") <= 1}
    glob = {r.term for r in df.where(au.term_predicate(au.glob_automaton("a*[!b]"))(df.term)).collect()}
    assert glob == {w for w in WORDS if re.fullmatch("a.*[^b]", w)} and glob


KINDS = [ids.SortedIntSet, ids.BitSet, ids.RoaringIdSet]


@pytest.mark.parametrize("kind", KINDS)
@settings(max_examples=40, deadline=None)
@given(a=st.sets(st.integers(0, 200_000), max_size=60), b=st.sets(st.integers(0, 200_000), max_size=60), x=st.integers(0, 200_000))
def test_sets_are_sets(kind, a, b, x):
    s, t = kind(a), kind(b)
    assert list(s) == sorted(a) and len(s) == len(a) and (x in s) == (x in a)
    assert set(s | t) == a | b and set(s & t) == a & b and set(s - t) == a - b and s.isdisjoint(t) == a.isdisjoint(b)
    assert s.first() == min(a, default=None) and s.last() == max(a, default=None)
    assert s.before(x) == max((i for i in a if i < x), default=None) and s.after(x) == min((i for i in a if i > x), default=None)
    s.add(x)
    assert set(s) == a | {x}
    s.discard(x)
    assert set(s) == a - {x}


def test_other_sets(spark, tmp_path):
    dense = set(range(0, 60_000, 3)) | {70_000}
    r = ids.RoaringIdSet(dense)
    assert set(r) == dense and 3 in r and 4 not in r and set(ids.ReverseIdSet(r, 100)) == set(range(100)) - dense and set(r.invert(10)) == {1, 2, 4, 5, 7, 8}
    (tmp_path / "bits").write_bytes(b"xx" + ids.BitSet([1, 9, 17]).dump())
    d = ids.OnDiskBitSet(str(tmp_path / "bits"), 2)
    assert list(d) == [1, 9, 17] and 9 in d and 8 not in d and 1000 not in d
    m = ids.MultiIdSet([ids.SortedIntSet([0, 2]), ids.BitSet([1])], [0, 10])
    assert list(m) == [0, 2, 11] and 11 in m and 10 not in m and ids.SortedIntSet() == ids.BitSet()
    assert sorted(x.doc_id for x in d.to_frame(spark).collect()) == [1, 9, 17]
