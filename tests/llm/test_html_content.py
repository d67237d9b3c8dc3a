import itertools
import random

import numpy as np
import pytest

from wordloom.llm import html_content as h


def page(r, mark="article"):
    w = lambda n: " ".join(r.choice(["lorem", "ipsum", "dolor", "sit", "amet,", "elit."]) for _ in range(n))
    body = [w(r.randrange(12, 60)) for _ in range(r.randrange(2, 6))]
    nav = "".join(f"<li><a href=/{i}>{w(2)}</a>" for i in range(5))
    ad, foot = w(6), w(5)
    tag = mark.split()[0]
    text = f"<html><head><title>{w(3)}</title><script>var t='</p>'</script></head><body><nav><ul>{nav}</ul></nav><div class=ad>{ad}</div><{mark}><h1>{w(5)}</h1>" + "".join(f"<p>{p}" for p in body) + f"</{tag}><footer>{foot}</footer></body></html>"
    return text, body


def test_marginals_are_those_of_all_labellings():
    r = random.Random(1)
    for n in (1, 2, 6, 9):
        parent = [-1] + [r.randrange(i) for i in range(1, n)]
        p = h.Page(parent, [r.randrange(len(h.TAGS)) for _ in range(n)], [r.choice(["", "a b."]) for _ in range(n)], [0] * n, [0] * n, [False] * n, False)
        f = h.forest([p, p])
        g = np.random.default_rng(n)
        unary, pair = g.normal(size=n), g.normal(size=(h.EDGES, 2, 2))
        got, joint = h.marginals(f, np.tile(unary, 2), pair)
        total, node, both = 0.0, np.zeros((n, 2)), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            s = np.exp(sum(unary[i] * y[i] for i in range(n)) + sum(pair[f.edge[i], y[parent[i]], y[i]] for i in range(1, n)))
            total += s
            for i in range(n):
                node[i, y[i]] += s
                if i:
                    both[i, y[parent[i]], y[i]] += s
        assert got[:n] == pytest.approx(node / total) and got[n:] == pytest.approx(node / total)
        assert joint[:n] == pytest.approx(both / total)


def test_held_out_pages_and_pages_without_marks():
    r = random.Random(2)
    model = h.fit([h.parse(page(r)[0]) for _ in range(150)])
    for mark in ("article", "main", "div", "div class=x"):
        right = wrong = missed = 0
        for _ in range(40):
            source, body = page(r, mark)
            tree = h.parse(source)
            got = {t for t, p in zip(tree.text, model.content([tree])[0]) if t and p >= 0.5}
            right += len(got & set(body))
            missed += len(set(body) - got)
            wrong += len([t for t in got if t not in body and len(t.split()) != 5])
        assert right > 50 * max(missed, 1) / 2 and wrong <= 0.05 * right, (mark, right, missed, wrong)


def test_texts_stand_in_document_order():
    texts = lambda source: [t for t in h.parse(source).text if t]
    assert texts("<p>a<p>b<div>c<b>d</div></i></b>e &amp; f<li>x<li>y<!-- <p>no --><script>if(a<b)</script><a href='>'>z</a><img src=x>q<br>w</td>") == ["a", "b", "cd", "e & f", "x", "yzq w"]
    assert texts("<div>one<p>two</p>three</div>") == ["one", "two", "three"]
    assert texts("<div>one<p>two</p>three <b>four</b><ul><li>five</ul>six</div>seven") == ["one", "two", "three four", "five", "six", "seven"]
    assert texts("<pre>a\n  b  c\n\nd</pre>") == ["a\n  b  c\n\nd"] and texts("<pre>\n<code>x = 1\ny</code></pre> z  z") == ["x = 1\ny", "z z"]
    assert texts("<p>a<b> </b>b <i>c</i>\n d</p>") == ["a b c d"]
    p = h.parse("<nav class=menu>one<p>two</p><a href=x>three</a></nav>")
    assert p.parent == [-1, 0, 1, 1] and p.names[1] == p.names[3] == 2 and p.link == [0, 0, 0, 5]


def test_parser_survives():
    for s in ("", "   ", "plain words", "<", "<<<>>>", "<p" * 5000, "</p>" * 100, "<div>" * 20000 + "x", "<script>", "<!--", "<a title=\"" + "x" * 50_000, "<div>" + "a<p>b</p>" * 5000):
        t = h.parse(s)
        assert t.parent[0] == -1 and all(u < i for i, u in enumerate(t.parent)) and len(t.parent) == len(t.text) == len(t.link)
    assert h.parse("plain words").text == ["plain words"]


def test_pages_without_marks_and_ties(spark):
    r = random.Random(6)
    made = [page(r, "div") for _ in range(30)]
    pages = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(made)], "page_id long, html string")
    model = h.train(pages)
    assert (model.weights == h._default().weights).all()
    got = {x.page_id: x for x in h.extract(pages, model).collect()}
    extra = 0
    for i, (source, body) in enumerate(made):
        lines = got[i].content.split("\n")
        assert set(body) <= set(lines) and lines == [t for t in h.parse(source).text if t in set(lines)]
        assert got[i].n_content == len(lines) < got[i].n_blocks - 4  # no line of the navigation
        extra += len(lines) > len(body) + 1  # more than the heading
    assert extra <= 3
    even = h.Model(np.zeros(h.N_FEATURES), np.zeros((h.EDGES, 2, 2)))  # every marginal is one half
    tie = {x.page_id: x for x in h.extract(pages, even).collect()}
    assert all(x.n_content == x.n_blocks for x in tie.values())


def test_odd_rows(spark):
    r = random.Random(3)
    rows = [(i, page(r)[0], "u") for i in range(40)]
    long = "<html><body><article>" + "<p>" + "many words, again. " * 60_000 + "</article></body></html>"
    odd = [(100, rows[0][1], "u"), (100, rows[0][1], "u"), (None, rows[1][1], None), (101, None, "u"), (102, "", "u"), (103, long, "u"), (104, "bare text", "u")]
    pages = spark.createDataFrame(rows + odd, "page_id long, html string, content string")
    model = h.train(pages)
    got = h.extract(pages, model).collect()
    assert len(got) == len(rows) + len(odd)
    by = {}
    for x in got:
        by.setdefault(x.page_id, []).append(x)
    assert len(by[100]) == 2 and by[100][0] == by[100][1] and by[100][0].content == by[0][0].content
    assert by[101][0].content is None and by[101][0].n_blocks is None and by[102][0].content == ""
    assert by[103][0].content.count("many words") == 60_000 and by[104][0].n_blocks == 1
    assert h.extract(pages.limit(0), model).collect() == []
    assert (h.train(pages.limit(0)).weights == h._default().weights).all()
