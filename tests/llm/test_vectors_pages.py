"""Vector searches and page text against brute force and written pages."""

import math
import random
import re

import numpy as np
import pytest


def vectors(spark, x, extra=()):
    rows = [(i, [float(v) for v in row], 0, 1) for i, row in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<float>, label int, score int")


ODD = [(3, [9.0] * 8, 0, 0), (20, [9.0] * 8, 0, 0), (5000, None, 0, 0), (5020, [1.0, None], 0, 0), (5040, [float("nan")] * 8, 0, 0), (None, [1.0] * 8, 0, 0), (5060, [float("inf")] * 8, 0, 0), (5080, [], 0, 0), (5081, [1.0, 2.0], 0, 0)]


def data(n=900):
    x = np.random.Generator(np.random.PCG64(5)).standard_normal((n, 8)).astype(np.float32)
    x[100:400] = x[100]  # one common vector
    return x


def best(x, q, k=20):
    s = x @ x[q]
    order = np.lexsort((np.arange(len(x)), -s))
    return [(int(i), s[i]) for i in order if i != q][:k]


def test_exact_top_k(spark):
    from pyspark.sql import functions as F

    from wirespan.llm.vectors import exact_top_k, quantised

    x = data()
    z = np.floor(64 * x.astype(np.float64))
    got = {}
    for r in exact_top_k(quantised(vectors(spark, x, ODD)), F.col("vec_id") % 20 == 0, shard_rows=200).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 900, 20))
    for q, hits in got.items():
        assert [(v, s) for _, v, s in sorted(hits)] == [(i, int(s)) for i, s in best(z, q)]
        assert [r for r, _, _ in sorted(hits)] == list(range(1, 21))


def test_neighbours(spark):
    from pyspark.sql import functions as F

    from wirespan.llm.vectors import nearest_lists, valid

    x = data()
    got = {}
    for r in nearest_lists(valid(vectors(spark, x, ODD)), F.col("vec_id") % 20 == 0, list_rows=40).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    y = x.astype(np.float64)
    hit = total = 0
    for q in range(0, 900, 20):
        want = best(y, q)
        found = [v for _, v, _ in sorted(got[q])]
        assert all(math.isclose(s, float((y[q] * y[v]).sum()), rel_tol=1e-12) for _, v, s in got[q])
        hit += len({i for i, _ in want} & set(found))
        total += len(want)
    assert hit >= 0.9 * total


@pytest.mark.parametrize("n", [0, 1, 7])
def test_few_vectors(spark, n):
    from pyspark.sql import functions as F

    from wirespan.llm.vectors import exact_top_k, nearest_lists, quantised, valid

    df = vectors(spark, data()[:n])
    for out in (exact_top_k(quantised(df), F.col("vec_id") % 20 == 0), nearest_lists(valid(df), F.col("vec_id") % 20 == 0)):
        assert sorted(r.vec_id for r in out.collect()) == list(range(1, n))


PAGES = {
    "<article><h1>A &amp; B</h1><p>one  <b>two</b>three<br>four<p>five</article>": "A & B one twothree four five",
    "<body><nav><ul><li><a href='/'>home</a></ul></nav><div class='ad'>buy this now please</div><main><p>Real text.</p><aside>see also</aside><p>More.</p></main><footer>&copy; me</footer>": "Real text. More.",
    "<div id=menu>a b c</div><div class='post'><p>text of the page here and more</p><script>var a = '<p>no</p>';</script></div><div class=comments>first! second!</div>": "text of the page here and more",
    "<div class=ad>unclosed words here<article>kept</article>": "kept",
    "plain & simple < 5 <!-- gone --> end": "plain & simple < 5 end",
    "<script>only script": "",
    "": "",
}

#: Article text that was dropped: after self-closed tags, of formulas and fallbacks, under names that say little.
KEPT = {
    "<article><svg class='i'/><p>one two three</p></article>": "one two three",
    "<svg viewBox=\"0 0 1 1\" /><math/><article><p>one two three</p><svg><text>no</text></svg><p>more</p></article>": "one two three more",
    "<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2 in TeX</annotation></math> holds</p></article>": "so x=2 holds",
    "<body><noscript>Please enable scripts</noscript><article><p>one two</p><noscript><p>three</p></noscript><object data=a><p>four</p></object><canvas>five</canvas><p>six</p></article>": "one two three four five six",
    "<main><div class='share-of-votes'><p>one</p></div><p id='meta-analysis'>two</p><section class='legal-history'><p>three</p></section><div class='byline'>By four</div><div class='section-header'><h2>five</h2></div><p class='tags'>six</p><div class='ad-slot'>buy</div></main>": "one two three By four five six",
    "<div class='legal'>terms</div><noscript>Please enable scripts</noscript><div class='post'><p>text of the page here and more</p></div><div class='share'>tell all</div>": "text of the page here and more",
}


@pytest.mark.parametrize("page", KEPT)
def test_article_text_stays(page):
    from wirespan.llm.html_text import main_text

    assert main_text(page) == KEPT[page]


def test_pages(spark):
    from wirespan.llm.html_text import extract, main_text

    for page, want in PAGES.items():
        assert main_text(page) == want
    long = "<p>" + "word " * 100_000 + "</p>"
    rows = [(1, "u", None, "x"), (2, None, long, "y"), (2, None, long, "y"), (None, "v", "<p>a", "z")]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 1), (1, 0), (2, 499_999), (2, 499_999)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _prose(n, stem="word"):
    return " ".join(f"{stem}{i}" for i in range(n))


#: Bodies of which every word of prose is the article's, whatever names or markup are around them.
WHOLE = {
    "heading": (f"<div class='entry-header'><h1>Big title here</h1></div><p>{_prose(50)}</p>", f"Big title here {_prose(50)}"),
    "byline": (f"<h1>Title</h1><p class='meta'>By some one</p><p>{_prose(50)}</p>", f"Title By some one {_prose(50)}"),
    "formula": (f"<p>{_prose(30)} <math><mi>x</mi></math> after</p>", f"{_prose(30)} x after"),
    "named": (f"<section id='form-validation'><h2>Form validation</h2><p>{_prose(40, 'v')}</p></section><p>{_prose(40)}</p>", f"Form validation {_prose(40, 'v')} {_prose(40)}"),
    "quote": (f"<p>{_prose(30)}</p><blockquote class='alert'><p>a quoted alarm</p></blockquote><p>{_prose(20)}</p>", f"{_prose(30)} a quoted alarm {_prose(20)}"),
    "long menu": (f"<p>{_prose(60)}</p><div class='menu'>{_prose(3000, 'm')}</div><nav>{_prose(900, 'n')}</nav><p>{_prose(50, 't')}</p>", f"{_prose(60)} {_prose(50, 't')}"),
    "breaks": ("<p>first words of it</p>" + "<br>" * 50 + f"<p>{_prose(60)}</p>", f"first words of it {_prose(60)}"),
    "parts": (f"<p>{_prose(30)}</p><div class='ad'>buy this now</div><form><label>name</label><input></form><p>{_prose(30, 't')}</p><div id='comments'><h3>Two comments</h3><p>{_prose(40, 'c')}</p></div>", f"{_prose(30)} {_prose(30, 't')}"),
}


@pytest.mark.parametrize("body", WHOLE)
@pytest.mark.parametrize("start, end", [("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("<div>", "</div>")])
def test_article_stays_whole(body, start, end):
    from wirespan.llm.html_text import main_text

    page = f"<html><body><header><p>Site name</p></header><ul class='menu'><li><a href='/'>Home</a></li></ul>{start}{WHOLE[body][0]}{end}<aside><p>{_prose(30, 's')}</p></aside><footer><p>All rights reserved by us</p></footer></body></html>"
    assert main_text(page) == WHOLE[body][1]


def test_best_run_is_the_best_of_all():
    from wirespan.llm.html_text import best_run

    rng = random.Random(5)
    for _ in range(300):
        values = [rng.choice([-4, -1, -0.25, 0, 0.5, 1, 3]) for _ in range(rng.randrange(12))]
        start, stop = best_run(values)
        every = [sum(values[i:j]) for i in range(len(values)) for j in range(i + 1, len(values) + 1)]
        assert sum(values[start:stop]) == max([0, *every])


def test_words_and_tags_have_graded_weights():
    from wirespan.llm.html_text import labelled_pages, main_text, weights

    _, words, tags = weights()
    assert len({round(v, 3) for v in words.values()}) > 20 and all(v < 0 for v in tags.values())
    for page in labelled_pages():  # what was learned tells the labelled pages themselves apart
        got = main_text(page).split()
        own = [w for w in re.sub(r"<[^>]*>", " ", page).split() if w[0] == "w"]
        kept = sum(w[0] == "w" for w in got)
        assert kept >= 0.95 * len(got) and kept >= 0.9 * len(own)


def test_stray_end_tags_take_no_time():
    import time

    from wirespan.llm.html_text import tokens

    began = time.perf_counter()
    assert sum(1 for _ in tokens("<div>" * 50_000 + "</p>" * 50_000 + "words")) == 100_001
    assert time.perf_counter() - began < 10
