"""Template deduction on hosts whose pages name nothing, against planted articles and plain counting."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm import html_extraction as H

FIELDS = "page_id long, url string, html string, text string, n_chars int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))


def site(host, n, seed, first):
    """Pages without article or main tags and telling names: a menu with inline tags, a line of adverts, the text, a foot."""
    rng = random.Random(seed)
    rows, want = [], {}
    for i in range(n):
        paragraphs = [words(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 5))]
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        html = (f"<html><body><div class='k1'><b>All</b> our <i>things</i> and more</div><div class='k2'>{words(rng, 5)}</div>"
                f"<div class='k3'><h1>{paragraphs[0][:20]}</h1>{body}<div class='k5'>Tell <b>your</b> friends about us</div></div><div class='k4'>Made with care in our town</div></body></html>")  # fmt: skip
        rows.append((first + i, f"http://{host}/{i}", html, "x", 1))
        want[first + i] = "\n".join([paragraphs[0][:20].strip(), *paragraphs])
    return rows, want


def texts(spark, rows):
    return {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, FIELDS)).collect()}


def test_articles_without_names(spark):
    rows, want = site("a.example", 30, 1, 0)
    odd = [(900, "http://a.example/null", None, "x", 1), (901, "http://a.example/odd", "<html><body><table><tr><td>odd one</td></tr></table></body></html>", "x", 1), rows[3], rows[3]]
    got = texts(spark, rows + odd)
    assert {i: got[i] for i in want} == want
    assert got[900] == "" and "odd one" in got[901]


def test_small_hosts_find_the_slot(spark):
    rows, want = site("b.example", 3, 2, 0)
    got = texts(spark, rows)
    for i, text in want.items():
        assert text in got[i] and "Made with care" not in got[i] and "All our" not in got[i]


def test_copies_and_near_copies_keep_their_text(spark):
    rng = random.Random(5)
    parts = [words(rng, 40) for _ in range(10)]
    page = lambda p: "<html><body><div class='q'>" + "".join(f"<p>{x}</p>" for x in p) + "</div></body></html>"
    rows = [(i, "http://c.example/x", page(parts[:9] + [f"{parts[9]} n{i}"]), "x", 1) for i in range(12)] + [(50 + i, "http://c.example/y", page(parts), "x", 1) for i in range(12)]
    got = texts(spark, rows)
    assert got[0] == "\n".join(parts[:9] + [f"{parts[9]} n0"]) and got[50] == "\n".join(parts)


@pytest.mark.parametrize("n", [30, 12])
def test_classes_are_those_of_plain_counting(spark, n):
    rows, _ = site("d.example", n, 3, 0)
    rows += [(1000 + i, f"http://d.example/o{i}", f"<html><body><section class='z'><div>{i} other</div></section></body></html>", "x", 1) for i in range(n // 3)]
    pages = spark.createDataFrame(rows, FIELDS).withColumn("page", F.xxhash64("html"))
    got = defaultdict(set)
    for r in H.templates(pages.select(F.lit("d").alias("host"), "page", "html")).collect():
        got[r.page] = {t["token"] for t in r.template if not t["is_text"]}
    counts = [Counter(x.path for x in H.runs(r[2])[1][1:]) for r in rows]
    vectors = {p: tuple(c[p] for c in counts) for c in counts for p in c}
    size = Counter(vectors.values())
    valid = {p for p, v in vectors.items() if size[v] >= 2 and sum(x > 0 for x in v) >= max(2, 0.1 * len(rows)) and max(v) == 1}
    assert set().union(*got.values()) == valid and all(got[r["page"]] == valid & set(c) for r, c in zip(pages.select("page").collect(), counts))


def test_deep_pages_and_clashing_columns(spark):
    deep = "<html><body>" + "<div>" * 3000 + "at the bottom" + "</div>" * 3000 + "</body></html>"
    assert texts(spark, [(1, None, deep, "x", 1), (None, "no host", "<p>only</p>", "y", 2)]) == {1: "at the bottom", None: "only"}


def test_article_parts_with_menu_words_stay(spark):
    body = ("<h1>Title</h1><section class='related-work'><p>Others found this.</p></section><div class='legal'>The law says so.</div>"
            "<div class='search-results'>We <a href='/s'>searched</a> and found ten.</div><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> hold.</p>"
            "<noscript>A table in words.</noscript><div class='widget'>A widget is a <b>part</b>.</div>")  # fmt: skip
    rest = ("<div class='related'>More: <a href='/a'>one thing</a> <a href='/b'>another thing</a></div><div class='share'><a href='/f'>Share</a><button>Send</button></div>"
            "<noscript>Please enable JavaScript</noscript><noscript>Title</noscript><div class='comments'>A reader wrote.</div><div class='cookie-notice'>Cookies!</div>")  # fmt: skip
    html = f"<html><body><nav>Home</nav><article>{body}{rest}</article><footer>End</footer></body></html>"
    want = "Title\nOthers found this.\nThe law says so.\nWe searched and found ten.\nLet x=2 hold.\nA table in words.\nA widget is a part."
    assert texts(spark, [(1, "http://one.example/", html, "x", 1)]) == {1: want}


def test_doubtful_parts_nest():
    text = H.page_text("<body><div class='related'><noscript><div class='legal'>Kept words stand here.</div></noscript><a href='/'>no</a></div></body>", None)
    assert text == "Kept words stand here.\nno"
    assert H.page_text("<body>x<div class='share'>" * 2000 + "<a href='/'>deep</a>" + "</div></body>" * 2000, None).startswith("x")


def planted(rng, n):
    """A page of a shop-like site whose parts are named as real ones are, and its article's text."""
    parts = [words(rng, rng.randint(10, 50)) for _ in range(rng.randint(2, 6))]
    names = ["related-work", "legal-basis", "search-terms", "text", "widget-theory", "social-history"]
    article = "".join(f"<section class='{rng.choice(names)}'><p>{p}</p></section>" for p in parts)
    aside = f"<aside>{words(rng, 8)}</aside><div class='related'>{' '.join(f'<a href=/{i}>{words(rng, 4)}</a>' for i in range(4))}</div><div class='comments'><p>{words(rng, 12)}</p></div>"
    html = f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Page {n}</h1>{article}{aside}</article><footer>Made here</footer></body></html>"
    return html, "\n".join([f"Page {n}", *parts])


def test_planted_site_is_found_whole(spark):
    rng = random.Random(8)
    pages = [planted(rng, n) for n in range(40)]
    got = texts(spark, [(n, f"http://p.example/{n}", html, "x", 1) for n, (html, _) in enumerate(pages)])
    assert got == {n: want for n, (_, want) in enumerate(pages)}
