"""Template deduction against plain Python, nested classes, slots, long pages and both ways of handing templates on."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tamarack.llm import html_extraction as H
from tests.conftest import DATA


def pages_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")


def plain_templates(rows):
    """Templates by their definition: whole occurrence vectors, classes by equality, shares by counting pages."""
    hosts = defaultdict(dict)
    for host, source in rows:
        page, found = H.Page(source), Counter()
        for p, n in page.tags.items():
            found["tag", p, p.rpartition("/")[0]] += n
        for p, t, *_ in page.texts:
            if t != " ":
                found["text", p, t.strip()] += 1
        hosts[host][source] = found
    out = set()
    for host, pages in hosts.items():
        vectors = defaultdict(dict)
        for source, found in pages.items():
            for tok, n in found.items():
                vectors[tok][source] = n
        classes = defaultdict(set)
        for tok, v in vectors.items():
            classes[frozenset(v.items())].add(tok)
        kept = {t for v, ts in classes.items() for t in ts if len(v) >= H.CLASS_PAGES and len(ts) >= H.CLASS_TOKENS}
        n_tag = {t[1]: len(v) for t, v in vectors.items() if t[0] == "tag"}
        around = lambda t: t[2] if t[0] == "tag" else t[1]
        holders = {around(t) for t in kept}
        for t in kept:
            n_outer = n_tag.get(around(t), len(pages))
            if (t[0] == "tag" and t[1] in holders) or len(vectors[t]) >= H.CLASS_SHARE * n_outer:
                out.add((host, H.token("tag", t[1]) if t[0] == "tag" else H.token("text", t[1], t[2])))
    return out


def random_pages(r):
    rows = []
    for _ in range(60):
        host = r.choice(["a", "a", "b", "c"])
        parts = ["<html><body><div class=top><span>Home</span> <span>About</span></div>"]
        if r.random() < 0.5:
            parts.append(f"<div class=side><h3>Categories</h3><ul><li>{r.choice(['One', 'Two', 'One'])}</li></ul></div>")
        parts.append("<div class=text>" + "".join(f"<p>{' '.join(r.choices('some words of many kinds in a text'.split(), k=r.randint(1, 6)))}</p>" for _ in range(r.randint(0, 4))) + "</div>")
        if r.random() < 0.8:
            parts.append("<div>All rights</div>")
        rows.append((host, "".join(parts)))
    return rows + rows[:5]


def test_templates_by_definition(spark):
    rows = random_pages(random.Random(5)) + [(r.url.split("/")[2].lower(), r.html) for r in spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").collect()]
    got = H.templates(spark.createDataFrame(rows, "host string, html string")).collect()
    want = plain_templates(rows)
    assert {(r.host, r.token) for r in got} == want and len(want) > 20


SIDE = "<div class=side><h3>Categories</h3><p>Pick one of the many categories of this host that we have</p></div>"


def story(i, side):
    return f"<html><body><div class=top><b>Home</b> <b>News</b></div>{SIDE if side else ''}<div class=text><h2>Story {i}</h2><p>{'It tells of ' + str(i * 7)} and of more.</p></div><div>All rights</div></body></html>"


def test_both_ways_of_handing_templates_on(spark, monkeypatch):
    pages = spark.read.parquet(f"{DATA}/sf0.001/pages.parquet")
    one = {r.page_id: r.text for r in H.extract(pages).collect()}
    monkeypatch.setattr(H, "BROADCAST_TOKENS", 0)
    assert {r.page_id: r.text for r in H.extract(pages).collect()} == one


@pytest.mark.parametrize("most", [10**6, 0])
def test_nested_classes_and_slots(spark, monkeypatch, most):
    """A side box that 6 of 20 pages have is template inside its own element, and the text's element is the slot."""
    monkeypatch.setattr(H, "BROADCAST_TOKENS", most)
    monkeypatch.setattr(H, "_ASIDE_WORDS", H.re.compile("(?!)"))  # names shall not decide
    rows = [(f"http://h.example/{i}", story(i, i < 6)) for i in range(20)]
    df = pages_of(spark, rows).withColumn("template", F.lit(1)).withColumn("host", F.lit(2))
    out = H.extract(df)
    assert out.columns == ["page_id", "url", "template", "host", "text"]
    assert {r.page_id: r.text for r in out.collect()} == {i: f"Story {i}\nIt tells of {i * 7} and of more." for i in range(20)}


def test_slots_find_the_articles_of_the_given_pages(spark):
    """With every telling tag and name made a plain <div> of its own, the slots of the template still lead to the article."""
    names = dict(zip("article main nav header footer aside form menu".split(), "abcdefgh", strict=True))
    tags = "|".join(names)
    rows = [(r.url.split("/")[2].lower(), r.html) for r in spark.read.parquet(f"{DATA}/sf0.01/pages.parquet").collect()]
    plain = [(h, H.re.sub(rf"</(?:{tags})\b", "</div", H.re.sub(rf"<({tags})\b", lambda m: f'<div class="{names[m[1]]}"', x.replace('class="ad"', 'class="k"')))) for h, x in rows]
    framed = defaultdict(set)
    for r in H.templates(spark.createDataFrame(plain, "host string, html string")).collect():
        framed[r.host].add(r.token)
    same = sum(H.main_text(x, frozenset()) == H.main_text(y, frozenset(framed[h])) for (h, x), (_, y) in zip(rows, plain, strict=True))
    assert len(rows) == 250 and same >= 0.95 * len(rows), same


def test_the_slots_decide_over_a_tag(spark):
    """Where the tag is on what the host's pages share, the text is what varies."""
    page = lambda i: f"<body><div class=x><article><p>The same words of welcome stand on each of the pages here.</p></article></div><div class=y><h2>Story {i}</h2><p>{'It tells of ' + str(i * 7)} and of more.</p></div></body>"
    rows = [(f"http://h.example/{i}", page(i)) for i in range(8)]
    assert {r.text for r in H.extract(pages_of(spark, rows)).collect()} == {f"Story {i}\nIt tells of {i * 7} and of more." for i in range(8)}


def test_nothing_of_an_article_is_lost():
    inside = '<div class="share-price"><p>Rose 4 %</p></div><h2 id="comments-on-policy">Policy</h2><p>a <math><mi>x</mi></math> b</p><div class="ad">Buy</div><ul class="related_posts-list"><li>More</li></ul><section class="comments"><p>First!</p></section>'
    assert H.main_text(f"<body><article><h1>T</h1>{inside}</article></body>", frozenset()) == "T\nRose 4 %\nPolicy\na x b"


def test_long_and_empty_pages(spark):
    long = "<body><article><p>" + "word &amp; more " * 100_000 + "</p></article></body>"
    rows = [("http://h.example/1", long), ("http://h.example/2", ""), (None, None), ("no host", "<p>x"), ("http://h.example/2", "")]
    got = {r.page_id: r.text for r in H.extract(pages_of(spark, rows)).collect()}
    assert got == {0: ("word & more " * 100_000).strip(), 1: "", 2: "", 3: "x", 4: ""}
    assert H.extract(pages_of(spark, rows).limit(0)).count() == 0
