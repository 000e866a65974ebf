"""Operator 4 on small pages."""

import random
import re

import pytest

from civicgauge.llm import page_text

PAGE = "page_id long, url string, html string, host int, path int, lines string, deleted string, key string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, 2, "x", "y", "z") for i, (u, h) in enumerate(rows)], PAGE)


def texts(spark, rows):
    return {r.page_id: r.text for r in page_text.extract(pages(spark, rows)).collect()}


ARTICLE = """<!DOCTYPE html><html><head><title>T &amp</title><style>p{}</style><script>var t="</p><article>no";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy</div><header>Top</header>
<article><header><h1>The  title</h1></header><p><b>One &amp; two&nbsp;&#233;<br>three<p>Four <i>five</i></p>
<aside>Side</aside><div class="share-buttons">Share</div><form><p>Mail</p></form><section id="comments"><p>Nice!</p></section></article>
<footer>&copy; foot</footer>"""


def test_article_without_its_surroundings(spark):
    found = page_text.extract(pages(spark, [("http://h.example/a", ARTICLE)])).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in found] == [(0, "http://h.example/a", "The title\n\nOne & two é three\n\nFour five", 39)]


def test_awkward_rows(spark):
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    rows = [(None, None), ("", ""), ("no url", "plain < text & more"), ("http://h/x", "<p>a</p>"), ("http://h/x", long),
            ("http://h/x", "<div" * 50), ("http://h/y", "<p title='>\">q</p>\"'>quoted</p>"), ("http://h/z", "<script>never closed <p>x</p>")]
    found = texts(spark, rows)
    assert found[0] == found[1] == "" and found[2] == "plain < text & more" and found[4].count("\n\n") == 19_999
    assert found[6].endswith("quoted") and found[7] == "" and len(found) == len(rows)
    assert page_text.extract(pages(spark, rows).limit(0)).count() == 0


def plain(lines):
    return "".join(f"<div>{x}</div>" for x in lines)


def test_lines_shared_with_the_nearest_page_are_template(spark):
    """Pages without an article: what the neighbour by path has too goes, in order, and nothing else."""
    rows = [("http://h.example/news/1", plain(["Welcome", "first story", "Contact us"])),
            ("http://h.example/news/2", plain(["Welcome", "second story", "more of it", "Contact us"])),
            ("http://h.example/shop/1", plain(["Shop", "a chair", "Pay here"])),
            ("http://h.example/shop/2", plain(["Shop", "a table", "Pay here"])),
            ("http://other.example/news/1", plain(["Welcome", "alone", "Contact us"]))]
    assert texts(spark, rows) == {0: "first story", 1: "second story\n\nmore of it", 2: "a chair", 3: "a table", 4: "Welcome\n\nalone\n\nContact us"}


def test_copies_and_articles_lose_nothing(spark):
    same, article = plain(["Welcome", "story"]), "<article><p>Welcome</p><p>story</p></article>"
    rows = [("http://h/1", same), ("http://h/2", same), ("http://h/1", same), ("http://g/1", article), ("http://g/2", article + "<p>Welcome</p>")]
    assert set(texts(spark, rows).values()) == {"Welcome\n\nstory"}


def test_template_inside_articles(spark):
    """What all pages of a host have in their articles goes, from the first and the last one too; quotations and versions stay."""
    def page(i, *more):
        return "<article>" + "".join(f"<p>{x}</p>" for x in ("Subscribe now", f"a long story {i} of its own", f"and its end {i}", *more, "Read more")) + "</article>"

    rows = [(f"http://h/{i}", page(i, "Quoted") if i < 2 else page(i)) for i in range(6)]
    rows += [(f"http://v/{i}", f"<main><p>one story in versions</p><p>the same end</p><p>version {i}</p></main>") for i in range(4)]
    rows += [(f"http://o/{i}", f"<article><p>story {i}</p></article><div>Shared</div><div>own note {i}</div>") for i in range(3)]
    found = texts(spark, rows)
    assert [found[i] for i in range(6)] == [f"a long story {i} of its own\n\nand its end {i}" + "\n\nQuoted" * (i < 2) for i in range(6)]
    assert [found[6 + i] for i in range(4)] == [f"one story in versions\n\nthe same end\n\nversion {i}" for i in range(4)]
    assert [found[10 + i] for i in range(3)] == [f"story {i}\n\nown note {i}" for i in range(3)]


def test_names_drop_only_what_they_name():
    def text(html):
        return [t for _, t in page_text.blocks(html)]

    for name in ("layout has-sidebar", "no-comments", "with-banner", "search-results-article", "sidebar"):
        assert text(f'<div class="{name}"><article><p>story</p></article></div>') == ["story"], name
    for name in ("related-work", "social-policy", "no-comments"):
        assert text(f'<article><section id="{name}"><p>part</p></section></article>') == ["part"], name
    for name in ("share-buttons", "site-footer", "ad", "x sidebar", "comments", "left_nav"):
        assert text(f'<article><p>a</p><div class="{name}"><p>no</p><article>no</article></div><p>b</p></article>') == ["a", "b"], name
        assert text(f'<p>a</p><div class="{name}"><p>no</p><div>no</div></div><p>b</p>') == ["a", "b"], name
    assert text('<p>a</p><div class="sidebar"><p>never closed') == ["a"]


def slow_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_are_longest():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(14))] for _ in range(2))
        found = page_text.common_lines(a, b)
        assert len(found) == slow_common(a, b) and found == sorted(set(found))
        rest = iter(b)
        assert all(a[i] in rest for i in found)  # in b in the same order


def test_halved_lists_align_as_whole_ones(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(page_text, "HELD_BITS", 8)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(30))] for _ in range(2))
        found = page_text.common_lines(a, b)
        assert len(found) == slow_common(a, b) and found == sorted(set(found))
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_long_and_deep_pages_take_time_in_proportion():
    import time

    def seconds(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    lines = list(range(20_000))
    random.Random(1).shuffle(lines)
    assert seconds(lambda: page_text.common_lines(lines, list(range(20_000)))) < 20
    one, two = (seconds(lambda n=n: page_text.blocks("<div>" * n + "x" + "</span></ul>" * n + "</div>" * n)) for n in (10_000, 40_000))
    assert two < 8 * one + 0.5


def test_copies_get_one_text_wherever_they_are(spark):
    copy = plain(["TOP", "the same text", "FOOT"])
    rows = [(f"http://h.example/a/{i}", copy) for i in range(7)] + [(f"http://h.example/b/{i}", plain(["TOP", f"other {i}", "FOOT"])) for i in range(3)]
    found = texts(spark, rows)
    assert {found[i] for i in range(7)} == {"the same text"} and [found[i] for i in (7, 8, 9)] == ["other 0", "other 1", "other 2"]


def test_forms_and_names(spark):
    around = "<form id='f'><header>Top</header><h1>Title</h1><p>The text.</p><form><p>Your name</p><input></form></form>"
    inside = "<article><p>The text.</p><form><p>Write to us</p></form><p>The end.</p></article>"
    named = "<article><p>The text.</p><p class='advert'>Buy now</p><p class=cookie-notice>We use cookies<li>An item<p>More.</article><div class='post-comments'><p>Nice</p></div><div class='ad-slot'>Ad</div>"
    found = texts(spark, [(f"http://h{i}.example/", html) for i, html in enumerate([around, inside, named])])
    assert found[0].startswith("Title\n\nThe text.") and "Your name" not in found[0]
    assert found[1] == "The text.\n\nThe end." and found[2] == "The text.\n\nAn item\n\nMore."


def test_pairs_do_not_depend_on_partitions(spark):
    rows = [(f"http://h{i % 3}.example/d{i % 7}/{i}", plain(["Top", f"text {i}", f"Shelf {i % 7}", "End"])) for i in range(120)]
    found = []
    for n in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found.append(texts(spark, rows))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found[0] == found[1] == found[2]
    assert all(t == f"text {i}" for i, t in found[0].items())


def test_given_pages_give_their_article(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r.page_id: r.text for r in page_text.extract(rows).collect()}
    from html import unescape
    for r in rows.collect():
        inside = re.search("<article>(.*)</article>", r.html, re.S).group(1)
        parts = (" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?p>|</?h1>", inside))
        assert found[r.page_id] == "\n\n".join(p for p in parts if p)
