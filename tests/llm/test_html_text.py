import html
import re

from pyspark.sql import functions as F

from docketry.llm import html_text as H


def test_query_against_the_plain_article(spark, sf_dir):
    pages = {x.page_id: x.html for x in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for x in H.op6_page_differencing(spark, sf_dir).collect():
        inside = re.search(r"<article>(.*?)(</article>|$)", pages[x.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert x.text == "\n\n".join(b for b in blocks if b) and x.n_chars == len(x.text)


def test_chrome_and_blocks():
    page = """<body><header><h1>Site</h1></header><nav>m</nav><main><article class=post><header><h1>Title</h1></header><p>One&nbsp;two <b>th</b>ree&amp;lt;.<div class="share">Share</div>
    <p>Four<ul><li>a<li>b</ul><aside>x</aside><form><p>q</p></form><!-- <p>no</p> --><script>var t="</p>";</script><section id="comments"><p>c</p></section></article></main><div class="cookie-notice">k</div><footer>f</footer>"""
    assert H.main_text(page) == "Title\n\nOne two three&lt;.\n\nFour\n\na\n\nb"


def test_common_lines_are_a_longest_subsequence():
    import random

    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randrange(4) for _ in range(r.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        places = sorted(H.common_lines(a, b))
        assert len(places) == best[-1][-1]
        it = iter(b)
        assert all(a[i] in it for i in places)


def page(*blocks):
    return "".join(f"<div>{b}</div>" for b in blocks)


def test_pages_without_an_article_are_differenced(spark):
    rows = [
        (1, "http://a.example/x/1", page("Home", "First story", "Imprint")), (2, "http://a.example/x/2", page("Home", "Second story", "Imprint")),
        (3, "http://b.example/", page("Home", "Alone")), (4, "http://c.example/1", page("Copy")), (5, "http://c.example/2", page("Copy")),
    ]
    got = {x.page_id: x.text for x in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "First story", 2: "Second story", 3: "Home\n\nAlone", 4: "Copy", 5: "Copy"}


def test_most_partners_decide(spark):
    """A line goes if more than half of the two pages on either side have it; pages farther off have no vote."""
    lines = {"all": range(9), "three of four": (2, 3, 4, 5), "one neighbour": (4, 5), "far": (0, 4, 8)}
    rows = [(i, f"http://h.example/p/{i}", page(*[name for name, has in lines.items() if i in has], f"own {i} " * 20)) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id as id", "page_id as t").repartition(3)
    got = {x.page_id: x.text.split("\n\n") for x in H.extract(df).collect()}
    assert got[4][:-1] == ["one neighbour", "far"] and got[0][:-1] == ["far"] and got[7][:-1] == []


def test_nothing_of_an_article_is_dropped():
    big = "".join(f"<p>Paragraph {i} of the story, at some length.</p>" for i in range(20))
    assert H.main_text(f"<article>{big}</article><article><p>A short second article.</p></article>").endswith("\n\nA short second article.")
    assert H.main_text('<article><p title="a hidden gem">Kept</p><p data-x=\'role="menu"\'>also</p><p alt="x" hidden>gone</p><p role=menu>gone</p></article>') == "Kept\n\nalso"
    assert H.main_text('<article><section id="discussion"><p>We discuss.</p></section></article>') == "We discuss."
    assert H.main_text('<article><p aria-hidden="false">a</p><p aria-hidden=true>b</p><p class>c</p><p id = "x" CLASS=\'share\'>d</p></article>') == "a\n\nc"


def test_what_the_partner_decides(spark):
    """Every open page of a host with a frame around its pages loses the frame, which no markup names; articles keep lines that others have."""
    frame = lambda i, story: "".join(f"<div>{x}</div>" for x in ("The daily paper", "Sections of it", *story, "All rights of this paper", f"Seen {i} times"))
    story = lambda i: [f"Story {i} told at length. " * 12, "A line that all the articles have."]
    rows = [(i, f"http://h.example/{i:02}", frame(i, story(i)) if i % 3 else f"<article>{frame(i, story(i))}</article>") for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got, alone = ({x.page_id: x.text for x in H.extract(pages).collect()} for pages in (df, df.withColumn("url", F.concat(F.lit("http://h"), "page_id", F.lit(".example/")))))
    for i in range(20):
        assert alone[i] == "\n\n".join(x.strip() for x in ("The daily paper", "Sections of it", *story(i), "All rights of this paper", f"Seen {i} times"))
        assert got[i] == ("\n\n".join((story(i)[0].strip(), f"Seen {i} times")) if i % 3 else alone[i])


def test_differencing_finds_the_element(spark, sf_dir):
    """Every page of the tables has the article as the element that holds what differs, found without its name."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id as id", "'http://h/' || page_id as url", "page_id as t", "html")
    parsed = H.parse(pages).cache()
    holding = H.differences(parsed)[1]
    rows = parsed.join(holding, "host").withColumn("spans", H.holding_spans()).select("inside", "spans").collect()
    assert len(rows) == parsed.count() and all(x.inside == list(range(x.spans[0].firsts, x.spans[0].afters)) for x in rows)


def test_teasers_are_not_the_story(spark):
    """Pages with article elements for teasers and the story elsewhere: what differs between pages decides, and markup alone where there is no other page."""
    story = lambda i: [f"Paragraph {k} of story {i} told at length. " * 3 for k in range(i, i + 4)]
    html_of = lambda i: f"<body><div class=top><p>The paper<p>All sections</div><article><h2>Teaser</h2><p>See number {i % 3}.</article><div class=story>{''.join(f'<p>{p}' for p in [*story(i), 'A sentence of many stories.'])}</div></body>"
    rows = [(i, f"http://h.example/{i:02}", html_of(i)) for i in range(12)] + [(99, "http://alone.example/", html_of(99))]
    got = {x.page_id: x.text for x in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(got[i].split("\n\n")[:4] == [p.strip() for p in story(i)] and "Teaser" not in got[i] for i in range(12)) and got[99] == "Teaser\n\nSee number 0."


def test_the_element_loses_no_line(spark):
    """A page without an article element: lines around the element go, a sentence that near articles share stays in it."""
    story = lambda i: [f"Paragraph {k} of story {i} told at length." for k in range(14)]
    html_of = lambda i: f"<body><div class=top><p>The paper<p>All sections</div><div class=story>{''.join(f'<p>{p}' for p in [*story(i), 'Read on.'])}</div></body>"
    rows = [(i, f"http://h.example/{i:02}", html_of(i)) for i in range(600)]
    got = {x.page_id: x.text for x in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == {i: "\n\n".join([*story(i), "Read on."]) for i in range(600)}


def test_classes_and_articles():
    assert H.main_text('<article><p class="notice-period">a</p><div class="media-widget"><p>b</p></div><div class="share-buttons">c</div><p class="ad">d</p></article>') == "a\n\nb"
    assert H.main_text("<main><h1>Title</h1><article><p>One</p></article><div class=related>x</div></main>") == "Title\n\nOne"
    assert H.main_text("<article><p>The first part of it</p></article><article><p>The second part</p></article><article>x</article>") == "The first part of it\n\nThe second part\n\nx"


def test_near_copies_are_no_partners(spark):
    story = ["The first paragraph of it", "And the second paragraph of it"]
    copies = [(i, f"http://a.example/s/{i}", page("Home", *story, f"Seen {i} times")) for i in range(5)]
    rows = [*copies, (5, "http://a.example/s/9", page("Home", "A story of another kind")), *[(i, f"http://b.example/{i}", page(*story, f"Seen {i} times")) for i in (6, 7)]]
    got = {x.page_id: x.text for x in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n\n".join([*story, f"Seen {i} times"]) for i in (0, 1, 2, 3, 4, 6, 7)} | {5: "A story of another kind"}


def test_edges(spark):
    big = 2**53 + 1
    rows = [(1, None, None), (1, None, None), (None, "http://[bad", "<p>x"), (big, "http://a", ""), (3, "http://a", "<p>" + "long " * 200_000), (4, "http://a", "<<<a <p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", *(f"'c' as {c}" for c in ("id", "t", "partner", "text", "host", "at", "open", "gone", "_id", "_t", "lines")))
    got = H.extract(df).collect()
    assert len(got) == 6 and max(len(x.text) for x in got) == 999_999 and {x.page_id for x in got} == {1, None, big, 3, 4}
    assert sorted(x.text for x in got if x.page_id == 1) == ["", ""]
    assert H.extract(df.limit(0)).count() == 0
