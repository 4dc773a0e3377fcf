import re

import pytest

from loomstone.llm import html_extraction as hx

P1, P2, P3 = (f"This is paragraph {n}, which has some commas, and enough words to count as content of the page." for n in ("one", "two", "three"))
FULL = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x:y}}</style><script>var t = "<p>no</p>";</script></head>
<body class="has-sidebar"><header class="site"><a href="/">Home</a> Site name</header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div id="cookie-notice">We use cookies, and more cookies, all of the time, so please accept them now.</div>
<div class="wrap"><aside><p>{P1}</p></aside>
<article class="post"><h1>Title &amp; more</h1><p>{P1}<p>{P2} a<br>b   c &lt;tag&gt; &#233; <b>bold</b><i>er</i></p><ul><li>first item</li><li>second item</li></ul>
<div class="ad">Buy this, buy that, buy everything, because it is cheap, cheap, cheap today.</div><blockquote>{P3}</blockquote><form><p>{P1}</p><input value="x"></form>
<section class="comments"><h2>Comments</h2><p>{P1}</p></section></article></div><footer>&copy; someone, <a href="#">Imprint</a></footer></body></html>"""


def test_article_without_furniture():
    assert hx.extract(FULL) == "\n\n".join(["Title & more", P1, f"{P2} a b c <tag> é bolder", "first item", "second item", P3])


def test_best_container_without_article():
    page = f"<body><div class=menu><a href=/x>{P1}</a></div><div><h1>Head</h1><p>{P1}</p><p>{P2}</p></div><div><p><a href=y>Links, links, links, links and links that go elsewhere</a></p></div></body>"
    assert hx.extract(page) == f"Head\n\n{P1}\n\n{P2}"


def test_comments_as_articles_and_main():
    page = f"<main><h1>H</h1><p>{P1}</p><p>{P2}</p></main><div class='comment-list'><article class='comment'><p>{P3}</p></article></div>"
    assert hx.extract(page) == f"H\n\n{P1}\n\n{P2}"


def test_headers_of_the_site_and_of_the_article():
    page = f"<body><div class='site-header'><p>{P3}</p></div><div class='content has-sidebar'><article><header class='entry-header'><h1>H</h1></header><p>{P1}</p></article></div><div class='sidebar'><p>{P2}</p></div></body>"
    assert hx.extract(page) == f"H\n\n{P1}"
    assert hx.extract(f"<body><div class='with-sidebar'><h2>H</h2><p>{P1}</p></div><div class='sidebar'><p>{P2}</p></div></body>") == f"H\n\n{P1}"


@pytest.mark.parametrize("name", ["ad-free", "content-bottom", "left-side", "legal-analysis", "related-work", "warning-signs", "commentary-on-law", "header-free"])
def test_names_that_only_have_such_a_word_lose_nothing(name):
    text = f"H\n\n{P1}\n\n{P2}\n\n{P3}"
    assert hx.extract(f"<body><div class='post {name}'><h1>H</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div><div>short</div></body>") == text
    for attribute in ("class", "id"):
        assert hx.extract(f"<article><h1>H</h1><p>{P1}</p><div {attribute}='{name}'><p>{P2}</p></div><p>{P3}</p></article>") == text


@pytest.mark.parametrize("name", ["ad", "ads", "ad-slot", "cookie-notice", "sidebar", "right-sidebar", "site-footer", "shareButtons", "newsletter_box", "comments", "comment-list", "social-links", "promo"])
def test_names_that_are_furniture_go(name):
    text = f"H\n\n{P1}\n\n{P2}"
    for attribute in ("class", "id"):
        assert hx.extract(f"<article><h1>H</h1><p>{P1}</p><div {attribute}='{name}'><p>{P3}</p></div><p>{P2}</p></article>") == text
        assert hx.extract(f"<body><div><h1>H</h1><p>{P1}</p><p>{P2}</p></div><div {attribute}='{name}'><p>{P3}</p></div></body>") == text


def test_a_name_alone_does_not_remove_most_of_a_page():
    assert hx.extract(f"<body><div class='sidebar'><p>{P1}</p><p>{P2}</p></div><div>short</div></body>") == f"{P1}\n\n{P2}"
    many = "".join(f"<div class=comment><p>{P3}</p></div>" for _ in range(9))
    assert hx.extract(f"<article><h1>H</h1><p>{P1}</p><p>{P2}</p><section id=comments>{many}</section></article>") == f"H\n\n{P1}\n\n{P2}"
    nested = f"<article class=post><h1>H</h1><p>{P1}</p><p>{P2}</p><div id=comments><article class=comment><p>{P3}</p></article></div></article>"
    assert hx.extract(nested) == f"H\n\n{P1}\n\n{P2}"


def test_pages_with_div_for_article_give_the_same_text(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").limit(100).collect():
        page = r["html"] or ""
        assert hx.extract(page.replace("<article", "<div").replace("</article", "</div")) == hx.extract(page)


@pytest.mark.parametrize("page", [None, "", "   ", "<html>", "<p>", "<nav><a>x</a></nav>", "<", "<!-- open", "<script>x", "</p></div>", "<a href='x"])
def test_pages_without_text(page):
    assert hx.extract(page) == ""


def test_broken_and_deep_pages():
    assert hx.extract(f"<article><p><b>Bold<br><p>{P1}<p>{P2}") == f"Bold\n\n{P1}\n\n{P2}"
    deep = "<div>" * 5000 + f"<p>{P1}</p>" + "</div>" * 5000
    assert hx.extract(deep) == P1
    long = "<article>" + "".join(f"<p>{P1} {i}</p>" for i in range(20000)) + "</article>"
    assert hx.extract(long).count("\n\n") == 19999


def test_query_against_the_articles(spark, sf):
    import html

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = hx.op8_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]]["html"], re.S)[1].replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(x for x in blocks if x) and r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_awkward_rows(spark):
    rows = spark.createDataFrame([(1, None, None, "t"), (None, "u", f"<article><p>{P1}</p></article>", None), (2, "u", "", "x"), (2, "u", "", "x")], "page_id bigint, url string, html string, text string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in hx.extract_pages(rows).collect()) == [(0, P1), (1, ""), (2, ""), (2, "")]
    assert hx.extract_pages(rows.limit(0)).count() == 0
