"""Main text of hand-made pages."""

import pytest

from allelemill.llm import html_text

ARTICLE = "<article><h1>Short head</h1><p>First &amp; only   <b>bold</b> paragraph\n of this page.</p><div class='ad'>Buy!</div><p>Ok.</p></article>"
FRAME = "<html><head><title>T</title><style>p{{}}</style><script>var t='</p><p>no</p>';</script></head><body><header>Top</header><nav><ul><li><a href='/a'>A</a></li></ul></nav>{}<aside>Side</aside><form><p>Your name</p></form><footer><p>&copy; Foot</p></footer></body></html>"
LONG = "A sentence of some length that fills a paragraph of an article, and goes on and on until it is long enough."


def test_articles_are_whole():
    assert html_text.main_text(FRAME.format(ARTICLE)) == "Short head\n\nFirst & only bold paragraph of this page.\n\nOk."


def test_without_an_article_surge_and_dive_tell():
    body = f"<div id='top'><p>Hi</p></div><div class='sidebar'><p>{LONG}</p></div><div><h2>Head</h2><p>{LONG}</p><p>No.</p><p>{LONG}</p></div><div class='comments'><p>{LONG}</p></div>"
    assert html_text.main_text(FRAME.format(body)) == "\n\n".join(["Head", LONG, "No.", LONG])
    links = "".join(f"<li><a href='/{k}'>A link of a list of many links</a></li>" for k in range(9))
    assert html_text.main_text(f"<body><ul>{links}</ul><p>{LONG}</p><p>{LONG}</p><ul>{links}</ul></body>") == f"{LONG}\n\n{LONG}"


@pytest.mark.parametrize("mark", ["<div class='ad-box'>{}</div>", "<section id=comments>{}</section>", "<div class='cookieNotice'>{}</div>", "<div role='navigation'>{}</div>", "<aside>{}</aside>", "<form>{}</form>", "<div hidden>{}</div>", "<header>{}</header>", "<nav>{}</nav>", "<!-- {} -->", "<script>{}</script>", "<div class='comment-list'><article>{}</article></div>"])
def test_what_stands_apart_goes(mark):
    inner = "<p>Not wanted, though it is quite a long paragraph for what it is.</p>"
    page = FRAME.format(f"<article><p>{LONG}</p>{mark.format(inner)}<p>End.</p></article>{mark.format(inner)}")
    assert html_text.main_text(page) == f"{LONG}\n\nEnd."


def test_words_that_only_look_like_marks_stay():
    assert html_text.main_text("<article class='header-image-post shadow'><p>a</p></article><div class='download'>b</div>") == "a"
    assert html_text.main_text("<article><div class='lead broad'>Stays</div></article>") == "Stays"


def test_broken_markup():
    assert html_text.main_text("<article><p><b>One<br>two<p>Three</i> 3 < 4 & 5</p><p>Four") == "One two\n\nThree 3 < 4 & 5\n\nFour"
    assert html_text.main_text("<article><p title='a > b'>Text</p><p title=\"open>More</p></article>").startswith("Text")
    assert html_text.main_text("<article><p>&lt;p&gt; &eacute;&#233;&#xE9; &nbsp; x&ampy</p></article>") == "<p> ééé x&y"
    assert html_text.main_text("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>") == "a\n\nb\n\nc\n\nd"
    assert html_text.main_text("<article><p>x</p><script>unclosed <p>y</p>") == "x"
    assert html_text.main_text("<article><p>x<!-- unclosed <p>y</p>") == "x"


def test_nothing():
    assert [html_text.main_text(p) for p in (None, "", "<html></html>", "<nav>a</nav>", "<", "&")] == ["", "", "", "", "<", "&"]


def test_rows(spark):
    long = "<article>" + "".join(f"<p>Paragraph {k} &amp; more</p>" for k in range(20_000)) + "</article>"
    pages = spark.createDataFrame([(1, "u", FRAME.format(ARTICLE)), (1, "u", FRAME.format(ARTICLE)), (None, None, None), (2, "v", long)], "page_id long, url string, html string").selectExpr("*", "'x' AS text", "2 AS n_chars")
    rows = sorted((r["page_id"] or 0, r["n_chars"], r["text"]) for r in html_text.extracted(pages).collect())
    text = html_text.main_text(FRAME.format(ARTICLE))
    assert rows[0] == (0, 0, "") and rows[1] == rows[2] == (1, len(text), text)
    assert rows[3][2] == "\n\n".join(f"Paragraph {k} & more" for k in range(20_000))
    assert html_text.extracted(pages.limit(0)).count() == 0
