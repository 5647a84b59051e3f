from textgate.llm import html_text


def texts(spark, pages):
    rows = [(i, "http://h.com/x", p) for i, p in enumerate(pages)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return [r.text for r in sorted(got, key=lambda r: r.page_id)]


def test_near_copies_keep_their_article(spark):
    shared = "".join(f"<p>Paragraph {k}.</p>" for k in range(3))
    got = texts(spark, [f"<body><p>Site</p><article>{shared}<p>Only {i}.</p></article></body>" for i in range(25)])
    assert got == [f"Paragraph 0. Paragraph 1. Paragraph 2. Only {i}." for i in range(25)]


def test_common_contents_outside_articles_still_go(spark):
    assert texts(spark, [f"<body><p>Site</p><p>Only {i}.</p></body>" for i in range(25)]) == [f"Only {i}." for i in range(25)]
