from textgate.llm import html_text

SCHEMA = "page_id long, url string, html string"


def extracted(spark, pages, extra=False):
    rows = [(i, u, p) for i, (u, p) in enumerate(pages)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", path long, low string") if extra else spark.createDataFrame(rows, SCHEMA)
    return {r.page_id: r for r in html_text.extract(df.repartition(3)).collect()}


def page(i):
    return (
        f"<body><div class='top{i}'><p>All about boats</p><ul><li><a href=/>Start</a></li><li><a href=/x>News</a></li></ul></div>"
        f"<div class=body><h1>Title {i}</h1><p>Text of number {i}.</p></div><div class=end><p>Made by us</p></div></body>"
    )


def test_only_the_tree_can_remove_the_frame(spark):
    assert all(not a for _, _, a in html_text.candidates(page(0)))
    assert [t for _, t, _ in html_text.candidates(page(0))] == ["All about boats", "Start", "News", "Title 0", "Text of number 0.", "Made by us"]
    got = extracted(spark, [("http://h.com/x", page(i)) for i in range(30)])
    assert {r.text for r in got.values()} == {f"Title {i} Text of number {i}." for i in range(30)}
    assert {(r.n_blocks, r.n_removed) for r in got.values()} == {(6, 4)}


def test_few_pages_prove_nothing(spark):
    got = extracted(spark, [("http://h.com/x", page(i)) for i in range(4)] + [("http://other.com", page(9))])
    assert all(r.n_removed == 0 for r in got.values())


def test_boilerplate_goes_as_branches_on_any_host(spark):
    html = "<nav><ul><li>Home</li></ul></nav><main><p>Body</p></main><footer><p>F</p></footer>"
    got = extracted(spark, [("http://h.com/x", html), (None, "<p>Alone"), (None, None)], extra=True)
    assert [(got[k].text, got[k].n_removed) for k in range(3)] == [("Body", 2), ("Alone", 0), ("", 0)]


def test_branch_importance_is_that_of_its_best_child(spark):
    html = lambda i: f"<div class=a><p>same</p><div class=b><p>{i} differs</p></div></div>"
    got = extracted(spark, [("http://h.com/x", html(i)) for i in range(40)])
    assert {r.text for r in got.values()} == {f"{i} differs" for i in range(40)}


def test_repeated_rows_long_pages_and_an_empty_table(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} of many.</p>" for i in range(20_000)) + "</article>"
    got = extracted(spark, [("http://h.com/x", long), ("http://h.com/x", long)])
    assert got[0].text == got[1].text == " ".join(f"Paragraph {i} of many." for i in range(20_000))
    assert html_text.extract(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [r.text for r in extracted(spark, [(None, None), ("http://h.com", "<nav></nav>")]).values()] == ["", ""]


def test_joined_beyond_the_broadcast_limits(spark, monkeypatch):
    monkeypatch.setattr(html_text, "MAX_NODES", 0)
    got = extracted(spark, [("http://h.com/x", page(i)) for i in range(30)])
    assert {r.text for r in got.values()} == {f"Title {i} Text of number {i}." for i in range(30)}
