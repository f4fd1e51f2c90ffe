from fairlane.llm import html_text

PAGE = (
    '<html><body class="has-sidebar"><div id="page" class="with-sidebar"><header class="site-header"><h1>Site</h1><p>Tag line here.</p></header>'
    '<div class="cookie-notice"><p>We use cookies, really. Many of them.</p></div><main><article><header><h1>Title</h1></header><p>Short.</p>'
    "<p>Some long text, with commas,\n and more &eacute;t&#233; <b>bold</b>er.<br>Next line<p>Unclosed, twice<ul><li>one<li>two</ul>"
    '<div class="share-buttons"><a href=x>Share</a></div><blockquote>Quoted words.</blockquote>'
    '<section id="comments"><p>Nice post, really great. I liked it a lot, thanks!</p></section></article>'
    "<aside><p>Related things, more text.</p></aside></main></div><footer>c</footer></body></html>"
)


def test_article_without_what_is_around_it():
    assert html_text.main_text(PAGE) == "Title Short. Some long text, with commas, and more été bolder. Next line Unclosed, twice one two Quoted words."


def test_layout_without_article_element():
    page = ('<body><div class="menu"><a href=x>Home</a></div><div class="content"><h2>Head</h2>text one, two. <br>more <i>it</i>alic'
            '<table><tr><td>cell</td></tr></table></div><div class="sidebar">long long text. with dots. and, commas, of course. yes.</div>'
            "<form><p>mail</p></form><script>var t='</p>';</script></body>")
    assert html_text.main_text(page) == "Head text one, two. more italic cell"


def test_odd_pages():
    assert html_text.main_text(None) == "" == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == html_text.main_text("<!-- open")
    assert html_text.main_text("plain &lt;b&gt; &amp;amp; text") == "plain <b> &amp; text"
    assert html_text.main_text("a < b and c > d") == "a < b and c > d"
    assert html_text.main_text("<p title='it'>x" + "<div>" * 3000 + "deep</p>") == "x deep"
    assert html_text.main_text('<p>a<a title="never closed>b</p><p>c</p>') != ""
    long_page = "<article>" + "<p>" + "word, " * 200000 + "</p></article>"
    assert html_text.main_text(long_page) == ("word, " * 200000).strip()


def test_table_with_nulls_repeats_and_clashing_names(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df = df.withColumn("text", df["url"]).withColumn("n_chars", df["page_id"])
    got = sorted((tuple(r) for r in html_text.extract(df).collect()), key=str)
    text = html_text.main_text(PAGE)
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(2, None, "", 0), (None, "v", "x", 1)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0


def test_marks_are_read_from_class_id_and_role_only():
    text = "Long text, with commas, and more. " * 8
    page = f'<body><div data-id="comment-1" data-state="hidden" title="a menu"><p>{text}</p></div><div CLASS=adsbygoogle><p>buy, now.</p></div><p hidden>x</p></body>'
    assert html_text.main_text(page) == text.strip()
    page = f'<body><div class="page-widget"><h1>Head</h1><p>{text}</p></div><div class="widget"><p>small, one.</p></div></body>'
    assert html_text.main_text(page) == "Head " + text.strip()
