from prefengine.llm.html import extract_text, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body class="page">
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/a>A</a></ul></nav>
<div class="cookie-notice">We use cookies, and more cookies, and even more cookies than before.</div>
<article><h1>The  title</h1><p>First paragraph, with commas, &eacute; and &lt;markup&gt;, long enough to count.<p>Second <b>bold
 and <a href=x>linked</a> text that is long, yes.<div class="ad-slot">Buy it, buy it now, buy it here, buy it there.</div>
<form><input name=q>Search</form><blockquote>Quoted<br>lines</blockquote></article>
<aside>Popular, posts, here</aside><section id="comments"><p>I disagree, strongly, with all of this, and at some length.</p></section>
<footer>&copy; all rights</footer></body></html>"""


def test_article():
    assert main_text(PAGE).split("\n") == ["The title", "First paragraph, with commas, é and <markup>, long enough to count.", "Second bold and linked text that is long, yes.", "Quoted lines"]


def test_best_container_without_article():
    page = """<body><div id=top><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><h1>Head</h1>
    <div class="story no-sidebar"><p>One long paragraph, with commas, that speaks about something at length.</p><p>Another one, also with commas, that goes on about it.</p></div>
    <p>A sibling paragraph that is long enough to be kept with the text, since it has no links in it at all.</p>
    <div class=sidebar><p>Other, stories, of, the, day, that, one, could, read, instead, of, this.</p></div></body>"""
    assert [x.split()[0] for x in main_text(page).split("\n")] == ["Head", "One", "Another", "A"]


def test_names():
    keep = ('class="layout-with-sidebar"', 'class="no-ads wide"', 'id="content" class="has-comments"', 'class="postBody"', 'class="headerless"')
    drop = ('class="siteHeader"', 'id="disqus_thread"', 'class="comment-list"', 'class="share buttons"', 'role="navigation"', "hidden", 'style="display: none"', 'class="newsletter-signup"')
    page = "<article><p>Some text, of the article.</p><div {}><p>More of it, in a box.</p></div></article>"
    assert [a for a in keep if "More" not in main_text(page.format(a))] == [] and [a for a in drop if "More" in main_text(page.format(a))] == []


def test_broken_and_odd():
    assert main_text("") == "" and main_text("plain  text") == "plain text"
    assert main_text("<article><p>hi <b>bo") == "hi bo"
    assert main_text("<div>a < b &amp c</div>") == "a < b & c"
    assert main_text("<p>a<!-- <p>no</p> --><p>b<script>x</script") == "a\nb"
    assert main_text('<p title="a>b">t</p>') == "t" and main_text("<p title='x>y</p>") != None  # noqa: E711
    deep = "<div>" * 3000 + "<p>deep text</p>" + "</div>" * 3000
    assert main_text(deep) == "deep text"
    long = "<article>" + "".join(f"<p>paragraph {i}, long.</p>" for i in range(20_000)) + "</article>"
    assert main_text(long).count("\n") == 19_999


def test_table(spark):
    df = spark.createDataFrame([(1, PAGE, "old", 5), (2, None, "old", 5), (2, "", "old", 5), (None, "<p>x", "old", 5)], "page_id long, html string, text string, n_chars int")
    out = sorted((str(r.page_id), r.text, r.n_chars) for r in extract_text(df).collect())
    assert out == sorted([("1", main_text(PAGE), len(main_text(PAGE))), ("2", "", 0), ("2", "", 0), ("None", "x", 1)])
    assert extract_text(df.limit(0)).count() == 0


LINE = "This sentence of the article goes on for a while, says one thing, and then it says another thing as well. "


def test_wrappers_and_sections_named_like_furniture():
    """Names and form tags remove no element that holds the article, nor a section of it."""
    body = f"<h1>Head</h1><p>{LINE * 3}</p><p>{LINE * 2}</p>"
    for wrap in ("<div class='header-fixed'>{}</div>", "<div class='layout sidebar-left'>{}</div>", "<form id='aspnetForm'>{}</form>", "<fieldset><div>{}</div></fieldset>"):
        for inside in (body, f"<article>{body}</article>"):
            page = "<body><div class='sidebar'><p>Other stories, of the day, that one could read.</p></div>" + wrap.format(inside) + "<div id='comments'><p>I say no.</p></div></body>"
            assert main_text(page).split("\n") == ["Head", (LINE * 3).strip(), (LINE * 2).strip()], page
    for section in ("section id='discussion'", "section class='related-work'", "div class='notice-period'"):
        assert main_text(f"<article>{body}<{section}><h2>More</h2><p>{LINE}</p></{section.split()[0]}></article>").endswith("More\n" + LINE.strip())
    assert main_text(f"<article><p>{LINE}<span class='share'>Share it</span></p></article>") == LINE.strip()
    for box in ("div class='comment-list'", "div class='related'"):
        text = LINE if "comment" in box else f"<a href=x>{LINE}</a>"
        assert "More" not in main_text(f"<article>{body}<{box}><h2>More</h2><p>{text}</p></div></article>")


def test_article_in_several_sections():
    """Without article or main, every section with paragraphs is kept, with headings, lists and short paragraphs beside them."""
    long = f"<div>{f'<p>{LINE * 3}</p>' * 5}</div>"
    page = f"""<body><div id=top><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><h1>Head</h1>{long}<h2>Second</h2><div><p>{LINE}</p></div>
    <h3>Third</h3><ul><li>first point<li>second point</ul><p>A short end of the story.</p><div><a href=a>{LINE}</a></div></div></body>"""
    got = main_text(page).split("\n")
    assert got == ["Head", *[(LINE * 3).strip()] * 5, "Second", LINE.strip(), "Third", "first point", "second point", "A short end of the story."]
    deeper = f"<body><div><section>{long}</section><section><div><p>{LINE}</p></div></section></div></body>"
    assert main_text(deeper).split("\n") == [*[(LINE * 3).strip()] * 5, LINE.strip()]


def test_parts_of_an_article_are_kept():
    lead = "<header><h1>Title</h1><p>A lead that says what it is about.</p></header>"
    assert main_text(f"<header>Site, name, and more of it here</header><article>{lead}<p>{LINE}</p></article>") == f"Title\nA lead that says what it is about.\n{LINE.strip()}"
    links = "<ul><li><a href=1>Source one</a><li><a href=2>Source two</a><li><a href=3>Source three</a></ul>"
    assert main_text(f"<article><h1>T</h1>{links}<p>{LINE}</p></article>") == f"T\n{LINE.strip()}"
    assert main_text(f"<article><h1>T</h1><p>{LINE}</p>{links}</article>") == f"T\n{LINE.strip()}\nSource one\nSource two\nSource three"
    box = f"<div><h3>More</h3>{links}</div>"
    assert main_text(f"<article><h1>T</h1><p>{LINE}</p>{box}</article>") == f"T\n{LINE.strip()}"
    assert main_text("<article><p>Press <button>Save</button> and then, for the <label>name</label> of it, go on.</p></article>") == "Press Save and then, for the name of it, go on."
    assert main_text(f"<article><p>{LINE}</p><form><p>Your <label>name</label> <button>Send</button></p></form><button>Share</button></article>") == LINE.strip()


def test_comments_by_structure():
    note = "<p>I say, with many words, that all of this is wrong, and I go on.</p>"
    article = f"<h1>T</h1><p>{LINE * 3}</p>"
    want = f"T\n{(LINE * 3).strip()}"
    nested = f"<article>{note}</article><article>{note}</article>"
    for more in (f"<section><h2>Comments</h2>{nested}</section>", nested, f"<h2>3 comments</h2>{note}<div>{note}</div>", f"<section><h3>Kommentare (2)</h3>{note}</section>",
                 f"<div class=kommentare>{note}</div>", f"<div class=werbung>{note}</div>", f"<ol>{f'<li><a href=u>Ann</a> <time>May 1</time>{note}' * 2}</ol>"):
        assert main_text(f"<body><article>{article}{more}</article></body>") == want, more
        assert main_text(f"<body><article>{article}</article>{more}</body>") == want or "<article>" in more, more
    # entries that are the article, articles in a wrapper and headings that speak of comments stay
    live = "".join(f"<li><a href=u>Ann</a> <time>May {i}</time><p>{LINE}</p>" for i in range(3))
    assert main_text(f"<article><h1>Live</h1><p>Short opening of it all, yes.</p><ol>{live}</ol></article>").count(LINE.strip()) == 3
    assert main_text(f"<article><p>A line of the wrapper, not long.</p><article><p>{LINE}</p></article></article>").endswith(LINE.strip())
    assert main_text(f"<article>{article}<h2>Comments on the law</h2><p>{LINE}</p></article>") == f"{want}\nComments on the law\n{LINE.strip()}"
    assert main_text(f"<article>{article}<h2>Comments</h2>{note}<h2>Method</h2><p>{LINE}</p></article>") == f"{want}\nMethod\n{LINE.strip()}"
