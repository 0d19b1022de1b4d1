"""Main text where names, constant texts and containers could cost text."""

from ordergate.llm import html_wrapper as H


def text_of(source):
    return H.main_text(H.Page(source), set(), None)


def test_names_that_only_sound_like_boilerplate():
    for source, want in (
            ("<body><div id=content class='with-sidebar'><h1>T</h1><p>one two</p></div></body>", "T one two"),
            ("<body><nav>m</nav><main class='search-results'><p>one</p></main></body>", "one"),
            ("<article class='post social'><p>one two three</p><div class=share-links>Share</div></article>", "one two three"),
            ("<section id=discussion><p>one</p></section>", "one"),
            ("<div class='search'><main><p>one</p></main></div>", "one"),
            ("<div class='sidebar-wrapper'><article><p>one</p></article></div><div class=ad>buy</div>", "one"),
            ("<form id=aspnetForm><h1>T</h1><p>long text of the page</p><nav>m</nav></form><div class=ad>buy</div>", "T long text of the page"),
            ("<div class=comments>all there is</div>", "all there is"),
            ("<article><div class=entry-header><h1>T</h1></div><p>one</p></article>", "T one"),
            ("<article>one</article><ol class=comment-list><li><article class=comment-body>two</article></ol>", "one"),
            ("<article><p>one</p></article><section class=related-posts><article>teaser</article></section>", "one"),
            ("<body><p>one two three four</p><div class=cookieNotice>c</div><div id=top-ad>ad</div><div class=sidebar-left>s</div>"
             "<div class='site-header'>h</div><div class=comments>a much longer comment than the text</div></body>", "one two three four")):
        assert text_of(source) == want, source


def extracted(spark, sources):
    df = spark.createDataFrame([(i, "http://a.example/", s) for i, s in enumerate(sources)], "page_id bigint, url string, html string")
    return [r.text for r in sorted(H.extract(df).collect())]


def test_constant_texts_inside_an_article_stay(spark):
    """Whatever the number of the host's pages."""
    def source(i):
        return (f"<body><div class=bar><a href=h>News</a></div><article><h1>News</h1><p class=byline>By A. Writer</p><p>Story {i}</p>"
                "<p>Shared paragraph.</p></article></body>")
    for n in (1, 2, 4, 5, 7):
        assert extracted(spark, map(source, range(n))) == [f"News By A. Writer Story {i} Shared paragraph." for i in range(n)]


def test_constant_texts_go_only_at_their_place(spark):
    """A heading like the site's name stays, the site's name goes, at 4 pages as at 5."""
    def source(i):
        title = "The Site" if i == 0 else f"Title {i}"
        return f"<body><div class=box><h5>The Site</h5><h2>{title}</h2><p>Story {i} goes on.</p><h5>The end</h5></div></body>"
    for n in (4, 5, 7):
        assert extracted(spark, map(source, range(n))) == ["The Site Story 0 goes on."] + [f"Title {i} Story {i} goes on." for i in range(1, n)]
    assert extracted(spark, [source(1)] * 3) == ["The Site Title 1 Story 1 goes on. The end"] * 3


def test_titles_above_and_sections_beside_the_longest_container(spark):
    def source(i):
        return (f"<body><div class=top><a href=h>Home</a></div><div class=post><h1>Title {i}</h1><p>Lead {i}.</p><div class=entry><p>{f'Body {i} text. ' * 20}</p></div>"
                f"<section id=history><p>History {i}.</p><p><a href=x>A linked paragraph {i}</a></p></section><section id=sources><a href=y>Source {i}</a></section></div>"
                f"<div class=more><a href=1>Next {i}</a></div><footer>f</footer></body>")
    for n in (1, 3, 6):
        assert extracted(spark, map(source, range(n))) == [
            f"Title {i} Lead {i}. {' '.join([f'Body {i} text.'] * 20)} History {i}. A linked paragraph {i} Source {i}" for i in range(n)]


def test_pages_without_any_container(spark):
    def source(i):
        return f"<body><h1>Title {i}</h1><p>Text {i}.</p><p><a href=x>Linked {i}</a></p><div class=entry><p>More {i}.</p></div><div class=more><a href=1>Next {i}</a></div></body>"
    assert extracted(spark, map(source, range(3))) == [f"Title {i} Text {i}. Linked {i} More {i}." for i in range(3)]
