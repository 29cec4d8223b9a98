import random
import time
from collections import Counter

import pytest

from lintlake.llm import html_text
from lintlake.llm.html_text import extract, main_text, regions

PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>One</a></li></ul></nav><!-- x --><div class=\"ad\">Buy now this.</div>"
     "<article><h1>Head</h1><p><b>First.<br><p>Se&amp;cond  &eacute; &#x41;\n x</p><p>To.</p></article><footer>&copy; foot</footer>", "Head\nFirst.\nSe&cond é A x\nTo."),
    ("<body><header><h1>Site</h1></header><div id='cookie-notice'><p>We use cookies and more of them here.</p></div><div class=content><h1>Title</h1><p>First with <a href=x>a link</a> in it, and long enough.<p>Second."
     "<ul><li>one<li>two</ul><form><p>Sign up</p></form><p>Third.</div><div class='comments'><p>A reader says something that is quite long, longer than all of it.</p></div><aside><p>side</p></aside><footer>foot</footer>",
     "Title\nFirst with a link in it, and long enough.\nSecond.\none\ntwo\nThird."),
    ("plain text only", "plain text only"),
    ("<p>open <b>bold <p>next &unknown; &lt;tag&gt;", "open bold\nnext &unknown; <tag>"),
    ("<article><header><h1>Own title</h1></header><p>Body.</p></article><p>Outside text that is longer than the article itself is.</p>", None),
    ("<p title='a > b'>quoted</p>", "quoted"),
    ("<SCRIPT>x</SCRIPT><P>Upper</P>", "Upper"),
    ("<script>never ends", ""), ("<!-- never ends", ""), ("", ""), ("   ", ""), ("<div></div>", ""), ("a < b and c", "a < b and c"),
]


def test_pages():
    for html, text in PAGES:
        if text is not None:
            assert main_text(html) == text, html
    assert "Outside" not in main_text(PAGES[4][0]) and main_text(PAGES[4][0]).endswith("Body.")
    assert main_text(None) == ""


def test_many_regions_and_long_pages():
    menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(40))
    body = "".join(f"<p>Paragraph {i} with a good deal of text in it, more than a menu.</p>" for i in range(3000))
    page = f"<body><ul class=menu>{menu}</ul><div>{body}</div><div class=related><p>Read this too, it is long enough to look like text.</p></div>"
    assert main_text(page).split("\n") == [f"Paragraph {i} with a good deal of text in it, more than a menu." for i in range(3000)]


def test_nothing_of_an_article_is_dropped_for_its_length():
    long = "".join(f"<p>Paragraph {i} with a good deal of text in it.</p>" for i in range(9))
    lines = [f"Paragraph {i} with a good deal of text in it." for i in range(9)]
    assert main_text(f"<p>Out</p><main><h1>Title</h1><article>{long}</article><p>closing note</p></main><p>Out</p>").split("\n") == ["Title", *lines, "closing note"]
    gone = "<aside>a</aside><form><p>b</p></form><div class=ad>c</div>"
    assert main_text(f"<article>{long}{gone}<p>The end.</p></article>").split("\n") == [*lines, "The end."]
    assert main_text(f"<article>{long}</article><p>Out</p><article><p>Two.</p></article>").split("\n") == [*lines, "Two."]
    assert main_text("<p>Out<article><p>One.</p><p>Two.</p></article><p>Out</p>") == "One.\nTwo."
    # an article without text tells nothing
    assert main_text(f"<article></article><div>{long}</div>").split("\n") == lines


def test_a_class_does_not_lose_the_article():
    text = "".join(f"<p>Paragraph {i} with a good deal of text in it.</p>" for i in range(5))
    want = [f"Paragraph {i} with a good deal of text in it." for i in range(5)]
    for wrapper in ("div class='content has-sidebar'", "div class='layout-sidebar-right'", "div class='post has-comments'", "section class='tag-news'", "div class=search", "div id=top"):
        name = wrapper.split()[0]
        page = f"<nav>n</nav><{wrapper}><article>{text}</article><div class='sidebar'>side</div></{name}><div class='related'><article>Teaser</article></div>"
        assert main_text(page).split("\n") == want, wrapper
        assert main_text(f"<{wrapper}>{text}</{name}><footer>f</footer>").split("\n") == want, wrapper
    # wrappers in wrappers, and one that never ends
    assert main_text("<div class=alert>" * 300 + f"<main>{text}</main>").split("\n") == want
    # what is about as long as the text, or longer than a page's article, is still left out
    for gone in ("comments", "post-comments", "cookie-notice", "sidebar-right", "ad ad-300x250", "footer_widgets"):
        assert main_text(f"<div>{text}</div><div class='{gone}'>{text}</div>").split("\n") == want, gone
        assert main_text(f"<article>{text}</article><div class='{gone}'>{text * 9}</div>").split("\n") == want, gone
    assert main_text(f"<div>{text}</div><div class='related'><article>Teaser</article></div>").split("\n") == want


def test_a_class_does_not_lose_words_of_a_sentence():
    assert main_text("<p>Read <span class='alert'>this part</span> and <b class='notice'>that</b>.</p>") == "Read this part and that."
    assert main_text("<div><b class='notice'>Note:</b> some <span class=tag>words</span> here.</div>") == "Note: some words here."


def test_table(spark):
    rows = [(1, "u", PAGES[0][0], "t", 3), (1, "u", PAGES[0][0], "t", 3), (None, None, None, None, None), (2, "v", "", "t", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    out = extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter((r.page_id, r.text, r.n_chars) for r in out.collect()) == Counter({(1, PAGES[0][1], len(PAGES[0][1])): 2, (None, "", 0): 1, (2, "", 0): 1})
    assert extract(df.limit(0)).collect() == []


def plain_regions(lengths, texts):
    """Every stretch that begins and ends with text, has no three lines without text in a row, and cannot be made longer."""
    n, out = len(texts), []
    for a in range(n):
        for b in range(a, n):
            part = texts[a : b + 1]
            if part[0] and part[-1] and not any(not any(part[k : k + 3]) for k in range(len(part) - 2)):
                if not any(texts[max(0, a - 3) : a]) and not any(texts[b + 1 : b + 4]):
                    sums = [sum(lengths[k : min(k + 3, b + 1)]) for k in range(a, b + 1)]
                    out.append((a, b, sum(lengths[a : b + 1]), max(sums)))
    return out


def test_windows_against_plain_ones():
    rng = random.Random(2)
    for _ in range(300):
        lengths = [rng.choice((0, 0, 0, 0, 1, 5, 40)) for _ in range(rng.randrange(0, 30))]
        texts = [x > 0 or rng.random() < 0.1 for x in lengths]
        assert regions(lengths, texts) == plain_regions(lengths, texts)


def test_windows_decide_on_every_page(monkeypatch):
    page = "<article><h1>Head</h1><p>Some text of it.</p></article><p>Out</p>"
    assert main_text(page) == "Head\nSome text of it."
    monkeypatch.setattr(html_text, "regions", lambda *_: [])
    assert main_text(page) == ""


def test_comments_and_teasers_of_an_article():
    body = "<p>A comment on the text, with words.</p><p>More of it.</p>"
    want = ["A comment on the text, with words.", "More of it."]
    for name in ("user-comments-list", "post-comment-thread", "comments", "reply-box", "reader-comment", "disqus_thread"):
        assert main_text(f"<article>{body}<section class='{name}'><p>I think so too, and say it at length.</p></section></article>").split("\n") == want, name
    for name in ("has-comments", "comment-free-zone-essay", "commentary"):
        assert main_text(f"<article><section class='{name}'>{body}</section></article>").split("\n") == want, name
    river = "".join(f"<article><h3><a href=/{i}>Teaser {i}</a></h3></article>" for i in range(20))
    assert main_text(f"<div>{river}</div><main>{body}</main>").split("\n") == want


@pytest.mark.parametrize("page", ["<a " * 300_000, "</b>" * 200_000, "<div>" * 50_000 + "</i>" * 50_000, "<a x='" * 150_000, "<p><b>" * 30_000 + "x"], ids=range(5))
def test_hard_pages_take_linear_time(page):
    began = time.monotonic()
    main_text(page)
    assert time.monotonic() - began < 20


def test_markup_deep_in_a_paragraph():
    deep = "<i>" * 30
    assert main_text(f"<p>one {deep}two<div>three</div>") == "one two\nthree"
