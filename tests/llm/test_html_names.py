"""Names of elements don't decide about articles, and tags end where they end, however long they are."""

import time

import pytest

from gaugeworks.llm.html_extract import main_text

PROSE = "<p>The council met on Tuesday to discuss the bridge, and no one spoke against it. It will be built in May, they said. Costs are not known yet.</p>"
HEAD, FOOT = '<html><body><nav><a href="/">Home</a> <a href="/n">News</a></nav>', '<div class="comments"><p>I like it, very much.</p></div><footer>All rights reserved.</footer></body></html>'


@pytest.mark.parametrize("name", ["layout-with-sidebar", "no-sidebar", "privacy-law", "content warning", "page-header-fixed", "post share", "content has-sidebar"])
@pytest.mark.parametrize("shape", ['<div class="{}">{}</div>', '<article><div class="{}">{}</div></article>', '<main class="{}"><h2>About the bridge</h2>{}</main>', '<div id="banner-page"><div class="{}">{}</div></div>', '<section role="{}"><div>{}</div></section>'])
def test_the_page_s_prose_is_kept_whatever_it_is_called(name, shape):
    text = main_text(HEAD + shape.format(name, PROSE * 3) + FOOT)
    assert text.count("The council met") == 3 and "I like it" not in text and "rights" not in text and "News" not in text


@pytest.mark.parametrize("name", ["sidebar", "comments", "newsletter", "ad", "related"])
def test_named_parts_beside_an_article_go(name):
    text = main_text(f'{HEAD}<div class="story">{PROSE * 3}</div><div class="{name}"><p>Read this too, it says. There is more of it here.</p></div></body></html>')
    assert text.count("The council met") == 3 and "Read this" not in text


def test_siblings_of_one_name_are_one_part():
    text = main_text("<body>" + f'<div class="post share">{PROSE}</div>' * 3 + '<div class="sidebar"><p>Read also this, please.</p></div></body>')
    assert text.count("The council met") == 3 and "Read also" not in text


@pytest.mark.parametrize("n", [10, 8_000, 8_300, 400_000])
@pytest.mark.parametrize("quote", ['"', "'"])
def test_long_values_don_t_leak(n, quote):
    assert main_text(f"<body><div data-x={quote}{'a' * n} > leaked, all of it.{quote}>{PROSE}</div></body>") == main_text(f"<body>{PROSE}</body>")
    parts = " ".join(f'x{k}="{k} > leaked."' for k in range(n // 40 + 300))
    assert "leaked" not in main_text(f"<body><div {parts}>{PROSE}</div></body>")


def test_broken_quotes_are_read_on_in_linear_time():
    assert main_text(f'<body><div class="x>{PROSE}</div></body>') == main_text(f"<body>{PROSE}</body>")
    began = time.time()
    for page in ('<a b="c' * 200_000 + ">", "<a b=c" * 200_000, "<a b='" * 300_000 + ">", '<a b="c>d">x</a>' * 100_000, "<a b=" + " " * 300_000 + "=" * 300_000):
        main_text(page)
    assert time.time() - began < 60
