"""Boilerplate whose names are in no list, and articles whose names look like boilerplate."""

from __future__ import annotations

import pytest

from gantry.llm.html_text import main_text

TEXT = "".join(f"<p>{'The article text goes on with many words and no links at all. ' * n}</p>" for n in (4, 5, 3))
PLAIN = "\n".join(("The article text goes on with many words and no links at all. " * n).strip() for n in (4, 5, 3))
NOISE = "<p>NOISE a reader wrote quite a lot here, more than one sentence. And more words follow.</p>"


@pytest.mark.parametrize("around", ["<main>{}</main>", "<article>{}</article>", '<div class="content">{}</div>'])
@pytest.mark.parametrize("noise", ['div class="user-comments"', 'section id="reader-comments"', 'div class="comment-box"', 'div class="sidebar-left"', 'div class="site-notice"', 'div id="left_sidebar"', 'div class="x promo-2024"'])
def test_compound_names_beside_the_text(around, noise):
    block = f"<{noise}>{NOISE}</{noise.split()[0]}>"
    assert main_text(f"<body>{around.format(TEXT)}{block}</body>") == PLAIN
    assert main_text(f"<body>{block}{around.format(TEXT)}</body>") == PLAIN


def test_comments_inside_an_article_go():
    assert main_text(f'<body><article>{TEXT}<div class="user-comments">{NOISE}</div></article></body>') == PLAIN


def test_what_stands_beside_an_article_goes():
    assert main_text(f"<body><article>{TEXT}</article><div>{NOISE}</div></body>") == PLAIN
    both = main_text(f"<body><article>{TEXT}</article><article>{TEXT}</article></body>")
    assert both == f"{PLAIN}\n{PLAIN}"
    assert main_text(f"<body><h1>The title</h1><main>{TEXT}</main></body>") == f"The title\n{PLAIN}"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout has-sidebar"><article>{}</article></div>', '<div id="content-no-comments">{}</div>', '<div class="post social-sharing-on">{}</div>', '<div class="search-results-2">{}</div>',
        '<form id="page">{}</form>', '<article class="post promo">{}</article>', '<div class="badge commentary adsorption">{}</div>',
    ],
)
def test_articles_with_such_names_stay(page):
    assert main_text(f"<body>{page.format(TEXT)}</body>") == PLAIN


def test_an_article_header_stays():
    page = f'<body><div><div class="article-header"><h1>Title</h1><p>The lead of the article is here and says much.</p></div>{TEXT}</div></body>'
    assert main_text(page) == f"Title\nThe lead of the article is here and says much.\n{PLAIN}"
