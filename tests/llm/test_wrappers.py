import pytest

from molspan.llm import html_text

P = "<p>" + "A sentence of the article that goes on for a while. " * 4 + "</p>"


@pytest.mark.parametrize("name", ["content with-sidebar", "site-content no-sidebar", "entry comments-open", "layout-form", "page sidebar"])
@pytest.mark.parametrize("inner", [f"<article>{P}</article>", f"<div>{P}</div>"])
def test_wrappers_keep_the_article(name, inner):
    page = f'<body><div class="{name}">{inner}</div><div class="site-footer">About us</div></body>'
    assert html_text.main_text(page) == P[3:-4].strip()


def test_a_page_in_one_form_stays_and_named_boxes_go():
    page = f'<form><div class="ad">Buy now</div><div>{P}</div><div class="main-nav">Menu</div><form-x></form-x></form>'
    assert html_text.main_text(page) == P[3:-4].strip()
    page = f'<article>{P}</article><div class="related"><article>Another one</article></div>'
    assert html_text.main_text(page) == P[3:-4].strip()
