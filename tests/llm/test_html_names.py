"""What names of elements say about the article."""

from __future__ import annotations

import pytest

from arcloom.llm.htmltext import Page, outside_name


def text(inner):
    return Page(f"<html><body><article><p>Before.</p>{inner}<p>After.</p></article></body></html>").text(set(), set())


@pytest.mark.parametrize("tag", ['div class="notice-period"', 'p class="share-price"', 'section id="related-work"', 'div class="post no-sidebar"', 'section id="discussion"', 'div class="search-algorithms"', "div"])
def test_article_stays(tag):
    assert text(f"<{tag}>Notice is 30 days.</{tag.split()[0]}>") == "Before. Notice is 30 days. After."


@pytest.mark.parametrize("tag", ['ol class="commentlist"', 'div class="discussion"', 'div class="ad"', 'div class="ad-300x250"', 'div class="share-buttons"', 'section id="related-posts"', 'div class="entry COOKIE_BANNER"', 'div id="post-comments"', 'div class="comment-thread-item"'])
def test_others_go(tag):
    assert text(f"<{tag}><div>Not the article.</div></{tag.split()[0]}>") == "Before. After."


def test_names_without_words():
    assert not outside_name("", "") and not outside_name("- __", "-")
