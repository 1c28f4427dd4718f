"""Fragments that belong to an article, markup that is not closed, and the cost of deep nesting."""

import time

import pytest

from matchlake.llm import extraction

AROUND = "This paragraph stands in the middle of the article and is long enough to be read as its text."


def page(inner):
    return f"<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{AROUND}</p>{inner}<p>{AROUND}</p></article><footer>(c) us</footer></body></html>"


@pytest.mark.parametrize("inner,wanted", [
    ('<p title="a hidden gem">A word in a value hides nothing at all.</p>', "A word in a value hides nothing at all."),
    ('<p data-x="display: none">Only a style can hide.</p>', "Only a style can hide."),
    ('<section id="related-work"><p>Others wrote about it before us.</p></section>', "Others wrote about it before us."),
    ("<header><p>A standfirst says what follows.</p></header>", "A standfirst says what follows."),
    ("<ul><li><a href=/x>The full report</a></li></ul>", "The full report"),
    ("<object data=x><p>What is shown without the plugin.</p></object>", "What is shown without the plugin."),
    ("<p>Let <math><mi>x</mi></math> be one.</p>", "Let x be one."),
    ("<p>Before <svg><path d=1> the mark.</p>", "Before the mark."),
    ("<p>Here <svg><title>icon</title></svg>it goes on.</p>", "Here it goes on."),
])
def test_parts_of_an_article_stay(inner, wanted):
    assert extraction.main_text(page(inner)).split("\n\n") == ["Title", AROUND, wanted, AROUND]


@pytest.mark.parametrize("inner", ['<p hidden>gone</p>', '<div style="display : none"><p>gone</p></div>', '<p aria-hidden="true">gone</p>', '<div class="related-posts"><a href=/1>Other</a></div>', '<div class="share"><a href=/s>Tweet</a></div>', "<script>var a = '<p>gone</p>'</script>"])
def test_what_is_no_article_goes(inner):
    assert extraction.main_text(page(inner)).split("\n\n") == ["Title", AROUND, AROUND]


@pytest.mark.parametrize("unit", ["<font>x", "<div>", "<p><table><div>", "<b></i>", "<li><ul>", "<svg>", "</p>"])
def test_a_megabyte_of_nested_tags_takes_little_time(unit):
    began = time.time()
    found = extraction.blocks(unit * (1_000_000 // len(unit)))
    assert time.time() - began < 20 and isinstance(found, list)
