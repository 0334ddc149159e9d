import time

import pytest

from metaloom.llm import html_text

P = "A long paragraph of the article, with commas, stops and words enough to count."


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ("<b>Hello</b> <i>world</i>, and <a>more</a>\n<a>links</a>.", "Hello world, and more links."),
        ("one<b> </b>two <span> </span> three", "one two three"),
        ("See <img src=x> the <wbr>picture<img src='y'/>here and <input> there", "See the picturehere and there"),
        ("a<br>b<br/>c</br>d<hr>e", "a\nb\nc\nd\ne"),
        ("x </div>y </b>z</p>w", "x y z\nw"),
        ("left<script src='a.js'/>var leak = 1;</script>right <style/>p{}</style>end", "leftright end"),
        ("v <svg viewBox='0'/>w <math><mi>x</mi><mspace/><mi>y</mi></math>", "v w xy"),
        ("<span/>open <em/>stays", "open stays"),
    ],
)
def test_inline_elements(inner, text):
    got = html_text.main_text(f"<html><body><nav>Menu</nav><article><h1>Head</h1><p>{P}</p><p>{inner}</p><p>{P}</p></article></body></html>")
    assert got == "\n".join(["Head", P, text, P])


@pytest.mark.parametrize("name", ["related", "notice", "widget", "recommended"])
def test_a_weak_name_is_a_side_part_where_most_content_is_elsewhere(name):
    body = f"<h1>Head</h1><div class=text><p>{P}</p><p>{P}</p></div><div class='{name}'><p>{P}</p></div>"
    assert html_text.main_text(f"<html><body>{body}</body></html>") == "\n".join(["Head", P, P])
    alone = f"<div><a>Home</a></div><div class='{name}'><p>{P}</p><p>{P}</p></div>"
    assert html_text.main_text(f"<html><body>{alone}</body></html>") == "\n".join([P, P])


def test_many_regions_take_linear_time():
    page = f"<html><body>{f'<article><p>{P}</p></article>' * 20_000}</body></html>"
    start = time.process_time()
    assert html_text.main_text(page).count("\n") == 19_999
    assert time.process_time() - start < 4
