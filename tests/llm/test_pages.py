"""Awkward pages: markup that never closes, and elements nested very deep."""

import time

from wiretally.llm import html


def texts(page):
    return [b[0] for b in html.blocks(page)]


def test_markup_that_is_not_closed_is_no_text():
    assert texts('<p class="x>Hello world</p>tail') == ["Hello world", "tail"]
    assert texts("<p>one</p><!doctype") == ["one"]
    assert texts("<p>one</p><?php foo") == ["one"]
    assert texts("<p>one<div class='a") == ["one"]
    assert texts("<x " * 1000 + '"') == []


def test_a_quoted_angle_bracket_stays_in_its_tag():
    assert texts('<p title="a > b">one</p>') == ["one"]


def test_deep_pages_take_time_in_proportion():
    depth, start = 100_000, time.process_time()
    got = html.blocks("<div class='content'>" * depth + "deep" + "</div>" * depth)
    assert got == [("deep", ("div",), ("content",), 0.0)]
    assert time.process_time() - start < 5


def test_closing_rules_hold_by_depth():
    page = "<ul><li>a<ul><li>b<li>c</ul><li>d</ul><p>x <a href=u>y</a><table><tr><td>q<td><p>r</table><p>z"
    assert [(t, tags) for t, tags, _, _ in html.blocks(page)] == [
        ("a", ("li",)), ("b", ("li",)), ("c", ("li",)), ("d", ("li",)), ("x y", ("p",)), ("q", ("table", "td")), ("r", ("table", "td", "p")), ("z", ("p",))]


def test_names_end_with_their_element():
    assert [(t, n) for t, _, n, _ in html.blocks('<div class="nav menu"><p class=nav>a</p>b</div>c')] == [("a", ("menu", "nav")), ("b", ("menu", "nav")), ("c", ())]
